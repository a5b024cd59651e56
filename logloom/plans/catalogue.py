"""Named queries over the test tables, each with the SQL that a second engine checks it by."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import parse, timeutil
from logloom.functions.match import matches
from logloom.functions.tokens import tokens
from logloom.operators import aggregates, lifecycle
from logloom.operators.filters import at_or_above, filtered, log_columns
from logloom.plans.service import LogEngine, Storage, StoreEngine
from logloom.schema import ERROR_SEVERITIES, LOG_COLS
from logloom.sources.events import LOGS_SQL, logs_view
from logloom.sources.folders import shared_folder
from logloom.streaming.store import LogStore

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AT = "2024-01-27T08:00:00Z"
COLS = ", ".join(f'"{c}"' for c in LOG_COLS)
ERRORS = "severity IN ('" + "', '".join(ERROR_SEVERITIES) + "')"
NEWEST = "ORDER BY ts DESC, id DESC"


def query(sql: str | None = None, logs: bool = True):
    """Registers a query under its function's name; sql may read logs, the view of the events."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH logs AS ({LOGS_SQL}) {sql}" if logs else sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str, tokenized: bool = False) -> LogEngine:
    return LogEngine(logs_view(spark, sf_dir, tokenized))


@query(f"SELECT {COLS} FROM logs")
def scan_project(spark, sf_dir):
    return log_columns(logs_view(spark, sf_dir))


def _search(name: str, where: str, rows: int = 100, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, "query" in params).search(**params)

    QUERIES[name] = run
    ORACLE[name] = f"WITH logs AS ({LOGS_SQL}) SELECT {COLS} FROM logs WHERE {where} {NEWEST} LIMIT {rows}"


_search("search_host", "hostname = 'host-3'", hostname="host-3")
_search("search_source_ip", "source_ip = '10.0.1.13:514'", source_ip="10.0.1.13:514")
_search("search_severity", "severity = 'crit'", severity="crit")
_search("search_app", "app_name = 'purchase'", app_name="purchase")
_search("search_range", "ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'", **{"from": "2024-01-10T00:00:00Z", "to": "2024-01-20T13:00:00+01:00"})
_search("search_all_filters", "hostname = 'host-3' AND source_ip LIKE '10.0.3.%' AND source_ip = '10.0.3.43:514' AND severity = 'err' AND app_name = 'error' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-29'", 1000, hostname="host-3", source_ip="10.0.3.43:514", severity="err", app_name="error", limit=1000, **{"from": "2024-01-02T00:00:00Z", "to": "2024-01-29T00:00:00Z"})
_search("search_top100", "true")
_search("search_cap1000", "true", 1000, limit=5000)
_search("search_unknown_severity", "severity = 'warn'", severity="warn")


@query(f"SELECT {COLS} FROM logs WHERE severity IN ('emerg', 'alert') {NEWEST} LIMIT 100")
def search_severity_in(spark, sf_dir):
    from logloom.operators.filters import newest

    return log_columns(newest(filtered(logs_view(spark, sf_dir), severity_in=["emerg", "alert"]), 100))


@query(f"SELECT {COLS} FROM logs WHERE {ERRORS}")
def severity_threshold(spark, sf_dir):
    return log_columns(filtered(logs_view(spark, sf_dir), severity_in=at_or_above("warning")))


@query(f"SELECT {COLS} FROM logs {NEWEST} LIMIT 50")
def tail_default(spark, sf_dir):
    return engine(spark, sf_dir).tail()


@query(f"SELECT {COLS} FROM logs WHERE hostname = 'host-7' AND app_name = 'view' {NEWEST} LIMIT 20")
def tail_host_app(spark, sf_dir):
    return engine(spark, sf_dir).tail(hostname="host-7", app_name="view", n=20)


@query(f"SELECT {COLS} FROM logs {NEWEST} LIMIT 500")
def tail_cap500(spark, sf_dir):
    return engine(spark, sf_dir).tail(n=100_000)


@query(f"SELECT hostname, severity, count(*) AS count FROM logs WHERE {ERRORS} GROUP BY ALL")
def errors_all(spark, sf_dir):
    return engine(spark, sf_dir).errors()


@query(f"SELECT hostname, severity, count(*) AS count FROM logs WHERE {ERRORS} AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' GROUP BY ALL")
def errors_range(spark, sf_dir):
    return engine(spark, sf_dir).errors(**{"from": "2024-01-05T00:00:00Z", "to": "2024-01-06T00:00:00Z"})


@query("SELECT hostname, min(received_at) AS first_seen, max(received_at) AS last_seen, count(*) AS log_count FROM logs GROUP BY hostname")
def hosts_live(spark, sf_dir):
    return engine(spark, sf_dir).hosts(live=True)


AROUND = f"SELECT * FROM logs WHERE {ERRORS} AND ts BETWEEN TIMESTAMP '2024-01-27 07:00:00' AND TIMESTAMP '2024-01-27 09:00:00' {NEWEST}"


def _around(spark, sf_dir, at=AT, limit=10):
    return engine(spark, sf_dir).correlate(reference_time=at, window_minutes=60, limit=limit)


@query(f"SELECT {COLS} FROM ({AROUND} LIMIT 10)")
def correlate_events(spark, sf_dir):
    return _around(spark, sf_dir).events


@query(f"SELECT hostname, count(*) AS event_count, string_agg(CAST(id AS VARCHAR), ',' {NEWEST}) AS event_ids FROM ({AROUND} LIMIT 500) GROUP BY hostname")
def correlate_by_host(spark, sf_dir, at=AT):
    hosts = _around(spark, sf_dir, at, 500).hosts
    return hosts.select("hostname", "event_count", F.array_join(F.transform("events", lambda e: e.id.cast("string")), ",").alias("event_ids"))


@query(f"SELECT (SELECT count(*) FROM ({AROUND} LIMIT 11)) > 10 AS truncated, count(*) AS total_events, count(DISTINCT hostname) AS total_hosts FROM ({AROUND} LIMIT 10)")
def correlate_summary(spark, sf_dir):
    return _around(spark, sf_dir).summary


@query("SELECT count(*) AS total_logs, count(DISTINCT hostname) AS total_hosts, min(\"timestamp\") AS oldest_log, max(\"timestamp\") AS newest_log, CAST(0 AS BIGINT) AS phantom_fts_rows FROM logs")
def stats_counts(spark, sf_dir):
    return engine(spark, sf_dir).stats()


@query("""SELECT count(*) AS total_logs, (SELECT count(DISTINCT hostname) FROM logs) AS total_hosts, min("timestamp") AS oldest_log, max("timestamp") AS newest_log, CAST(0 AS BIGINT) AS phantom_fts_rows,
    printf('%.2f', 5.0 * count(*) / 4) AS logical_db_size_mb, '1.50' AS physical_db_size_mb, NULL::VARCHAR AS free_disk_mb, CAST(1024 AS BIGINT) AS max_db_size_mb, CAST(0 AS BIGINT) AS min_free_disk_mb, 5.0 * count(*) / 4 > 1024 AS write_blocked
    FROM logs WHERE received_at >= TIMESTAMP '2024-01-30'""")
def stats_after_purge(spark, sf_dir):
    """A purge leaves the registry; sizes are made up from the row count."""
    logs = logs_view(spark, sf_dir)
    left = lifecycle.retained(logs, F.lit("2024-01-30").cast("timestamp_ntz"))
    storage = Storage(left.count() * 5 * (1 << 18), 3 << 19, None, lifecycle.Budget(min_free_mb=0, recovery_free_mb=0))
    return LogEngine(left, aggregates.live_hosts(logs), storage).stats()


@query("""SELECT e.id, e.hostname, s.state FROM logs e LEFT JOIN (SELECT hostname, event_type AS state FROM (
    SELECT hostname, event_type, row_number() OVER (PARTITION BY hostname ORDER BY ts DESC, event_type DESC) AS n FROM logs WHERE event_type IN ('signup', 'view', 'purchase')) WHERE n = 1) s ON e.hostname = s.hostname""")
def container_states(spark, sf_dir):
    """Every row with the latest lifecycle state of its container; events of three kinds stand for lifecycle events."""
    logs = logs_view(spark, sf_dir).select("id", F.col("hostname").alias("host_name"), F.md5("hostname").alias("container_id"), F.col("event_type"), F.col("ts").alias("at"))
    states = aggregates.latest_states(logs.where("event_type IN ('signup', 'view', 'purchase')").withColumnRenamed("event_type", "state"))
    return aggregates.with_state(logs.select("id", "host_name", "container_id"), states).select("id", F.col("host_name").alias("hostname"), "state")


def _fts(name: str, expression: str, *event_types: str) -> None:
    """A search over the controlled vocabulary of the messages: which event types match is known."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = filtered(logs_view(spark, sf_dir, True), query=expression)
        return found.groupBy("hostname").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))

    types = ", ".join(f"'{t}'" for t in event_types) or "''"
    QUERIES[name] = run
    ORACLE[name] = f"WITH logs AS ({LOGS_SQL}) SELECT hostname, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM logs WHERE event_type IN ({types}) GROUP BY hostname"


_fts("fts_term", "connecting", "error", "click")
_fts("fts_and", "user AND services", "purchase")
_fts("fts_or", "kernel OR restarting", "view", "purchase")
_fts("fts_not", "connect NOT disk", "error")
_fts("fts_phrase", '"connection refused"', "error")
_fts("fts_stemmed_phrase", '"connect refusing"', "error")
_fts("fts_prefix", "restart*", "purchase")
_fts("fts_accent", "cafe", "signup")
_fts("fts_group", "(kernel OR disk) AND panic", "view")
_fts("fts_near", "NEAR(refused connection, 0)", "error", "click")
_fts("fts_first", "^kernel", "view")
_fts("fts_column", "message : root", "view")
_fts("fts_none", 'user AND "root fs"')


@query(f"SELECT {COLS} FROM logs WHERE event_type IN ('error', 'click') AND hostname = 'host-5' AND severity = 'err' {NEWEST} LIMIT 100")
def fts_filtered(spark, sf_dir):
    return engine(spark, sf_dir, True).search(query="connection", hostname="host-5", severity="err")


def _word(stems: str) -> str:
    """SQL for: the text has a word of one of the forms."""
    edge = "[^\\p{L}\\p{N}\\p{Co}]"
    return f"regexp_matches(lower(text), '(^|{edge})({stems})($|{edge})')"


@query(f"SELECT lang, count(*) AS n FROM documents WHERE {_word('licens(e|es|ed|ing)')} OR ({_word('token(s|ed|ing)?')} AND NOT {_word('password(s|ed|ing)?')}) GROUP BY lang", logs=False)
def documents_fts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("tokens", tokens(F.col("text")))
    return docs.where(matches(F.col("tokens"), "license OR (token NOT password)")).groupBy("lang").agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs with PRI and an aware receipt time; parsing renders times in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    pri = (F.lit(16) + F.col("id") % 8) * 8 + parse.severity_to_num(F.col("severity"))
    return logs_view(spark, sf_dir).withColumns({"pri": pri, "received": F.col("received_at").cast("timestamp"), "app": F.coalesce("app_name", F.lit("-"))})


_PARSED = ("timestamp", "hostname", "facility", "severity", "app_name", "process_id", "message")


def _parsed(lines: DataFrame, raw) -> DataFrame:
    fields = parse.parse_syslog(F.col("raw"), F.col("source_ip"), F.col("received"))
    return lines.withColumn("raw", raw).select("id", fields.alias("p")).select("id", *(f"p.{c}" for c in _PARSED))


@query(f"SELECT id, {', '.join(chr(34) + c + chr(34) for c in _PARSED)} FROM logs")
def parse_rfc5424(spark, sf_dir):
    raw = F.format_string("<%d>1 %s %s %s %s - - %s", "pri", "timestamp", "hostname", "app", "process_id", "message")
    return _parsed(_lines(spark, sf_dir), raw)


@query("SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000000+00:00') AS \"timestamp\", hostname, facility, severity, coalesce(app_name, 'app') AS app_name, process_id, message FROM logs")
def parse_rfc3164(spark, sf_dir):
    when = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss"))
    raw = F.format_string("<%d>%s %s %s[%s]: %s", F.col("pri"), when, F.col("hostname"), F.coalesce("app_name", F.lit("app")), F.col("process_id"), F.col("message"))
    return _parsed(_lines(spark, sf_dir), raw)


@query("SELECT id, concat('The ', hostname) AS hostname, facility, severity, concat('name ', event_type) AS app_name, NULL::VARCHAR AS process_id, message FROM logs")
def parse_cef(spark, sf_dir):
    ext = F.concat(F.lit("src=10.0.0.1 UNIFIdeviceName=The "), F.col("hostname"), F.lit(" name=x msg="), F.col("message"))
    raw = F.concat(F.lit("<"), F.col("pri").cast("string"), F.lit(">Jan  5 10:00:00 2024-01-05T10:00:00.000Z CEF:0|Vendor|Box OS|9.1|100|name "), F.col("event_type"), F.lit("|3|"), ext)
    return _parsed(_lines(spark, sf_dir), raw).drop("timestamp")


def _container_lines(spark, sf_dir):
    logs = _lines(spark, sf_dir)
    stream = F.when(F.col("id") % 3 == 0, "stdout").when(F.col("id") % 3 == 1, "stderr").otherwise("console")
    stamp = F.regexp_replace("timestamp", r"\+00:00$", "789Z")
    return logs.withColumns({"container_id": F.md5("hostname"), "stream": stream, "line": F.concat(stamp, F.lit(" "), F.col("message"), F.lit("\r\n")), "name": F.lit("web"), "service": F.when(F.col("id") % 2 == 0, "front"), "project": F.when(F.col("id") % 4 == 0, "shop")})


@query("""SELECT id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '789Z') AS "timestamp", hostname, 'local0' AS facility, CASE id % 3 WHEN 0 THEN 'info' ELSE 'warning' END AS severity,
    CASE WHEN id % 4 = 0 THEN 'shop/front/web' WHEN id % 2 = 0 THEN 'front/web' ELSE 'web' END AS app_name, left(md5(hostname), 12) AS process_id, message,
    concat('docker://', hostname, '/', md5(hostname), '/', CASE id % 3 WHEN 0 THEN 'stdout' ELSE 'stderr' END) AS source_ip FROM logs WHERE id % 3 < 2""")
def docker_normalize(spark, sf_dir):
    rows = _container_lines(spark, sf_dir)
    fields = parse.parse_container_line(*(F.col(c) for c in ("hostname", "container_id", "name", "project", "service", "stream", "line", "received")))
    return rows.select("id", fields.alias("p")).where("p IS NOT NULL").select("id", *(f"p.{c}" for c in _PARSED), "p.source_ip")


@query("SELECT id, hostname FROM logs WHERE CAST(substr(hostname, 6) AS INT) >= 10 OR ts > TIMESTAMP '2024-01-15 00:00:00'")
def docker_after_checkpoint(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = logs_view(spark, sf_dir).select("id", F.col("hostname").alias("host_name"), F.md5("hostname").alias("container_id"), timeutil.nanos(F.col("timestamp")).alias("entry_nanos"))
    cut = F.lit(int(datetime(2024, 1, 15, tzinfo=UTC).timestamp()) * 1_000_000_000)
    seen = rows.where("CAST(substr(host_name, 6) AS INT) < 10").select("host_name", "container_id").distinct().withColumn("checkpoint_nanos", cut)
    return aggregates.after_checkpoint(rows, seen).select("id", F.col("host_name").alias("hostname"))


@query("SELECT hostname, max_by(\"timestamp\", id) AS \"timestamp\" FROM logs GROUP BY hostname")
def checkpoint_latest(spark, sf_dir):
    return aggregates.latest_checkpoints(logs_view(spark, sf_dir), "hostname", value="timestamp", order="id")


@query("""SELECT hostname, CASE WHEN count(*) FILTER (id % 3 = 0) > 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS first_seen,
    CASE WHEN count(*) FILTER (id % 3 > 0) > 0 THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-02-01' END AS last_seen, count(*) AS log_count FROM logs GROUP BY hostname""")
def hosts_upsert_two_batches(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    none = spark.createDataFrame([], "hostname string, first_seen timestamp_ntz, last_seen timestamp_ntz, log_count long")
    first = aggregates.merge_hosts(none, logs.where("id % 3 = 0"), at("2024-02-01"))
    return aggregates.merge_hosts(first, logs.where("id % 3 > 0"), at("2024-02-02"))


@query("SELECT DISTINCT source_ip, replace(source_ip, ':514', '') AS ip FROM logs")
def source_addr_ip(spark, sf_dir):
    return logs_view(spark, sf_dir).select("source_ip").distinct().withColumn("ip", parse.source_addr_ip(F.col("source_ip")))


@query("SELECT id, CASE event_type WHEN 'signup' THEN 'Caf' ELSE left(message, 4) END AS cut FROM logs")
def truncate_utf8(spark, sf_dir):
    return logs_view(spark, sf_dir).select("id", parse.truncate_utf8(F.col("message"), 4).alias("cut"))


@query("SELECT date_trunc('minute', received_at) AS window_start, count(*) AS total, count(DISTINCT hostname) AS hosts, count(DISTINCT source_ip) AS sources FROM logs GROUP BY 1")
def ingest_summary_60s(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return aggregates.ingest_summary(logs_view(spark, sf_dir)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT string_agg(concat(hostname, '@', ip, '=', n), ', ' ORDER BY n DESC, hostname, ip) AS top FROM (
    SELECT hostname, replace(source_ip, ':514', '') AS ip, count(*) AS n FROM logs GROUP BY ALL ORDER BY n DESC, hostname, ip LIMIT 5)""")
def top_senders(spark, sf_dir):
    return aggregates.top_senders(logs_view(spark, sf_dir))


@query("""SELECT w AS window_start, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT hostname) AS hosts, count(DISTINCT ip) AS sources,
    string_agg(concat(hostname, '@', ip, '=', n), ', ' ORDER BY n DESC, hostname, ip) FILTER (nth <= 5) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, hostname, ip) AS nth FROM (
    SELECT date_trunc('hour', received_at) AS w, hostname, replace(source_ip, ':514', '') AS ip, count(*) AS n FROM logs GROUP BY ALL)) GROUP BY w""")
def ingest_summary_senders(spark, sf_dir):
    """The ingest summary with its senders, by the hour, so that windows hold several."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    summary = aggregates.summary_of(aggregates.sender_counts(logs_view(spark, sf_dir), "1 hour"))
    return summary.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"SELECT {COLS} FROM logs WHERE received_at >= TIMESTAMP '2024-01-20'")
def retention_survivors(spark, sf_dir):
    return log_columns(lifecycle.retained(logs_view(spark, sf_dir), F.lit("2024-01-20").cast("timestamp_ntz")))


BYTES = " + ".join(f'coalesce(strlen("{c}"), 0)' for c in lifecycle.TEXTS if c != "raw")


@query(f"""SELECT id, received_at FROM (SELECT *, row_number() OVER (ORDER BY received_at, id) AS nth, sum({BYTES}) OVER (ORDER BY received_at DESC, id DESC) AS kept FROM logs)
    WHERE nth > (SELECT ceil(coalesce(max(nth) FILTER (kept > 400000), 0) / 100.0) * 100 FROM (SELECT row_number() OVER (ORDER BY received_at, id) AS nth, sum({BYTES}) OVER (ORDER BY received_at DESC, id DESC) AS kept FROM logs))""")
def budget_survivors(spark, sf_dir):
    return lifecycle.budget_survivors(logs_view(spark, sf_dir), 400_000, 100).select("id", "received_at")


@query("SELECT DISTINCT hostname FROM (SELECT hostname FROM logs ORDER BY received_at, id LIMIT 15)")
def oldest_chunk_hosts(spark, sf_dir):
    return lifecycle.oldest(logs_view(spark, sf_dir), 15).select("hostname").distinct()


@query("""SELECT hostname, min(received_at) AS first_seen, max(received_at) AS last_seen, count(*) AS log_count FROM logs
    WHERE id NOT IN (SELECT id FROM logs ORDER BY received_at, id LIMIT 15) GROUP BY hostname""")
def reconcile_hosts(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    gone = lifecycle.oldest(logs, 15)
    return aggregates.reconcile_hosts(aggregates.live_hosts(logs), logs.join(gone.select("id"), "id", "left_anti"), gone)


def _store(spark: SparkSession, sf_dir: str) -> tuple[LogStore, list[DataFrame]]:
    """A new store in the shared folder, and the events as four batches that arrive in no order of time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = logs_view(spark, sf_dir).withColumns({"raw": F.col("message"), "received_at": F.col("received_at").cast("timestamp")})
    return LogStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"), [rows.where(F.col("id") % 4 == k).drop("id", "ts") for k in range(4)]


def _filled(spark: SparkSession, sf_dir: str) -> LogStore:
    store, batches = _store(spark, sf_dir)
    for k, rows in enumerate(batches):
        store.commit_batch(rows, k)
    return store


SHOWN = ("timestamp", "hostname", "severity", "app_name", "process_id", "message", "source_ip")
SHOWN_SQL = ", ".join(f'"{c}"' for c in SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM logs {NEWEST} LIMIT 500")
def store_tail(spark, sf_dir):
    """The newest rows of a store of four batches, by its zone map."""
    return StoreEngine(_filled(spark, sf_dir)).tail(n=500).select(*SHOWN)


@query(f"SELECT {SHOWN_SQL} FROM logs WHERE event_type = 'error' AND severity = 'crit' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' {NEWEST} LIMIT 1000")
def store_search(spark, sf_dir):
    """A search over merged, sorted and indexed parts."""
    store = _filled(spark, sf_dir)
    store.compact()
    return StoreEngine(store).search(query="connection NOT disk", severity="crit", limit=1000, **{"from": "2024-01-05T00:00:00Z", "to": "2024-01-25T00:00:00Z"}).select(*SHOWN)


STORED = " + ".join(f'coalesce(strlen("{c}"), 0)' for c in (*(c for c in lifecycle.TEXTS if c != "raw"), "message"))


@query(f"""SELECT count(*) AS total_logs, (SELECT count(DISTINCT hostname) FROM logs) AS total_hosts, min("timestamp") AS oldest_log, max("timestamp") AS newest_log, CAST(0 AS BIGINT) AS phantom_fts_rows,
    printf('%.2f', sum({STORED}) / 1048576.0) AS logical_db_size_mb, CAST(1024 AS BIGINT) AS max_db_size_mb FROM logs WHERE received_at >= TIMESTAMP '2024-01-20' OR id % 4 = 3""")
def store_stats_after_purge(spark, sf_dir):
    """Three batches, a purge, and a batch with rows from before its bound, which count; no log row is read for the figures."""
    store, batches = _store(spark, sf_dir)
    for k, rows in enumerate(batches):
        if k == 3:
            store.purge(datetime(2024, 1, 20, tzinfo=UTC))
        store.commit_batch(rows, k)
    stats = StoreEngine(store, lifecycle.Budget(min_free_mb=0, recovery_free_mb=0)).stats()
    return stats.select("total_logs", "total_hosts", "oldest_log", "newest_log", "phantom_fts_rows", "logical_db_size_mb", "max_db_size_mb")


@query(f"""SELECT hostname, min(received_at) AS first_seen, max(received_at) AS last_seen, count(*) AS log_count
    FROM (SELECT *, row_number() OVER (ORDER BY received_at) AS nth, sum({STORED}) OVER (ORDER BY received_at DESC) AS kept FROM logs)
    WHERE nth > (SELECT ceil(coalesce(max(nth) FILTER (kept > 60000), 0) / 100.0) * 100 FROM (SELECT row_number() OVER (ORDER BY received_at) AS nth, sum({STORED}) OVER (ORDER BY received_at DESC) AS kept FROM logs)) GROUP BY hostname""")
def store_hosts_after_budget(spark, sf_dir):
    """The registry of a store of which the budget has taken chunks of the oldest rows."""
    store = _filled(spark, sf_dir)
    store.enforce_budget(60_000, 100)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return store.hosts().select("hostname", ntz("first_seen"), ntz("last_seen"), "log_count")
