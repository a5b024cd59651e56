"""Summaries of logs: errors, hosts, correlation, senders, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.parse import source_addr_ip
from logloom.schema import ERROR_SEVERITIES, LOG_COLS


def error_summary(logs: DataFrame) -> DataFrame:
    """hostname, severity, count of warnings and worse, by host and then the larger count, ties by severity."""
    errors = logs.where(F.col("severity").isin(list(ERROR_SEVERITIES))).groupBy("hostname", "severity").agg(F.count("*").alias("count"))
    return errors.orderBy("hostname", F.col("count").desc(), "severity")


def live_hosts(logs: DataFrame) -> DataFrame:
    """The host registry counted anew from the rows there are, by arrival time."""
    return logs.groupBy("hostname").agg(F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), F.count("*").alias("log_count"))


def merge_hosts(hosts: DataFrame, batch: DataFrame, at) -> DataFrame:
    """The registry after a batch of rows arrived at `at`: counts add up, first_seen and last_seen take in at."""
    new = batch.groupBy("hostname").agg(F.count("*").alias("n"))
    both = hosts.join(new, "hostname", "full_outer")
    seen = F.when(F.col("n").isNotNull(), at)
    return both.select("hostname", F.least("first_seen", seen).alias("first_seen"), F.greatest("last_seen", seen).alias("last_seen"), (F.coalesce("log_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("log_count"))


def reconcile_hosts(hosts: DataFrame, logs: DataFrame, affected: DataFrame) -> DataFrame:
    """The registry with the affected hosts counted anew; those without rows go."""
    touched = affected.select("hostname").distinct()
    return hosts.join(touched, "hostname", "left_anti").unionByName(live_hosts(logs.join(touched, "hostname", "left_semi")))


def latest_checkpoints(rows: DataFrame, *keys: str, value: str, order: str) -> DataFrame:
    """The last value by arrival for each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def after_checkpoint(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows (host_name, container_id, entry_nanos) later than their container's checkpoint_nanos; unreadable times stay."""
    kept = rows.join(checkpoints, ["host_name", "container_id"], "left")
    return kept.where(F.coalesce(F.col("entry_nanos") > F.col("checkpoint_nanos"), F.lit(True))).drop("checkpoint_nanos")


def by_host(events: DataFrame) -> DataFrame:
    """hostname, event_count, events: the rows of each host as a list, newest first, hosts in byte order."""
    entry = F.struct(F.col("ts"), *LOG_COLS)
    listed = events.groupBy("hostname").agg(F.count("*").alias("event_count"), F.array_sort(F.collect_list(entry), lambda a, b: F.when((a.ts > b.ts) | ((a.ts == b.ts) & (a.id > b.id)), -1).when((a.ts == b.ts) & (a.id == b.id), 0).otherwise(1)).alias("events"))
    return listed.withColumn("events", F.transform("events", lambda e: F.struct(*[e[c].alias(c) for c in LOG_COLS]))).orderBy("hostname")


def counts(logs: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """One row: logs, hosts (of the registry, where there is one), oldest and newest time.

    The index never has phantom rows, as tokens live on their row.
    """
    one = logs.agg(F.count("*").alias("total_logs"), F.count_distinct("hostname").alias("total_hosts"), F.min("timestamp").alias("oldest_log"), F.max("timestamp").alias("newest_log"), F.lit(0).cast("bigint").alias("phantom_fts_rows"))
    if hosts is None:
        return one
    of_registry = hosts.agg(F.count("*").alias("total_hosts"), F.lit(1).alias("k"))
    return one.drop("total_hosts").withColumn("k", F.lit(1)).join(of_registry, "k").select("total_logs", "total_hosts", "oldest_log", "newest_log", "phantom_fts_rows")


def latest_states(events: DataFrame) -> DataFrame:
    """host_name, container_id, state, at: the last of each container's events (state, at); equal times go by state."""
    last = events.groupBy("host_name", "container_id").agg(F.max(F.struct("at", "state")).alias("last"))
    return last.select("host_name", "container_id", "last.state", "last.at")


def with_state(rows: DataFrame, states: DataFrame) -> DataFrame:
    """rows (host_name, container_id) with the state of their container; null if nothing is known of it."""
    return rows.join(states.select("host_name", "container_id", "state"), ["host_name", "container_id"], "left")


def _sender() -> Column:
    return F.concat(F.col("hostname"), F.lit("@"), F.col("ip"), F.lit("="), F.col("n").cast("string"))


def top_senders(logs: DataFrame, limit: int = 5) -> DataFrame:
    """One row, top: the most frequent host@ip=count, joined by a comma and a space."""
    sent = logs.groupBy("hostname", source_addr_ip(F.col("source_ip")).alias("ip")).agg(F.count("*").alias("n"))
    first = sent.orderBy(F.col("n").desc(), "hostname", "ip").limit(limit)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "hostname", "ip", _sender().alias("text"))))
    return first.agg(F.array_join(F.transform(order, lambda s: s.text), ", ").alias("top"))


def sender_counts(logs: DataFrame, every: str = "60 seconds") -> DataFrame:
    """window_start, hostname, ip, n: rows by window of arrival and sender, of a table or a stream."""
    return logs.groupBy(F.window("received_at", every).alias("w"), "hostname", source_addr_ip(F.col("source_ip")).alias("ip")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "hostname", "ip", "n")


def summary_of(counts: DataFrame, limit: int = 5) -> DataFrame:
    """window_start, total, hosts, sources, top: the summary of each window, top being its most frequent host@ip=count."""
    nth = F.row_number().over(Window.partitionBy("window_start").orderBy(F.col("n").desc(), "hostname", "ip"))
    ranked = counts.withColumn("nth", nth)
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= limit, F.struct("nth", _sender().alias("text")))))
    sums = ranked.groupBy("window_start").agg(F.sum("n").alias("total"), F.count_distinct("hostname").alias("hosts"), F.count_distinct("ip").alias("sources"))
    tops = ranked.where(F.col("nth") <= limit).groupBy("window_start").agg(F.array_join(F.transform(first, lambda s: s.text), ", ").alias("top"))
    return sums.join(tops, "window_start").select("window_start", "total", "hosts", "sources", "top")


def ingest_summary(logs: DataFrame, every: str = "60 seconds") -> DataFrame:
    """Rows, hosts and source addresses by window of arrival."""
    return logs.groupBy(F.window("received_at", every).alias("w")).agg(F.count("*").alias("total"), F.count_distinct("hostname").alias("hosts"), F.count_distinct(source_addr_ip(F.col("source_ip"))).alias("sources")).select(F.col("w.start").alias("window_start"), "total", "hosts", "sources")
