"""Log storage in Parquet: batches from a stream, the host registry, checkpoints, retention and budget.

Rows lie in parts (see parts.py), each written once under a folder name of its own and never changed. A version is one small
file that names the parts and the folders of the two small tables; it is created only if its number is free, so of two
writers, in whatever processes, one finds the number taken and does its work again on what the other left. What is written
before does not count until a version names it. So a purge, the budget and a merge write the few parts that they cut and a
version; readers under way keep theirs until vacuum() deletes what the last KEEP versions do not name.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.timeutil import instant, nanos
from logloom.functions.tokens import tokens
from logloom.operators.aggregates import live_hosts, merge_hosts, reconcile_hosts
from logloom.operators.lifecycle import Budget, edge, not_before, sums_by, walk
from logloom.schema import CHECKPOINTS, HOSTS, LOGS, Busy
from logloom.streaming.files import Files
from logloom.streaming.parts import DAY, SORTED, Part, day_of, figures, micros, to_merge, within
from logloom.streaming.postings import write_postings

FORMAT = 3
NEW = {"format": FORMAT, "version": 0, "next_id": 1, "batches": {}, "write_blocked": False, "hosts": None, "checkpoints": None, "parts": []}
#: Versions that stay for readers under way, tries of a commit, and how old what no version names must be to go.
KEEP, TRIES, GRACE_SECS = 20, 20, 86_400
#: Folders that hold nothing but what versions name, or a writer is still at.
TOPS = ("data", "logs", "tables", "staged", "index")
#: Rows of a sorted part, and about as many as a task sorts, however large a day or batch is.
PART_ROWS = 250_000
#: Finished days of no more rows than that which are sorted in one go, and how many times PART_ROWS they may have together.
DAYS, TOGETHER = 32, 4
#: Writers of one driver take turns, and wait so many seconds, so that they need not do work again.
WRITING, WAIT_SECS = threading.RLock(), 600


class WriteBlocked(RuntimeError):
    """The budget leaves no room; the stream keeps its offsets and tries again."""


@dataclass(frozen=True)
class Metrics:
    """Bytes of the texts of all rows, of all files, and free on the file system."""

    logical: int
    physical: int
    free: int | None


@dataclass(frozen=True)
class Outcome:
    """What enforcing the budget did."""

    deleted: int
    write_blocked: bool
    metrics: Metrics


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self._read: tuple[int, dict] = (0, NEW)

    def state(self) -> dict:
        """The last version, with its parts; that of a new store has none."""
        last = max((int(n.removesuffix(".json")) for n in self.files.children("versions") if n[0] != "."), default=0)
        if last == 0:
            from logloom.streaming.upgrade import upgrade

            return upgrade(self) or NEW
        if self._read[0] != last:
            self._read = (last, self.at(last))
        return self._read[1]

    def at(self, version: int) -> dict:
        """The version of a number, with its parts."""
        state = json.loads(self.files.read("versions", f"{version}.json"))
        if state["format"] != FORMAT:
            raise RuntimeError(f"the store has format {state['format']}, this reads {FORMAT}")
        return state | {"parts": [Part(**p) for p in state["parts"]]}

    def publish(self, state: dict) -> bool:
        """Makes state the version it names; False if there is one of that number."""
        text = json.dumps(state | {"parts": [asdict(p) for p in state["parts"]]})
        done = self.files.create(text, "versions", f"{state['version']}.json")
        if done and state["version"] > KEEP:
            self.files.delete("versions", f"{state['version'] - KEEP}.json")
        return done

    def _commit(self, work: Callable[[dict], dict | None]) -> dict | None:
        """Publishes what work makes of the last version, again from the start if another writer was first.

        work returns what changes, or None to leave all as it is.
        """
        if not WRITING.acquire(timeout=WAIT_SECS):
            raise Busy("another writer holds the store")
        try:
            for _ in range(TRIES):
                base = self.state()
                changes = work(base)
                new = base | (changes or {}) | {"version": base["version"] + 1}
                if changes is None or self.publish({k: new[k] for k in NEW}):
                    return changes
            raise Busy("other writers were first each time")
        finally:
            WRITING.release()

    def rows_of(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], LOGS)
        return self.spark.read.schema(LOGS).parquet(*(self.files.path(p.path) for p in parts))

    def logs(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """All rows, or those of the parts that can hold a time from start to end."""
        return self.rows_of(within(self.state()["parts"], start, end))

    def _table(self, folder: str | None, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.files.path("tables", folder)) if folder else self.spark.createDataFrame([], schema)

    def _new_table(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(self.files.path("tables", folder))
        return folder

    def hosts(self) -> DataFrame:
        return self._table(self.state()["hosts"], HOSTS)

    def checkpoints(self) -> DataFrame:
        return self._table(self.state()["checkpoints"], CHECKPOINTS)

    def write_parts(self, rows: DataFrame, slices: int = 0, level: int = 0, days: int = 1) -> list[Part]:
        """rows (of the logs' columns) written as new parts, one for each day, or with slices sorted by time: so many of one day, or one of each of several days."""
        folder, by = f"data/{uuid.uuid4().hex}", ["day", "slice"] if slices else ["day"]
        cut = rows.select(*LOGS.fieldNames(), day_of(F.col("received_at")).alias("day"))
        if slices:
            cut = (cut.repartitionByRange(days, "day") if days > 1 else cut.repartitionByRange(slices, "ts", "id")).withColumn("slice", F.spark_partition_id().cast("long")).sortWithinPartitions(*by, "ts", "id")
        cut.write.partitionBy(*by).parquet(self.files.path(folder))
        if not self.files.children(folder).keys() - {"_SUCCESS"}:
            return []
        kind = T.StructType([*LOGS.fields, *(T.StructField(c, T.LongType()) for c in by)])
        found = figures(self.spark.read.schema(kind).parquet(self.files.path(folder)), *by)
        return [Part(path="/".join((folder, *(f"{c}={f[c]}" for c in by))), level=level, **{k: v for k, v in f.items() if k != "slice"}) for f in found]

    def commit_batch(self, rows: DataFrame, batch_id: int, blocked: bool = False, stream: str = "syslog") -> bool:
        """Adds parsed rows (with received_at, and host_name, container_id, last_timestamp for container lines).

        Batches are numbered by stream and come in order. A batch already committed is left as it is and gives False. A
        blocked store raises, so that the stream's offsets stay. Rows count whenever they arrived, also before a purge's bound.
        """
        if blocked or self.state()["write_blocked"]:
            raise WriteBlocked("the storage budget is used up")
        if batch_id <= self.state()["batches"].get(stream, -1):
            return False
        staged = self._stage(rows)
        done = self._commit(lambda base: None if batch_id <= base["batches"].get(stream, -1) else self._added(base, staged, stream, batch_id))
        self.files.delete("staged", staged.rpartition("/")[2])
        return done is not None

    def _stage(self, rows: DataFrame) -> str:
        """rows in order of arrival, written aside with their partition and their place in it, so that no task sees all."""
        path = self.files.path("staged", uuid.uuid4().hex)
        for name in ("host_name", "container_id", "last_timestamp"):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        full = rows.withColumns({"ts": instant(F.col("timestamp")), "ts_nanos": nanos(F.col("timestamp")), "tokens": tokens(F.col("message")), "_arrived": F.monotonically_increasing_id()})
        order = ["received_at", "_arrived"]
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        full.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_place": place}).drop("_arrived").write.parquet(path)
        return path

    def _added(self, base: dict, staged: str, stream: str, batch_id: int) -> dict:
        rows, first, begins = self.spark.read.parquet(staged), base["next_id"], []
        for r in sorted(rows.groupBy("_part").agg(F.count("*").alias("n"), F.max("received_at").alias("at"), F.count("container_id").alias("containers")).collect()):
            begins.append((r["_part"], first, r["at"], r["containers"]))
            first += r["n"]
        batches = {"batches": base["batches"] | {stream: batch_id}}
        if not begins:
            return batches
        given = rows.join(F.broadcast(self.spark.createDataFrame([b[:2] for b in begins], "_part int, _begin long")), "_part").withColumn("id", F.col("_begin") + F.col("_place"))
        # The writer sorts a task's rows by day; a large batch is dealt out first, in order of arrival.
        tasks = -(-(first - base["next_id"]) // PART_ROWS)
        parts = self.write_parts(given.repartitionByRange(tasks, "id") if tasks > 1 else given)
        at = F.lit(max(b[2] for b in begins)).cast("timestamp")
        changes = batches | {"next_id": first, "parts": [*base["parts"], *parts], "hosts": self._new_table(merge_hosts(self._table(base["hosts"], HOSTS), rows, at))}
        if any(b[3] for b in begins):
            last = given.where("container_id IS NOT NULL").groupBy("host_name", "container_id").agg(F.max_by("last_timestamp", "id").alias("last_timestamp"), F.max("received_at").alias("updated_at"))
            old = self._table(base["checkpoints"], CHECKPOINTS).join(last, ["host_name", "container_id"], "left_anti")
            changes["checkpoints"] = self._new_table(old.unionByName(last).select(*CHECKPOINTS.fieldNames()))
        return changes

    def purge(self, cutoff: datetime | None) -> int:
        """Drops rows that arrived before cutoff (None: nothing); the registry stays. Returns how many went.

        Parts that are older throughout are dropped unread; of those that cutoff lies within, what stays is written anew.
        """
        if cutoff is None:
            return 0
        at = micros(cutoff)

        def work(base: dict) -> dict | None:
            old = [p for p in base["parts"] if p.first_received < at]
            cut = [p for p in old if p.last_received >= at]
            if not old:
                return None
            left = self.write_parts(self.rows_of(cut).where(F.unix_micros("received_at") >= at)) if cut else []
            return {"parts": [*(p for p in base["parts"] if p not in old), *left], "gone": sum(p.n for p in old) - sum(p.n for p in left)}

        done = self._commit(work)
        return done["gone"] if done else 0

    def metrics(self) -> Metrics:
        """From the parts' figures and the file system; no rows are read."""
        return Metrics(sum(p.bytes for p in self.state()["parts"]), self.files.used(), self.files.free())

    def enforce(self, budget: Budget, metrics=None) -> Outcome:
        """Lets the oldest rows go, and deletes their files, until the budget's recovery targets are met or none are left.

        Only if none are left and a limit is still passed is writing blocked. metrics, if given, is called in place of
        metrics(). Space short on the file system counts as the bytes of texts whose files take as much, but no pass takes
        more than an eighth of the rows (or a chunk), since what comes back is known only after it.
        """
        measure = metrics or self.metrics
        now, deleted = measure(), 0
        while budget.enabled and (budget.triggered(now.logical, now.free) or not budget.recovered(now.logical, now.free)):
            if budget.max_mb and now.logical > budget.recovery_mb << 20:
                gone = self.enforce_budget(budget.recovery_mb << 20, budget.chunk, least=1)
            else:
                short = max(0, (budget.recovery_free_mb << 20) - (now.free or 0))
                gone = self.enforce_budget(max(0, now.logical - short * max(now.logical, 1) // max(now.physical, 1)), budget.chunk, least=1, share=8)
            if not gone:
                break
            deleted, now = deleted + gone, measure()
        blocked = budget.enabled and budget.triggered(now.logical, now.free)
        self._commit(lambda base: None if base["write_blocked"] == blocked else {"write_blocked": blocked})
        return Outcome(deleted, blocked, now)

    def enforce_budget(self, max_bytes: int, chunk: int = Budget.chunk, least: int = 0, share: int | None = None) -> int:
        """Drops chunks of the oldest rows, `least` at least, until max_bytes of texts remain, and counts their hosts anew.

        With share, no more than this part of all rows goes, or one chunk.

        Sums by day come from the parts; of the rows, only those of the days where the bounds lie are read. Files of dropped parts are deleted
        at once, to win space, which a reader under way may notice. Returns how many rows went.
        """
        dropped: list[Part] = []

        def work(base: dict) -> dict | None:
            dropped.clear()
            days: dict[int, list[Part]] = {}
            for p in base["parts"]:
                days.setdefault(p.day, []).append(p)
            sums = [(d, sum(p.bytes for p in ps), sum(p.n for p in ps)) for d, ps in days.items()]

            def within_day(measure: int, room: int, newest: bool) -> tuple[int, int | None, tuple | None]:
                passed, room, day = walk(sums, measure, room, newest)
                if day is None or measure == 2 and not room:
                    return passed, day, None
                rows = self.rows_of(days[day])
                more, first = edge(rows, sums_by(rows, "minute"), measure, room, newest)
                return passed + more, day, first

            total = sum(n for _, _, n in sums)
            kept = within_day(1, max_bytes, True)[0]
            chunks = -(-max(total - kept, least) // chunk)
            gone = min(total, chunk * (chunks if share is None else min(chunks, max(1, total // share // chunk))))
            if not gone:
                return None
            _, day, first = within_day(2, gone, False)
            cut = [p for p in base["parts"] if p.day == day and first]
            dropped.extend([*(p for p in base["parts"] if day is None or p.day < day), *cut])
            left = self.write_parts(not_before(self.rows_of(cut), first)) if cut else []
            parts = [*(p for p in base["parts"] if p not in dropped), *left]
            hosts = reconcile_hosts(self._table(base["hosts"], HOSTS), self.rows_of(parts), self.rows_of(dropped))
            return {"parts": parts, "hosts": self._new_table(hosts), "gone": gone}

        done = self._commit(work)
        for p in dropped:
            self.files.delete(p.path)
        return done["gone"] if done else 0

    def compact(self, today: int | None = None, rows: int = PART_ROWS) -> int:
        """Merges parts: a finished day's into sorted ones of about so many rows, a running day's by FAN_IN. Returns how many went.

        Rows stay the same; readers under way keep the parts they read. today counts days since the epoch.
        """
        merged, today = 0, int(time.time() * 1_000_000 // DAY) if today is None else today
        groups, small = [], []
        for group in to_merge(self.state()["parts"], today, rows):
            if group[0].day >= today or sum(p.n for p in group) > rows:
                groups.append(group)
                continue
            # Finished days of few rows go together, up to DAYS of them.
            if len({p.day for p in small}) == DAYS or sum(p.n for p in small + group) > TOGETHER * rows:
                groups += [small] if small else []
                small = []
            small = small + group
        for group in [*groups, small] if small else groups:
            old, days = self.rows_of(group), len({p.day for p in group})
            if group[0].day < today:
                new = write_postings(self, self.write_parts(old, -(-sum(p.n for p in group) // rows), SORTED, days))
            else:
                new = self.write_parts(old.coalesce(max(1, -(-sum(p.n for p in group) // rows))), level=max(p.level for p in group) + 1)
            swapped = self._commit(lambda base: {"parts": [*(p for p in base["parts"] if p not in group), *new]} if all(p in base["parts"] for p in group) else None)
            merged += len(group) if swapped else 0
        return merged

    def recount(self) -> DataFrame:
        return live_hosts(self.logs())

    def vacuum(self, grace_secs: int = GRACE_SECS, keep: int = KEEP) -> None:
        """Deletes what none of the last versions names and no writer can still be at: older than grace_secs."""
        named: set[str] = set()
        versions = sorted(int(n.removesuffix(".json")) for n in self.files.children("versions") if n[0] != ".")
        for v in versions[-keep:]:
            state = json.loads(self.files.read("versions", f"{v}.json"))
            named |= {p["path"] for p in state["parts"]} | {f"index/{p['index']}" for p in state["parts"]} | {f"tables/{state[t]}" for t in ("hosts", "checkpoints")}
        above = {"/".join(n.split("/")[:k]) for n in named for k in range(1, n.count("/") + 1)}
        before = (time.time() - grace_secs) * 1000

        def sweep(folder: str) -> None:
            for name, changed in self.files.children(folder).items():
                path = f"{folder}/{name}"
                if path in above:
                    sweep(path)
                elif path not in named and changed <= before and (folder in TOPS or "=" in name):
                    self.files.delete(path)

        for top in TOPS:
            sweep(top)
