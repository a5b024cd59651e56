"""Opens a store of format 2, whose rows lie in folders by day of arrival, stream and batch, as one of parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.lifecycle import not_before
from logloom.schema import CHECKPOINTS, HOSTS, LOGS
from logloom.streaming.parts import Part, day_of, figures

OLD_STATE = "format int, version long, next_id long, batches map<string,long>, first_at timestamp, first_id long, write_blocked boolean"
KEYS = ("received_date", "stream", "batch")
OLD_ROWS = T.StructType([*LOGS.fields, T.StructField("received_date", T.DateType()), T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])


def upgrade(store) -> dict | None:
    """The first version of a store of format 2, made of its last state; None if there is no such store.

    Folders stay where they are and become parts, but for those that a purge's bound or the end of a day lies within: what
    counts of them is written anew. The old state and tables stay, unread.
    """
    found = sorted(int(n[2:]) for n in store.files.children("state") if n.startswith("v=") and "_SUCCESS" in store.files.children("state", n))
    if not found:
        return None
    spark, path, version = store.spark, store.files.path, found[-1]
    old = spark.read.schema(OLD_STATE).parquet(path("state", f"v={version}")).first().asDict()
    if old["format"] != 2:
        raise RuntimeError(f"the store has format {old['format']}, this reads 2 and 3")
    parts: list[Part] = []
    if old["batches"]:
        rows = spark.read.schema(OLD_ROWS).parquet(path("logs"))
        rows = rows.where(reduce(lambda a, b: a | b, ((F.col("stream") == s) & (F.col("batch") <= n) for s, n in old["batches"].items())))
        left = rows if old["first_at"] is None else not_before(rows, (old["first_at"], old["first_id"]))
        whole = {tuple(str(r[k]) for k in KEYS): r["n"] for r in rows.groupBy(*KEYS).agg(F.count("*").alias("n")).collect()}
        cut = []
        for f in figures(left.withColumn("day", day_of(F.col("received_at"))), *KEYS, "day"):
            key = tuple(str(f.pop(k)) for k in KEYS)
            if f["n"] == whole[key]:
                parts.append(Part(path="logs/" + "/".join(f"{k}={v}" for k, v in zip(KEYS, key, strict=True)), **f))
            else:
                cut.append(key)
        for day, stream, batch in set(cut):
            parts += store.write_parts(left.where((F.col("received_date") == F.lit(day).cast("date")) & (F.col("stream") == stream) & (F.col("batch") == int(batch))))
    tables = {name: store._new_table(spark.read.schema(kind).parquet(path(name, f"v={version}"))) for name, kind in (("hosts", HOSTS), ("checkpoints", CHECKPOINTS))}
    new = {"format": 3, "version": 1, "next_id": old["next_id"], "batches": old["batches"], "write_blocked": old["write_blocked"], **tables, "parts": parts}
    return new if store.publish(new) else store.state()
