"""Pigeonring chains: joins that find all pairs of 64-bit fingerprints within 2 bits.

A fingerprint has 8 segments of 8 bits on a ring. If two fingerprints differ in at most 2 bits, some segment starts a
chain whose cumulative differences stay within the proportional budget 2 * length / 8 at every length: the first three
segments are equal, the first four to seven differ in at most 1 bit, all eight in at most 2. So for each of 8 starts the
three equal segments, with one or the other equal half of the next four (at most one differs), make two join keys of 40
bits. Pairs that meet under a key must keep the chain's budgets, and then pass the full Hamming check.

Only different fingerprints take part. A key that more than `dense` fingerprints share gives no pairs: those fingerprints are linked through the 65 values within one bit of each, as two fingerprints within
2 bits of each other always share such a value, and no other two do. That is exact, and linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpointed

SEGMENTS, SEGMENT_BITS = 8, 8


def _rotated(fp: str, segment: int) -> Column:
    n = segment * SEGMENT_BITS
    return F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n)) if n else F.col(fp)


def chain_keys(fp: str) -> Column:
    """The 16 keys of a fingerprint: structs of part (start and half) and key."""
    keys = []
    for start in range(SEGMENTS):
        x = _rotated(fp, start)
        keys.append((2 * start, F.shiftrightunsigned(x, 24)))
        keys.append((2 * start + 1, F.shiftleft(F.shiftrightunsigned(x, 40), 16).bitwiseOR(F.shiftrightunsigned(x, 8).bitwiseAND(F.lit(0xFFFF)))))
    return F.array(*[F.struct(F.lit(part).alias("part"), key.alias("key")) for part, key in keys])


def links(fps: DataFrame, dense: int = 16) -> DataFrame:
    """u, v: edges that connect the fingerprints (column fp, all different) as all pairs within 2 bits would."""
    keys = fps.select("fp", F.explode(chain_keys("fp")).alias("k")).select("fp", "k.part", "k.key")
    shared = keys.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(keys.join(shared, ["part", "key"]))
    few = members.where(F.col("n") <= dense)
    a, b = few.select("part", "key", F.col("fp").alias("u")), few.select("part", "key", F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    start = F.floor(F.col("part") / 2).cast("int") * SEGMENT_BITS
    ring = F.expr("shiftleft(x, s) | shiftrightunsigned(x, 64 - s)")
    # The chain first: its first seven segments may differ in one bit. Then the full Hamming check.
    near = a.join(b, ["part", "key"]).where("u < v").withColumn("x", diff).withColumn("s", start)
    near = near.withColumn("ring", F.when(F.col("s") == 0, F.col("x")).otherwise(ring)).where(F.bit_count(F.shiftrightunsigned("ring", 8)) <= 1).where(F.bit_count("x") <= 2)
    crowded = members.where(F.col("n") > dense).select("fp").distinct()
    ball = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]))
    around = crowded.select("fp", F.explode(ball).alias("c"))
    hubs = around.groupBy("c").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("c", "hub")
    star = around.join(hubs, "c").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return near.select("u", "v").union(star).distinct()
