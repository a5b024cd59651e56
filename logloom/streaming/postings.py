"""An inverted index of sorted parts: which rows have a stem, for searches over a store.

It is written when a finished day's parts are sorted: a table of (stem, path, n, id), in order of stem, so that the Parquet
files' own statistics lead to a stem. A stem that stands in few of a part's rows has a line for each; of a stem in more than
one row in COMMON there is one line without id, since reading the part is no more work than following its lines. An
expression tells which stems a row must have; the part's rarest of them gives candidates, whose tokens then decide. Parts
where a needed stem is missing are not read. Positions are not kept: they stand on the row, in its tokens.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.match import search
from logloom.streaming.parts import Part

#: A stem in more than one of so many rows of a part is common there.
COMMON = 32
#: So many ids are put into the scan's own filter, beyond them a join finds their rows; so many may be broadcast for it.
FEW_IDS, BROADCAST_IDS = 1_000, 100_000


def write_postings(store, parts: list[Part]) -> list[Part]:
    """The parts with the name of their index, which is written."""
    if not parts:
        return parts
    folder = uuid.uuid4().hex
    found = reduce(DataFrame.unionAll, (store.rows_of([p]).select(F.lit(p.path).alias("path"), F.lit(p.n).alias("rows"), "id", "tokens") for p in parts))
    each = found.select("path", "rows", "id", F.explode(F.array_distinct("tokens")).alias("stem"))
    counted = each.groupBy("path", "rows", "stem").agg(F.count("*").alias("n"))
    common = F.col("n") * COMMON > F.col("rows")
    few = each.drop("rows").join(counted.where(~common), ["path", "stem"]).select("stem", "path", "n", "id")
    lines = few.unionByName(counted.where(common).select("stem", "path", "n", F.lit(None).cast("long").alias("id")))
    lines.repartitionByRange("stem", "path", "id").sortWithinPartitions("stem", "path", "id").write.parquet(store.files.path("index", folder))
    return [replace(p, index=folder) for p in parts]


def candidates(store, parts: list[Part], query: str | None) -> DataFrame:
    """Rows of parts, among which are all that meet a search expression; parts without an index are read whole."""
    indexed = [p for p in parts if p.index]
    if query is None or not indexed:
        return store.rows_of(parts)
    needs = search(F.col("tokens"), query).needs
    lines = store.spark.read.schema("stem string, path string, n long, id long").parquet(*(store.files.path("index", name) for name in sorted({p.index for p in indexed})))
    lines = lines.where(F.col("path").isin([p.path for p in indexed])) if len(indexed) <= 100 else lines.join(F.broadcast(store.spark.createDataFrame([(p.path,) for p in indexed], "path string")), "path", "left_semi")
    counts = _counts(lines, {s for need in needs for s in need})
    whole, chosen = [p for p in parts if not p.index], []
    for p in indexed:
        ways = [need for need in needs if all((p.path, s) in counts for s in need)]
        rarest = [min((s for s in need if not s[1]), key=lambda s: counts[p.path, s], default=None) for need in ways]
        if any(s is None or counts[p.path, s] * COMMON > p.n for s in rarest):
            whole.append(p)
        else:
            chosen += [(p, s[0]) for s in dict.fromkeys(rarest)]
    if not chosen:
        return store.rows_of(whole)
    hit = list({p.path: p for p, _ in chosen}.values())
    pairs = store.spark.createDataFrame([(p.path, stem) for p, stem in chosen], "path string, stem string")
    ids = lines.where(F.col("stem").isin(sorted({stem for _, stem in chosen}))).join(F.broadcast(pairs), ["path", "stem"], "left_semi").select("id").distinct()
    n = sum(counts[p.path, (stem, False)] for p, stem in chosen)
    rows = store.rows_of(hit)
    if n <= FEW_IDS:
        rows = rows.where(F.col("id").isin([r["id"] for r in ids.collect()]))
    else:
        rows = rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi").select(*rows.columns)
    return rows.unionByName(store.rows_of(whole)) if whole else rows


def _counts(lines: DataFrame, stems: set) -> dict:
    """How many rows of each part (by path) have each stem; of a stem's beginning, only whether there are any."""
    exact, begun = sorted(s for s, prefix in stems if not prefix), sorted(s for s, prefix in stems if prefix)
    out = {}
    if exact:
        for r in lines.where(F.col("stem").isin(exact)).groupBy("path", "stem").agg(F.max("n").alias("n")).collect():
            out[r["path"], (r["stem"], False)] = r["n"]
    for s in begun:
        for r in lines.where(F.startswith("stem", F.lit(s))).select("path").distinct().collect():
            out[r["path"], (s, True)] = 1
    return out
