"""A Merkle manifest of a table, with lookup proofs by coordinates.

Each row is a leaf, a SHA-256 of its fields; each source has a tree over its leaves by ascending id, in runs of GROUP
nodes, and the sources' roots have one over them. A run is named by (tree, level, run) and holds its nodes' digests: the
materialised node table. A proof needs no walk from node to node: a leaf's index and the group size give the coordinates
of its run on every level; these are exploded, joined with the node table, put in order of level and folded.

Indexes come from a range sort by (source, id), so that no task sees all of a source; a shuffle builds LEVELS levels at
once, from rows of at most GROUP ** LEVELS digests. Runs high up are asked for by very many leaves, but are few: the
levels with at most BROADCAST_RUNS runs together are broadcast, whatever the table's size; of those below, a run is asked
for by a share of all leaves that falls as the table grows.

Nulls in any field have a digest of their own, other than that of the empty text; a null id comes first, a null source
too. Rows of equal source and id go by their digest, and equal rows are leaves of their own. Texts are hashed whole.
An empty table has no leaves and no root. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import numbered, stored

GROUP = 3
#: Levels that one shuffle builds.
LEVELS = 4
#: Rows of the node table, of GROUP digests of 32 bytes each, that may be broadcast.
BROADCAST_RUNS = 20_000
#: Sources, of names of at most so many bytes, that may be broadcast.
BROADCAST_SOURCES, LONGEST_NAME = 10_000, 256
#: The tree over the sources' roots; other trees are named by the position of their first leaf.
TOP = -1


def field(value: Column) -> Column:
    """A value as text that no other value shares: its UTF-8 byte count, a colon and itself; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def hexed(digests: Column) -> Column:
    """An array of digests as lowercase hex, one after another."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def hashed(digests: Column) -> Column:
    """The digest of a run of digests."""
    return F.unhex(F.sha2(hexed(digests), 256))


def div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def runs_of(digests: Column) -> Column:
    """An array of digests cut into runs of GROUP; the last may have fewer."""
    starts = F.sequence(F.lit(0), F.size(digests) - 1, F.lit(GROUP))
    return F.transform(starts, lambda s: F.slice(digests, s + 1, F.lit(GROUP)))


@dataclass(frozen=True)
class Manifest:
    """leaves: at, tree, index, n, leaf, doc_id and what came with them; nodes: tree, level, run, digests; sources: tree,
    index, n (of all sources), source, subroot, root (the same for all)."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame


def forest(leaves: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """The node table of all trees, and their roots (tree, root), from nodes (tree, index, n, digest).

    n is the number of a tree's leaves, most the largest of them. Each round groups GROUP ** LEVELS nodes in a row and makes
    the levels above them there. A tree ends where one node is left. None stands for no runs at all.
    """
    roots, tables, level, width = [], [], 0, GROUP**LEVELS
    now = leaves.select("tree", "index", "n", "digest")
    while True:
        roots.append(now.where("n = 1").select("tree", F.col("digest").alias("root")))
        if most <= 1:
            break
        inside = F.transform(F.array_sort(F.collect_list(F.struct("index", "digest"))), lambda x: x["digest"])
        blocks = now.where("n > 1").groupBy("tree", div(F.col("index"), width).alias("block")).agg(F.max("n").alias("n"), inside.alias("d0"))
        for k in range(LEVELS):
            alone = F.col("n") <= GROUP**k
            blocks = blocks.withColumn(f"d{k + 1}", F.when(alone, F.col(f"d{k}")).otherwise(F.transform(runs_of(F.col(f"d{k}")), hashed)))
        blocks = stored(blocks)
        for k in range(LEVELS):
            runs = F.posexplode(runs_of(F.col(f"d{k}"))).alias("k", "digests")
            table = blocks.where(F.col("n") > GROUP**k).select("tree", "block", runs)
            tables.append(table.select("tree", F.lit(level + k).alias("level"), (F.col("block") * GROUP ** (LEVELS - k - 1) + F.col("k")).alias("run"), "digests"))
        now = blocks.select("tree", F.col("block").alias("index"), div(F.col("n") + (width - 1), width).alias("n"), F.col(f"d{LEVELS}")[0].alias("digest"))
        most, level = -(-most // width), level + LEVELS
    return reduce(DataFrame.unionAll, tables) if tables else None, reduce(DataFrame.unionAll, roots)


def build(docs: DataFrame, **also: Column) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text); also names further columns that leaves carry."""
    narrow = docs.select("doc_id", "source", leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"), *(c.alias(name) for name, c in also.items()))
    placed = numbered(narrow, ["source", "doc_id", "leaf"], "at")
    per_source = stored(placed.groupBy("source").agg(F.min("at").alias("tree"), F.count("*").alias("n")))
    size = per_source.agg(F.count("*"), F.max("n"), F.coalesce(F.max(F.octet_length("source")), F.lit(0))).first()
    small = size[0] <= BROADCAST_SOURCES and size[2] <= LONGEST_NAME
    trees = F.broadcast(per_source) if small else per_source
    same = placed["source"].eqNullSafe(trees["source"])
    leaves = stored(placed.join(trees, same).select(placed["*"], "tree", (F.col("at") - F.col("tree")).alias("index"), "n"))
    nodes, subroots = forest(leaves.withColumn("digest", F.col("leaf")), size[1] or 0)
    ranked = numbered(per_source.select("tree", "source"), ["tree"], "index").withColumn("n", F.lit(size[0]).cast("long"))
    sources = stored(ranked.join(subroots.withColumnRenamed("root", "subroot"), "tree").withColumn("top", F.lit(TOP).cast("long")))
    tops, root = forest(sources.select(F.col("top").alias("tree"), "index", "n", F.col("subroot").alias("digest")), size[0])
    sources = sources.join(root.withColumnRenamed("tree", "top"), "top").drop("top")
    tables = [t for t in (nodes, tops) if t is not None]
    none = docs.sparkSession.createDataFrame([], "tree long, level int, run long, digests array<binary>")
    return Manifest(leaves, reduce(DataFrame.unionAll, tables, none), sources)


def proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """at, proof for leaves (at, tree, index, n) that have siblings: for each level the digests left and right of the path.

    A leaf is asked for by its coordinates alone; leaves of trees with one node have none and so no row.
    """
    height = (leaves.agg(F.max("n")).first()[0] or 0) - 1
    levels = next(k for k in range(64) if GROUP**k > height)
    if not levels:
        return leaves.sparkSession.createDataFrame([], "at long, proof array<struct<level:int,left:array<binary>,right:array<binary>>>")
    counts = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    few = next(k for k in range(levels + 1) if sum(counts.get(j, 0) for j in range(k, levels)) <= BROADCAST_RUNS)
    path = F.filter(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(GROUP**k).cast("long").alias("step")) for k in range(levels))), lambda x: x["step"] < F.col("n"))
    asked = leaves.select("at", "tree", "index", F.explode(path).alias("p")).select("at", "tree", F.col("p.level").alias("level"), F.call_function("div", F.col("index"), F.col("p.step")).alias("node"))
    asked = asked.select("at", "tree", "level", div(F.col("node"), GROUP).alias("run"), (F.col("node") % GROUP).cast("int").alias("place"))
    step = F.struct("level", F.slice("digests", F.lit(1), F.col("place")).alias("left"), F.slice("digests", F.col("place") + 2, F.lit(GROUP)).alias("right"))
    found = []
    if few < levels:
        found.append(asked.where(F.col("level") >= few).join(F.broadcast(nodes.where(F.col("level") >= few)), ["tree", "level", "run"]))
    if few:
        found.append(asked.where(F.col("level") < few).join(nodes.where(F.col("level") < few), ["tree", "level", "run"]))
    steps = reduce(DataFrame.unionAll, (f.select("at", step.alias("step")) for f in found))
    return steps.groupBy("at").agg(F.array_sort(F.collect_list("step")).alias("proof"))


def with_proofs(manifest: Manifest) -> DataFrame:
    """The manifest's leaves with subroot, root and proof, the steps from the leaf through its source's root to the root."""
    sources, none = manifest.sources, F.array().cast("array<struct<level:int,left:array<binary>,right:array<binary>>>")
    tops = proofs(sources.select(F.col("tree").alias("at"), F.lit(TOP).cast("long").alias("tree"), "index", "n"), manifest.nodes)
    above = stored(sources.select("tree", "subroot", "root").join(tops.withColumnsRenamed({"at": "tree", "proof": "above"}), "tree", "left"))
    own = proofs(manifest.leaves.select("at", "tree", "index", "n"), manifest.nodes)
    small = above.count() <= BROADCAST_SOURCES
    full = manifest.leaves.join(own, "at", "left").join(F.broadcast(above) if small else above, "tree")
    return full.withColumn("proof", F.concat(F.coalesce("proof", none), F.coalesce("above", none))).drop("above")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda d, s: hashed(F.concat(s["left"], F.array(d), s["right"])))


def merkle_proofs(docs: DataFrame, tampered: Column, doubtful: Column) -> DataFrame:
    """One row for each row of docs: its leaf, proof and roots, and whether the proof holds for what is there now.

    Where doubtful is true, the leaf to be verified has the text that tampered gives; else the text itself.
    """
    names = ("doc_id", "source", "lang", "n_chars")
    now = F.when(F.coalesce(doubtful, F.lit(False)), leaf_digest(*(F.col(c) for c in names), tampered))
    manifest = build(docs, now=now)
    rows = with_proofs(manifest)
    siblings = F.flatten(F.transform("proof", lambda s: F.concat(s["left"], s["right"])))
    lower = lambda d: F.lower(F.hex(d))
    rows = rows.select("doc_id", lower(F.col("leaf")).alias("leaf"), lower(F.col("subroot")).alias("subroot"), lower(F.col("root")).alias("root"), F.sha2(hexed(siblings), 256).alias("proof_sha256"), lower(folded(F.coalesce("now", "leaf"), F.col("proof"))).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
