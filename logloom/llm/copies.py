"""Near copies at a given shingle similarity: SimHash chains and prefix keys find candidates, SimHash prunes them, whole shingle sets decide.

Close copies, which differ in at most 2 of 64 bits of their SimHash, are found by pigeonring chains (chains.py). Those
that are further apart, down to the similarity, are found by prefix keys:

The similarity of two texts is the share of shingle occurrences that they have in common: shared ones over all of both.
With the occurrences of every text in one global order, two texts of at least the similarity share one of the first
n - ceil(similarity * n) + 1 occurrences of each, so an equi-join on these prefixes meets every such pair. Any order is
right; shingles that a sample finds often come last, which keeps common lines out of the prefixes.

Candidates then compare SimHash fingerprints of 256 bits. At a similarity of 0.8 these differ in 39 bits with a deviation
of 6, so the radius of 68 loses less than one pair in a million; unrelated texts differ in 128. Pigeonring chains of that
radius cannot find the candidates: each segment of 8 bits may differ in 2, so that it is no join key, and of unrelated
texts one pair in seven agrees that well on a segment.

Equal texts are one node. A key of up to three nodes gives all its pairs, from sums by key alone. A key of more, a crowd,
gives a star around its least node. Nodes of a crowd that are still apart after that are compared by fingerprint, in blocks
within tasks; those within the radius make families, and the texts of a family are compared in blocks as well. Both put out
stars, so that rows grow with a crowd and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.chains import links
from logloom.llm.common import checkpointed, stored
from logloom.llm.components import connected_components
from logloom.llm.tokens import mix, run_hashes, word_hashes

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
#: One text of SAMPLE is looked at for common shingles, and so many of these at most are told to the tasks (16 bytes each).
SAMPLE, OFTEN, MOST_COMMON = 16, 3, 200_000
#: So many nodes to compare (16 bytes each) go to every task; more are joined by shuffle.
BROADCAST_NODES = 300_000
#: Fingerprints of fewer shingles than this deviate too much to prune by.
FEW = 64
#: 64-bit parts of a fingerprint.
PARTS = 4
_FP = [f"f{i}" for i in range(PARTS)]


def _pieces(texts, most: int = 500_000) -> Iterator[list[bytes]]:
    """texts as lower-cased bytes, in runs of about `most` of them; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if held and size + len(data) > most:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def occurrences(texts, width: int) -> Iterator[np.ndarray]:
    """The sorted hashes (uint64, all different) of each text's shingle occurrences; a shorter text is one shingle."""
    for piece in _pieces(texts):
        words, bounds = word_hashes(piece)
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                yield np.zeros(0, np.uint64)
                continue
            h = np.sort(run_hashes(words[a:b], min(width, b - a)))
            at = np.arange(len(h))
            before = at - np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), at, 0))
            yield np.sort(np.where(before > 0, mix(h + before.astype(np.uint64) * _REPEAT), h)) if before.any() else h


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def wide_simhash(h: np.ndarray, chunk: int = 50_000) -> list[int]:
    """The PARTS signed 64-bit numbers of a text's fingerprint: a bit is set if it is in over half the hashes."""
    out = []
    for part in range(PARTS):
        x, ones = mix(h + np.uint64(2 * part + 1)), np.zeros(64, np.int64)
        for i in range(0, len(x), chunk):
            ones += np.unpackbits(x[i : i + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h)).view(">i8")[0]))
    return out


def signature(h: np.ndarray) -> int:
    """A hash of all of a text's shingle occurrences."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64))


def sketch_column(text: Column, width: int) -> Column:
    """n, sig and the fingerprint's parts: the number of occurrences, a hash of all of them, their SimHash."""

    @F.pandas_udf("n int, sig long, " + ", ".join(f"{f} long" for f in _FP))
    def sketches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [(len(h), signature(h), *wide_simhash(h)) for h in occurrences(texts, width)]
            yield pd.DataFrame(rows, columns=["n", "sig", *_FP]).astype({"n": np.int32} | {c: np.int64 for c in ("sig", *_FP)})

    return sketches(text)


def prefix_column(text: Column, width: int, similarity: float, common) -> Column:
    """sig and keys, the prefix; a text that repeats within a batch has no keys again. common is a broadcast (hashes, counts)."""

    @F.pandas_udf("sig long, keys array<long>")
    def prefixes(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, counts = common.value
        for texts in parts:
            sigs, keys, seen = [], [], set()
            for h in occurrences(texts, width):
                sigs.append(signature(h))
                if sigs[-1] in seen:
                    keys.append(np.zeros(0, np.int64))
                    continue
                seen.add(sigs[-1])
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                weight = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
                keys.append(h[np.lexsort((h, weight))[: prefix_size(len(h), similarity)]].view(np.int64))
            yield pd.DataFrame({"sig": np.array(sigs, np.int64), "keys": pd.Series(keys, dtype=object)})

    return prefixes(text)


def occurrence_column(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def hashes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([h.view(np.int64) for h in occurrences(texts, width)], dtype=object)

    return hashes(text)


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(occurrence_column(F.col("text"), width)).alias("h"))
    often = sample.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "h").limit(MOST_COMMON).toPandas()
    h, c = often["h"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def shared_keys(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """key, sig, m, a, b, x: for each key of m > 1 nodes, its least (a) and greatest (b) node and the XOR of all (x).

    A key of up to three nodes has one row, with sig = a; a crowd has a row for each of its nodes. One shuffle of (key,
    sig) serves the sums and the join.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))
    each = docs.select(prefix_column(F.col("text"), width, similarity, common).alias("p")).select(F.explode("p.keys").alias("key"), "p.sig").repartition("key")
    sums = each.distinct().groupBy("key").agg(F.count("*").alias("m"), F.min("sig").alias("a"), F.max("sig").alias("b"), F.bit_xor("sig").alias("x")).where("m > 1")
    return stored(each.join(sums, "key").where("m > 3 OR sig = a").distinct())


def first_candidates(shared: DataFrame) -> DataFrame:
    """u, v (u < v): all pairs of the keys of two or three nodes, and the stars of the crowds."""
    pair = lambda u, v: F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    a, b = F.col("a"), F.col("b")
    third = F.col("x").bitwiseXOR(a).bitwiseXOR(b)
    pairs = F.when(F.col("m") == 2, F.array(pair(a, b))).when(F.col("m") == 3, F.array(pair(a, b), pair(a, third), pair(third, b))).otherwise(F.array(pair(a, F.col("sig"))))
    return shared.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u < v")


def chain_candidates(nodes: DataFrame) -> DataFrame:
    """u, v (u < v): stars around the least node of each 64-bit SimHash, and the links of the chains between those."""
    f = _FP[0]
    firsts = nodes.groupBy(f).agg(F.min("sig").alias("first"))
    same = nodes.select(f, "sig").join(firsts, f).select(F.col("first").alias("u"), F.col("sig").alias("v"))
    near = links(firsts.select(F.col(f).alias("fp")))
    for side in ("u", "v"):
        near = near.join(firsts.select(F.col(f).alias(side), F.col("first").alias(f"{side}_first")), side)
    near = near.select(F.least("u_first", "v_first").alias("u"), F.greatest("u_first", "v_first").alias("v"))
    return same.union(near).where("u < v")


def _described(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("sig").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *_FP)]), side)
    return pairs


def distance(u: str = "u_", v: str = "v_") -> Column:
    return sum((F.bit_count(F.col(u + f).bitwiseXOR(F.col(v + f))) for f in _FP[1:]), F.bit_count(F.col(u + _FP[0]).bitwiseXOR(F.col(v + _FP[0]))))


def possible(similarity: float, radius: int) -> Column:
    """Whether two described nodes are near enough in size and, if not of few shingles, by fingerprint."""
    return (F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9) & ((F.least("u_n", "v_n") < FEW) | (distance() <= radius))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts have at least the similarity."""
    wanted = pairs.select(F.col("u").alias("sig")).union(pairs.select(F.col("v").alias("sig"))).distinct()
    wanted = checkpointed(wanted.join(nodes.select("sig", "tkey"), "sig"))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text").join(wanted, "tkey").groupBy("sig").agg(F.min("text").alias("text"))
    sets = texts.select("sig", occurrence_column(F.col("text"), width).alias("hs"))
    both = pairs.join(sets.select(F.col("sig").alias("u"), F.col("hs").alias("hu")), "u").join(sets.select(F.col("sig").alias("v"), F.col("hs").alias("hv")), "v")
    overlap = F.size(F.array_intersect("hu", "hv"))
    return checkpointed(both.where(overlap >= similarity * (F.size("hu") + F.size("hv") - overlap) - 1e-9).select("u", "v"))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, h), each node's nearest, as u < v."""
    ways = pairs.select("u", "v", "h").union(pairs.select("v", "u", "h"))
    best = ways.groupBy("u").agg(F.min(F.struct("h", "v")).alias("best"))
    return best.select(F.least("u", "best.v").alias("u"), F.greatest("u", "best.v").alias("v")).distinct()


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    for side in ("u", "v"):
        pairs = pairs.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).drop("c_u", "c_v")


def node_components(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """node, component: nodes connected by pairs of at least the similarity; a node without such a pair has no row."""
    shared = shared_keys(docs, width, similarity)
    pairs = first_candidates(shared).union(chain_candidates(nodes)).distinct()
    pairs = checkpointed(_described(pairs, nodes).where(possible(similarity, radius)).select("u", "v", distance().alias("h")))
    nearest = checkpointed(_nearest(pairs))
    edges = verified(nearest, nodes, docs, width, similarity)
    parts = connected_components(edges)
    rest = checkpointed(_apart(pairs.select("u", "v"), parts).join(nearest, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        edges = checkpointed(edges.union(verified(rest, nodes, docs, width, similarity)))
        parts = connected_components(edges)

    crowd = shared.where("m > 3").select("key", "sig", "m")
    placed = crowd.join(parts, F.col("sig") == F.col("node"), "left").select("key", "sig", "m", F.coalesce("component", "sig").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    placed = checkpointed(placed.join(split, "key").join(nodes.select("sig", "n", *_FP), "sig"))
    if placed.isEmpty():
        return parts
    families = connected_components(close_stars(placed, similarity, radius))
    found = verified_in_blocks(families, parts, nodes, docs, width, similarity)
    return connected_components(edges.union(found))


def _in_blocks(rows: DataFrame, size: Column, by: Column, block: int) -> DataFrame:
    """Copies of rows, one for each pair of blocks (i <= j) of their group that has theirs (b); a group has ceil(size / block)."""
    many = F.greatest(F.lit(1), F.ceil(size / block)).cast("int")
    rows = rows.withColumn("many", many).withColumn("b", F.pmod(F.xxhash64(F.lit(9), by), F.col("many")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    return rows.withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).drop("many", "other")


def star_edges(label: np.ndarray, near: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges (a, b) that join all rows a with those near to them, as few as there are labels to merge. label is changed."""
    out = []
    for a, close in near:
        for x in np.unique(label[close]).tolist():
            if x != label[a]:
                out.append((a, int(close[label[close] == x][0])))
                label[label == x] = label[a]
    return out


def _sides(b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(b == i), np.flatnonzero(b == j)


def close_stars(placed: DataFrame, similarity: float, radius: int, block: int = 2048) -> DataFrame:
    """u, v: edges that connect the nodes of one key (key, m, sig, c, n, fingerprint) which are possible pairs and apart.

    A crowd is compared in blocks within tasks; what comes out are stars, so rows grow with the crowd and not its square.
    """
    rows = _in_blocks(placed, F.col("m"), F.col("sig"), block).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(pdf: pd.DataFrame) -> np.ndarray:
        fp, n, c, sig = pdf[_FP].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64), pdf["c"].to_numpy(), pdf["sig"].to_numpy()
        left, right = _sides(pdf["b"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0])

        def near():
            for a in left:
                away = np.bitwise_count(fp[right] ^ fp[a]).sum(axis=1, dtype=np.int64)
                small, large = np.minimum(n[right], n[a]), np.maximum(n[right], n[a])
                yield a, right[(c[right] != c[a]) & (small >= similarity * large - 1e-9) & ((small < FEW) | (away <= radius))]

        pairs = star_edges(np.arange(len(pdf)), near())
        return sig[np.array(pairs, np.int64).reshape(-1, 2)]

    def groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each group of a sorted partition, whole, however the batches cut it."""
        held: list[pd.DataFrame] = []
        for pdf in parts:
            keys = pdf[["key", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for at, to in zip(cuts, cuts[1:]):
                if at or (held and tuple(held[-1][["key", "i", "j"]].iloc[-1]) != tuple(keys[0])):
                    yield pd.concat(held)
                    held = []
                held.append(pdf.iloc[at:to])
        if held:
            yield pd.concat(held)

    def stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for pdf in groups(parts):
            out.append(compare(pdf))
            size += len(out[-1])
            if size > 50_000:
                yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])
                out, size = [], 0
        if size:
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])

    return rows.mapInPandas(stars, "u long, v long")


def near_in_block(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], apart, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of left with those rows of right that are apart from it and share enough occurrences with it."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owners = np.repeat(np.arange(len(right)), sizes[right])
    everything = np.concatenate([sets[x] for x in right]) if len(right) else np.zeros(0, np.int64)
    order = np.argsort(everything, kind="stable")
    everything, owners = everything[order], owners[order]
    for a in left:
        first, last = np.searchsorted(everything, sets[a]), np.searchsorted(everything, sets[a], side="right")
        size = last - first
        # The places first..last of all of a's occurrences, one after the other.
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        shared = np.bincount(owners[at], minlength=len(right))
        enough = shared >= similarity * (sizes[a] + sizes[right] - shared) - 1e-9
        yield a, right[enough & apart(a, right)]


def verified_in_blocks(families: DataFrame, parts: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float, block: int = 512) -> DataFrame:
    """u, v: edges that connect the nodes of a family (node, component) whose texts have at least the similarity and are
    in different parts. A node's set travels once for each block of its family."""
    own = families.select(F.col("node").alias("sig"), F.col("component").alias("family"))
    sizes = own.groupBy("family").agg(F.count("*").alias("m"))
    own = own.join(sizes, "family").join(parts, F.col("sig") == F.col("node"), "left").select("sig", "family", "m", F.coalesce("component", "sig").alias("c"))
    own = checkpointed(own.join(nodes.select("sig", "tkey"), "sig"))
    some = F.broadcast(own) if own.count() <= BROADCAST_NODES else own
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text").join(some, "tkey").groupBy("sig", "family", "m", "c").agg(F.min("text").alias("text"))
    sets = _in_blocks(texts.select("sig", "family", "m", "c", occurrence_column(F.col("text"), width).alias("hs")), F.col("m"), F.col("sig"), block)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf["b"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0])
        sig, c = pdf["sig"].to_numpy(), pdf["c"].to_numpy()
        label = np.unique(c, return_inverse=True)[1].astype(np.int64)
        hs = [np.asarray(x, np.int64) for x in pdf["hs"]]
        pairs = star_edges(label, near_in_block(left, right, hs, lambda a, others: label[others] != label[a], similarity))
        return pd.DataFrame(sig[np.array(pairs, np.int64).reshape(-1, 2)], columns=["u", "v"])

    return checkpointed(sets.groupBy("family", "i", "j").applyInPandas(verify, "u long, v long"))


def near_copies(docs: DataFrame, row: Column, *extra: Column, width: int = 5, similarity: float = 0.8, radius: int = 68) -> DataFrame:
    """row, doc_id, extra columns, c: each row of docs with its component c, the same for rows connected by pairs of at
    least the similarity. Texts without words are one component."""
    tkey = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey")
    prints = docs.select("doc_id", row.alias("row"), *extra, tkey, sketch_column(F.col("text"), width).alias("p"))
    prints = stored(prints.select(*[c for c in prints.columns if c != "p"], "p.*"))
    nodes = stored(prints.groupBy("sig").agg(F.first("n").alias("n"), *[F.first(f).alias(f) for f in _FP], F.min("tkey").alias("tkey")))
    parts = node_components(docs, nodes, width, similarity, radius)
    return prints.drop("n", "tkey", *_FP).join(parts, F.col("sig") == F.col("node"), "left").withColumn("c", F.coalesce("component", "sig")).drop("node", "component", "sig")
