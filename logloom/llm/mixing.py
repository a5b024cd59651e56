"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources sorted by code point (null last) weigh 5, 2, 1, repeating. They share `share` times all words; no
target exceeds `max_repeat` times its source's words, and what is over goes to the others by weight.

Draw: a document's words fall into blocks of `block_words`. A source's blocks are permuted by a seeded hash, once
for each pass over the source; the mix takes whole passes and then a prefix of the last permutation, whose last block
is cut to length, so that the words taken equal the rounded target. The number of blocks that a source gives is its
quota. A splitting tree halves the quotas again and again: each node draws its left half from a multivariate
hypergeometric distribution, until each of `n_shards` output shards has its exact quota of each source. Ranks in the
permutation then deal disjoint blocks to the shards, and a second hash gives the order within a shard.

Ranks are counted in hash buckets of a source, so a hot source is spread over many tasks. Only counts by source (one
row each) meet in one task: targets, quotas and the tree hang on all sources at once, and their number bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import checkpointed, free_names, space_word_count, stored

WEIGHTS = (5, 2, 1)
#: The type of the blocks drawn from a document.
DRAWN = "array<struct<shard:int,place:bigint,pass:int,first_word:bigint,n_words:bigint>>"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """source, source_size, weight, target for each source of sizes (source, size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("n", F.row_number().over(by_ratio)).withColumn(
        "level",
        F.try_divide(
            F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        ),
    )
    free = F.col("ratio") > F.col("level")
    s = s.withColumn("first_free", F.min(F.when(free, F.col("n"))).over(everything))
    s = s.withColumn("free_level", F.max(F.when(F.col("n") == F.col("first_free"), F.col("level"))).over(everything))
    target = F.when(F.col("n") >= F.col("first_free"), F.least(F.col("cap"), F.col("weight") * F.col("free_level"))).otherwise(F.col("cap"))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _steps(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items out of `total`, `marked` of them marked, are marked: the value at uniform u.

    Weights relative to the mode are summed over ten standard deviations on both sides, in double precision.
    """
    n, k, d = (x.cast("double") for x in (total, marked, drawn))
    low, high = F.greatest(F.lit(0), marked + drawn - total), F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2))))
    sd = F.sqrt(F.greatest(F.lit(0.0), d * k * (n - k) * (n - d)) / F.greatest(F.lit(1.0), n * n * (n - 1)))
    reach = F.ceil(sd * 10 + 10)
    top, bottom = F.least(high, mode + reach), F.greatest(low, mode - reach)
    rises = lambda x: (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))  # noqa: E731  weight of x + 1 over that of x
    falls = lambda x: x * (n - k - d + x) / ((k - x + 1) * (d - x + 1))  # noqa: E731  weight of x - 1 over that of x

    def walk(ratio, steps, aim=None):
        """The summed weights; with an aim, the first step at which they reach it."""

        def add(acc, x):
            p = acc["p"] * ratio(x.cast("double"))
            s = acc["s"] + p
            hit = acc["hit"] if aim is None else F.coalesce(acc["hit"], F.when(s >= aim, x))
            return F.struct(p.alias("p"), s.alias("s"), hit.alias("hit"))

        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"), F.lit(None).cast("bigint").alias("hit"))
        return F.aggregate(steps, start, add, lambda acc: acc["s"] if aim is None else acc["hit"])

    def pick(w):
        aim = u * (w["above"] + w["below"] + 1)
        drawn_up = F.coalesce(walk(rises, w["up"], aim - 1) + 1, w["top"])
        drawn_down = F.coalesce(walk(falls, w["down"], aim - 1 - w["above"]) - 1, w["bottom"])
        return F.when(aim <= 1, w["mode"]).when(aim <= w["above"] + 1, drawn_up).otherwise(drawn_down).cast("bigint")

    def weigh(m):
        up, down = _steps(m["mode"], m["top"] - 1), F.reverse(_steps(m["bottom"] + 1, m["mode"]))
        sides = F.struct(m["mode"].alias("mode"), m["top"].alias("top"), m["bottom"].alias("bottom"), up.alias("up"), down.alias("down"), walk(rises, up).alias("above"), walk(falls, down).alias("below"))
        return _let(sides, pick)

    around = lambda m: F.struct(m.alias("mode"), F.least(high, m + reach).alias("top"), F.greatest(low, m - reach).alias("bottom"))
    return F.when(drawn * marked <= 0, F.lit(0).cast("bigint")).otherwise(_let(mode, lambda m: _let(around(m), weigh)))


def shard_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """source, ends: for each source, the running sums of its quotas (source, blocks) by shard, from the splitting tree."""
    entry = "array<struct<source:string,left:bigint,blocks:bigint>>"
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("source", F.lit(0).cast("bigint").alias("left"), F.col("blocks").cast("bigint").alias("blocks")))).alias("items")).withColumn("path", F.lit(1))
    while n_shards > 1:
        n_shards //= 2

        def split(acc, x):
            u = (F.pmod(F.xxhash64(F.lit(seed), F.col("path"), x["source"], x["source"].isNull()), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            done = lambda left: F.struct(x["source"].alias("source"), left.alias("left"), x["blocks"].alias("blocks"))
            more = lambda left: F.struct((acc["total"] - x["blocks"]).alias("total"), (acc["draw"] - left).alias("draw"), F.concat(acc["out"], F.array(done(left))).alias("out"))
            return _let(hypergeometric(acc["total"], x["blocks"], acc["draw"], u), more)

        total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["blocks"])
        tree = tree.withColumn("total", total)
        start = F.struct(F.col("total").alias("total"), F.shiftright("total", 1).alias("draw"), F.array().cast(entry).alias("out"))
        tree = tree.withColumn("items", F.aggregate("items", start, split, lambda acc: acc["out"]))
        half = lambda take: F.transform("items", lambda x: F.struct(x["source"].alias("source"), F.lit(0).cast("bigint").alias("left"), take(x).alias("blocks")))
        sides = F.array(
            F.struct(half(lambda x: x["left"]).alias("items"), (F.col("path") * 2).alias("path")),
            F.struct(half(lambda x: x["blocks"] - x["left"]).alias("items"), (F.col("path") * 2 + 1).alias("path")),
        )
        tree = tree.select(F.explode(sides).alias("side")).select("side.items", "side.path")
    leaves = tree.select("path", F.explode("items").alias("x")).select("path", "x.source", "x.blocks")
    return leaves.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("path", "blocks"))).alias("x")).select(
        "source",
        F.transform("x", lambda e, i: F.aggregate(F.slice("x", 1, i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y["blocks"])).alias("ends"),
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source, size, mark (a hash of the text). A row of its own for each input row, also where doc_id repeats or is null."""
    sized = docs.select("doc_id", "source", space_word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    return checkpointed(sized.withColumn("uid", F.monotonically_increasing_id()))


def mixture(sized: DataFrame, targets: DataFrame, block_words: int = 512, n_shards: int = 16, bucket_bits: int = 10, seed: int = 7, max_repeat: int = 2) -> DataFrame:
    """The mix, a row for each drawn block: shard, place, uid, pass, block, first_word, n_words.

    Sorting a shard by place gives its order. Words of a block: first_word to first_word + n_words, from 0.
    Documents without words give no block; an empty table gives no rows. The same rows and seed give the same mix, in whatever
    order or partitions they come; which of two rows equal in doc_id, source and text is which makes no difference.
    """
    quota = F.least(F.round("target").cast("bigint"), F.col("source_size") * max_repeat)
    # A source's quota of words: whole passes over it, and `rest` words of one more.
    plan = targets.where("source_size > 0").select(F.col("source").alias("s"), F.floor(quota / F.col("source_size")).alias("whole"), (quota % F.col("source_size")).alias("rest"))
    n_blocks = F.ceil(F.col("size") / block_words)
    rows = sized.where("size > 0").join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int")))).where("pass < whole OR rest > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    rows = rows.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("bigint"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "pass", "doc_id", "source", "size", "mark", "block"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bucket_bits)).withColumn("partial", F.col("pass") == F.col("whole"))
    rows = rows.select("uid", "source", "pass", "block", "words", "key", "bucket", "partial", "rest")
    # What comes before a bucket in its source's permutation, from counts by bucket.
    upto = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source", "pass", "bucket").agg(F.sum("words").alias("w")).select(
        F.col("source").alias("s"), F.col("pass").alias("p"), F.col("bucket").alias("b"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("before")
    )
    # Only what begins before the end of the quota is drawn; within a bucket, by key.
    drawn = rows.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("bucket") == F.col("b"))).where("NOT partial OR before < rest")
    in_bucket = Window.partitionBy("source", "pass", "bucket").orderBy("key", "uid", "block")
    start = F.col("before") + F.sum("words").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    drawn = drawn.withColumn("start", start).where("NOT partial OR start < rest")
    drawn = drawn.withColumn("n_words", F.when(F.col("partial"), F.least("words", F.col("rest") - F.col("start"))).otherwise(F.col("words")))
    # Blocks of equal key are told apart by their rank among these, not by a row's number, which hangs on how rows came in.
    same_key = F.row_number().over(in_bucket) - F.rank().over(Window.partitionBy("source", "pass", "bucket").orderBy("key"))
    drawn = drawn.withColumns({"nth": F.row_number().over(in_bucket), "twin": same_key}).drop("s", "p", "b")
    upto_all = Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = drawn.groupBy("source", "pass", "bucket").agg(F.count("*").alias("n"))
    quotas = shard_quotas(ranks.groupBy("source").agg(F.sum("n").alias("blocks")), n_shards, seed).withColumnRenamed("source", "qs")
    ranks = ranks.select("source", F.col("pass").alias("p"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(upto_all), F.lit(0)).alias("blocks_before"))
    ranks = ranks.join(quotas, F.col("source").eqNullSafe(F.col("qs"))).drop("qs").withColumnRenamed("source", "s")
    dealt = drawn.join(ranks, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("bucket") == F.col("b")))
    rank = F.col("blocks_before") + F.col("nth")
    return dealt.select(
        F.size(F.filter("ends", lambda e: e < rank)).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "key", "twin").alias("place"),
        "uid", "pass", "block", (F.col("block") * block_words).alias("first_word"), "n_words",
    )


def drawn_documents(docs: DataFrame, sized: DataFrame, **options) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, taken, drawn for each row of sized_documents(docs); drawn is empty where nothing is taken."""
    targets = checkpointed(source_targets(sized))
    blocks = mixture(sized, targets, **options)
    block = F.struct("shard", "place", "pass", "first_word", "n_words")
    taken = blocks.groupBy("uid").agg(F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(block)).alias("drawn"))
    by_source = targets.withColumnRenamed("source", "s")
    out = sized.join(by_source, F.col("source").eqNullSafe(F.col("s"))).join(taken, "uid", "left")
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("drawn", F.array().cast(DRAWN)).alias("drawn"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, drawn for each row of documents: taken sums the words of drawn.

    drawn lists the blocks that the mix takes of that row: shard, place (sorting a shard by it gives its order), pass,
    first_word and n_words. Null texts have size 0 and give nothing. A source without words has target 0. Null is a
    source like any other. An empty table gives no rows.
    """
    return drawn_documents(docs, sized_documents(docs), **options).drop("uid")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes words from, with size, source_size, target, taken and drawn.

    A row that repeats is a row of its own. Where docs has a column of one of these names, the new one gets a trailing _.
    """
    new = ("size", "source_size", "target", "taken", "drawn")
    uid, *names = free_names(docs.columns, "uid", *new)
    # The numbers of rows hold for one written copy of docs; without it a retried task could deal them anew.
    numbered = stored(docs.withColumn(uid, F.monotonically_increasing_id()))
    sized = numbered.select(F.col(uid).alias("uid"), "doc_id", "source", space_word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    drawn = drawn_documents(docs, sized, **options).where("taken > 0").select(F.col("uid").alias(uid), *[F.col(c).alias(n) for c, n in zip(new, names)])
    return numbered.join(drawn, uid).drop(uid)
