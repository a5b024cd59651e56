"""Benchmark decontamination with DataFrame functions only.

Which pairs: a window similar enough to an item must hold one of the item's rarest shingles, however they are chosen, if
those left out weigh too little to reach the similarity. A join on the rarest shingles finds the texts to look at, with
their items; only of these texts are all shingles of the item placed.

Which windows: every item-sized window that holds enough of the item's shingles to reach the similarity, in any order.

Which of them: windows and items get SimHash fingerprints of their shingles, cut into radius + 1 blocks; two fingerprints
within the radius agree on a block at least, so windows that agree on none with their item go, then those beyond the
radius. What is left is verified by the exact weighted-shingle similarity: shared occurrences over all occurrences.

A SimHash of 64 bits differs in about 10 bits, with a deviation of 3, at a similarity of 0.8, so the default radius of 24
loses none in practice, while 97 of 100 unrelated windows stop there. For such a radius the blocks have 2 or 3 bits, and
nearly every pair agrees on one of 25: they cannot find the pairs, which is why the rarest shingles do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import ALNUM_GAP, checkpointed, free_names, stored

#: An index of up to this many shingles (about 40 bytes each) goes to every task; a larger one is joined by shuffle.
BROADCAST_SHINGLES = 500_000


def plain_words(text: Column) -> Column:
    """The alphanumeric words of a text, all letters lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), lambda w: w != "")


def _shingles(words: str, n: Column, width: int) -> Column:
    """XXH64 of each `width` consecutive words of an array of n; none if it is shorter."""
    at = F.when(n >= width, F.sequence(F.lit(0), n.cast("int") - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def _own_shingles(words: str, width: int) -> Column:
    """Shingles of an array of words; of the whole array if it is shorter than `width`."""
    n = F.size(words)
    short = F.when(n > 0, F.array(F.xxhash64(*[F.get(words, F.lit(k)) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= width, _shingles(words, n, width)).otherwise(short)


def _occurrences(hashes: str) -> Column:
    """A hash for each occurrence, so that sharing occurrences is sharing these."""
    s = F.array_sort(hashes)
    return F.transform(s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x)))


def simhash(hashes: str) -> Column:
    """64 bits, each set if it is set in over half the hashes. Four bits are counted at a time, in 16 bits each (up to 65535 hashes)."""
    four = f"aggregate({hashes}, 0L, (a, h) -> a + (shiftright(h, b) & 281479271743489L))"
    bits = " | ".join(f"if((shiftrightunsigned(n, {k}) & 65535L) * 2 > size({hashes}), shiftleft(1L, b + {k}), 0L)" for k in (0, 16, 32, 48))
    fast = f"aggregate(sequence(0, 15), 0L, (acc, b) -> acc | transform(array({four}), n -> {bits})[0])"
    slow = f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * aggregate({hashes}, 0, (a, h) -> a + cast(shiftright(h, b) & 1L as int)) > size({hashes}), shiftleft(1L, b), 0L))"
    return F.expr(f"if(size({hashes}) < 65536, {fast}, {slow})")


def block_masks(radius: int) -> list[int]:
    """The bits of each of radius + 1 blocks of a fingerprint, as signed longs."""
    n, out, at = radius + 1, [], 0
    for i in range(n):
        bits = 64 // n + (i < 64 % n)
        mask = ((1 << bits) - 1) << at
        out.append(mask - (1 << 64) if mask >> 63 else mask)
        at += bits
    return out


def _item_tables(benchmark: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (iid, item_id, n, hs), their shingles (iid, n, all, h), and of these the rarest (iid, n, h), whose absence rules an item out."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    items = checkpointed(items.withColumn("hs", _own_shingles("words", width)).withColumn("iid", F.monotonically_increasing_id()).drop("words"))
    each = items.select("iid", "n", F.size("hs").alias("all"), F.explode("hs").alias("h")).groupBy("iid", "n", "all", "h").agg(F.count("*").alias("weight"))
    df = each.groupBy("h").agg(F.count("*").alias("df"))
    before = Window.partitionBy("iid").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    index = checkpointed(each.join(df, "h").withColumn("held", F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # All from here on must weigh at least the similarity times the whole, or the item could be missed.
    rarest = index.where(F.col("all") - F.col("held") >= F.ceil(F.col("all") * similarity - 1e-9))
    return items, index.select("iid", "n", "all", "h"), rarest.select("iid", "n", "h")


def window_starts(places: Column, n: Column, width: Column, least: Column) -> Column:
    """Starts of the windows of n words that hold `least` or more of the shingles at places (sorted; runs of width words)."""
    size = F.size(places)
    nth = F.when(size >= least, F.sequence(F.lit(1), size - least + 1)).otherwise(F.array().cast("array<int>"))
    lasts = lambda j: F.element_at(places, j + least - 1) - n + width  # noqa: E731  the window that ends with the last of them
    runs = F.transform(nth, lambda j: F.when(lasts(j) <= F.element_at(places, j), F.sequence(lasts(j), F.element_at(places, j))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(runs))


def _agree(a: str, b: str, radius: int) -> Column:
    """Whether two fingerprints agree on one of radius + 1 blocks, and then differ in at most radius bits."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    same = [differ.bitwiseAND(F.lit(mask)) == 0 for mask in block_masks(radius)]
    return reduce(lambda x, y: x | y, same) & (F.bit_count(differ) <= radius)


def leaks_by_text(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """key, item_id, similarity, first_word, n_words: the best window for each text (by text_key) that holds an item."""
    items, index, rarest = _item_tables(benchmark, width, similarity)
    shape = index.agg(F.count("*").alias("rows"), F.collect_set(F.least("n", F.lit(width))).alias("widths")).first()
    small = (lambda df: F.broadcast(df)) if shape["rows"] <= BROADCAST_SHINGLES else (lambda df: df)
    texts = docs.select(text_key().alias("key"), "text")
    none = docs.sparkSession.createDataFrame([], f"key struct<a:bigint,b:bigint>, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, first_word int, n_words int")
    if not shape["widths"]:
        return none

    def placed(worded: DataFrame, table: DataFrame, *more: str) -> DataFrame:
        """key, iid and more for each place of a text's shingles in the table."""
        out = None
        for w in sorted(shape["widths"]):
            here = worded.select("key", F.posexplode(_shingles("words", F.size("words"), w)).alias("pos", "h"))
            met = here.join(small(table.where(F.least("n", F.lit(width)) == w)), "h").select("key", "iid", *more)
            out = met if out is None else out.unionByName(met)
        return out

    suspects = checkpointed(placed(texts.select("key", plain_words(F.col("text")).alias("words")), rarest).distinct())
    # Few texts are suspects, so their keys usually go to the tasks; Spark decides by the size of what was written.
    keys = stored(suspects.select("key").distinct())
    hit = checkpointed(texts.join(keys, "key").groupBy("key").agg(F.min("text").alias("text")).select("key", plain_words(F.col("text")).alias("words")))
    found = placed(hit, index, "n", "all", "pos").join(suspects, ["key", "iid"]).groupBy("key", "iid", "n", "all").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    # Of a whole window, as many shingles as the item has, more must be shared than of one that an end of the text cuts.
    n, size = F.col("n"), F.col("size")
    at = lambda share: window_starts(F.col("places"), n, F.least("n", F.lit(width)), F.ceil(F.col("all") * share - 1e-9).cast("int"))
    cut_off = F.filter(at(similarity), lambda s: (s < 0) | (s + n > size))
    found = found.join(hit.select("key", F.size("words").alias("size")), "key")
    starts = found.select("key", "iid", "n", F.array_distinct(F.concat(at(2 * similarity / (1 + similarity)), cut_off)).alias("starts")).where(F.size("starts") > 0)
    cut = lambda s: F.struct(F.greatest(s, F.lit(0)).alias("first_word"), F.slice("words", F.greatest(s, F.lit(0)) + 1, F.col("n") + F.least(s, F.lit(0))).alias("words"))
    window = hit.join(starts, "key").select("key", "iid", F.explode(F.transform("starts", cut)).alias("w")).select("key", "iid", "w.first_word", "w.words")
    window = window.where(F.size("words") > 0).withColumn("hs", _own_shingles("words", width)).select("key", "iid", "first_word", F.size("words").alias("n_words"), "hs")
    known = items.withColumn("ifp", simhash("hs")).select("iid", "item_id", "ifp", _occurrences("hs").alias("ihs"))
    close = window.withColumn("fp", simhash("hs")).join(small(known), "iid").where(_agree("fp", "ifp", radius)).withColumn("hs", _occurrences("hs"))
    shared = F.size(F.array_intersect("hs", "ihs"))
    sure = close.withColumn("similarity", shared / (F.size("hs") + F.size("ihs") - shared)).where(F.col("similarity") >= similarity - 1e-12)
    best = sure.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words")).alias("best"))
    return best.select("key", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), "best.n_words")


def text_key() -> Column:
    """128 bits of hash for a text."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window for each document that holds an item.

    Words are lower-cased alphanumeric ones, so that signs and spacing do not matter. An item of fewer than `width` words
    is one shingle; items without words, null ones too, are in no document. Rows that share a doc_id or an item_id
    are taken together: a pair is in the result once. Windows at the ends of a text may be shorter than the item. Null,
    empty and very long texts are texts like any other. Empty tables give no rows.
    """
    leaks = leaks_by_text(docs, benchmark, width, similarity, radius)
    each = docs.select("doc_id", text_key().alias("key")).join(stored(leaks), "key")
    best = each.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), "best.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; doc_id and other columns, whatever their names, play no part."""
    (key,) = free_names(docs.columns, "key")
    leaks = stored(leaks_by_text(docs, benchmark, **options).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, text_key()).join(leaks, key, "left_anti").drop(key)
