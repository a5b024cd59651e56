"""Shards along a Hilbert curve, so that a filter on any of several metadata columns reads few of them.

Each dimension is quantised to 2 ** BITS cells of about equal numbers of rows; a row's cells together are its place in a
grid, the grid's places are put in the order in which a Hilbert curve visits them, and the ordered rows are cut into runs.
Neighbours on the curve are neighbours in the grid, so a run covers a narrow range of every dimension at once.

Only numbers travel: a first pass writes each row's dimensions, size and checksum, without its text. The quantiles come from
exact counts: of a number by its leading bits, of a text by its value, in an order that range partitions share. The curve
is computed for the grid's places, at most 2 ** (BITS * dimensions), not for rows. A crowded place is split into pieces of
about PIECE rows by a hash of the row; places and pieces have counts, so that a row's rank is the count before its piece
and its rank within it, and no task orders more than a piece. All of it is native, and the same at every size.

Null dimensions are the least; a null text has no bytes. Repeated rows are rows of their own, and which of two equal rows
comes first makes no difference. An empty table gives no rows. Columns of any name stay, beside those added here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import checkpointed, free_names, numbered, stored

#: Bits of a dimension's cells.
BITS = 4
#: Tasks that compute the curve for the places, which take some 0.3 ms each.
CURVE_TASKS = 32
#: Rows of a place that are put in order together.
PIECE = 50_000
#: Bytes that count for a row besides those of its text.
ROW_BYTES = 16
#: Characters of a text dimension that its order goes by.
NAME = 64
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
LAWS = ("rows", "bytes")


def leading_bits(n: Column) -> Column:
    """A number's sign, magnitude and six leading bits, in the order of the numbers; at most 16 384 values."""
    size = F.when(n < 0, -(n + 1)).otherwise(n)
    length = F.length(F.bin(size))
    top = F.when(length > 6, F.call_function("shiftright", size, length - 7).bitwiseAND(F.lit(63))).otherwise(size)
    code = F.when(length > 6, length * 64 + top).otherwise(size)
    return F.when(n < 0, -code - 1).otherwise(code).cast("long")


def coded(df: DataFrame, column: str) -> Column:
    """A dimension's value as (number, text), of which one is used, in the order of the values."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.struct(F.lit(0).cast("long").alias("number"), F.coalesce(F.substring(column, 1, NAME), F.lit("")).alias("name"))
    whole = F.col(column).cast("long")
    return F.struct(F.coalesce(leading_bits(whole), F.lit(-(1 << 20))).alias("number"), F.lit("").alias("name"))


def cells(coded_rows: DataFrame, dims: list[str], bits: int) -> dict[str, list]:
    """For each dimension the least value (number, name) of each of its cells, at most 2 ** bits, by the counts of all rows."""
    long = coded_rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims))).alias("x"))
    counts = long.groupBy("x.dim", "x.value.number", "x.value.name").agg(F.count("*").alias("n"))
    placed = numbered(counts, ["dim", "number", "name"], "at")
    # Running counts in the order of `at`: by blocks of it, then within each block.
    block = F.call_function("div", F.col("at"), F.lit(4096))
    whole = placed.withColumn("block", block)
    sums = whole.groupBy("dim", "block").agg(F.sum("n").alias("s"))
    by_block = sums.select("dim", "block", (F.sum("s").over(Window.partitionBy("dim").orderBy("block")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("dim")).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("dim", "block").orderBy("at")) - F.col("n")
    running = whole.withColumn("inside", inside).join(by_block, ["dim", "block"])
    middle = 2 * (F.col("before") + F.col("inside")) + F.col("n")
    cell = F.least(F.floor(middle * F.lit(1 << bits) / (2 * F.col("total"))), F.lit((1 << bits) - 1)).cast("int")
    firsts = running.withColumn("cell", cell).groupBy("dim", "cell").agg(F.min(F.struct("number", "name")).alias("least"))
    found: dict[str, list] = {d: [] for d in dims}
    for r in firsts.orderBy("dim", "cell").collect():
        found[r["dim"]].append((r["cell"], r["least"]["number"], r["least"]["name"]))
    return found


def place(dims: list[str], found: dict[str, list], bits: int) -> Column:
    """A row's place in the grid: its cell in each dimension, bits a dimension, the first dimension highest."""
    out = F.lit(0).cast("long")
    for d in dims:
        number, name = F.col(d)["number"], F.col(d)["name"]
        cell = F.lit(0)
        for at, least, text in found[d][1:]:
            cell = F.when((number > least) | ((number == least) & (name >= text)), at).otherwise(cell)
        out = F.shiftleft(out, bits).bitwiseOR(cell.cast("long"))
    return out


def curve_index(at: Column, dims: int, bits: int) -> Column:
    """The index on the Hilbert curve of a place in a grid of dims dimensions of 2 ** bits cells.

    The coordinates are turned step by step, from the highest bit down, into the transposed index, whose bits are then dealt
    out in turn (Skilling, Programming the Hilbert curve, 2004).
    """
    mask = (1 << bits) - 1
    axes = F.array(*(F.shiftright(at, bits * (dims - 1 - d)).bitwiseAND(F.lit(mask)).cast("int") for d in range(dims)))
    turns = F.array(*(F.struct(F.lit(d).alias("axis"), F.lit(1 << b).alias("bit")) for b in range(bits - 1, 0, -1) for d in range(dims)))

    def turn(x: Column, s: Column) -> Column:
        low, first, this = s["bit"] - 1, F.element_at(x, 1), F.element_at(x, s["axis"] + 1)
        up = this.bitwiseAND(s["bit"]) != 0
        swap = F.when(up, 0).otherwise(first.bitwiseXOR(this).bitwiseAND(low))
        flip = F.when(up, low).otherwise(0)
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, F.when(s["axis"] == 0, flip).otherwise(flip.bitwiseXOR(swap))).when(k == s["axis"], swap).otherwise(0)))

    turned = F.aggregate(turns, axes, turn)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(dims - 1)), turned, lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.element_at(x, i))).otherwise(v))) if dims > 1 else turned
    last = F.element_at(gray, dims)
    tail = reduce(Column.bitwiseXOR, (F.when(last.bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0) for b in range(bits - 1, 0, -1)), F.lit(0))
    taken = F.array(*(F.struct(F.lit(d + 1).alias("axis"), F.lit(b).alias("bit")) for b in range(bits - 1, -1, -1) for d in range(dims)))
    one = lambda s: F.call_function("shiftright", F.element_at(gray, s["axis"]).bitwiseXOR(tail), s["bit"]).bitwiseAND(F.lit(1))
    return F.aggregate(taken, F.lit(0).cast("long"), lambda n, s: n * 2 + one(s).cast("long"))


def shard(docs: DataFrame, shards: int, law: str = "rows", dims=DIMENSIONS, bits: int = BITS, piece: int = PIECE) -> DataFrame:
    """docs without its text, with size, text_crc32, law, shard, slot and grown_shard (null under these laws).

    Law rows cuts the ordered rows into runs whose counts are at most one apart; bytes cuts them where the running size
    passes each shard's share, so that sizes differ by less than the largest row's. slot counts a shard's rows from 0.
    A column of docs of one of these names gives way to the new one.
    """
    if law not in LAWS:
        raise ValueError(f"unknown law {law!r}; one of {', '.join(LAWS)}")
    if len(dims) * bits > 20:
        raise ValueError("a grid of more than 2 ** 20 places")
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c != "text" and c.lower() not in added]
    taken = [*docs.columns, *added]
    size, crc, *codes = free_names(taken, "size_", "crc_", *(f"dim{n}" for n in range(len(dims))))
    grid, part, salt, rank, before = free_names([*taken, size, crc, *codes], "grid", "part", "salt", "rank", "before")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.xxhash64(F.crc32(text.cast("binary")), *(F.col(c) for c in kept if dict(docs.dtypes)[c].partition("<")[0] != "map"))
    measured = docs.withColumns({size: F.octet_length(text).cast("long") + ROW_BYTES, crc: F.when(F.col("text").isNotNull(), F.crc32(F.col("text").cast("binary"))), salt: own} | {code: coded(docs, d) for code, d in zip(codes, dims, strict=True)})
    rows = stored(measured.select(*kept, size, crc, salt, *codes))
    cuts = cells(rows, codes, bits)
    rows = rows.withColumn(grid, place(codes, cuts, bits)).drop(*codes)

    here = rows.groupBy(grid).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    visited = here.repartition(CURVE_TASKS, grid).withColumn("curve", curve_index(F.col(grid), len(dims), bits))
    along = Window.orderBy("curve")  # at most 2 ** (bits * dimensions) rows, whatever the table's size
    before_place = checkpointed(visited.select(grid, F.greatest(F.ceil(F.col("n") / F.lit(piece)), F.lit(1)).alias("pieces"), (F.sum("n").over(along) - F.col("n")).alias("rows_before"), (F.sum("bytes").over(along) - F.col("bytes")).alias("bytes_before")))
    total = here.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    split = rows.join(F.broadcast(before_place), grid).withColumn(part, F.pmod(F.col(salt), F.col("pieces")))
    sums = split.groupBy(grid, part).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max("rows_before").alias("r"), F.max("bytes_before").alias("b"))
    inside = Window.partitionBy(grid).orderBy(part)
    before_piece = sums.select(grid, part, F.struct((F.col("r") + F.sum("n").over(inside) - F.col("n")).alias("rows"), (F.col("b") + F.sum("bytes").over(inside) - F.col("bytes")).alias("bytes")).alias(before))
    order = Window.partitionBy(grid, part).orderBy(*(F.col(c) for c in ("doc_id",) if c in kept), salt)
    ranked = split.drop("pieces", "rows_before", "bytes_before").withColumns({rank: F.row_number().over(order), "bytes_": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)})
    ranked = ranked.join(before_piece, [grid, part]).withColumn(rank, F.col(rank) - 1 + F.col(before)["rows"])

    out = [*kept, F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.lit(law).alias("law")]
    grown = F.lit(None).cast("int").alias("grown_shard")
    if law == "rows":
        at = F.call_function("div", F.col(rank) * shards, F.lit(max(total[0], 1)))
        start = F.call_function("div", at * total[0] + (shards - 1), F.lit(shards))
        return ranked.select(*out, at.cast("int").alias("shard"), (F.col(rank) - start).cast("long").alias("slot"), grown)
    middle = 2 * (F.col(before)["bytes"] + F.col("bytes_")) + F.col(size)
    share = F.call_function("div", middle.cast("decimal(38,0)") * shards, F.lit(2 * max(total[1], 1)).cast("decimal(38,0)"))
    placed = stored(ranked.withColumn("shard", F.least(share, F.lit(shards - 1)).cast("int")).drop(before, "bytes_"))
    starts = placed.groupBy("shard").agg(F.min(rank).alias("start_"))
    return placed.join(F.broadcast(starts), "shard").select(*out, "shard", (F.col(rank) - F.col("start_")).cast("long").alias("slot"), grown)


def shard_ranges(sharded: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """shard, n_rows, bytes, and for each dimension its least and greatest value and whether there are nulls: what a reader prunes by."""
    bounds = (f(d).alias(f"{name}_{d}") for d in dims for name, f in (("least", F.min), ("greatest", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull()))))
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *bounds)


def shards_with(ranges: DataFrame, **wanted) -> DataFrame:
    """The shards that can hold a row whose dimensions lie within the given (least, greatest) bounds."""
    meets = ((F.col(f"least_{d}") <= F.lit(hi)) & (F.col(f"greatest_{d}") >= F.lit(lo)) for d, (lo, hi) in wanted.items())
    return ranges.where(reduce(lambda a, b: a & b, meets)).select("shard")


def write_shards(docs: DataFrame, sharded: DataFrame, keys: list[str], path: str) -> None:
    """docs, with their texts, as Parquet files of one shard each, a folder for a shard, beside the ranges that prune them.

    keys tell rows of docs and of sharded apart; a row's shard and slot come from sharded, and a file is sorted by slot.
    """
    rows = docs.join(sharded.select(*keys, "shard", "slot"), keys)
    rows.repartition("shard", F.call_function("div", F.col("slot"), F.lit(1_000_000))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/data")
    shard_ranges(sharded).write.parquet(f"{path}/ranges")
