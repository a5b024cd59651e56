"""Hilbert sharding: the curve, the laws, the order, and what pruning gains."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import queries, sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark, dims, bits):
    rows = spark.range(1 << dims * bits).select("id", sharding.curve_index(F.col("id"), dims, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << dims * bits))
    axes = [[r.id >> bits * d & (1 << bits) - 1 for d in range(dims)] for r in rows]
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for a, b in zip(axes, axes[1:], strict=False))


def test_leading_bits_keep_the_order(spark):
    numbers = sorted({s * v for k in range(63) for v in (2**k - 1, 2**k, 2**k + 2**k // 3) for s in (1, -1)} | set(range(-300, 300)) | {-(2**63), 2**63 - 1})
    got = [r.c for r in spark.createDataFrame([(n,) for n in numbers], "n long").orderBy("n").select(sharding.leading_bits(F.col("n")).alias("c")).collect()]
    assert got == sorted(got) and len(set(got)) <= 16384 and len({c for n, c in zip(numbers, got, strict=True) if -64 < n < 128}) == 191


def shards_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.shard].append(r)
    return found


@pytest.mark.parametrize("law", sharding.LAWS)
def test_laws_on_whole_documents(spark, sf_dir, law):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.shard(docs, 7, law, piece=10).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), law, None)
    found = shards_of(got)
    assert sorted(found) == list(range(7)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in found.values())
    if law == "rows":
        assert max(map(len, found.values())) - min(map(len, found.values())) <= 1
    else:
        sizes = [sum(r["size"] for r in s) for s in found.values()]
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    again = sharding.shard(docs.orderBy(F.rand(3)).repartition(5), 7, law, piece=10).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}, "the rows' order of arrival counts for nothing"


def test_order_is_that_of_the_curve_against_a_plain_version(spark):
    rows = [(i, f"s{i * i % 5}", "de" if i % 3 else None, i * 37 % 400, "x" * (i % 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    dims, bits = ("source", "n_chars"), 2

    def quantiles(values):
        at, out = 0, {}
        for v in sorted(set(values)):
            n = values.count(v)
            out[v], at = min(int((2 * at + n) * 4 // (2 * len(values))), 3), at + n
        return out

    code = lambda n: n.bit_length() * 64 + (n >> n.bit_length() - 7 & 63) if n.bit_length() > 6 else n
    source, chars = quantiles([r[1] for r in rows]), quantiles([code(r[3]) for r in rows])
    curve = {r.id: r.h for r in spark.range(16).select("id", sharding.curve_index(F.col("id"), 2, 2).alias("h")).collect()}
    index = {r[0]: curve[source[r[1]] * 4 + chars[code(r[3])]] for r in rows}
    found = shards_of(sharding.shard(df, 6, "rows", dims, bits).collect())
    order = [index[r.doc_id] for s in sorted(found) for r in sorted(found[s], key=lambda r: r.slot)]
    assert order == sorted(order)


def test_nulls_repeats_clashing_names_and_a_hot_group(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "en", "s", 0)] * 4 + [(5, "lorem " * 50_000, None, "s", -7)] + [(i, "same text", "en", "hot", 9) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("size", "grid", "part", "salt", "rank", "before", "n", "bytes", "shard_", "dim0", "place", "at"):
        df = df.withColumn(clash, F.lit("x"))
    for law in sharding.LAWS:
        got = sharding.shard(df, 4, law, piece=4).collect()
        assert len(got) == len(rows) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards_of(got).values())
        assert sorted(r["size"] for r in got) == sorted(len((r[1] or "").encode()) + 16 for r in rows) and {r.grid for r in got} == {"x"}
        assert {r.text_crc32 for r in got if r.doc_id is None} == {None}
    assert sharding.shard(df.where("false"), 4).count() == 0
    few = sharding.shard(df.limit(2), 4).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}


def test_pruning_and_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharded = sharding.shard(docs, 40).cache()
    ranges = sharding.shard_ranges(sharded).cache()
    box = {"source": ("src1", "src12"), "lang": ("fr", "fr"), "n_chars": (0, 1000)}
    chosen = {r.shard for r in sharding.shards_with(ranges, **box).collect()}
    wanted = {r.doc_id for r in docs.where("source BETWEEN 'src1' AND 'src12' AND lang = 'fr' AND n_chars BETWEEN 0 AND 1000").collect()}
    assert wanted <= {r.doc_id for r in sharded.collect() if r.shard in chosen} and len(chosen) <= 16
    sharding.write_shards(docs, sharded, ["doc_id"], str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "data"))
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert spark.read.parquet(str(tmp_path / "ranges")).count() == 40


def test_query(spark, sf_dir):
    got = queries.op12_hilbert_sharding(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert got.count() == 200 and {r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {5}
