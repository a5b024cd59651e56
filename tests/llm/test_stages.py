"""Each pipeline stage on nulls, repeated rows and ids, empty and very long texts, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LONG = " ".join(f"word{i % 997} lorem{i % 83}" for i in range(15_000))
CLASHES = ("head", "leak", "mixed", "redacted", "score", "predicted", "size", "source_size", "target", "taken", "drawn", "uid", "key", "row", "c", "p", "n", "sig", "words", "fp")


@pytest.fixture(scope="module")
def item(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first()["text"]


@pytest.fixture(scope="module")
def docs(spark, item):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (1, None), (2, ""), (3, text(2)), (3, text(3)), (3, text(3)), (4, LONG), (5, f"before {item} after"), (5, text(4)), (6, "password: hunter2xyz " + text(5)), (None, None)]
    df = spark.createDataFrame([(i, t, "en", None if n % 3 else "s", len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).cache()


def through(stage, spark, docs, sf_dir, tmp_path):
    getattr(corpus_pipeline, stage)(spark, docs, sf_dir).write.parquet(str(tmp_path / "out"))
    return spark.read.parquet(str(tmp_path / "out"))


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))


def keeps_columns(out, docs):
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.select(*CLASHES).distinct().count() == 1


def test_toxicity(spark, docs, sf_dir, tmp_path):
    out = through("toxicity_filter", spark, docs, sf_dir, tmp_path)
    keeps_columns(out, docs)
    assert out.exceptAll(docs).count() == 0 and docs.exceptAll(out).count() == 0, "nothing is toxic here"


def test_near_dedup(spark, docs, sf_dir, tmp_path):
    out = through("near_dedup", spark, docs, sf_dir, tmp_path)
    keeps_columns(out, docs)
    # Of texts without words and of equal texts one row stays, the one of the smallest id; all different texts stay.
    want = {t or "" for _, _, t in texts(docs)}
    assert sorted(t for *_, t in texts(out)) == sorted(want)
    assert [i for _, i, t in texts(out) if t == ""] == [1]


def test_benchmark(spark, docs, item, sf_dir, tmp_path):
    out = through("benchmark_filter", spark, docs, sf_dir, tmp_path)
    keeps_columns(out, docs)
    assert texts(out) == [x for x in texts(docs) if item not in x[2]]


def test_secrets(spark, docs, sf_dir, tmp_path):
    out = through("secret_redaction", spark, docs, sf_dir, tmp_path)
    keeps_columns(out, docs)
    assert texts(out) == sorted((a, i, t.replace("password: hunter2xyz", "[secret]")) for a, i, t in texts(docs))


def test_mix(spark, docs, sf_dir, tmp_path):
    out = through("source_mix", spark, docs, sf_dir, tmp_path)
    keeps_columns(out, docs)
    assert out.columns[len(docs.columns) :] == ["size_", "source_size_", "target_", "taken_", "drawn_"]
    for r in out.collect():
        assert 0 < r.taken_ <= 2 * r.size_ and sum(b.n_words for b in r.drawn_) == r.taken_ and r.size_ == len(r.text.split())
    assert out.count() <= docs.count()


@pytest.mark.parametrize("stage", [f.__name__ for _, f in corpus_pipeline.STAGES])
def test_empty_table(spark, docs, sf_dir, tmp_path, stage):
    assert through(stage, spark, docs.where("false"), sf_dir, tmp_path).count() == 0


def test_columns_with_maps(spark, docs, sf_dir, tmp_path):
    mapped = docs.withColumn("more", F.create_map(F.lit("a"), F.col("text")))
    out = through("near_dedup", spark, mapped, sf_dir, tmp_path)
    assert texts(out) == texts(corpus_pipeline.near_dedup(spark, docs, sf_dir)) and out.columns[-1] == "more"
