"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from pyspark.sql import functions as F

from logloom.llm import decontaminate, licenses, mixing, neighbours, quality, secrets, simhash, substrings, toxicity, urls

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [(1, "one two three four five six"), (2, None), (3, ""), (3, ""), (4, "  \n\t "), (None, "no id at all"), (5, LONG), (6, "one two three four five six"), (6, "one two three four five six"), (7, "Ünï cödé MIT License")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("size", "uid", "words", "score", "fp", "key", "d", "t", "rule", "verdict", "perplexity", "n"):
        df = df.withColumn(clash, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_mixing(docs):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(TEXTS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_source = {r.source: r for r in got}
    for source, r in by_source.items():
        assert abs(sum(x.taken for x in got if x.source == source) - r.target) <= 1
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert mixing.mix_documents(docs.where("false")).count() == 0


def test_mixing_agrees_with_itself(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (docs, table.unionByName(table.limit(20))):
        once, *again = (sorted(map(repr, mixing.mix_documents(d).collect())) for d in (df.repartition(1), df.repartition(7), df.orderBy(F.rand(5))))
        assert all(a == once for a in again)


def test_secrets(docs):
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(TEXTS) and all(r.spans == "" for r in got)
    assert secrets.scan_secrets(docs.where("false")).count() == 0
    assert secrets.redact_secrets(docs).exceptAll(docs).count() == 0


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id == 6} == {1}
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_substrings(docs):
    got = {(r.doc_id, r.n_words): r for r in substrings.remove_repeats(docs.select("doc_id", "text")).collect()}
    assert got[5, 20000].n_removed == 0 and got[2, 0].kept == ""
    assert got[6, 6].n_removed == 0, "shorter than a window"
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def test_toxicity(docs, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_quality(docs, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(TEXTS)
    assert all(r.perplexity is None and not r.keep for r in got if r.doc_id in (2, 3))
    assert quality.classify(docs, labels.where("false")).where("keep").count() == 7
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_licenses(docs):
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(TEXTS)
    (mit,) = (r for r in got if r.doc_id == 7)
    assert (mit.n_base, mit.first_word, mit.last_word, mit.labels, mit.score) == (1, 2, 2, "mit", 1.0)
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, "two three four five six"), (2, None), (3, ""), (4, "amet"), (4, "amet"), (9, "never seen in any of them")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (6, 1), (5, 4)}
    assert decontaminate.find_leaks(docs.where("false"), items).count() == 0
    assert decontaminate.find_leaks(docs, items.where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == len(TEXTS) - 4


def test_urls(spark):
    cases = {
        "http://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"),
        "HTTP://WWW.Example.COM/en/71?x#y": ("www.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "x://example.net/de/89": ("example.net", "/de/89", "example.net/de/8", "block"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://a.com/EN/1": ("a.com", "/EN/1", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "http://h?q": ("h", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(cases)] + [(0, "http://a.com/en/1", "x")], "page_id long, url string, rule string")
    got = urls.judge_urls(pages, urls.rule_table(spark)).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    assert urls.judge_urls(pages.where("false"), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, urls.rule_table(spark).where("false")).collect()} == {"allow"}


@pytest.mark.parametrize("most", [0, 50_000])
def test_many_rules_long_urls_and_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rules = [("block" if n % 2 else "allow", f"h{n % 40}.org", "/" + "p" * (n // 40)) for n in range(800)] + [("block", None, "/"), ("block", "h1.org", None)]
    long = "/" + "p" * 30_000
    addresses = [f"http://a.b.c.h{n}.org{long}" for n in range(45)] + ["http://" + "x." * 5000 + "h3.org/pp"]
    clashing = "page_id long, url string, bh string, bp string, key string, p string, h string, full string, host string, url_host_ string"
    pages = spark.createDataFrame([(n, u, *"abcdefgh") for n, u in enumerate(addresses)], clashing)
    got = {r.page_id: r for r in urls.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert {(r.bh, r.bp, r.key, r.p, r.h, r.full, r.url_host_) for r in got.values()} == {(*"abcdef", "h")}
    for n in range(45):
        want = (f"h{n}.org/" + "p" * 19, "block" if n % 2 else "allow") if n < 40 else (None, "allow")
        assert (got[n].rule, got[n].verdict, got[n].path) == (*want, long)
    assert got[45].rule == "h3.org/pp"


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (40, [0.0, 0.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.5)]
    assert neighbours.nearest_neighbours(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
