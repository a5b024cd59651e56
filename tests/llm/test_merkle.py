"""The Merkle manifest against a plain tree, and what a proof notices."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.llm import merkle, queries

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def climb(nodes):
    """The levels of a tree, from its leaves to the one node that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i // 3 * 3
        yield level[first:i], level[i + 1 : first + 3]
        i //= 3


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: H("".join(map(field, (*r[:4], text))))
    order = lambda v: (v is not None, v)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), leaf(r, r[4]))) for s in sources}
    trees = [climb([leaf(r, r[4]) for r in of[s]]) for s in sources]
    top = climb([t[-1][0] for t in trees])
    for k, s in enumerate(sources):
        for i, r in enumerate(of[s]):
            steps = [*path(trees[k], i), *path(top, k)]
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            now = leaf(r, r[4] if odd or r[4] is None else r[4].replace("\n", ""))
            for left, right in steps:
                now = H("".join([*left, now, *right]))
            yield r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in steps)), now, now == top[-1][0]


def proved(df):
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    got = merkle.merkle_proofs(df, cut, F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return sorted(map(repr, (tuple(r) for r in got.collect())))


@pytest.mark.parametrize("most", [0, 5, 20_000])
def test_every_proof_against_a_plain_tree(spark, monkeypatch, most):
    monkeypatch.setattr(merkle, "BROADCAST_RUNS", most)
    rows = [(i, None if i < 1 else "ab"[i % 2] if i < 270 else "a" if i < 600 else f"s{i % 11}é", "en", i, f"line {i}\nmore") for i in range(640)]
    rows += [(7, "a", None, None, None), (7, "a", None, None, ""), (7, "a", None, None, ""), (None, None, "de", 1, "x\n"), (None, "b", "", -1, "\n" * 9), (900, "alone", "fr", 5, "word " * 30_000)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    for clash in ("tree", "index", "n", "level", "run", "at", "digest"):
        df = df.withColumn(clash, F.lit("x"))
    assert proved(df) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 81, 82])
def test_sizes_around_the_group_and_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
    assert proved(spark.createDataFrame(rows, COLUMNS)) == sorted(map(repr, plain(rows)))


def test_query_agrees_with_sql_and_notices_every_change(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got, want = queries.op13_merkle_proofs(spark, sf_dir), con.sql(queries.oracle_sql()["op13_merkle_proofs"])
    rows = sorted(tuple(r) for r in got.collect())
    assert got.columns == list(want.columns) and rows == sorted(want.fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r[0] for r in rows if not r[-1]} == {i for i, t in texts.items() if "\n" in t and zlib.crc32(str(i).encode()) % 2 == 0}
