"""The near-duplicate stage of the pipeline at five words and a similarity of 0.8."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from logloom.llm import simhash

KIND = "doc_id long, text string, lang string"


def shingles(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / sum((a | b).values())


def edited(words, at):
    return " ".join("edit%d" % i if i in at else w for i, w in enumerate(words))


def by_hand(rows):
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a, _) in enumerate(rows):
        for j, b, _ in rows[n + 1 :]:
            if similarity(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_copies_of_similarity_08_go(spark, sf_dir):
    words = [f"w{i}" for i in range(300)]
    texts = [edited(words, ()), edited(words, range(30, 300, 60)), edited(words, range(5, 300, 25)), "quite another text of a few words"]
    assert 0.8 <= similarity(texts[0], texts[1]) < 0.95 and similarity(texts[0], texts[2]) < 0.8
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], KIND)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [0, 2, 3]


@pytest.mark.parametrize("words", [8, 40, 160])
def test_components_against_all_pairs(spark, words):
    r, rows = np.random.default_rng(3), []
    seeds = [[f"s{s}w{i}" for i in range(int(r.integers(words, 3 * words)))] for s in range(4)]
    for i in range(120):
        words = seeds[i % 4]
        at = {int(x): f"e{r.integers(0, 3)}" for x in r.choice(len(words), size=int(r.integers(0, max(2, len(words) // 18))), replace=False)}
        rows.append((i, " ".join(at.get(k, w) for k, w in enumerate(words)), "en"))
    want = by_hand(rows)
    assert 4 < len(set(want.values())) < 120
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert got == want


def test_rows_go_only_because_of_their_group(spark, sf_dir):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(30))
    rows = [(None, text(0), "en"), (None, text(1), "en"), (None, text(2), "en"), (7, text(3), "en"), (7, text(4), "en"), (8, text(4), "de"), (None, text(3), "de"), (9, text(5), "en"), (9, text(5), "en")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, KIND), sf_dir).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted([(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5))], key=key)
