"""Pigeonring chains among the candidates of near copies."""

import numpy as np

from logloom.llm import copies, simhash


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for pair in pairs:
        x, y = sorted(map(find, pair))
        root[y] = x
    return {x: find(x) for x in root}


def test_chains_find_close_copies_without_prefix_keys(spark, monkeypatch):
    found = copies.first_candidates
    monkeypatch.setattr(copies, "first_candidates", lambda shared: found(shared).where("false"))
    words = [[f"t{t}w{i}" for i in range(400)] for t in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:399] + ["end"]) for w in words[:3]]
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in rows} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1, 8: 2}


def test_chain_candidates_are_the_links_of_all_pairs(spark):
    r = np.random.default_rng(9)
    base = r.integers(-(1 << 62), 1 << 62, 30)
    prints = [int(base[i % 30]) ^ (1 << int(r.integers(0, 60))) ^ (1 << int(r.integers(0, 60))) ** int(r.integers(0, 2)) for i in range(150)] + [int(base[0])] * 3
    nodes = spark.createDataFrame([(i, fp) for i, fp in enumerate(prints)], "sig long, f0 long")
    pairs = [(x.u, x.v) for x in copies.chain_candidates(nodes).collect()]
    near = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2]
    assert all(u < v for u, v in pairs) and len(near) > 100 and groups(pairs) == groups(near)
