"""The trained models against plain versions of the same estimates."""

import math
from collections import Counter

import numpy as np
import pytest

from logloom.llm import quality, toxicity


def plain_kneser_ney(texts):
    """log p of the last class of each 4-gram, by the textbook sums over dictionaries."""
    grams = Counter()
    for t in texts:
        c = [0] * 3 + [int(quality._CLASS[b]) for b in t.encode()]
        grams.update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    levels = []
    for order in (4, 3, 2, 1):
        by_n = Counter(grams.values())
        n1, n2, n3, n4 = (max(by_n[i], 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = [min(max(d, 0.05), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, freed = Counter(), Counter()
        for g, n in grams.items():
            total[g[:-1]] += n
            freed[g[:-1]] += min(cut[min(n, 3) - 1], n)
        levels.append((dict(grams), cut, total, freed))
        grams = Counter(g[1:] for g in grams)

    def p(gram, level):
        if level == 4:
            return 1 / quality.CLASSES
        grams, cut, total, freed = levels[level]
        n, context = grams.get(gram, 0), gram[:-1]
        if context not in total:
            return p(gram[1:], level + 1)
        own = (n - min(cut[min(n, 3) - 1], n)) / total[context] if n else 0.0
        return own + freed[context] / total[context] * p(gram[1:], level + 1)

    return lambda gram: math.log(p(gram, 0))


def test_kneser_ney_by_hand(spark):
    texts = ["the cat sat on the mat, the cat ran", "a cat; a mat 12 12 12", "über öl"]
    table = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    want, r = plain_kneser_ney(texts), np.random.default_rng(1)
    seen = [tuple(int(quality._CLASS[b]) for b in t.encode()[i : i + 4]) for t in texts for i in range(len(t.encode()) - 3)]
    for gram in [*seen, *map(tuple, r.integers(0, quality.CLASSES, (200, 4)).tolist())]:
        code = sum(int(x) * quality.CLASSES ** (3 - i) for i, x in enumerate(gram))
        assert table[code] == pytest.approx(want(gram), abs=1e-5), gram


def plain_risk(theta, p, u, prior):
    f = lambda x: np.hstack([x, np.ones((len(x), 1))]) @ theta
    loss = lambda margin: np.log1p(np.exp(-margin)).mean()
    return prior * loss(f(p)) + max(0.0, loss(-f(u)) - prior * loss(-f(p)))


def test_weights_reach_the_least_risk():
    r = np.random.default_rng(2)
    p = (r.random((300, 3)) < (0.8, 0.3, 0.5)).astype(float)
    u = (r.random((900, 3)) < (0.3, 0.35, 0.5)).astype(float)
    w, b = toxicity.pu_weights(p, u, 0.2, steps=3000, rate=0.02, decay=0.0)
    got = plain_risk(np.append(w, b), p, u, 0.2)
    best, theta = np.inf, np.zeros(4)
    for scale in (1.0, 0.3, 0.1, 0.03, 0.01):  # a plain search, without gradients
        for _ in range(1500):
            step = theta + r.normal(scale=scale, size=4)
            if (risk := plain_risk(step, p, u, 0.2)) < best:
                best, theta = risk, step
    assert got <= best + 1e-3
    assert w[0] > 0.5 and abs(w[2]) < 0.5


def test_risk_never_trains_below_zero():
    # The estimate of the negative part would go below zero here: positives look like the unlabelled rows.
    p, u = np.ones((50, 1)), np.ones((50, 1))
    w, b = toxicity.pu_weights(p, u, 0.9)
    assert np.isfinite(w).all() and np.isfinite(b) and plain_risk(np.append(w, b), p, u, 0.9) < 5
