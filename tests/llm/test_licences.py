"""Alignments of the licence scan against a plain version, and texts of licences among other words."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import licenses

RARE, VOTES, SLACK = 12, 4, 8


def plain_scan(texts):
    """found and score of each text, without Spark."""
    postings, mandatory = licenses.template_tables()
    words = [licenses.words_of(t) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    index = {}
    for name in licenses.TEMPLATES:
        ranked = sorted({w for n, w, _ in postings if n == name}, key=lambda w: (-math.log((len(texts) + 1) / (df[w] + 1)), w))
        index[name] = {w: [at for n, x, at in postings if (n, x) == (name, w)] for w in ranked[:RARE]}
    for ws in words:
        found, share = set(), 0.0
        for name, rare in index.items():
            begins = sorted((at - t_at, w) for at, w in enumerate(ws) for t_at in rare.get(w, ()))
            runs = []
            for b, w in begins:
                if runs and b - runs[-1][-1][0] <= SLACK:
                    runs[-1].append((b, w))
                else:
                    runs.append([(b, w)])
            for run in runs:
                votes = len({w for _, w in run})
                stands = all(
                    any(ws[at : at + len(parts)] == parts and run[0][0] - SLACK <= at - p_at <= run[-1][0] + SLACK for at in range(len(ws)))
                    for n, parts, p_at in mandatory
                    if n == name
                )
                if votes >= VOTES and stands:
                    found.add((name, run[0][0], votes))
                    share = max(share, votes / len(rare))
        has_base = any(ws[i : i + 2 + (p[:1] == "g")] == p.split() for p, _ in licenses.BASE_PHRASES for i in range(len(ws)))
        out.append((found, 1.0 if has_base else share))
    return out


def edited(words, rng, edits):
    """Words with some dropped, put in or changed."""
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [words[at], "foo"], ["bar"]])
    return words


@pytest.fixture(scope="module")
def cases(spark, sf_dir):
    """Documents, some with one or several licences in them, whole, edited or cut."""
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    names, cases = list(licenses.TEMPLATES), []
    for n, text in enumerate(texts):
        words = (text or "").split()[:400]
        for name in rng.sample(names, n % 4):
            part = edited(licenses.TEMPLATES[name][0].split(), rng, rng.choice([0, 0, 1, 3, 9]))
            if rng.random() < 0.2:
                part = part[: len(part) // 2]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part * rng.choice([1, 1, 2])
        cases.append(" ".join(words))
    return [*cases, "", *(licenses.TEMPLATES[n][0].upper() for n in names)]


def test_alignments_equal_a_plain_version(spark, cases):
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string").repartition(7)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    want = plain_scan(cases)
    assert sum(bool(f) for f, _ in want) > 60
    for n, (found, score) in enumerate(want):
        assert {tuple(x) for x in got[n].found} == found and got[n].score == pytest.approx(score), (n, cases[n])
        assert set(filter(None, got[n].labels.split(","))) >= {name for name, *_ in found}


def test_each_licence_is_told_from_those_like_it(spark):
    # gpl is also the base label of any "general public license"; lgpl is that of every version.
    others = {"gpl-2": {"gpl"}, "agpl": {"gpl"}, "ncsa": set(), "mit": set(), "lgpl-3": {"gpl", "lgpl"}, "lgpl": {"gpl"}, "0bsd": set(), "isc": set(), "cc-by": set(), "cc-by-sa": set(), "cc-by-nc": set(), "cddl": set()}
    rows = [(name, f"Copyright (c) 2020 someone\n * {licenses.TEMPLATES[name][0]}") for name in others]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: {name} | more for name, more in others.items()}


def test_phrases_stand_in_their_templates():
    postings, mandatory = licenses.template_tables()
    assert {n for n, _, _ in mandatory} == set(licenses.TEMPLATES)
    assert all(len({w for n, w, _ in postings if n == name}) >= VOTES + 2 for name in licenses.TEMPLATES)


def test_repeated_rows_and_words_of_licences_without_their_order(spark):
    shuffled = licenses.TEMPLATES["postgresql"][0].split()
    random.Random(1).shuffle(shuffled)
    rows = [(1, licenses.TEMPLATES["ofl"][0])] * 3 + [(2, " ".join(shuffled)), (3, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string").withColumn("votes", F.lit(1)))
    assert sorted((r.doc_id, r.labels) for r in got.collect()) == [(1, "ofl")] * 3 + [(2, ""), (3, "")]
