import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from logloom.functions.match import matches
from logloom.functions.porter import stem
from logloom.functions.tokens import tokenize, tokens
from logloom.schema import InvalidInput, QueryFailed

# Stems of the classic algorithm.
STEMS = "as:as is:is was:wa ties:ti dying:dy flies:fli happy:happi relational:relat rational:ration operator:oper feudalism:feudal hopefulness:hope triplicate:triplic formative:form allowance:allow adjustable:adjust effective:effect rate:rate cease:ceas controll:control roll:roll oed:o yes:ye say:sai caresses:caress ponies:poni agreed:agre motoring:motor conflated:conflat sized:size hopping:hop failing:fail filing:file news:new"
ERRORS = ["", "  ", "(", "()", "(a", "a)", "*", '"', "AND", "OR", "NOT x", "a AND", "a OR NOT b", "a AND NOT b", "(a OR b) c", "a (b OR c)", "10.0.0.1", "a-b", "-disk", "foo:bar", "+foo", "a ; b", "don't", "near(a b)", "NEAR()"]
WORDS = ["disk", "full", "connection", "refused", "connecting", "kernel", "panic", "foo_bar", "Café", "restarted"]


def test_stems():
    for pair in STEMS.split():
        word, want = pair.split(":")
        assert stem(word) == want
    assert stem("a" * 70 + "ing") == "a" * 70 + "ing"


def test_tokens_agree_with_an_index():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table v using fts5(m, tokenize='porter unicode61')")
    db.execute("create virtual table t using fts5vocab(v, instance)")
    random.seed(3)
    parts = ["al", "ing", "ed", "s", "tion", "y", "e", "ness", "fulness", "izer", "ational"]
    texts = ["".join(random.choice("abcdeilnorstuyz") for _ in range(random.randint(1, 6))) + random.choice(parts) for _ in range(3000)] + ["ø straße Ａ１ ậ naïve 中文 x_y"]
    db.executemany("insert into v(rowid, m) values (?, ?)", list(enumerate(texts)))
    got: dict[int, list] = {}
    for term, doc, _, offset in db.execute("select term, doc, col, offset from t"):
        got.setdefault(doc, []).append((offset, term))
    for i, text in enumerate(texts):
        assert [t for _, t in sorted(got.get(i, []))] == tokenize(text), text


@pytest.mark.parametrize("text", ERRORS)
def test_syntax_errors(spark, text):
    with pytest.raises(QueryFailed):
        matches(F.col("tokens"), text)


def test_limits(spark):
    with pytest.raises(InvalidInput):
        matches(F.col("tokens"), "é" * 257)
    with pytest.raises(InvalidInput):
        matches(F.col("tokens"), "a " * 17)


def _expression(r: random.Random) -> str:
    word = lambda: r.choice(WORDS)
    simple = r.choice([word(), f'"{word()} {word()}"', word()[:4] + "*", f"^{word()}", f"NEAR({word()} {word()}, {r.randint(0, 3)})", f"{word()} {word()}", f'"{word()}" + {word()}', f"message : {word()}"])
    return r.choice([simple, f"{simple} {r.choice(['AND', 'OR', 'NOT'])} {word()}", f"({simple} OR {word()}) AND {word()}", f"{word()} NOT {word()} {word()}", f"{word()} OR {word()} NOT {word()}", '"" disk'])


def test_conditions_agree_with_an_index(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 6))) for _ in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table v using fts5(message, tokenize='porter unicode61')")
    db.executemany("insert into v(rowid, message) values (?, ?)", list(enumerate(texts, 1)))
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id int, m string").withColumn("tokens", tokens(F.col("m"))).cache()
    asked = sorted({_expression(r) for _ in range(60)})
    got = df.select("id", *[matches(F.col("tokens"), q).alias(f"q{i}") for i, q in enumerate(asked)]).collect()
    for i, q in enumerate(asked):
        want = {x for (x,) in db.execute("select rowid from v where v match ?", (q,))}
        assert {row["id"] for row in got if row[f"q{i}"]} == want, q
