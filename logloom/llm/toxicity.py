"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents drawn without regard to labels are the unlabelled ones. The risk
of a linear classifier f is pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss and the class prior pi, the
share of toxic ones among the labelled training rows. Training takes bounded samples; scoring reads all of each text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpointed

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Besides whole words, stems are features: the first so many characters of a word, with the number of different
#: words of the text that begin so, up to MOST. Written ^stem, ^stem+2, ^stem+3.
PREFIXES, MOST = (3, 4, 5, 6, 7), 3
#: A task forgets the words it has looked up when they are more than this; it only looks them up again.
MOST_SEEN = 50_000
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD_BYTES else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves remainder 1 by 3; such rows' labels are never learnt from. Null: false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@dataclass
class ToxicityModel:
    """Weights of features; score is the logistic of bias plus the weights of the features that a text has."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: pd.Series) -> pd.Series:
        known = {x.partition("+")[0] for x in self.weights}
        seen: dict[bytes, tuple[str, ...]] = {}  # words looked up
        f = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            f[i] += sum(self.weights.get(x, 0.0) for x in sorted(text_features(text, known, seen)))
        return pd.Series(1 / (1 + np.exp(-np.clip(f, -40, 40))))


def _stems(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def text_features(text: str | None, known: set | None = None, seen: dict | None = None) -> set[str]:
    """The features of a text; only those of known words and stems, if given. seen keeps the known ones of each word met."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) if text else set()
    seen = {} if seen is None else seen
    if len(seen) > MOST_SEEN:
        seen.clear()
    for w in (w for w in words if w not in seen):
        stems = _stems(w.decode("utf-8", "replace"))
        seen[w] = tuple(stems if known is None else (x for x in stems if x in known))
    counts = Counter(x for w in words for x in seen[w])
    return counts.keys() | {f"{x}+{k}" for x, n in counts.items() if n > 1 for k in range(2, min(n, MOST) + 1)}


def features(text: str, known: list[str] | None = None) -> Column:
    """The features of a text column; only the known ones, if given."""
    stems = None if known is None else {x.partition("+")[0] for x in known}
    wanted = None if known is None else set(known)

    @F.pandas_udf("array<string>")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            seen: dict[bytes, tuple[str, ...]] = {}
            found = (text_features(t, stems, seen) for t in texts)
            yield pd.Series([sorted(x if wanted is None else x & wanted) for x in found])

    return named(text)


def pu_weights(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over 0/1 rows, by Adam steps on the full samples."""
    theta = np.zeros(positive.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float64) for x in (positive, unlabelled))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        fp, fu = 1 / (1 + np.exp(-np.clip(p @ theta, -40, 40))), 1 / (1 + np.exp(-np.clip(u @ theta, -40, 40)))
        negative = np.log1p(np.exp(np.clip(u @ theta, -40, 40))).mean() - prior * np.log1p(np.exp(np.clip(p @ theta, -40, 40))).mean()
        g_negative = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)
        # Below zero the estimate has overfitted: the step then goes up on that part alone.
        g = prior * (p.T @ (fp - 1)) / len(p) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 5000, max_features: int = 300, min_share: float = 0.015, min_z: float = 5.0, seed: int = 5) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), of rows that are not held out.

    At most max_positive toxic and max_unlabelled other documents are read, the first by a hash of doc_id. Features that
    at least min_share of the toxic ones have, and by min_z standard errors more of them than of the unlabelled, are kept,
    the max_features clearest. The driver gets a 0/1 row of those for each sampled document. Without toxic rows the score
    is near 0 throughout; without features that tell, it is that of the prior.
    """
    mine = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(seed), "doc_id")
    marked = mine(labels).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marked.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
    if not counts["p"]:
        return ToxicityModel()
    prior = min(0.95, max(1e-4, counts["p"] / counts["n"]))
    only_prior = ToxicityModel(bias=float(np.log(prior / (1 - prior))))
    toxic_ids = F.broadcast(marked.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id"))
    other_ids = F.broadcast(mine(docs).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_unlabelled))
    # One text for each sampled id, however often it stands in docs.
    part = lambda ids, p: docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(p).alias("p"), "text")
    sample = checkpointed(part(toxic_ids, 1).unionByName(part(other_ids, 0)).repartition(48))
    sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return only_prior
    n_p, n_u = sizes[1], sizes[0]
    each = lambda p, known=None: sample.where(F.col("p") == p).select(F.explode(features("text", known)).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    # A document's features over min_share can be that frequent at most, so the driver can hold them.
    often = {r["x"]: r["n"] for r in each(1).where(F.col("n") >= max(3, min_share * n_p)).collect()}
    others = {r["x"]: r["n"] for r in each(0, sorted(often)).collect()}
    told = []
    for x, a in often.items():
        b = others.get(x, 0)
        pooled = (a + b + 1) / (n_p + n_u + 2)
        told.append(((a / n_p - b / n_u) / (pooled * (1 - pooled) * (1 / n_p + 1 / n_u)) ** 0.5, x))
    chosen = [x for z, x in sorted(told, key=lambda t: (-t[0], t[1])) if z >= min_z][:max_features]
    if not chosen:
        return only_prior
    has = F.transform(F.array(*map(F.lit, chosen)), lambda x: F.array_contains("f", x).cast("tinyint"))
    rows = sample.withColumn("f", features("text", chosen)).select("p", has.alias("x")).toPandas()
    x, p = np.array(rows["x"].tolist(), np.float64), rows["p"].to_numpy()
    by_value = np.lexsort(x.T)  # the same sums whatever order the rows come in
    x, p = x[by_value], p[by_value]
    weights, bias = pu_weights(x[p == 1], x[p == 0], prior)
    return ToxicityModel(bias, {w: float(v) for w, v in zip(chosen, weights)})


def score_column(text: Column, model: ToxicityModel) -> Column:
    """The score of a text, 0 to 1. Null and empty texts get the score of no words."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield model.scores(texts)

    return score(text)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 from threshold on), which replace columns so named."""
    return docs.withColumn("score", score_column(F.col("text"), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    Null and empty texts get the score of no words; long texts are scored whole. Rows that repeat are scored alike; a null doc_id
    is neither held out nor learnt from. An empty table gives no rows; other columns are not looked at.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score_documents(docs.select("doc_id", "text"), model, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
