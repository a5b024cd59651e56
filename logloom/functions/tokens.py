"""Full-text tokens: lower-cased alphanumeric runs without a single Latin diacritic, stemmed."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.porter import stem


@lru_cache(maxsize=50_000)
def _fold(ch: str) -> str:
    """The folded form of a character of a token, or a space for a separator."""
    if unicodedata.category(ch)[0] not in "LN" and unicodedata.category(ch) != "Co":
        return " "
    low = ch.lower() if len(ch.lower()) == 1 else ch
    parts = unicodedata.normalize("NFD", low)
    if len(parts) == 2 and parts[0] in "abcdefghijklmnopqrstuvwxyz" and unicodedata.combining(parts[1]):
        return parts[0]
    return low


def tokenize(text: str | None) -> list[str]:
    """The stemmed tokens of a text, in order."""
    if not text:
        return []
    folded = text.lower() if text.isascii() else "".join(map(_fold, text))
    if text.isascii():
        folded = "".join(c if c.isalnum() else " " for c in folded)
    return [stem(w) for w in folded.split()]


def tokens(text: Column) -> Column:
    """An array column of tokenize(text), made when rows are written."""

    @F.pandas_udf("array<string>")
    def tokenized(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(tokenize)

    return tokenized(text)
