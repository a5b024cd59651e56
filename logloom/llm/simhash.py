"""SimHash near-duplicates by pigeonring filtering.

chains.py links the fingerprints; copies hang on their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.chains import chain_keys, links  # noqa: F401
from logloom.llm.common import checkpointed
from logloom.llm.components import connected_components
from logloom.llm.copies import near_copies

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of `width` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)))), repeat(seed)))


def simhash_batch(texts, width: int = 3, chunk: int = 200_000) -> np.ndarray:
    """Fingerprints (uint64) of texts: a bit is set if it is set in over half the hashes."""
    ones, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owners = [], []

    def flush():
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            hashes = np.array([x for part in held for x in part], dtype=np.uint64)
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            held.clear(), owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, width)
        sizes[i] = len(hashes)
        for k in range(0, len(hashes), chunk):
            held.append(hashes[k : k + chunk]), owners.append(i)
            waiting += len(held[-1])
            if waiting >= chunk:
                flush()
                waiting = 0
    flush()
    return np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(simhash_batch(texts.tolist(), width).view(np.int64))

    return simhash(text)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int | None = None, dense: int = 16) -> DataFrame:
    """doc_id, fp (long), fingerprint (16 hex digits), component_id: a row for each row of docs.

    component_id is the smallest doc_id reachable over links, the document itself included: links are pairs that share
    `similarity` of their shingle occurrences or more (copies.py), or, with radius=2, whose fingerprints differ in at
    most 2 bits, whatever their similarity. Null and empty texts have fingerprint zero and link with each other.
    Rows with the same doc_id each keep their own fingerprint. A null doc_id counts only where a component has no other.
    Long texts are read whole; an empty table gives no rows; other columns are not looked at.
    """
    if radius is None:
        rows = near_copies(docs, F.xxhash64("text"), fingerprint_column(F.col("text"), width).alias("fp"), width=width, similarity=similarity)
        least = rows.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        return rows.join(least, "c").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    if radius != 2:
        raise ValueError("the chains are built for a radius of 2")
    prints = checkpointed(docs.select("doc_id", fingerprint_column(F.col("text"), width).alias("fp")))
    firsts = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(firsts.select("fp"), dense))
    linked = firsts.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = linked.groupBy("c").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "c").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
