"""Removal of passages that repeat across documents, over the token k-mers of a De Bruijn graph.

An edge is a run of `width` words. Equal texts compact first: of each, the smallest document stands for all.

Most edges stand in one text only. So a first pass finds the edges worth looking at: of each edge's shorter k-mers
only the one of the smallest hash (its minimizer) is kept, equal edges having equal minimizers. The pass sorts
(minimizer, text) over range partitions, which also split a minimizer that very many texts share, and keeps those
that stand beside an equal one of another text.

The second pass makes the edges of each text whose minimizer was kept. A sum by edge gives its source, the smallest
document that has it; a join takes the source back to each document. Consecutive edges with an earlier source compact
into one path, whose words are removed; each edge carries 96 bits of hash, and the text at the coordinates is what is
cut. The two joins with the texts use one shuffle of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.tokens import batches, run_hashes, word_hashes


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _edges(words: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of `width` words: its hash, a second one, and its minimizer's hash."""
    edge = run_hashes(words, width)
    if not len(edge):
        return edge, edge, edge
    short = run_hashes(words, k)
    least = short[: len(edge)].copy()
    for i in range(1, width - k + 1):
        np.minimum(least, short[i : i + len(edge)], out=least)
    return edge, run_hashes(words, width, "check"), least


def _documents(pdf: pd.DataFrame):
    """Position in the batch and word hashes of each document with words."""
    texts = _bytes(pdf["text"])
    for first, last in batches(texts):
        hashes, bounds = word_hashes(texts[first:last])
        for i in range(last - first):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, its 64-bit key d and its digest t."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("d"), F.md5(text.cast("binary")).alias("t"))


def shared_minimizers(texts: DataFrame, width: int, k: int) -> DataFrame:
    """d, minimizers: those of each text that another text may have as well."""

    def minimizers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.drop_duplicates("d", ignore_index=True)
            keys, found, owners = pdf["d"].to_numpy(), [], []
            for at, words in _documents(pdf):
                least = _edges(words, width, k)[2]
                if len(least):
                    found.append(np.unique(least))
                    owners.append(np.full(len(found[-1]), keys[at]))
            if found:
                yield pd.DataFrame({"m": np.concatenate(found).view(np.int64), "d": np.concatenate(owners)})

    def beside_equal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The first and the last row of a partition stay in any case: what stands beyond them is in another task.
        last, same = None, True
        for pdf in parts:
            now = (pdf if last is None else pd.concat([last, pdf], ignore_index=True)).drop_duplicates(ignore_index=True)
            if not len(now):
                continue
            m = now["m"].to_numpy()
            equal = m[1:] == m[:-1]
            keep = np.concatenate([[same], equal])[:-1] | equal
            yield now[:-1][keep]
            last, same = now[-1:], bool(equal[-1]) if len(equal) else same
        if last is not None:
            yield last

    rows = texts.select("d", "text").mapInPandas(minimizers, "m long, d long")
    kept = rows.repartitionByRange("m", "d").sortWithinPartitions("m", "d").mapInPandas(beside_equal, "m long, d long")
    return kept.groupBy("d").agg(F.collect_set("m").alias("minimizers"))


def repeated_edges(texts: DataFrame, firsts: DataFrame, width: int, k: int) -> DataFrame:
    """d, edges: hashes of the text's edges that a document smaller than its first one has too."""

    def candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            stands = [first is not None and any(x["t"] == t and x["first"] == i for x in first) for first, t, i in zip(pdf["firsts"], pdf["t"], pdf["doc_id"])]
            pdf = pdf[pdf["minimizers"].notna() & np.array(stands, bool)]
            ids, wanted = pdf["doc_id"].to_numpy(), pdf["minimizers"].tolist()
            out = []
            for at, words in _documents(pdf):
                edge, check, least = _edges(words, width, k)
                keep = np.isin(least, np.asarray(wanted[at], np.int64).view(np.uint64))
                if keep.any():
                    edge, first = np.unique(edge[keep], return_index=True)
                    out.append((edge.view(np.int64), (check[keep][first] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(edge), int(ids[at]))))
            if out:
                yield pd.DataFrame(dict(zip(("e", "f", "doc_id"), map(np.concatenate, zip(*out)))))

    lists = firsts.join(shared_minimizers(texts, width, k), "d", "left")
    edges = texts.join(lists, "d", "left").mapInPandas(candidates, "e long, f int, doc_id long")
    sources = edges.groupBy("e", "f").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    found = edges.join(sources, ["e", "f"]).where("source < doc_id").groupBy("doc_id").agg(F.collect_set("e").alias("edges"))
    keys = firsts.select("d", F.explode("firsts").alias("x")).select("d", F.col("x.first").alias("doc_id"))
    return keys.join(found, "doc_id").groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))


def remove_repeats(docs: DataFrame, width: int = 13, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept: a row for each row of docs (doc_id, text).

    Words are runs without spaces, unchanged. A word goes if a run of `width` words that covers it also stands in a
    document with a smaller doc_id. spans are the compacted paths, as word numbers start and end (exclusive); kept is the
    remaining words joined by one space. Null and empty texts have no words. Texts shorter than `width` stay. Rows that
    share a doc_id are judged each by itself, against smaller ids; a null doc_id removes nothing and loses nothing. Long texts
    are read whole; an empty table gives no rows; other columns are not looked at.
    """
    texts = keyed_texts(docs)
    # Of each text, the smallest document; two texts of one key are told apart by their digest.
    firsts = texts.select("d", "t", "doc_id").groupBy("d", "t").agg(F.min("doc_id").alias("first")).groupBy("d").agg(F.collect_list(F.struct("t", "first")).alias("firsts"))
    joined = texts.join(firsts.join(repeated_edges(texts, firsts, width, k), "d", "left"), "d", "left")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, wanted = _bytes(pdf["text"]), pdf["edges"].tolist()
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
            first = [next((x["first"] for x in some if x["t"] == t), None) for some, t in zip(pdf["firsts"], pdf["t"])]
            copy = [i is not None and f is not None and f < i for i, f in zip(ids, first)]
            places = np.flatnonzero([i is not None and f == i and w is not None for i, f, w in zip(ids, first, wanted)])
            hit = {int(places[at]): words for at, words in _documents(pdf.iloc[places])}
            out = []
            for i, text in enumerate(texts):
                parts_of = text.split()
                spans, kept = [], parts_of
                if copy[i] and len(parts_of) >= width:
                    spans, kept = [[0, len(parts_of)]], []
                elif i in hit:
                    edge = run_hashes(hit[i], width)
                    at = np.flatnonzero(np.isin(edge, np.asarray(wanted[i], np.int64).view(np.uint64)))
                    if len(at):
                        cover = np.zeros(len(parts_of) + 2, np.int32)
                        np.add.at(cover, at + 1, 1), np.add.at(cover, at + 1 + width, -1)
                        gone = np.cumsum(cover)[1:-1] > 0
                        border = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                        spans = border.reshape(-1, 2).tolist()
                        kept = [w for w, g in zip(parts_of, gone.tolist()) if not g]
                out.append((len(parts_of), len(parts_of) - len(kept), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
            done = pd.DataFrame(out, columns=["n_words", "n_removed", "spans", "kept"])
            done.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield done

    return joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept string")

