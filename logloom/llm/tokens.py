"""Vectorised hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = {"byte": np.uint64(0x9E3779B97F4A7C15), "word": np.uint64(0xD6E8FEB86659FD93), "check": np.uint64(0xA24BAED4963EE407)}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        base = _ODD[kind]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        grow = lambda x: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, x, np.uint64))])
        _POWERS[kind] = grow(base), grow(inverse)
    ups, downs = _POWERS[kind]
    return ups[:n], downs[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ups, downs = _powers(kind, len(values) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(values * ups[:-1], dtype=np.uint64)]), downs


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts, in order, and where each text's words begin and end (len(texts) + 1 numbers)."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, stops = edge[::2], edge[1::2]
    sums, downs = _sums(_BYTE[data], "byte")
    hashes = mix((sums[stops] - sums[starts]) * downs[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def run_hashes(words: np.ndarray, width: int, kind: str = "word") -> np.ndarray:
    """A hash of each `width` consecutive words; none if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums, downs = _sums(words, kind)
    return mix((sums[width:] - sums[:n]) * downs[:n])


def batches(texts, most: int = 2_000_000):
    """Runs (first, last) of texts, of at most `most` bytes together; a longer text makes a run of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)
