"""Sets of word shingles and their MinHash values, computed on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: words of a shingle, MinHash values of a document
WORDS, HASHES = 5, 128
#: text bytes that are hashed in one go (a longer text is one go of its own)
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x5851F42D4C957F2D


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, np.uint64(base), dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240)
    return rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def _chunk_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of texts data[starts[i]:ends[i]] that lie one behind the other, and how many each text has."""
    size = 1 << max(16, int(len(data) - 1).bit_length()) if len(data) else 1 << 16
    power, inverse = _powers(size)
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    begin[starts[starts < len(data)]] = ~space[starts[starts < len(data)]]
    last = ~space
    last[:-1] &= space[1:]
    ends_in = ends[(ends > starts)] - 1
    last[ends_in] = ~space[ends_in]
    first, after = np.flatnonzero(begin), np.flatnonzero(last) + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    word = mix64((total[after] - total[first]) * inverse[first])
    words = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    at = np.concatenate([[0], np.cumsum(words)])
    # a window of WORDS words, or of all words of a shorter text
    n = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(words.dtype))
    out = np.zeros(int(n.sum()), dtype=np.uint64)
    where = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(out))
    short = np.repeat(np.minimum(words, WORDS), n)
    padded = np.concatenate([word, np.zeros(WORDS, dtype=np.uint64)])
    for k in range(WORDS):
        part = padded[where + k]
        if len(short) and short.min() < WORDS:
            part = np.where(k < short, part, np.uint64(k + 1))
        out = mix64(out * _ODD + part)
    return out, n


def shingle_arrays(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per stretch of consecutive texts: their shingle hashes, one text behind the other, and how many each has. Null: none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    with np.errstate(over="ignore"):
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1)
            stop = min(stop, len(texts))
            low, high = int(offsets[start]), int(offsets[stop])
            yield _chunk_shingles(data[low:high], offsets[start:stop] - low, offsets[start + 1 : stop + 1] - low)
            start = stop


def minhashes(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """HASHES 16-bit values per text (0 where a text has no shingle)."""
    out = np.zeros((len(counts), HASHES), dtype=np.uint16)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    mul, add = _hash_family()
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            least = np.minimum.reduceat(values * mul[k] + add[k], begin)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def distinct_sets(shingles: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of every text."""
    found, at = [], 0
    for n in counts.tolist():
        own = np.sort(shingles[at : at + n])
        at += n
        if n > 1:
            keep = np.empty(n, dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        found.append(own)
    return found
