"""Whole texts cut into words on Arrow buffers: what the phrase, index and run operators share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

#: text bytes that are cut in one go (a longer text is one go of its own)
CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(members: bytes) -> np.ndarray:
    """A table over all bytes, true for ``members``."""
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: bytes between words: ASCII white space
WHITE = byte_class(b" \t\n\v\f\r")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some consecutive texts, one text behind the other."""

    rows: slice  # which texts of the batch
    doc: np.ndarray  # per word: its text, counted from the first of ``rows``
    ids: np.ndarray  # per word: its place in ``vocabulary``; equal words have equal ids
    vocabulary: pa.Array  # the distinct words, as strings
    breaks: np.ndarray  # per word: whether a text or a piece begins with it

    @property
    def docs(self) -> int:
        return self.rows.stop - self.rows.start

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    @cached_property
    def vocabulary_hash(self) -> np.ndarray:
        """64-bit hashes of the distinct words, the same in every task."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.vocabulary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(self.vocabulary))


def cut_words(texts: pa.Array, between: np.ndarray, ends: np.ndarray | None = None, lower: bool = False, size: int = 0) -> Iterator[Words]:
    """The words of ``texts`` (null: empty), a stretch of about ``size`` (or CHUNK) bytes at a time.

    A word is a longest run of bytes outside ``between``, which holds ASCII
    bytes only; a byte of ``ends`` (part of ``between``) also ends a piece.
    ``lower`` folds A-Z first.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    size = size or CHUNK
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        low, high = int(offsets[start]), int(offsets[stop])
        yield _cut(data[low:high], offsets[start : stop + 1] - low, slice(start, stop), between, ends, lower)
        start = stop


def _cut(data: np.ndarray, bounds: np.ndarray, rows: slice, between: np.ndarray, ends: np.ndarray | None, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    inside = ~between[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begin[heads] = inside[heads]
    first = np.flatnonzero(begin)
    doc = (np.searchsorted(bounds, first, side="right") - 1).astype(np.int32)
    # where each word's bytes lie once everything between words is taken out
    letters = data[inside]
    before = np.cumsum(inside, dtype=np.int64)
    place = before[first] - 1 if len(first) else first
    offsets = np.append(place, len(letters))
    kind, width = (pa.string(), np.int32) if len(letters) < 2**31 - 1 else (pa.large_string(), np.int64)
    words = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    breaks = np.ones(len(first), dtype=bool)
    breaks[1:] = doc[1:] != doc[:-1]
    if ends is not None and len(first):
        seen = np.cumsum(ends[data], dtype=np.int64)[first]
        breaks[1:] |= seen[1:] != seen[:-1]
    return Words(rows, doc, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, breaks)
