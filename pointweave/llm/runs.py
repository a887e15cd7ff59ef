"""Periodic runs of words: stretches that repeat themselves at least twice.

A run is a longest stretch with a period, of at least two periods and twelve
words. All runs of a text come from queries for short blocks inside the text
itself. Words get numbers, prefix doubling sorts all suffixes, and on the way
names every stretch of 4, 8, 16, .. words. A run with period q holds, within its
first period, a block of a dyadic length B near q, whose next copy lies q words
on; the places where a block occurs in the neighbouring window are a range of
the suffix array cut by place, which a wavelet tree answers by counting and by
its range successor. Places of a block in a window no longer than the block form
a progression, known by its first, second and last member, and each member is a
candidate period. Longest common extensions, by the names of dyadic stretches,
turn candidates into runs. All steps work on many texts and queries at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pointweave.llm.words import WHITE, Words, cut_words

#: words of a run at least
SHORTEST = 12
#: length of the smallest blocks and their distance; every stretch of 6 words holds such a block
BLOCK, STEP = 4, 3
#: candidates that are extended at once
CANDIDATES = 1 << 21
#: text bytes that go through the arrays at once (a longer text goes alone)
TEXT_BYTES = 4 << 20


def _names(*columns: np.ndarray) -> np.ndarray:
    """Numbers such that rows get equal ones when they are equal; in the order of the rows."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


@dataclass
class Suffixes:
    """Suffix array of several texts behind each other, and the names of their dyadic stretches.

    ``names[k][i]`` is the first place, in the suffix array, of the suffixes that
    share their first 2^k words with suffix i, so equal names mean equal
    stretches inside the texts; ``sizes[k][i]`` is how many they are. A stretch
    that runs over its text's end equals no other. The last level is that where
    no stretch occurs twice.
    """

    array: np.ndarray
    names: list[np.ndarray]
    sizes: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, doc: np.ndarray) -> Suffixes:
        n = len(ids)
        last = np.append(doc[1:] != doc[:-1], True) if n else np.zeros(0, bool)
        order = np.lexsort((ids, doc))
        new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
        ends = np.flatnonzero(last)
        end_of = ends[np.searchsorted(ends, np.arange(n))] + 1  # where the text of each word ends
        names, sizes = [], []
        step = 1
        while True:
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            name = np.empty(n, dtype=np.int64)
            name[order] = heads[group]
            size = np.empty(n, dtype=np.int32)
            size[order] = np.diff(np.append(heads, n))[group]
            names.append(name.astype(np.int32) if n < 2**31 else name)
            sizes.append(size)
            if len(heads) == n:
                return cls(order, names, sizes)
            # only suffixes whose class has others move, and only inside their class
            open_ = np.flatnonzero(size[order] > 1)
            rows = order[open_]
            beyond = rows + step
            # a suffix that ends here sorts before the others of its class, and apart from them
            key = np.where(beyond < end_of[rows], name[np.minimum(beyond, n - 1)] + n, end_of[rows] - rows)
            inside = np.lexsort((key, name[rows]))
            order = order.copy()
            order[open_] = rows[inside]
            key, owner = key[inside], name[rows][inside]
            fresh = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
            new = np.ones(n, dtype=bool)
            new[open_] = fresh
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and b on (a < b)."""
        a, b = a.copy(), b.copy()
        start, n = b.copy(), len(self.array)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            while True:  # more than once only at the top level
                same = (b < n) & (name[np.minimum(a, n - 1)] == name[np.minimum(b, n - 1)])
                a[same] += step
                b[same] += step
                if k < len(self.names) - 1 or not same.any():
                    break
        return b - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and b (a < b), going left."""
        a, b = a.copy(), b.copy()
        start = b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            while True:
                room = a >= step
                same = room & (name[np.where(room, a - step, 0)] == name[np.where(room, b - step, 0)])
                a[same] -= step
                b[same] -= step
                if k < len(self.names) - 1 or not same.any():
                    break
        return start - b


class WaveletTree:
    """Counting and selection by value in ranges of a sequence, for many queries at a time.

    Level by level from the highest bit, the sequence is parted stably by that
    bit; per level only the running count of zeros is kept.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for k in range(self.bits - 1, -1, -1):
            zero = (values >> k) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32 if len(values) < 2**31 else np.int64))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the entries low..high-1 are smaller than ``bound``."""
        whole = bound >= (1 << self.bits)
        found = np.zeros(len(low), dtype=np.int64)
        a, b = low.astype(np.int64), high.astype(np.int64)
        for level, zero in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            za, zb = zero[a], zero[b]
            found += np.where(one, zb - za, 0)
            a, b = np.where(one, zero[-1] + a - za, za), np.where(one, zero[-1] + b - zb, zb)
        return np.where(whole, high - low, found)

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The entry of rank k (from 0) by value among the entries low..high-1; k must be below their number."""
        out = np.zeros(len(low), dtype=np.int64)
        a, b, k = low.astype(np.int64), high.astype(np.int64), k.astype(np.int64)
        for level, zero in enumerate(self.zeros):
            za, zb = zero[a], zero[b]
            one = k >= zb - za
            k = np.where(one, k - (zb - za), k)
            out |= one.astype(np.int64) << (self.bits - 1 - level)
            a, b = np.where(one, zero[-1] + a - za, za), np.where(one, zero[-1] + b - zb, zb)
        return out

    def successors(self, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per query: how many entries of the range have values in start..end-1, and the first, second and last of those (0 where missing)."""
        before = self.below(low, high, start)
        count = self.below(low, high, end) - before
        picked = []
        for rank, least in ((before, 1), (before + 1, 2), (before + count - 1, 1)):
            rows = np.flatnonzero(count >= least)
            value = np.zeros(len(low), dtype=np.int64)
            value[rows] = self.smallest(low[rows], high[rows], rank[rows])
            picked.append(value)
        return count, *picked


def _blocks(suffixes: Suffixes, n: int) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """(first words of blocks with another copy, level, nearest copy, one beyond the farthest copy) of every query.

    Blocks of 4 words serve periods 1 to 15, blocks of B = 8, 16, .. words those from 2B to 4B - 1.
    """
    for level in range(2, len(suffixes.names)):
        length = 1 << level
        at = np.arange(0, n, STEP if length == BLOCK else length)
        at = at[suffixes.sizes[level][at] > 1]
        if len(at):
            low = 1 if length == BLOCK else 2 * length
            for near in range(low, 4 * length, length):
                yield at, level, near, min(near + length, 4 * length)


def find_runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts whose words are ``ids``; places count through all texts.

    Sorted by start, then period. ``doc`` rises with the place.
    """
    n = len(ids)
    empty = np.zeros(0, dtype=np.int64)
    suffixes = Suffixes.of(ids, doc)
    if len(suffixes.names) <= 2:
        return empty, empty, empty
    tree = WaveletTree(suffixes.array)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for at, level, near, far in _blocks(suffixes, n):
        low = suffixes.names[level][at].astype(np.int64)
        count, first, second, last = tree.successors(low, low + suffixes.sizes[level][at], at + near, at + far)
        rows = np.flatnonzero(count)
        gap = np.where(count > 1, second - first, 1)
        # a progression inside one stretch of period ``gap`` with the block itself only repeats that stretch's period
        several = rows[count[rows] > 2]
        same = suffixes.forward(at[several], at[several] + gap[several]) + at[several] + gap[several] >= last[several] + (1 << level)
        repeats = several[same & ((first[several] - at[several]) % gap[several] == 0) & (gap[several] < near)]
        rows = np.setdiff1d(rows, repeats, assume_unique=True)
        for part in np.split(rows, np.searchsorted(np.cumsum(count[rows]), np.arange(CANDIDATES, int(count[rows].sum()), CANDIDATES))):
            owner = np.repeat(part, count[part])
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            found.append(_extend(suffixes, at[owner], first[owner] + step * gap[owner] - at[owner]))
    runs = np.unique(np.concatenate(found), axis=0)
    # a stretch counts with its smallest period
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _extend(suffixes: Suffixes, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The longest stretches of the given periods round ``at`` (start, end, period) that are long enough, each once."""
    start = at - suffixes.backward(at, at + period)
    end = at + period + suffixes.forward(at, at + period)
    long = end - start >= np.maximum(SHORTEST, 2 * period)
    return np.unique(np.column_stack([start, end, period])[long], axis=0)


def _repeats(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Which texts hold a stretch of BLOCK words twice; without one there is no run."""
    out = np.zeros(docs, dtype=bool)
    if len(ids) < BLOCK:
        return out
    at = np.flatnonzero(doc[: len(doc) - BLOCK + 1] == doc[BLOCK - 1 :])
    key = doc[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BLOCK):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    out[doc[at[order[again]]]] = True
    return out


def _with_tail(n: int, number: int) -> np.ndarray | None:
    """Which original word stands at each of n places: the marked tenth of texts ends periodically. None: all stay."""
    h = zlib.crc32(str(number).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def runs_of_words(words: Words, numbers: list[int | None] | None) -> list[tuple]:
    """Per text: runs as [(start, length, period)], and the bytes of the text without repeats, words joined by one space.

    With ``numbers``, texts first get the periodic tail that their number asks for.
    """
    counts = words.per_doc()
    begin = np.cumsum(counts) - counts
    ids, doc = words.ids.astype(np.int64), words.doc
    changed: set[int] = set()
    if numbers is not None:
        for row in range(words.docs):
            place = _with_tail(int(counts[row]), numbers[row]) if numbers[row] is not None else None
            if place is not None:
                b = int(begin[row])
                ids[b : b + len(place)] = words.ids[b + place]
                changed.add(row)
    wanted = _repeats(ids, doc, words.docs)
    picked = np.flatnonzero(wanted[doc]) if len(doc) else doc
    start, end, period = find_runs(ids[picked], doc[picked])
    # places back to the words of each text, and words after a run's first period dropped
    owner = doc[picked[start]] if len(start) else start
    kept = np.ones(len(ids) + 1, dtype=np.int64)
    if len(start):
        first = picked[start]
        cover = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(cover, first + period, 1)
        np.add.at(cover, first + (end - start), -1)
        kept[:-1] = np.cumsum(cover)[:-1] == 0
    out = []
    bounds = np.searchsorted(owner, np.arange(words.docs + 1))
    binary = words.vocabulary.cast(pa.binary())
    for row in range(words.docs):
        a, b = int(bounds[row]), int(bounds[row + 1])
        low, high = int(begin[row]), int(begin[row] + counts[row])
        own = ids[low:high][kept[low:high] == 1] if b > a else ids[low:high]
        text = b" ".join(binary.take(pa.array(own)).to_pylist())
        found = zip((picked[start[a:b]] - low).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist()) if b > a else ()
        out.append((list(found), text))
    return out


def repetitions(df: DataFrame, tails: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its runs, ``runs`` array<struct<start, length, period>>, and ``collapsed``, the text without repeats.

    A null text is empty; empty texts have no runs and collapse to an empty
    text; equal rows and ids stay rows of their own; other columns are not
    looked at; an empty table gives an empty result. Texts stay whole, a text
    is worked on in one task. ``tails`` gives a tenth of the texts, by the CRC-32
    of the id, a periodic ending first (a null id asks for none).
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for ids, rows in _rows(batches, tails):
            runs = [[dict(zip(("start", "length", "period"), r)) for r in found] for found, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(runs, kind), pa.array([text.decode() for _, text, _ in rows], pa.string())],
                names=[id_col, "runs", "collapsed"],
            )

    schema = source.select(F.col("id").alias(id_col)).schema
    run_type = StructType().add("start", "long").add("length", "long").add("period", "long")
    return source.mapInArrow(run, schema.add("runs", ArrayType(run_type)).add("collapsed", "string"))


def _rows(batches: Iterator[pa.RecordBatch], tails: bool) -> Iterator[tuple[pa.Array, list[tuple]]]:
    for batch in batches:
        for words in cut_words(batch.column(1), WHITE, size=TEXT_BYTES):
            ids = batch.column(0).slice(words.rows.start, words.docs)
            found = runs_of_words(words, ids.to_pylist() if tails else None)
            yield ids, [(runs, text, n) for (runs, text), n in zip(found, words.per_doc().tolist())]


def run_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row with its periodic tail: number of runs, the longest (ties: first start, then period), and digests of runs and collapsed text.

    Same rules for nulls, empty texts, repeated rows and other columns as ``repetitions``.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _rows(batches, True):
            best = [min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3 for found, _, _ in rows]
            columns = [
                [len(found) for found, _, _ in rows],
                *[[b[k] for b in best] for k in range(3)],
                [b[1] * 1000 // b[2] if b[2] else None for b in best],
            ]
            listed = [_hex("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()) for found, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, pa.int64()) for c in columns], pa.array(listed), pa.array([_hex(text) for _, text, _ in rows])],
                names=[id_col, *numbers, "runs_sha256", "collapsed_sha256"],
            )

    schema = source.select(F.col("id").alias(id_col)).schema
    for name in numbers:
        schema = schema.add(name, "long")
    return source.mapInArrow(run, schema.add("runs_sha256", "string").add("collapsed_sha256", "string"))
