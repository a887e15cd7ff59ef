"""Exact nearest rows in a space of any number of dimensions, by blocks of it.

Planes through a small sample cut the space, so every block of rows has a compact
box, and inside a block its rows lie in the leaves of a tree of such boxes. A row
that asks goes to the block nearest to it, where it searches the tree; that bounds
how far it has to look, and it goes on only to the blocks whose boxes lie within
that. A row is sent once, and once more for every such block; a block is sent to as
many groups of rows as share its work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.rowblocks import freeze, thaw
from pointweave.session import cut, discard

#: rows of a block, rows of a leaf and of a run, rows that ask a block together, bits of a place on the curve, and those that tell near rows
BLOCK_FEATURES, LEAF, GROUP, CURVE_BITS, PART_BITS = 1 << 15, 64, 1 << 16, 60, 15


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], np.ascontiguousarray(rows).ravel())


def _halves(f: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows in leaves of ``size`` at most, by halves of the longest side."""
    leaves, waiting = [], [np.arange(len(f))]
    while waiting:
        at = waiting.pop()
        if len(at) <= size:
            leaves.append(at)
            continue
        axis = np.argmax(f[at].max(axis=0) - f[at].min(axis=0))
        half = len(at) // 2
        order = np.argpartition(f[at, axis], half)
        waiting += [at[order[:half]], at[order[half:]]]
    return leaves


class _Planes:
    """Planes through a sample that cut the space into about ``parts`` parts of equal content."""

    def __init__(self, some: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int):
        self.part, self.axis = 0, -1
        if parts < 2 or len(some) < 2:
            return
        self.axis = int(np.argmax(high - low))
        self.at = float(np.sort(some[:, self.axis])[len(some) // 2])
        below = some[:, self.axis] < self.at
        middle, edge = np.array(low), np.array(high)
        middle[self.axis] = edge[self.axis] = self.at
        self.sides = [_Planes(some[below], low, edge, parts // 2), _Planes(some[~below], middle, high, parts - parts // 2)]

    def number(self, first: int = 0) -> int:
        """Numbers the parts from ``first`` on; the next number."""
        if self.axis < 0:
            self.part = first
            return first + 1
        for side in self.sides:
            first = side.number(first)
        return first

    def parts(self, f: np.ndarray) -> np.ndarray:
        out = np.full(len(f), self.part, dtype=np.int32)
        if self.axis >= 0:
            below = f[:, self.axis] < self.at
            for side, own in zip(self.sides, (below, ~below)):
                out[own] = side.parts(f[own])
        return out


def _gap_sq(low: np.ndarray, high: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``f`` to every box; added up like that of two rows, so rounding makes it no larger than that of a row inside."""
    gap = np.zeros((len(f), len(low)))
    for axis in range(f.shape[1]):
        off = np.maximum(np.maximum(low[:, axis] - f[:, axis, None], f[:, axis, None] - high[:, axis]), 0.0)
        gap += off * off
    return gap


def _least_sq(asks: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``asks`` to its nearest of ``f``."""
    d2 = np.zeros((len(asks), len(f)))
    for axis in range(f.shape[1]):
        gap = asks[:, axis, None] - f[None, :, axis]
        d2 += gap * gap
    return d2.min(axis=1)


def _tree(f: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows leaf by leaf, where leaves begin, and their boxes."""
    leaves = _halves(f, LEAF)
    f, starts = f[np.concatenate(leaves)], np.cumsum([0, *[len(leaf) for leaf in leaves]])
    return f, starts, np.minimum.reduceat(f, starts[:-1], axis=0), np.maximum.reduceat(f, starts[:-1], axis=0)


def _search(tree: tuple[np.ndarray, ...], asks: np.ndarray, best: np.ndarray) -> None:
    """Lowers ``best`` to the squared distance of every row of ``asks`` to its nearest of the tree where that is less."""
    f, starts, low, high = tree
    for run in _halves(asks, LEAF):
        q, found = asks[run], best[run]
        off = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0.0)
        apart = (off * off).sum(axis=1) * (1 - 1e-9)  # of the run's box; an allowance for rounding
        first = int(np.argmin(apart))
        if apart[first] >= found.max():
            continue
        found = np.minimum(found, _least_sq(q, f[starts[first] : starts[first + 1]]))
        rest = np.flatnonzero(apart < found.max())
        rest = rest[rest != first]
        rest = rest[np.argsort(apart[rest])]
        near = _gap_sq(low[rest], high[rest], q)
        for place, leaf in enumerate(rest):
            if apart[leaf] >= found.max():
                break
            some = np.flatnonzero(near[:, place] < found)
            if len(some):
                found[some] = np.minimum(found[some], _least_sq(q[some], f[starts[leaf] : starts[leaf + 1]]))
        best[run] = found


def _packed(base: DataFrame, planes: _Planes, parts: int) -> DataFrame:
    """Written blocks (block, low, high, data) of the rows (f) between the planes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(planes.parts(_matrix(batch.column(0)))), batch.column(0)], names=["block", "f"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in _groups(batches, 1):
            tree = _tree(np.concatenate([_matrix(r.column(1)) for r in rows]))
            out = ([block], [tree[2].min(axis=0)], [tree[3].max(axis=0)], [freeze(tree)])
            types = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["block", "low", "high", "data"])

    placed = base.select("f").mapInArrow(place, "block int, f array<double>").repartition(parts, "block").sortWithinPartitions("block")
    return cut(placed.mapInArrow(pack, "block int, low array<double>, high array<double>, data binary"), "feature_blocks")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows that follow each other with equal first columns."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _visits(blocks: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows (block, turn, data, part, id, f, score, ..) by block and turn, each block before the rows that visit it.

    Rows near each other in space (``part``) visit a block in the same turn, about ``GROUP`` at once.
    """
    counts = cut(asks.groupBy("block", "part").agg(F.count(F.lit(1)).alias("rows")), "part_rows")
    before = F.sum("rows").over(Window.partitionBy("block").orderBy("part")) - F.col("rows")
    # of a part that alone fills several turns the rows are dealt by their ids
    share = F.floor(F.col("rows") / GROUP)
    turns = cut(counts.select("block", "part", F.floor(before / GROUP).cast("int").alias("turn"), F.greatest(share, F.lit(1)).alias("share")), "turns")
    dealt = asks.join(turns, ["block", "part"])
    dealt = dealt.withColumn("turn", (F.col("turn") + F.pmod(F.xxhash64("id"), "share")).cast("int")).drop("share")
    own = turns.select("block", F.explode(F.sequence(F.col("turn"), (F.col("turn") + F.col("share") - 1).cast("int"))).alias("turn")).distinct()
    home = own.join(blocks.select("block", "data"), "block")
    both = home.unionByName(dealt, allowMissingColumns=True).select("block", "turn", "data", *[c for c in asks.columns if c != "block"])
    number = own.count()
    return both.repartition(max(1, min(2 * number, 2000)), "block", "turn").sortWithinPartitions("block", "turn", F.col("data").isNull())


def nearest_sq(base: DataFrame, asks: DataFrame, some: np.ndarray, low: np.ndarray, high: np.ndarray, block_rows: int = 0) -> DataFrame:
    """(id, .., score): squared distance of every row of ``asks`` (id, f, ..) to the nearest row of ``base`` (f), all finite; ids are unique.

    ``some`` are a few rows of ``base``; the box of all of them reaches from ``low`` to ``high``.
    """
    extra = [c for c in asks.columns if c not in ("id", "f")]
    parts = min(-(-base.count() // (block_rows or BLOCK_FEATURES)), len(some))
    planes = _Planes(some, low, high, parts)
    parts = planes.number()
    blocks = _packed(base, planes, parts)
    # no more boxes than ``some`` has rows
    boxes = blocks.select("block", "low", "high").collect()
    names, lows, highs = np.array([b.block for b in boxes], dtype=np.int32), np.array([b.low for b in boxes]), np.array([b.high for b in boxes])
    axes = len(low)
    hull = asks.agg(*[f(F.get("f", F.lit(a))).alias(f"{n}{a}") for a in range(axes) for n, f in (("low", F.min), ("high", F.max))]).first()
    if hull.low0 is None:
        return asks.select("id", *extra, F.lit(0.0).alias("score"))
    corner, side = (np.array([hull[f"{n}{a}"] for a in range(axes)]) for n in ("low", "high"))
    side = np.maximum(side - corner, 1e-300)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block nearest to every row, and the part of the curve it lies on."""
        for batch in batches:
            f = _matrix(batch.column(1))
            used = min(axes, CURVE_BITS)
            bits = max(1, PART_BITS // used)
            cells = np.clip((f[:, :used] - corner[:used]) / side[:used] * 2.0**bits, 0, 2.0**bits - 1).astype(np.int64)
            part = np.zeros(len(f), dtype=np.int64)
            for bit in range(bits - 1, -1, -1):
                for axis in range(used):
                    part = part << 1 | (cells[:, axis] >> bit & 1)
            nearest = np.zeros(len(f), dtype=np.int64)
            for at in range(0, len(f), 1024):
                nearest[at : at + 1024] = _gap_sq(lows, highs, f[at : at + 1024]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names[nearest]), pa.array(part), *batch.columns], names=["block", "part", *batch.schema.names])

    kinds = {c: t for c, t in asks.dtypes}
    columns = "id long, f array<double>" + "".join(f", `{c}` {kinds[c]}" for c in extra)
    asked = cut(asks.select("id", "f", *extra).mapInArrow(home, f"block int, part long, {columns}"), "asked")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the nearest block says, and the blocks that may know better."""
        for (block, _), rows in _groups(batches, 2):
            tree = thaw(rows[0].column(2)[0].as_py())
            rows = [r for r in [rows[0].slice(1), *rows[1:]] if r.num_rows]
            f = np.concatenate([_matrix(r.column(5)) for r in rows])
            best = np.full(len(f), np.inf)
            _search(tree, f, best)
            at = 0
            for r in rows:
                for low in range(0, r.num_rows, 1024):
                    part = r.slice(low, 1024)
                    own = slice(at, at + part.num_rows)
                    at = own.stop
                    row, there = np.nonzero((_gap_sq(lows, highs, f[own]) < best[own, None]) & (names != block))
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    more = ends[1:] > ends[:-1]
                    kept = _lists(f[own][more])
                    offsets = np.append(0, np.cumsum(more)).astype(np.int32) * f.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(3), part.column(4), pa.ListArray.from_arrays(offsets, kept.flatten()), pa.array(best[own]),
                         pa.ListArray.from_arrays(ends, pa.array(names[there])), *part.columns[6:]],
                        names=["part", "id", "f", "score", "to", *extra],
                    )

    visited = _visits(blocks, asked.select("block", "part", "id", "f", *extra)).mapInArrow(first, "part long, id long, f array<double>, score double, to array<int>" + columns.split("array<double>", 1)[1])
    seen = cut(visited, "seen")
    discard(asked)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 2):
            tree = thaw(rows[0].column(2)[0].as_py())
            rows = [r for r in [rows[0].slice(1), *rows[1:]] if r.num_rows]
            known = np.concatenate([r.column(6).to_numpy(zero_copy_only=False) for r in rows])
            best = known.copy()
            _search(tree, np.concatenate([_matrix(r.column(5)) for r in rows]), best)
            ids, better = np.concatenate([r.column(4).to_numpy(zero_copy_only=False) for r in rows]), best < known
            yield pa.RecordBatch.from_arrays([pa.array(ids[better]), pa.array(best[better])], names=["id", "score"])

    on = seen.where(F.size("to") > 0)
    letters = on.select(F.explode("to").alias("block"), "part", "id", "f", "score")
    found = _visits(blocks, letters).mapInArrow(further, "id long, score double")
    known = on.select("id", "score", *extra).unionByName(found, allowMissingColumns=True).groupBy("id").agg(F.min("score").alias("score"), *[F.max(c).alias(c) for c in extra])
    return seen.where(F.size("to") == 0).select("id", *extra, "score").unionByName(known.select("id", *extra, "score"))
