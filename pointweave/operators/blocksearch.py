"""Exact nearest neighbours of all points among themselves, by blocks of space.

One key per point, its place on a space-filling curve, deals a cloud into blocks
of equal size, so a dense spot has more blocks and no other cloud notices. A
block searches itself first; that bounds how far each of its points has to look.
Points in runs along the curve share one box that holds their balls, and an
equi-join of cells at the box's own level, pruned by the blocks' bounding boxes,
finds the few blocks it meets. These send the points that lie in the boxes, each
once to a block that asks, and the block finishes its search among them. Rows that
are shuffled are proportional to the points, whatever the number of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.octree import frame_of
from pointweave.operators.rowblocks import freeze, space_order, thaw
from pointweave.session import cut

#: points of a block and of a run of queries, distances computed at once (they stay in a core's cache), points of other blocks merged at once
BLOCK_POINTS, RUN_POINTS, CHUNK, MERGED = 4096, 64, 1 << 16, 1 << 14
#: parts of a block that a slice of the curve is cut into
PIECES = 8
#: levels of cells: every second one is used, so few of them are
DEEPEST = 20
BOX = ["x0", "y0", "z0", "x1", "y1", "z1"]
ASKED = "cloud_id string, block int, run int, level int, " + ", ".join(f"{c} double" for c in BOX) + ", data binary"
POST = "cloud_id string, to int, kind int, sender int, data binary, boxes array<array<double>>"


def space_blocks(points: DataFrame, rows: int, values: Sequence[str] = ()) -> DataFrame:
    """Written (cloud_id, block, blocks, data): the points of a cloud in blocks of about equal size, ``rows`` and a piece at most, along the curve.

    ``data`` holds their ids and coordinates, and their ``values`` where some are named.
    A slice of the curve packs its points into small pieces, and pieces are dealt
    into blocks, so points are rows only once.
    """
    placed = space_order(points, "x", "y", "z", *values).select("cloud_id", "at", "x", "y", "z", *values)
    ranged = placed.repartitionByRange("cloud_id", "at").sortWithinPartitions("cloud_id", "at")
    ranged = ranged.select("cloud_id", F.col("at.id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *values)])
    width = max(1, rows // PIECES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice (task) counts its rows; those of one cloud follow each other."""
        place, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            if batch.column(1).null_count:
                raise ValueError("a point of a block has no id")
            numbers = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(2, batch.num_columns)]).astype(float)
            ends = [*(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            low, out = 0, []
            for end in ends:
                for at in range(low, end, width):
                    part = slice(at, min(at + width, end))
                    held = (ids[part].copy(), numbers[part, :3].copy())
                    data = freeze((*held, numbers[part, 3:].copy()) if values else held)
                    out.append((names.dictionary[int(code[at])].as_py(), number, place + at, part.stop - at, data))
                low = end
            place += batch.num_rows
            columns = list(zip(*out))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cloud_id", "slice", "place", "rows", "data"])

    cut_up = cut(ranged.mapInArrow(pieces, "cloud_id string, slice int, place long, rows long, data binary"), "pieces")
    slices = cut_up.groupBy("cloud_id", "slice").agg(F.sum("rows").alias("rows"), F.min("place").alias("first"))
    over = Window.partitionBy("cloud_id")
    offsets = slices.select(
        "cloud_id", "slice", (F.sum("rows").over(over.orderBy("slice")) - F.col("rows") - F.col("first")).alias("before"), F.sum("rows").over(over).alias("n")
    )
    blocks = F.ceil(F.col("n") / rows)
    block = F.least(F.floor((F.col("before") + F.col("place")) / F.ceil(F.col("n") / blocks)), blocks - 1).cast("int")
    dealt = cut_up.join(cut(offsets, "offsets"), ["cloud_id", "slice"])
    dealt = dealt.select("cloud_id", block.alias("block"), blocks.cast("int").alias("blocks"), (F.col("before") + F.col("place")).alias("place"), "data")
    dealt = dealt.repartition("cloud_id", "block").sortWithinPartitions("cloud_id", "block", "place")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cloud, block), letters in groupby(_letters(batches), key=lambda r: r[:2]):
            letters = list(letters)  # the pieces of one block
            data = freeze(tuple(np.concatenate(c) for c in zip(*[thaw(r[4]) for r in letters])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([cloud], pa.string()), pa.array([block], pa.int32()), pa.array([letters[0][2]], pa.int32()), pa.array([data], pa.binary())],
                names=["cloud_id", "block", "blocks", "data"],
            )

    return cut(dealt.mapInArrow(join, "cloud_id string, block int, blocks int, data binary"), "blocks")


def _about(xyz: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by one product of matrices, and by how much those of a query may be off."""
    centre = np.nan_to_num(queries[len(queries) // 2])
    p, q = xyz - centre, queries - centre
    p2, q2 = (np.einsum("ij,ij->i", v, v) for v in (p, q))
    left, right = np.column_stack([q, q2, np.ones(len(q))]), np.vstack([-2.0 * p.T, np.ones(len(p)), p2])
    return left @ right, 64 * np.finfo(float).eps * (q2 + np.nanmax(p2, initial=0.0))


def _within(ids: np.ndarray, xyz: np.ndarray, queries: np.ndarray, bound: np.ndarray, own: np.ndarray | None):
    """(query, place, d2) of the points within the finite ``bound`` of every query."""
    about, slack = _about(xyz, queries)
    row, col = np.divmod(np.flatnonzero(about <= (bound + slack)[:, None]), max(1, len(xyz)))
    gap = [xyz[col, a] - queries[row, a] for a in range(3)]
    d2 = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
    close = d2 <= bound[row]
    if own is not None:
        close &= ids[col] != own[row]
    return row[close], col[close], d2[close]


def nearest(ids: np.ndarray, xyz: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None, own: np.ndarray | None = None):
    """(query, place, d2) of the k nearest points of every query, ties by id; within ``bound`` where given, without the query's ``own`` id where given."""
    out = []
    step = max(1, CHUNK // max(1, len(ids)))
    for low in range(0, len(queries), step):
        part = slice(low, low + step)
        if bound is not None and np.isfinite(bound[part]).all():
            row, col, d2 = _within(ids, xyz, queries[part], bound[part], None if own is None else own[part])
            out.append(_best(row + low, col, ids[col], d2, k))
            continue
        gap = [xyz[None, :, a] - queries[part, a, None] for a in range(3)]
        d2 = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
        if own is not None:
            d2[ids[None, :] == own[part, None]] = np.inf
        limit = None if bound is None else bound[part]
        if len(ids) > k and (limit is None or not np.isfinite(limit).all()):
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            limit = kth if limit is None else np.minimum(limit, kth)
        close = d2 < np.inf
        if limit is not None:
            close &= d2 <= limit[:, None]
        row, col = np.nonzero(close)
        out.append(_best(row + low, col, ids[col], d2[row, col], k))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(row: np.ndarray, col: np.ndarray, ids: np.ndarray, d2: np.ndarray, k: int):
    order = np.lexsort((ids, d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    stays = _places(row) < k
    return row[stays], col[stays], d2[stays]


def _places(row: np.ndarray) -> np.ndarray:
    """Place of every entry among those of its row, rows in order."""
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    return np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))


def _kth(ids: np.ndarray, xyz: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of the k-th nearest point of every query or a little more, without its ``own`` id where given; infinite where there are fewer."""
    out = np.full(len(queries), np.inf)
    if len(ids) < k:
        return out
    step = max(1, CHUNK // len(ids))
    for low in range(0, len(queries), step):
        part = slice(low, low + step)
        d2, slack = _about(xyz, queries[part])
        if own is not None:
            d2[ids[None, :] == own[part, None]] = np.inf
        out[part] = np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1], 0.0) + slack
    out[np.isnan(out)] = np.inf
    return out


def _boxes(xyz: np.ndarray, bound: np.ndarray, ext: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the boxes that hold the balls of every run."""
    reach = np.minimum(np.sqrt(bound) * (1 + 1e-9), 4 * ext)[:, None]
    starts = np.arange(0, len(xyz), RUN_POINTS)
    # a point that lacks a coordinate has no ball
    xyz = np.where(np.isfinite(xyz).all(axis=1)[:, None], xyz, np.nan)
    return np.fmin.reduceat(xyz - reach, starts, axis=0), np.fmax.reduceat(xyz + reach, starts, axis=0)


def _inside(xyz: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    inside = np.ones(len(xyz), dtype=bool)
    for a in range(3):
        inside &= (xyz[:, a] >= low[a]) & (xyz[:, a] <= high[a])
    return inside


def _own_bounds(ids: np.ndarray, xyz: np.ndarray, queries: np.ndarray, at: np.ndarray, k: int, own: np.ndarray | None, ext: float, reach: float) -> np.ndarray:
    """How far the queries of a block have to look, ``reach`` at most: first among the points beside their run, then in its boxes within the block.

    ``at`` is the place of every query among the points along the curve.
    """
    bound = np.full(len(queries), np.inf)
    for low in range(0, len(queries), RUN_POINTS):
        run = slice(low, low + RUN_POINTS)
        wide = slice(max(0, int(at[run][0]) - RUN_POINTS), int(at[run][-1]) + RUN_POINTS + 1)
        bound[run] = _kth(ids[wide], xyz[wide], queries[run], k, None if own is None else own[run])
    bound = np.minimum(bound, reach * reach)
    if len(queries):
        for n, (low, high) in enumerate(zip(*_boxes(queries, bound, ext))):
            run = slice(n * RUN_POINTS, (n + 1) * RUN_POINTS)
            near = _inside(xyz, low, high)
            bound[run] = np.minimum(bound[run], _kth(ids[near], xyz[near], queries[run], k, None if own is None else own[run]))
    return bound


class _Block:
    """A block's points, its queries and the best answers so far; ``more`` brings points of other blocks."""

    def __init__(self, data: bytes, k: int, skip_self: bool):
        self.ids, self.xyz, self.asks, self.places, self.bound, self.ext = thaw(data)
        self.k, self.skip_self = k, skip_self
        if len(self.asks):
            self.low, self.high = _boxes(self.places, self.bound, self.ext)
        self.waiting, self.size, self.best = [(self.ids, self.xyz, True)], len(self.ids), None

    def more(self, data: bytes) -> None:
        self.waiting.append((*thaw(data), False))
        self.size += len(self.waiting[-1][0])
        if self.size > MERGED:
            self.merge()

    def merge(self) -> None:
        """(query, id, place among those found or own, d2) of the best of what is known and what waits."""
        ids, xyz = (np.concatenate([w[c] for w in self.waiting]) for c in (0, 1))
        mine = np.concatenate([np.arange(len(w[0])) if w[2] else np.full(len(w[0]), -1) for w in self.waiting])
        self.waiting, self.size = [], 0
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for n, at in enumerate(range(0, len(self.asks), RUN_POINTS)):
            run = slice(at, at + RUN_POINTS)
            near = np.flatnonzero(_inside(xyz, self.low[n], self.high[n]))
            row, col, d2 = nearest(ids[near], xyz[near], self.places[run], self.k, self.bound[run], self.asks[run] if self.skip_self else None)
            parts.append((row + at, near[col], d2))
        row, col, d2 = (np.concatenate(c) for c in zip(*parts))
        found = (row, ids[col], mine[col], xyz[col], d2)
        if self.best is not None:
            both = [np.concatenate(c) for c in zip(self.best, found)]
            _, keep, _ = _best(both[0], np.arange(len(both[0])), both[1], both[4], self.k)
            found = tuple(c[keep] for c in both)
        self.best = found

    def answers(self) -> tuple:
        if self.waiting:
            self.merge()
        return self.best


#: what a search gives where no digest is asked for
ANSWERS = "cloud_id string, src long, dst long, d2 double, rank int, dx double, dy double, dz double, back boolean"


def _answers(ids: np.ndarray, row: np.ndarray, found: np.ndarray, d2: np.ndarray, way: np.ndarray, back: np.ndarray, inside: np.ndarray) -> list[pa.Array]:
    return [pa.array(ids[row]), pa.array(found), pa.array(d2), pa.array((_places(row) + 1).astype(np.int32)), *[pa.array(way[:, a]) for a in range(3)], pa.array(back, mask=~inside)]


def self_search(
    points: DataFrame, k: int, skip_self: bool, block_points: int = 0, repeated: bool = False, queries: DataFrame | None = None, reach: float = float("inf"),
    digest: Callable[..., list[pa.Array]] = _answers, schema: str = ANSWERS,
) -> DataFrame:
    """(cloud_id, src, dst, d2, rank, dx, dy, dz, back): the k nearest points of every point, ties by id.

    ``skip_self`` leaves out the point's own id. ``dx``.. is the way from the
    point to its neighbour. ``back`` says whether the point is among its
    neighbour's answers too; null where the neighbour is in another block. Where
    ids are ``repeated`` it says nothing, and a row counts once for every row of its id.

    With ``queries`` (their ids are not null) these ask, not the points, and none
    looks farther than about ``reach``; ``back`` says nothing then.

    Where only something made of the answers is wanted, ``digest`` makes the
    columns of ``schema`` after cloud_id from those of a block (ids of those that
    ask; per answer, by row and rank: row, id found, d2, way, back and whether
    that is known), so answers need not leave it.
    """
    rows = max(block_points or BLOCK_POINTS, 4 * (k + 1))
    base = points.select("cloud_id", "point_id", "x", "y", "z").where(F.col("point_id").isNotNull())
    if repeated:
        base = base.join(base.select("cloud_id", "point_id"), ["cloud_id", "point_id"])
    foreign = queries is not None
    if foreign:
        asking = queries.select("cloud_id", "point_id", "x", "y", "z", F.lit(1.0).alias("asks"))
        base = base.withColumn("asks", F.lit(0.0)).unionByName(asking)
    table = space_blocks(base, rows, ["asks"] if foreign else [])

    def parts(data: bytes) -> tuple[np.ndarray, ...]:
        """A block's points, those that ask, and the places of these among the points."""
        ids, xyz, *asks = thaw(data)
        if not asks:
            return ids, xyz, ids, xyz, np.arange(len(ids))
        asks = asks[0][:, 0] > 0
        return ids[~asks], xyz[~asks], ids[asks], xyz[asks], np.cumsum(~asks)[asks]

    frame = cut(frame_of(base).select("cloud_id", "ox", "oy", "oz", "ext"), "frame")
    framed = table.join(frame, "cloud_id").select("cloud_id", "block", "blocks", "ox", "oy", "oz", "ext", "data")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block with how far its points have to look (run -1), and its runs with the boxes of their balls."""
        for cloud, block, blocks, *_, ext, data in _letters(batches):
            ids, xyz, asks, places, at = parts(data)
            bound = _own_bounds(ids, xyz, places, at, k, asks if skip_self else None, ext, reach)
            # the pickle keeps points that ask once
            box = [f.reduce(xyz, axis=0, initial=v) for f, v in ((np.fmin, np.inf), (np.fmax, -np.inf))]
            out = [(-1, 0, *box[0], *box[1], freeze((ids, xyz, asks, places, bound, ext)))]
            if blocks > 1 and len(asks):
                for run, (low, high) in enumerate(zip(*_boxes(places, bound, ext))):
                    side = float((high - low).max())
                    level = int(np.clip(np.floor(np.log2(ext / side)) if side > 0 else DEEPEST, 0, DEEPEST)) // 2 * 2
                    out.append((run, level, *low, *high, None))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cloud] * len(out)), pa.array([block] * len(out), pa.int32()), *[pa.array(c, pa.int32()) for c in columns[:2]],
                    *[pa.array(c, pa.float64()) for c in columns[2:8]], pa.array(columns[8], pa.binary()),
                ],
                names=[c.split()[0] for c in ASKED.split(", ")],
            )

    asked = cut(framed.mapInArrow(ask, ASKED), "asked")
    own = asked.where("run < 0")
    runs = asked.where("run >= 0").drop("data")
    levels = cut(runs.groupBy("cloud_id").agg(F.collect_set("level").alias("levels")), "levels")
    wanted = framed.join(levels, "cloud_id").select("cloud_id", "block", "ox", "oy", "oz", "ext", "levels", "data")
    cell = ["level", "cx", "cy", "cz"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of every wanted level that a block's points lie in."""
        for cloud, block, ox, oy, oz, ext, levels, data in _letters(batches):
            xyz = parts(data)[1]
            xyz = xyz[np.isfinite(xyz).all(axis=1)]
            for level in levels:
                at = np.clip(np.floor((xyz - (ox, oy, oz)) / ext * 2.0**level), 0, 2**level - 1).astype(np.int64)
                at = np.unique(at[:, 0] << 40 | at[:, 1] << 20 | at[:, 2])
                at = [at >> 40, at >> 20 & (1 << 20) - 1, at & (1 << 20) - 1]
                n = len(at[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cloud] * n), pa.array([level] * n, pa.int32()), *[pa.array(c) for c in at], pa.array([block] * n, pa.int32())],
                    names=["cloud_id", *cell, "target"],
                )

    held = wanted.mapInArrow(cells, "cloud_id string, level int, cx long, cy long, cz long, target int")
    targets = own.select("cloud_id", F.col("block").alias("target"), *[F.col(c).alias(f"t{c}") for c in BOX])
    held = held.join(targets, ["cloud_id", "target"])
    spread = runs.join(frame, "cloud_id")
    width = F.pow(F.lit(2.0), F.col("level"))
    for axis in "xyz":
        slot = [
            F.least(F.greatest(F.floor((F.col(f"{axis}{end}") - F.col(f"o{axis}")) / F.col("ext") * width).cast("long"), F.lit(0)), width.cast("long") - 1)
            for end in "01"
        ]
        spread = spread.withColumn(f"c{axis}", F.explode(F.sequence(*slot)))
    meets = [F.col(f"t{a}0") <= F.col(f"{a}1") for a in "xyz"] + [F.col(f"{a}0") <= F.col(f"t{a}1") for a in "xyz"]
    # a row for every point at most: files of this size look small, in a broadcast it is not
    pairs = spread.join(held.hint("merge"), ["cloud_id", *cell]).where((F.col("target") != F.col("block")))
    for test in meets:
        pairs = pairs.where(test)
    # a block has at most rows / RUN_POINTS runs, so a set is small
    wishes = pairs.groupBy("cloud_id", "target", "block").agg(F.collect_set(F.array(*BOX)).alias("boxes"))
    none = F.lit(None).cast("array<array<double>>").alias("boxes")
    mail = wishes.select("cloud_id", F.col("target").alias("to"), F.lit(1).alias("kind"), F.col("block").alias("sender"), F.lit(None).cast("binary").alias("data"), "boxes")
    home = table.select("cloud_id", F.col("block").alias("to"), F.lit(0).alias("kind"), F.lit(-1).alias("sender"), "data", none)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block's points inside the boxes of those that asked."""
        for (cloud, _), letters in groupby(_letters(batches), key=lambda r: r[:2]):
            ids = xyz = None
            for _, to, kind, sender, data, boxes in letters:
                if kind == 0:
                    ids, xyz = parts(data)[:2]
                    continue
                held = np.zeros(len(ids), dtype=bool)
                for box in boxes:
                    held |= _inside(xyz, box[:3], box[3:])
                if held.any():
                    yield _letter(cloud, sender, to, freeze((ids[held], xyz[held])))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cloud, _), letters in groupby(_letters(batches), key=lambda r: r[:2]):
            block = None
            for _, _, kind, _, data, _ in letters:
                if kind == 0:
                    block = _Block(data, k, skip_self)
                else:
                    block.more(data)
            row, found, mine, place, d2 = block.answers()
            n, inside = len(block.ids), mine >= 0
            pair = row * n + mine
            back = inside & False if foreign else np.isin(mine * n + row, pair[inside])
            columns = digest(block.asks, row, found, d2, place - block.places[row], back, back if foreign else inside)
            yield pa.RecordBatch.from_arrays([pa.array([cloud] * len(columns[0]), pa.string()), *columns], names=[c.split()[0] for c in schema.split(", ")])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("cloud_id", "to").sortWithinPartitions("cloud_id", "to", "kind")

    answers = dealt(home.unionByName(mail)).mapInArrow(answer, POST)
    mine = own.select("cloud_id", F.col("block").alias("to"), F.lit(0).alias("kind"), F.lit(-1).alias("sender"), "data", none)
    return dealt(mine.unionByName(answers)).mapInArrow(finish, schema)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time, so that only one block's data is held as Python objects."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield tuple(c[r].as_py() for c in batch.columns)


def _letter(cloud: str, to: int, sender: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([cloud]), *[pa.array([v], pa.int32()) for v in (to, 1, sender)], pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.list_(pa.float64())))],
        names=[c.split()[0] for c in POST.split(", ")],
    )
