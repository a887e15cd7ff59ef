"""An adaptive cell index over 3-D points, kept as ordinary tables.

Every cloud gets a cubic frame that is halved ``depth`` times. A *leaf* is the
first cell on the way down that holds at most ``cap`` points, so dense places
get small leaves and empty space costs nothing. The index is a set of
DataFrames keyed by (cloud_id, lv, cx, cy, cz); nothing is collected and no
task owns a cloud, so one cloud may hold most of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.session import cut

CELL = ["cx", "cy", "cz"]
FINE = ["fx", "fy", "fz"]
BOX = ["x0", "x1", "y0", "y1", "z0", "z1"]
MAX_DEPTH = 45


@dataclass
class CellIndex:
    depth: int
    cap: int
    frame: DataFrame  # cloud_id, ox, oy, oz, ext, n
    points: DataFrame  # input columns + fine cell + leaf cell (lv, cx, cy, cz)
    cells: DataFrame  # cloud_id, lv, cell, cnt, box, value sums
    lookup: DataFrame  # cloud_id, lv, cell -> leaf (leaf_lv, lx, ly, lz), its box, cnt, value sums
    sums: list[str]


def with_fine_cell(points: DataFrame, frame: DataFrame, depth: int) -> DataFrame:
    """Attach the frame and the cell at full depth; points outside the frame are clamped to it."""
    scale = float(2**depth)
    joined = points.join(frame, "cloud_id")
    for axis, name in zip("xyz", FINE):
        raw = F.floor((F.col(axis) - F.col("o" + axis)) / F.col("ext") * F.lit(scale))
        joined = joined.withColumn(name, F.least(F.greatest(raw, F.lit(0)), F.lit(2**depth - 1)).cast("long"))
    return joined


def cell_at(level: Column, depth: int) -> list[Column]:
    # F.shiftright only takes an int literal, so levels that vary per row go through expr
    return [F.call_function("shiftright", F.col(f), (F.lit(depth) - level).cast("int")) for f in FINE]


def near_sq(qx: Column, qy: Column, qz: Column) -> Column:
    """Squared distance from a query to the nearest place of the box in scope."""
    total = F.lit(0.0)
    for q, lo, hi in ((qx, "x0", "x1"), (qy, "y0", "y1"), (qz, "z0", "z1")):
        gap = F.greatest(F.col(lo) - q, q - F.col(hi), F.lit(0.0))
        total = total + gap * gap
    return total


def far_sq(qx: Column, qy: Column, qz: Column, prefix: str = "") -> Column:
    """Squared distance from a query to the farthest corner of the box in scope."""
    total = F.lit(0.0)
    for q, lo, hi in ((qx, "x0", "x1"), (qy, "y0", "y1"), (qz, "z0", "z1")):
        gap = F.greatest(F.abs(q - F.col(prefix + lo)), F.abs(q - F.col(prefix + hi)))
        total = total + gap * gap
    return total


def box_aggs() -> list[Column]:
    return [
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"),
        F.max("y1").alias("y1"), F.min("z0").alias("z0"), F.max("z1").alias("z1"),
    ]


def frame_of(points: DataFrame) -> DataFrame:
    """Cubic frame per cloud. Partial aggregation makes this safe for a hot cloud."""
    f = points.groupBy("cloud_id").agg(
        F.min("x").alias("ox"), F.min("y").alias("oy"), F.min("z").alias("oz"),
        F.max("x").alias("mx"), F.max("y").alias("my"), F.max("z").alias("mz"),
        F.count(F.lit(1)).alias("n"),
    )
    ext = F.greatest(F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"), F.col("mz") - F.col("oz"))
    return f.select("cloud_id", "ox", "oy", "oz", F.when(ext > 0, ext).otherwise(1.0).alias("ext"), "n")


def build_index(points: DataFrame, cap: int = 64, sums: list[str] | None = None, rows: str | None = None) -> CellIndex:
    """Index ``points``; ``sums`` are value columns pre-summed per cell, ``rows`` a weight column.

    The depth is found by looking at the fullest finest cell, so a cell over
    ``cap`` can only remain where more than ``cap`` points agree to about 45
    binary digits of the frame.
    """
    sums = sums or []
    frame = cut(frame_of(points), "frame")
    largest = frame.agg(F.max("n")).first()[0] or 1
    depth = 2
    while depth < MAX_DEPTH and 4**depth * cap < largest * 4:
        depth += 1
    weight = F.col(rows) if rows else F.lit(1)
    while True:
        placed = with_fine_cell(points, frame, depth)
        fine = placed.groupBy("cloud_id", *FINE).agg(
            F.count(F.lit(1)).alias("cnt"),
            F.sum(weight).alias("weight"),
            *[F.sum(s).alias(s) for s in sums],
            *[g(F.col(a)).alias(a + k) for a in "xyz" for g, k in ((F.min, "0"), (F.max, "1"))],
        )
        fine = cut(fine, "fine", fullest=F.max("cnt"))
        fullest = fine.seen["fullest"] or 0
        if fullest <= cap or depth >= MAX_DEPTH:
            break
        depth = min(MAX_DEPTH, depth + 3)
    ladder = fine.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    for name, c in zip(CELL, cell_at(F.col("lv"), depth)):
        ladder = ladder.withColumn(name, c)
    key = ["cloud_id", "lv", *CELL]
    cells = cut(
        ladder.groupBy(*key).agg(
            F.sum("cnt").alias("cnt"), F.sum("weight").alias("weight"),
            *[F.sum(s).alias(s) for s in sums], *box_aggs(),
        ),
        "cells",
    )
    # the leaf of a finest cell is the first level whose cell is small enough
    leaf_lv = (
        ladder.select(*key, *FINE)
        .join(cells.select(*key, F.col("cnt").alias("total")), key)
        .groupBy("cloud_id", *FINE)
        .agg(F.coalesce(F.min(F.when(F.col("total") <= cap, F.col("lv"))), F.lit(depth)).alias("leaf_lv"))
    )
    leaves = fine.join(leaf_lv, ["cloud_id", *FINE])
    for name, c in zip(["lx", "ly", "lz"], cell_at(F.col("leaf_lv"), depth)):
        leaves = leaves.withColumn(name, c)
    leaves = cut(leaves, "leaves")
    climb = leaves.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    for name, c in zip(CELL, cell_at(F.col("lv"), depth)):
        climb = climb.withColumn(name, c)
    lookup = climb.groupBy(*key, "leaf_lv", "lx", "ly", "lz").agg(
        F.sum("cnt").alias("cnt"), F.sum("weight").alias("weight"), *[F.sum(s).alias(s) for s in sums], *box_aggs()
    )
    homes = leaves.select("cloud_id", *FINE, "leaf_lv", "lx", "ly", "lz")
    indexed = with_fine_cell(points, frame, depth).join(homes, ["cloud_id", *FINE])
    return CellIndex(
        depth=depth,
        cap=cap,
        frame=frame,
        points=cut(indexed, "indexed"),
        cells=cells,
        lookup=cut(lookup, "lookup"),
        sums=sums,
    )


def covering_cells(queries: DataFrame, index: CellIndex, radius: Column) -> DataFrame:
    """One row per (query, cell) at the level where a ball meets at most two cells per axis.

    ``queries`` carries qx, qy, qz and the frame columns of its cloud.
    """
    reach = radius * (1.0 + 1e-9) + F.col("ext") * 1e-12
    level = F.floor(F.log2(F.col("ext") / (reach * 2.0)))
    level = F.least(F.greatest(level, F.lit(0)), F.lit(index.depth)).cast("int")
    out = queries.withColumn("reach", reach).withColumn("lv", level)
    width = F.pow(F.lit(2.0), F.col("lv"))
    top = width.cast("long") - 1
    for axis, name in zip("xyz", CELL):
        q, o = F.col("q" + axis), F.col("o" + axis)

        def slot(v):
            raw = F.floor((v - o) / F.col("ext") * width).cast("long")
            return F.least(F.greatest(raw, F.lit(0)), top)

        out = out.withColumn(name, F.explode(F.sequence(slot(q - F.col("reach")), slot(q + F.col("reach")))))
    return out
