"""Down-sampling: voxel representatives, exact farthest-point sampling, and their combinations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.session import cut, discard, is_empty


def voxel_key(points: DataFrame, size) -> DataFrame:
    """Add the voxel indices vx, vy, vz; ``size`` is a number, three numbers or a column name."""
    sizes = size if isinstance(size, (tuple, list)) else (size, size, size)
    out = points
    for a, s in zip("xyz", sizes):
        width = F.col(s) if isinstance(s, str) else F.lit(float(s))
        out = out.withColumn("v" + a, F.floor(F.col(a) / width).cast("long"))
    return out


def voxel_representatives(points: DataFrame, size) -> DataFrame:
    """Per occupied voxel the point nearest its centre (ties: smallest id), and how many points it holds."""
    sizes = size if isinstance(size, (tuple, list)) else (size, size, size)
    d2 = F.lit(0.0)
    for a, s in zip("xyz", sizes):
        width = F.col(s) if isinstance(s, str) else F.lit(float(s))
        off = F.col(a) - (F.col("v" + a) + 0.5) * width
        d2 = d2 + off * off
    keyed = voxel_key(points, size).withColumn("d2", d2)
    best = keyed.groupBy("cloud_id", "vx", "vy", "vz").agg(
        F.min(F.struct("d2", "point_id", "x", "y", "z")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    return best.select("cloud_id", "best.point_id", "best.x", "best.y", "best.z", "vx", "vy", "vz", "n")


LEAVES = 1024  # about this many leaves (or a small multiple) per cloud
OFFER_ROWS = 100_000  # rows one cloud may offer in a round


def _replay(pdf: pd.DataFrame, shown_per_leaf: int) -> pd.DataFrame:
    """Continue farthest-point picking inside the offered candidates of one cloud, as far as it is exact.

    Rows are bounded by OFFER_ROWS (at least nine per leaf). A leaf's last row only
    gives the bound for its hidden points; picking stops before that bound
    could hide a farther point.
    """
    pdf = pdf.sort_values("point_id", kind="stable")
    leaf, leaf_row = np.unique(pdf[["leaf_lv", "lx", "ly", "lz"]].to_numpy(), axis=0, return_inverse=True)
    leaf_row = leaf_row.reshape(-1)
    shown = (pdf["rn"] <= shown_per_leaf).to_numpy()
    far = pdf["md2"].to_numpy(dtype=float)
    hidden = np.full(len(leaf), -1.0)
    hidden[leaf_row[~shown]] = far[~shown]
    lo, hi = np.empty((len(leaf), 3)), np.empty((len(leaf), 3))
    lo[leaf_row] = pdf[["x0", "y0", "z0"]].to_numpy()
    hi[leaf_row] = pdf[["x1", "y1", "z1"]].to_numpy()
    widest = np.zeros(len(leaf))
    np.maximum.at(widest, leaf_row, far)
    ids = pdf["point_id"].to_numpy()[shown]
    xyz = pdf[["x", "y", "z"]].to_numpy()[shown]
    md2 = far[shown]
    need, done = int(pdf["need"].iloc[0]), int(pdf["done"].iloc[0])
    picks = []
    while done + len(picks) < need:
        i = int(np.argmax(md2))
        if md2[i] <= 0.0 or (picks and md2[i] <= hidden.max()):
            break
        p = xyz[i]
        diff = xyz - p
        md2 = np.minimum(md2, diff[:, 0] * diff[:, 0] + diff[:, 1] * diff[:, 1] + diff[:, 2] * diff[:, 2])
        corner = np.maximum(np.abs(p - lo), np.abs(p - hi))
        reach = (corner * corner).sum(axis=1)
        hidden = np.minimum(hidden, reach)
        gap = np.maximum(np.maximum(lo - p, p - hi), 0.0)
        touched = np.flatnonzero((gap * gap).sum(axis=1) <= widest)
        widest = np.minimum(widest, reach)
        picks.append((done + len(picks), int(ids[i]), *p, leaf[touched].tolist()))
    cloud = pdf["cloud_id"].iloc[0]
    rows = [(cloud, *p[:5], [[int(v) for v in row] for row in p[5]]) for p in picks]
    return pd.DataFrame(rows, columns=["cloud_id", "sample_rank", "point_id", "px", "py", "pz", "touched"])


def farthest_points(points: DataFrame, k: int, seed: int | None = 0) -> DataFrame:
    """Exact farthest-point sample per cloud: (cloud_id, sample_rank, point_id), at most ``k`` each.

    The start is the seeded random row (the first by id without a seed); every next pick is the point farthest
    from all picks (ties: smallest id). Clouds of at most ``k`` points are
    returned whole, in id order; a cloud with fewer than ``k`` distinct places gives one point of each. Picks are made in rounds: each round offers the
    farthest few points of every leaf of the cell index, replays the sequential
    rule inside them for as long as no hidden point can win, and then updates
    only the leaves a pick can reach. A cloud therefore never sits in one task,
    and a round usually yields about as many picks as there are leaves.
    """
    from pointweave.functions.order_stats import values_at_ranks
    from pointweave.operators.octree import build_index

    points = cut(points.select("cloud_id", "point_id", "x", "y", "z"), "cloud")
    counts = cut(points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    few = counts.where(F.col("n") <= k)
    order = Window.partitionBy("cloud_id").orderBy("point_id")
    whole = points.join(few, "cloud_id", "left_semi").select(
        "cloud_id", (F.row_number().over(order) - 1).alias("sample_rank"), "point_id"
    )
    many = counts.where(F.col("n") > k)
    if is_empty(many):
        return whole

    @F.pandas_udf("long")
    def start_row(n: pd.Series) -> pd.Series:
        return n.map(lambda v: 0 if seed is None else int(np.random.default_rng(seed).integers(0, v)))

    rest = points.join(many, "cloud_id", "left_semi")
    starts = values_at_ranks(rest, ["cloud_id"], "point_id", many.select("cloud_id", start_row("n").alias("rank")))
    starts = starts.join(rest, ["cloud_id", "point_id"])
    picks = cut(starts.select("cloud_id", F.lit(0).alias("sample_rank"), "point_id"), "picks")
    largest = many.agg(F.max("n")).first()[0]
    index = build_index(rest, cap=max(64, -(-largest // LEAVES)))
    leaf = ["leaf_lv", "lx", "ly", "lz"]
    first = starts.select("cloud_id", *[F.col(a).alias("p" + a) for a in "xyz"])
    d2 = sum(((F.col(a) - F.col("p" + a)) * (F.col(a) - F.col("p" + a)) for a in "yz"), (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")))
    state = index.points.join(first, "cloud_id").select("cloud_id", *leaf, "point_id", "x", "y", "z", d2.alias("md2"))
    state = cut(state, "state")
    box = state.groupBy("cloud_id", *leaf).agg(
        *[g(a).alias(a + s) for a in "xyz" for g, s in ((F.min, "0"), (F.max, "1"))]
    )
    box = cut(box, "box")
    leaves = box.groupBy("cloud_id").count().agg(F.max("count")).first()[0]
    shown = max(8, OFFER_ROWS // leaves)
    top = Window.partitionBy("cloud_id", *leaf).orderBy(F.desc("md2"), "point_id")
    while True:
        taken = picks.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("done")).where(F.col("done") < k)
        offer = state.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= shown + 1)
        offer = offer.join(box, ["cloud_id", *leaf]).join(taken, "cloud_id").withColumn("need", F.lit(k))
        new = offer.groupBy("cloud_id").applyInPandas(
            lambda pdf: _replay(pdf, shown),
            "cloud_id string, sample_rank int, point_id long, px double, py double, pz double, touched array<array<long>>",
        )
        new = cut(new, "round", rows=F.count(F.lit(1)))
        if not new.seen["rows"]:
            break
        picks = cut(picks.unionByName(new.select("cloud_id", "sample_rank", "point_id")), "picks")
        touch = new.select("cloud_id", "px", "py", "pz", F.explode("touched").alias("t")).select(
            "cloud_id", *[F.col("t")[i].alias(n) for i, n in enumerate(leaf)], "px", "py", "pz"
        )
        touch = touch.groupBy("cloud_id", *leaf).agg(F.collect_list(F.struct("px", "py", "pz")).alias("near"))

        def gap(p):
            parts = [(F.col(a) - p["p" + a]) * (F.col(a) - p["p" + a]) for a in "xyz"]
            return parts[0] + parts[1] + parts[2]

        closer = F.array_min(F.transform("near", gap))
        state = state.join(touch.withColumn("leaf_lv", F.col("leaf_lv").cast("int")), ["cloud_id", *leaf], "left")
        last, state = state, cut(state.select("cloud_id", *leaf, "point_id", "x", "y", "z", F.least("md2", closer).alias("md2")), "state")
        discard(last)
    return whole.unionByName(picks)


def working_sample(
    points: DataFrame, k: int = 10_000, mode: str = "exact", prefilter: int | None = None, seed: int = 0,
    cell_rounds: int = 8,
) -> DataFrame:
    """Sampled cloud (cloud_id, point_id, sample_rank, x, y, z) by one of the sampling modes.

    ``exact``: farthest-point sampling of all points. ``voxel``: of one point per
    voxel, the voxel width adjusted until about max(k, prefilter, 2k) voxels are
    occupied. ``random``: of a random ``prefilter`` of the points.
    """
    points = cut(points, "raw")
    pool = points
    if mode == "voxel":
        pool = voxel_representatives(*_fit_voxels(points, max(k, prefilter or 0, 2 * k), cell_rounds))
    elif mode == "random":
        pool = random_rows(points, max(k, prefilter or k), seed)
    elif mode != "exact":
        raise ValueError(f"unknown sampling mode {mode}")
    picks = farthest_points(pool, k, seed)
    return points.join(picks, ["cloud_id", "point_id"]).select("cloud_id", "point_id", "sample_rank", "x", "y", "z")


def random_rows(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points of every cloud, all of a smaller one: those with the lowest hash of seed, cloud and id.

    The draw does not depend on how rows are partitioned, and the cut-off of a
    cloud comes from range-partitioned counts.
    """
    from pointweave.functions.order_stats import values_at_ranks

    text = F.concat_ws(":", F.lit(str(seed)), F.col("cloud_id").cast("string"), F.col("point_id").cast("string"))
    drawn = cut(points.withColumn("draw", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), "draw")
    sizes = drawn.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("rows"))
    last = values_at_ranks(drawn, ["cloud_id"], "draw", sizes.select("cloud_id", (F.least("rows", F.lit(n)) - 1).alias("rank")))
    last = last.select("cloud_id", F.col("draw").alias("last"))
    return drawn.join(last, "cloud_id").where(F.col("draw") <= F.col("last")).drop("draw", "last")


def sample_summary(sample: DataFrame, truth: DataFrame) -> DataFrame:
    """Per cloud: sampled points, MD5 of their ids in rank order, and how much of the truth (defect) the sample holds.

    Samples are bounded by the working size, which bounds the id list of a cloud.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "point_id"))), lambda r: r["point_id"].cast("string")), ",")
    picked = sample.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("points"), F.md5(ids).alias("indices_md5"))
    defects = truth.where("defect").select("cloud_id", "point_id")
    kept = defects.join(sample.select("cloud_id", "point_id"), ["cloud_id", "point_id"]).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("kept"))
    whole = defects.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("defects")).join(kept, "cloud_id", "left")
    out = picked.join(whole, "cloud_id", "left").na.fill(0, ["defects", "kept"])
    return out.withColumn("retention", F.when(F.col("defects") > 0, F.col("kept") / F.col("defects")).otherwise(0.0))


def _fit_voxels(points: DataFrame, target: int, rounds: int) -> tuple[DataFrame, str]:
    """Attach a voxel width per cloud whose occupancy is within 10 % of the target, or the closest one found."""
    box = points.groupBy("cloud_id").agg(
        *[(F.max(a) - F.min(a)).alias("e" + a) for a in "xyz"], F.count(F.lit(1)).alias("n")
    )
    extent = F.greatest("ex", "ey", "ez", F.lit(1e-9))
    width = cut(box.select("cloud_id", (extent / F.sqrt(F.lit(float(target)))).alias("width")), "width")
    best = width.withColumn("miss", F.lit(float("inf")))
    for _ in range(rounds):
        keyed = voxel_key(points.join(width, "cloud_id"), "width")
        used = keyed.select("cloud_id", "vx", "vy", "vz").distinct().groupBy("cloud_id").agg(F.count(F.lit(1)).alias("used"))
        now = cut(width.join(used, "cloud_id").withColumn("miss", F.abs(F.log(F.col("used") / float(target)))), "fit")
        merged = best.join(now.select("cloud_id", F.col("width").alias("w1"), F.col("miss").alias("m1")), "cloud_id")
        best = cut(
            merged.select(
                "cloud_id", F.when(F.col("m1") < F.col("miss"), F.col("w1")).otherwise(F.col("width")).alias("width"),
                F.least("miss", "m1").alias("miss"),
            ), "best")
        if is_empty(now.where((F.col("used") < 0.9 * target) | (F.col("used") > 1.1 * target))):
            break
        width = now.select("cloud_id", (F.col("width") * F.sqrt(F.col("used") / float(target))).alias("width"))
    return points.join(best.select("cloud_id", "width"), "cloud_id"), "width"
