"""Ground-truth tables aligned to clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import half_even_round
from pointweave.functions.order_stats import percentiles
from pointweave.operators.neighbors import knn_join, nearest_within
from pointweave.session import cut


def match_rounded(points: DataFrame, truth: DataFrame, decimals: int) -> DataFrame:
    """Equi-join of points and truth rows on coordinates rounded half to even."""
    keys = [half_even_round(F.col(a), decimals).alias("k" + a) for a in "xyz"]
    left = points.select("cloud_id", "point_id", *keys)
    extra = [c for c in truth.columns if c not in ("cloud_id", "x", "y", "z")]
    return left.join(truth.select("cloud_id", *keys, *extra), ["cloud_id", "kx", "ky", "kz"]).drop("kx", "ky", "kz")


def align_coordinates(points: DataFrame, truth: DataFrame, tolerance: float | None = None, decimals=(6, 5, 4)) -> DataFrame:
    """(cloud_id, point_id, label) for truth rows (cloud_id, x, y, z, label), label > 0 is a defect.

    The first rounding at which every truth row of a cloud finds a point wins
    for that cloud; clouds without one use the nearest point within the
    tolerance (by default three times the median positive spacing of the cloud).
    """
    points = cut(points.select("cloud_id", "point_id", "x", "y", "z"), "points")
    truth = cut(truth.withColumn("gt_id", F.monotonically_increasing_id()), "truth")
    open_rows, done = truth, []
    for d in decimals:
        hit = cut(match_rounded(points, open_rows, d), "hit")
        found = hit.groupBy("cloud_id").agg(F.count_distinct("gt_id").alias("found"))
        full = open_rows.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("rows")).join(found, "cloud_id").where("rows = found")
        done.append(hit.join(full, "cloud_id", "left_semi").select("cloud_id", "point_id", "label"))
        open_rows = open_rows.join(full, "cloud_id", "left_anti")
    reach = tolerance if tolerance is not None else spacing_tolerance(points)
    ask = open_rows.select("cloud_id", F.col("gt_id").alias("point_id"), "x", "y", "z")
    near = nearest_within(points, ask, reach).join(
        open_rows.select("cloud_id", F.col("gt_id").alias("src"), "label"), ["cloud_id", "src"]
    )
    rows = near.select("cloud_id", F.col("dst").alias("point_id"), "label")
    for part in done:
        rows = rows.unionByName(part)
    flag = rows.groupBy("cloud_id", "point_id").agg(F.max("label").alias("label"))
    return points.select("cloud_id", "point_id").join(flag, ["cloud_id", "point_id"], "left").select(
        "cloud_id", "point_id", F.coalesce(F.col("label") > 0, F.lit(False)).alias("defect")
    )


def spacing_tolerance(points: DataFrame, factor: float = 3.0, least: float = 1e-8) -> DataFrame:
    """``factor`` times the median of the positive nearest-neighbour distances; at least ``least``, also for one place only."""
    near = cut(knn_join(points, 1).where("dist > 0"), "spacing")
    t = percentiles(near, ["cloud_id"], "dist", [0.5], ["median"])
    clouds = points.select("cloud_id").distinct().join(t, "cloud_id", "left")
    return clouds.select("cloud_id", F.greatest(F.coalesce(F.col("median") * factor, F.lit(least)), F.lit(least)).alias("tolerance"))


def from_vector(points: DataFrame, values: DataFrame) -> DataFrame:
    """Label vectors (cloud_id, row, value): one value per point, or a list of 0- or 1-based indices.

    A cloud whose vector fits neither has no labels and gives no rows; it is not a cloud without defects.
    """
    sizes = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    shape = values.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.bool_and(F.col("value") == F.rint("value")).alias("whole"),
    ).join(sizes, "cloud_id")
    kind = (
        F.when(F.col("rows") == F.col("n"), "vector")
        .when(F.col("whole") & (F.col("low") >= 0) & (F.col("high") < F.col("n")), "zero")
        .when(F.col("whole") & (F.col("low") >= 1) & (F.col("high") <= F.col("n")), "one")
    )
    rows = values.join(shape.select("cloud_id", kind.alias("kind")), "cloud_id")
    spot = F.when(F.col("kind") == "vector", F.col("row")).when(F.col("kind") == "zero", F.col("value")).otherwise(F.col("value") - 1)
    hit = F.when(F.col("kind") == "vector", F.col("value") > 0).otherwise(True)
    marks = rows.where(F.col("kind").isNotNull() & hit).select("cloud_id", spot.cast("long").alias("point_id"), F.lit(True).alias("defect"))
    usable = shape.where(kind.isNotNull()).select("cloud_id")
    labelled = points.select("cloud_id", "point_id").join(usable, "cloud_id")
    return labelled.join(marks.distinct(), ["cloud_id", "point_id"], "left").na.fill(False, ["defect"])


def looks_like_labels(rows: DataFrame, column: str) -> DataFrame:
    """Per cloud: does the column look like a label (few values) rather than a coordinate?"""
    v = F.col(column).cast("double")
    whole = F.abs(v - F.rint(v)) <= 1e-8
    s = rows.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(v).alias("exact"), F.count_distinct(F.rint(v)).alias("rounded"),
        F.bool_and(whole).alias("whole"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.bool_and(F.rint(v).isin(0.0, 1.0)).alias("binary"),
    )
    kinds = F.when(F.col("whole"), F.col("rounded")).otherwise(F.col("exact"))
    n = F.col("n")
    test = (
        (F.col("whole") & F.col("binary"))
        | (F.col("whole") & (kinds <= F.greatest(F.lit(16), F.floor(F.sqrt(n)))))
        | ((kinds <= 8) & (F.col("high") <= 255))
        | (kinds <= F.greatest(F.lit(8), F.floor(n / 4)))
    )
    return s.select("cloud_id", ((F.col("low") >= 0) & test).alias("is_label"))


def through_sample(truth: DataFrame, sample: DataFrame) -> DataFrame:
    """Truth of the raw points carried to the sampled ones (same point ids)."""
    return sample.join(truth, ["cloud_id", "point_id"], "left").na.fill(False, ["defect"])
