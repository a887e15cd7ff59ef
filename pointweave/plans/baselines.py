"""Comparison methods: each returns one row per point with its verdict."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.neighbors import knn_join
from pointweave.operators.surface import pca_features, plane_smooth
from pointweave.session import cut, discard


def statistical_outliers(points: DataFrame, k: int = 5, ratio: float = 0.25) -> DataFrame:
    """Removed by statistical outlier filtering: mean distance to the k nearest (the point
    itself counts as the first) above mean + ratio * sample deviation of the cloud."""
    points = cut(points, "cloud")
    near = knn_join(points, k, queries=points, skip_same_id=False)
    mean = cut(near.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.avg("dist").alias("d")), "mean")
    stats = mean.groupBy("cloud_id").agg(F.avg("d").alias("mu"), F.stddev_samp("d").alias("sd"))
    return mean.join(stats, "cloud_id").select(
        "cloud_id", "point_id", F.coalesce(F.col("d") > F.col("mu") + F.col("sd") * ratio, F.lit(False)).alias("outlier")
    )


def region_growing(
    points: DataFrame, smooth_k: int = 30, smooth_rounds: int = 1, normal_k: int = 50, region_k: int = 30,
    angle_deg: float = 5.0, max_curvature: float = 0.002, min_size: int = 1,
) -> DataFrame:
    """(cloud_id, point_id, region, outlier): smooth-surface regions; all but the largest are outliers.

    Neighbourhoods contain the point itself. See :func:`grow_regions` for the growing rule.
    """
    now = cut(points.select("cloud_id", "point_id", "x", "y", "z"), "cloud")
    for _ in range(smooth_rounds):
        now = cut(plane_smooth(now, knn_join(now, smooth_k, queries=now, skip_same_id=False)), "smoothed")
    near = cut(knn_join(now, normal_k, queries=now, skip_same_id=False), "near")
    feats = pca_features(now, near).select("cloud_id", "point_id", "nx", "ny", "nz", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))
    regions = cut(grow_regions(feats, near.where(F.col("rank") <= region_k), angle_deg, max_curvature), "regions")
    sizes = regions.groupBy("cloud_id", "region", "root_curvature").agg(F.count(F.lit(1)).alias("size"))
    big = sizes.where(F.col("size") >= min_size)
    # largest region; a tie goes to the region that was started first
    best = big.groupBy("cloud_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "root_curvature", "region")).alias("b"))
    best = best.select("cloud_id", F.col("b.region").alias("largest"))
    return regions.join(best, "cloud_id", "left").select(
        "cloud_id", "point_id", "region", F.coalesce(F.col("region") != F.col("largest"), F.lit(True)).alias("outlier")
    )


def grow_regions(feats: DataFrame, near: DataFrame, angle_deg: float, max_curvature: float) -> DataFrame:
    """(cloud_id, point_id, region, root_curvature) of sequential region growing, without the sequence.

    The rule starts regions in order of (curvature, id); a region takes neighbours
    whose normals agree up to sign and goes on from those of low curvature. So a
    point belongs to the earliest start that reaches it, where only low-curvature
    points pass a region on. First the smallest start is propagated along such
    links; what no low-curvature point reaches is then settled among itself: in
    order, an unclaimed point starts a region and claims its direct neighbours.
    """
    cos = math.cos(math.radians(angle_deg))
    rank = F.struct("curvature", F.col("point_id").alias("id"))
    f = cut(feats.withColumn("rank", rank).withColumn("low", F.col("curvature") < max_curvature), "features")
    a = f.select("cloud_id", F.col("point_id").alias("src"), F.col("nx").alias("ax"), F.col("ny").alias("ay"), F.col("nz").alias("az"), F.col("low").alias("src_low"), F.col("rank").alias("src_rank"))
    b = f.select("cloud_id", F.col("point_id").alias("dst"), "nx", "ny", "nz", F.col("rank").alias("dst_rank"))
    links = near.select("cloud_id", "src", "dst").where(F.col("src") != F.col("dst")).join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    dot = F.abs(F.col("ax") * F.col("nx") + F.col("ay") * F.col("ny") + F.col("az") * F.col("nz"))
    links = cut(links.where(dot >= cos).select("cloud_id", "src", "dst", "src_low", "src_rank", "dst_rank"), "links")
    passing = links.where("src_low").select("cloud_id", F.col("src").alias("point_id"), "dst")
    label = cut(f.where("low").select("cloud_id", "point_id", F.col("rank").alias("root")), "label")
    front = label
    while True:
        offer = front.join(passing, ["cloud_id", "point_id"]).groupBy("cloud_id", F.col("dst").alias("point_id")).agg(F.min("root").alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("root").isNull() | (F.col("offer") < F.col("root")))
        merged = label.join(offer, ["cloud_id", "point_id"], "full").select(
            "cloud_id", "point_id", F.when(better, F.col("offer")).otherwise(F.col("root")).alias("root"),
            F.coalesce(better, F.lit(False)).alias("better"),
        )
        merged = cut(merged, "label", changed=F.count_if("better"))
        label = merged.drop("better")
        if not merged.seen["changed"]:
            break
        front = cut(merged.where("better").drop("better"), "front", rows=F.count(F.lit(1)))
    rest = cut(f.join(label, ["cloud_id", "point_id"], "left_anti").select("cloud_id", "point_id", "rank"), "rest")
    among = links.where(F.col("src_rank") < F.col("dst_rank"))
    among = among.join(rest.select("cloud_id", F.col("point_id").alias("src")), ["cloud_id", "src"], "left_semi")
    among = cut(among.join(rest.select("cloud_id", F.col("point_id").alias("dst")), ["cloud_id", "dst"], "left_semi").select("cloud_id", "src", "dst", "src_rank"), "among")
    state = rest.withColumn("state", F.lit(0))  # 0 open, 1 start, 2 claimed
    state = cut(state, "state", open=F.count_if(F.col("state") == 0))
    while state.seen["open"]:
        before = among.join(state.select("cloud_id", F.col("point_id").alias("src"), F.col("state").alias("s")), ["cloud_id", "src"])
        seen = before.groupBy("cloud_id", F.col("dst").alias("point_id")).agg(
            F.bool_or(F.col("s") == 1).alias("claimed"), F.bool_and(F.col("s") == 2).alias("free")
        )
        nxt = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("claimed", F.lit(False)), 2).when(F.coalesce("free", F.lit(True)), 1).otherwise(0)
        last, state = state, state.join(seen, ["cloud_id", "point_id"], "left").select("cloud_id", "point_id", "rank", nxt.alias("state"))
        state = cut(state, "state", open=F.count_if(F.col("state") == 0))
        discard(last)
    starts = state.where(F.col("state") == 1)
    owner = among.join(starts.select("cloud_id", F.col("point_id").alias("src")), ["cloud_id", "src"], "left_semi")
    owner = owner.groupBy("cloud_id", F.col("dst").alias("point_id")).agg(F.min("src_rank").alias("root"))
    claimed = state.where(F.col("state") == 2).select("cloud_id", "point_id").join(owner, ["cloud_id", "point_id"])
    every = label.unionByName(starts.select("cloud_id", "point_id", F.col("rank").alias("root"))).unionByName(claimed)
    return every.select("cloud_id", "point_id", F.col("root.id").alias("region"), F.col("root.curvature").alias("root_curvature"))
