"""Decision rules over component tables: ordered conditions on counts and distributions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import add_eigenvalues, ratio_or_zero, safe_ratio
from pointweave.functions.order_stats import percentiles
from pointweave.session import cut

# The scale-consistency rules, in order of precedence. A rule holds when all its comparisons of
# component sizes hold; all are of integers, so nothing is divided.
SCALE_RULES = (
    ("defect_anchor", "w <= 4 * z", "y <= 4 * q"),
    ("defect_anchor", "w >= 8 * z", "u >= 8 * q", "y >= 8 * q", "gtr >= 8 * q", "z >= 8 * q"),
    ("strong_normal", "gtr >= 2 * y", "w <= u"),
    ("strong_normal", "2 * gtr >= 3 * y", "4 * w <= y"),
    ("strong_normal", "z >= 4 * q", "gtr >= 4 * w"),
    ("strong_normal", "2 * y <= 3 * u", "gtr >= 4 * u"),
    ("weak_normal", "q = 1", "2 * gtr >= 3 * y"),
    ("weak_normal", "y >= 8 * u", "2 * gtr >= 3 * w"),
)
#: a region is normal when strong-normal seeds hold more than this share of its seed mass
NORMAL_MASS = (1, 2)


def seed_state(rules: tuple[tuple[str, ...], ...] = SCALE_RULES) -> Column:
    """State of a seed from the sizes q, u, y, z, w, gtr (columns ``*_size``, bigint): that of the first rule that holds."""
    state = F.lit("unknown")
    for name, *comparisons in reversed(rules):
        sizes = " AND ".join(re.sub(r"\b(q|u|y|z|w|gtr)\b", r"\1_size", c) for c in comparisons)
        state = F.when(F.expr(sizes), name).otherwise(state)
    return state


def vote_regions(seeds: DataFrame, keys=("cloud_id", "y_id"), majority: tuple[int, int] = NORMAL_MASS) -> DataFrame:
    """Seeds (keys, q_size, seed_state) -> state of every grown region."""
    strong = F.col("seed_state") == "strong_normal"
    out = seeds.groupBy(*keys).agg(
        F.sum("q_size").alias("total_mass"),
        F.coalesce(F.sum(F.when(strong, F.col("q_size"))), F.lit(0).cast("long")).alias("strong_mass"),
        F.bool_or(F.col("seed_state") == "defect_anchor").alias("has_anchor"),
    )
    normal = F.col("strong_mass") * majority[1] > F.col("total_mass") * majority[0]
    state = F.when(normal, "normal").when(F.col("has_anchor"), "defect").otherwise("unknown")
    return out.withColumn("y_state", state)


def quadrant(displacement: Column, stress: Column, d_at: float = 0.5, s_at: float = 0.5) -> Column:
    """1 high-high, 2 low-high, 3 high-low, 4 low-low (displacement, stress); a tie counts as high."""
    d, s = displacement >= d_at, stress >= s_at
    return F.when(d & s, 1).when(~d & s, 2).when(d & ~s, 3).otherwise(4)


def adaptive_threshold(median_spacing: Column, alpha: float = 0.25, low: float = 0.08, high: float = 0.25) -> Column:
    return F.least(F.greatest(median_spacing * alpha, F.lit(low)), F.lit(high))


def point_filter(accepted: DataFrame, fields: DataFrame, threshold: DataFrame | float, protected: DataFrame | None = None) -> DataFrame:
    """Accepted points (cloud_id, point_id, ..) whose displacement reaches the threshold (one number, or cloud_id and threshold).

    ``protected`` points stay in any case.
    """
    rows = accepted.join(fields.select("cloud_id", "point_id", "displacement"), ["cloud_id", "point_id"])
    rows = rows.join(threshold, "cloud_id") if isinstance(threshold, DataFrame) else rows.withColumn("threshold", F.lit(float(threshold)))
    keep = F.col("displacement") >= F.col("threshold")
    if protected is not None:
        safe = protected.select("cloud_id", "point_id").distinct().withColumn("_safe", F.lit(True))
        rows = rows.join(safe, ["cloud_id", "point_id"], "left")
        keep = keep | F.coalesce("_safe", F.lit(False))
    return rows.where(keep).select(*accepted.columns)


def classify_regions(
    *, mode: str = "adaptive", min_size: int = 20, max_ratio: float = 0.5, min_large_fraction: float = 0.02,
    max_shallow: float = 0.007, object_scale: float = 64.0, stress_veto: bool = True, max_stress: float = 0.9,
    min_displacement: float = 0.28, absolute_threshold: float | None = None,
) -> Column:
    """Rejection reason of a region, or ``accepted``.

    Reads size, cloud_size, d_p90, d_p95, s_p90, d_ratio_p95 and s_ratio_p95 (null when the
    local reference is not available). ``mode``: adaptive, legacy (absolute
    displacement), or fixed (reject below ``absolute_threshold``).
    """
    small = F.col("size") < min_size
    veto = (F.col("s_p90") > max_stress) if stress_veto else F.lit(False)
    if mode == "legacy":
        return (
            F.when(small, "too_small_closed_component")
            .when(F.col("d_p90") < min_displacement, "low_displacement")
            .when(veto, "stress_veto")
            .otherwise("accepted")
        )
    if mode == "fixed":
        return (
            F.when(small, "too_small")
            .when(F.col("d_p90") < float(absolute_threshold), "fixed_absolute")
            .when(veto, "stress_veto")
            .otherwise("accepted")
        )
    relative = F.coalesce(
        (F.col("d_ratio_p95") <= max_ratio) & (F.col("s_ratio_p95") <= max_ratio), F.lit(False)
    )
    fraction = F.col("size") / F.greatest(F.col("cloud_size"), F.lit(1))
    shallow = (fraction >= min_large_fraction) & (F.col("d_p95") / object_scale <= max_shallow)
    return (
        F.when(small, "too_small")
        .when(relative & shallow, "relative_normal_and_large_shallow")
        .when(relative, "relative_normal")
        .when(shallow, "large_shallow")
        .when(veto, "stress_veto")
        .otherwise("accepted")
    )


def relative_size(sizes: DataFrame, fraction: float = 0.5, cloud_sizes: DataFrame | None = None, min_fraction: float = 0.0) -> DataFrame:
    """Components at least ``fraction`` of the largest of their cloud (exact integer test at one half).

    With ``cloud_sizes`` (cloud_id, n) they must also hold ``min_fraction`` of the cloud's points.
    """
    if not (0.0 <= fraction <= 1.0 and 0.0 <= min_fraction <= 1.0):
        raise ValueError("fractions lie between 0 and 1")
    top = sizes.groupBy("cloud_id").agg(F.max("size").alias("largest"))
    both = sizes.join(top, "cloud_id")
    if fraction == 0.5:
        ok = F.col("size") * 2 >= F.col("largest")
    else:
        ok = F.col("size") >= F.col("largest") * fraction
    if cloud_sizes is not None:
        both = both.join(cloud_sizes.select("cloud_id", F.col("n").alias("_n")), "cloud_id")
        ok = ok & (F.col("size") / F.col("_n") >= min_fraction)
    return both.withColumn("eligible", ok & (F.col("largest") > 0)).drop("_n")


def drop_small_and_red(
    labels: DataFrame, values: DataFrame, cut_off: DataFrame, min_size: int = 2, label: str = "component"
) -> DataFrame:
    """Drop components that are below ``min_size`` and wholly at or above the cut-off (cloud_id, red)."""
    rows = labels.join(values, ["cloud_id", "point_id"]).join(cut_off, "cloud_id")
    bad = rows.groupBy("cloud_id", label).agg(
        F.count(F.lit(1)).alias("size"), F.min("value").alias("low"), F.first("red").alias("red")
    )
    bad = bad.where((F.col("size") < min_size) & (F.col("low") >= F.col("red")))
    return labels.join(bad.select("cloud_id", label), ["cloud_id", label], "left_anti")


def elongation_filter(
    components: DataFrame, points: DataFrame, energy: DataFrame, threshold: DataFrame, min_points: int = 10,
    max_elongation: float = 3.5, factor: float = 1.5, label: str = "component",
) -> DataFrame:
    """Keep components whose mean energy reaches the bar; long thin ones face ``factor`` times the bar.

    Elongation is the ratio of the two largest eigenvalues of the covariance (divided by n).
    """
    rows = components.join(points, ["cloud_id", "point_id"]).join(energy, ["cloud_id", "point_id"])
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    stats = rows.groupBy("cloud_id", label).agg(
        F.count(F.lit(1)).alias("size"), F.avg("energy").alias("mean_energy"),
        *[F.covar_pop(a, b).alias(f"c_{a}{b}") for a, b in pairs],
    )
    stats = add_eigenvalues(stats, [f"c_{a}{b}" for a, b in pairs])
    long = F.when(F.col("mid") > 1e-12, F.col("high") / F.nullif("mid", F.lit(0.0))).otherwise(F.lit(float("inf")))
    stats = cut(stats.withColumn("elongation", long), "elongation").join(threshold, "cloud_id")
    bar = F.when(F.col("elongation") > max_elongation, F.col("bar") * factor).otherwise(F.col("bar"))
    return stats.where((F.col("size") >= min_points) & (F.col("mean_energy") >= bar))


def region_statistics(labels: DataFrame, fields: DataFrame, label: str = "component", rows_bound: int | None = None) -> DataFrame:
    """size and p90/p95/mean/median/max of displacement and stress per region."""
    rows = labels.select("cloud_id", label, "point_id").join(fields, ["cloud_id", "point_id"])
    keys = ["cloud_id", label]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg("displacement").alias("d_mean"), F.max("displacement").alias("d_max"),
        F.avg("stress").alias("s_mean"), F.max("stress").alias("s_max"),
    )
    d = percentiles(rows, keys, "displacement", [0.5, 0.9, 0.95], ["d_median", "d_p90", "d_p95"], rows_bound)
    s = percentiles(rows, keys, "stress", [0.5, 0.9, 0.95], ["s_median", "s_p90", "s_p95"], rows_bound)
    return base.join(d, keys).join(s, keys)


def reference_ratios(candidate: DataFrame, control: DataFrame, label: str = "component") -> DataFrame:
    """Ratios and excesses of candidate over control p90/p95 (both from :func:`region_statistics`)."""
    names = ["d_median", "d_p90", "d_p95", "s_median", "s_p90", "s_p95"]
    ref = control.select("cloud_id", label, *[F.col(n).alias("ref_" + n) for n in names])
    both = candidate.join(ref, ["cloud_id", label], "left")
    for n in names:
        kind, stat = n.split("_")
        both = both.withColumn(f"{kind}_ratio_{stat}", safe_ratio(F.col(n), F.col("ref_" + n)))
        if stat != "median":
            both = both.withColumn(f"{kind}_excess_{stat}", F.col(n) - F.col("ref_" + n))
    return both


def fraction_above(labels: DataFrame, fields: DataFrame, reference: DataFrame, label: str = "component") -> DataFrame:
    """Shares of a region's points above the reference p90/p95 of displacement and stress."""
    rows = labels.join(fields, ["cloud_id", "point_id"]).join(reference, ["cloud_id", label])
    high_d, high_s = F.col("displacement") > F.col("ref_d_p90"), F.col("stress") > F.col("ref_s_p90")
    n = F.count(F.lit(1))
    return rows.groupBy("cloud_id", label).agg(
        ratio_or_zero(F.count_if(high_d), n).alias("fraction_d_above_p90"),
        ratio_or_zero(F.count_if(F.col("displacement") > F.col("ref_d_p95")), n).alias("fraction_d_above_p95"),
        ratio_or_zero(F.count_if(high_s), n).alias("fraction_s_above_p90"),
        ratio_or_zero(F.count_if(F.col("stress") > F.col("ref_s_p95")), n).alias("fraction_s_above_p95"),
        ratio_or_zero(F.count_if(high_d & high_s), n).alias("fraction_both_above_p90"),
    )
