"""Per-cloud scaling, normalising, gating and scoring of point values.

Every function takes the point table and returns it with one more column (or a
changed one). ``rows_bound`` is the proven largest cloud (a working sample);
without it the exact quantiles run range-partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import clip
from pointweave.functions.order_stats import percentiles

CLOUD = ["cloud_id"]
TINY = 1e-12


def isotropic_scale(points: DataFrame, cube: float = 64.0) -> DataFrame:
    """Centre each cloud on its box and scale its longest side to ``cube``; a cloud without extent is an error."""
    box = points.groupBy("cloud_id").agg(*[g(a).alias(a + s) for a in "xyz" for g, s in ((F.min, "_lo"), (F.max, "_hi"))])
    extent = F.greatest(*[F.col(a + "_hi") - F.col(a + "_lo") for a in "xyz"])
    frame = box.select(
        "cloud_id",
        *[((F.col(a + "_lo") + F.col(a + "_hi")) * 0.5).alias("c" + a) for a in "xyz"],
        F.when(extent > 0, F.lit(cube) / extent).otherwise(F.raise_error(F.concat(F.lit("no extent in cloud "), F.col("cloud_id").cast("string")))).alias("scale"),
    )
    moved = points.join(frame, "cloud_id")
    for a in "xyz":
        moved = moved.withColumn(a, (F.col(a) - F.col("c" + a)) * F.col("scale"))
    return moved.drop("cx", "cy", "cz", "scale")


def _with_quantiles(df: DataFrame, value: str, p_low: float, p_high: float, rows_bound: int | None) -> DataFrame:
    q = percentiles(df, CLOUD, value, [p_low / 100.0, p_high / 100.0], ["q_lo", "q_hi"], rows_bound)
    return df.join(q, "cloud_id")


def quantile_norm(
    df: DataFrame, value: str, out: str, *, p_low: float = 1.0, p_high: float = 99.0, rows_bound: int | None = None,
    degenerate: str = "le", eps: float = TINY,
) -> DataFrame:
    """Clip (v - lo) / (hi - lo + eps) to [0, 1].

    ``degenerate``: when the result is zero everywhere -- ``le`` if hi <= lo,
    ``le_eps`` if hi <= lo + eps, ``never`` without such a test.
    """
    both = _with_quantiles(df, value, p_low, p_high, rows_bound)
    lo, hi = F.col("q_lo"), F.col("q_hi")
    norm = clip((F.col(value) - lo) / (hi - lo + eps), 0.0, 1.0)
    flat = {"le": hi <= lo, "le_eps": hi <= lo + eps, "never": F.lit(False)}[degenerate]
    return both.withColumn(out, F.when(flat, 0.0).otherwise(norm)).drop("q_lo", "q_hi")


def quantile_norm_positive_fallback(
    df: DataFrame, value: str, out: str, *, p_low: float = 1.0, p_high: float = 99.0, rows_bound: int | None = None
) -> DataFrame:
    """As above; a zero upper quantile is replaced by the smallest positive value (then without eps)."""
    positive = df.groupBy("cloud_id").agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias("low_pos"))
    both = _with_quantiles(df, value, p_low, p_high, rows_bound).join(positive, "cloud_id")
    lo = F.col("q_lo")
    fall = (F.col("q_hi") == 0.0) & F.col("low_pos").isNotNull()
    hi = F.when(fall, F.col("low_pos")).otherwise(F.col("q_hi"))
    width = hi - lo + F.when(fall, 0.0).otherwise(TINY)
    norm = F.when(hi <= lo, 0.0).otherwise(clip((F.col(value) - lo) / F.nullif(width, F.lit(0.0)), 0.0, 1.0))
    return both.withColumn(out, norm).drop("q_lo", "q_hi", "low_pos")


def reference_norm(value: Column, lo: Column, hi: Column, eps: float = TINY) -> Column:
    return clip((value - lo) / (hi - lo + eps), 0.0, 1.0)


def minmax_norm(df: DataFrame, value: str, out: str) -> DataFrame:
    bounds = df.groupBy("cloud_id").agg(F.min(value).alias("v_lo"), F.max(value).alias("v_hi"))
    lo, hi = F.col("v_lo"), F.col("v_hi")
    norm = F.when(hi <= lo, 0.0).otherwise(clip((F.col(value) - lo) / (hi - lo + TINY), 0.0, 1.0))
    return df.join(bounds, "cloud_id").withColumn(out, norm).drop("v_lo", "v_hi")


def percentile_mask(
    df: DataFrame, value: str, percent: float, out: str, *, strict: bool = False, rows_bound: int | None = None
) -> DataFrame:
    t = percentiles(df, CLOUD, value, [percent / 100.0], ["cutoff"], rows_bound)
    test = F.col(value) > F.col("cutoff") if strict else F.col(value) >= F.col("cutoff")
    return df.join(t, "cloud_id").withColumn(out, test).drop("cutoff")


def nonzero_percentile(
    df: DataFrame, value: str, percent: float, out: str = "threshold", rows_bound: int | None = None
) -> DataFrame:
    """Per cloud percentile over the values that are not zero."""
    return percentiles(df.where(F.col(value) != 0), CLOUD, value, [percent / 100.0], [out], rows_bound)


def gate(value: Column, threshold: Column, replacement: float = 0.0) -> Column:
    return F.when(value >= threshold, value).otherwise(F.lit(replacement))


def attenuate(value: Column, mask: Column, weight: float = 0.01) -> Column:
    return F.when(mask, value * weight).otherwise(value)


def display_level(norm: Column, cuts: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> Column:
    """How many cuts the value has reached (a cut belongs to the upper level)."""
    level = F.lit(0)
    for c in cuts:
        level = level + F.when(norm >= F.lit(float(c)), 1).otherwise(0)
    return level.cast("int")


def hop_budget(level: Column, is_root: Column, budgets: Sequence[int] = (1, 2, 3, 4, 6)) -> Column:
    """Budget of the level for a root, -1 elsewhere."""
    table = F.array(*[F.lit(int(b)) for b in budgets])
    return F.when(is_root, F.element_at(table, level + 1)).otherwise(-1).cast("int")


def zscore(df: DataFrame, values: Sequence[str], prefix: str = "z_") -> DataFrame:
    stats = df.groupBy("cloud_id").agg(
        *[F.avg(v).alias("m_" + v) for v in values], *[F.stddev_pop(v).alias("s_" + v) for v in values]
    )
    out = df.join(stats, "cloud_id")
    for v in values:
        std = F.when(F.col("s_" + v) < TINY, 1.0).otherwise(F.col("s_" + v))
        out = out.withColumn(prefix + v, (F.col(v) - F.col("m_" + v)) / std)
    return out.drop(*["m_" + v for v in values], *["s_" + v for v in values])


def mahalanobis(df: DataFrame, values: Sequence[str], out: str, ridge: float = 1e-6, stats: DataFrame | None = None) -> DataFrame:
    """Squared Mahalanobis distance for one to three values; covariance with n-1 and a ridge.

    ``stats`` may come from other rows (:func:`covariance_stats`): the calibrated form.
    """
    values = list(values)
    if not 1 <= len(values) <= 3:
        raise ValueError("one to three values")
    s = stats if stats is not None else covariance_stats(df, values)
    both = df.join(s, "cloud_id")
    d = [F.col(v) - F.col("mu_" + v) for v in values] + [F.lit(0.0)] * (3 - len(values))

    def cov(i, j):
        if i >= len(values) or j >= len(values):
            return F.lit(1.0 if i == j else 0.0)
        base = F.coalesce(F.col(f"cov_{min(i, j)}{max(i, j)}"), F.lit(0.0))
        return base + ridge if i == j else base

    a, b, c, dd, e, f = cov(0, 0), cov(0, 1), cov(0, 2), cov(1, 1), cov(1, 2), cov(2, 2)
    i00, i01, i02 = dd * f - e * e, c * e - b * f, b * e - c * dd
    i11, i12, i22 = a * f - c * c, b * c - a * e, a * dd - b * b
    det = a * i00 + b * i01 + c * i02
    form = (
        d[0] * (i00 * d[0] + i01 * d[1] + i02 * d[2])
        + d[1] * (i01 * d[0] + i11 * d[1] + i12 * d[2])
        + d[2] * (i02 * d[0] + i12 * d[1] + i22 * d[2])
    ) / det
    score = F.when(form.isNull() | F.isnan(form), 0.0).otherwise(F.greatest(form, F.lit(0.0)))
    drop = ["mu_" + v for v in values] + [f"cov_{i}{j}" for i in range(len(values)) for j in range(i, len(values))]
    return both.withColumn(out, score).drop(*drop)


def covariance_stats(df: DataFrame, values: Sequence[str]) -> DataFrame:
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    return df.groupBy("cloud_id").agg(
        *[F.avg(v).alias("mu_" + v) for v in values],
        *[F.covar_samp(values[i], values[j]).alias(f"cov_{i}{j}") for i, j in pairs],
    )


def summary(df: DataFrame, keys: Sequence[str], value: str, rows_bound: int | None = None) -> DataFrame:
    """count, mean, median, p75, p90, p95, max per group."""
    q = percentiles(df, keys, value, [0.5, 0.75, 0.9, 0.95], ["median", "p75", "p90", "p95"], rows_bound)
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return base.join(q, list(keys), "left")


def fuse_scores(df: DataFrame, first: str, second: str, out: str, rows_bound: int | None = None) -> DataFrame:
    """Larger of the two scores, each normalised by its 1 % and 99 % quantiles."""
    both = quantile_norm(df, first, "_f0", degenerate="never", rows_bound=rows_bound)
    both = quantile_norm(both, second, "_f1", degenerate="never", rows_bound=rows_bound)
    return both.withColumn(out, F.greatest("_f0", "_f1")).drop("_f0", "_f1")
