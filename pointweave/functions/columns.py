"""Column builders shared by the operators. Everything here stays in Catalyst."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sq_dist(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return dx * dx + dy * dy + dz * dz


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def relu(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(value)


def safe_ratio(numerator: Column, denominator: Column, eps: float = 1e-12) -> Column:
    return numerator / F.greatest(F.abs(denominator), F.lit(eps))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, 0.0).otherwise(numerator / denominator)


def half_even_round(value: Column, decimals: int) -> Column:
    """Round half to even on the scaled value, as ``numpy.round`` does."""
    scale = float(10**decimals)
    return F.rint(value * scale) / scale


def add_eigenvalues(df: DataFrame, entries: Sequence[str], out: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """Eigenvalues of the symmetric matrix [[a,b,c],[b,d,e],[c,e,f]] given by six columns.

    Trigonometric solution of the characteristic cubic, then one Newton step on
    the smallest root, where the cosine form loses digits. Each stage is its own
    projection: the intermediate values are used many times and must not be
    inlined into one expression.
    """
    a, b, c, d, e, f = (F.col(n) for n in entries)
    mean, p2, p, low0 = F.col("_mean"), F.col("_p2"), F.col("_p"), F.col("_low0")
    out_low, out_mid, out_high = out
    df = df.withColumn("_mean", (a + d + f) / 3.0)
    df = df.withColumn(
        "_p2",
        (a - mean) * (a - mean) + (d - mean) * (d - mean) + (f - mean) * (f - mean) + (b * b + c * c + e * e) * 2.0,
    ).withColumn("_p", F.sqrt(p2 / 6.0))
    shifted = (
        (a - mean) * ((d - mean) * (f - mean) - e * e)
        - b * (b * (f - mean) - e * c)
        + c * (b * e - (d - mean) * c)
    )
    df = df.withColumn("_phi", F.when(p2 > 0, F.acos(clip(shifted / F.nullif(p * p * p, F.lit(0.0)) / 2.0, -1.0, 1.0)) / 3.0).otherwise(0.0))
    df = df.withColumn(out_high, F.when(p2 > 0, mean + p * 2.0 * F.cos("_phi")).otherwise(mean))
    df = df.withColumn("_low0", mean + p * 2.0 * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0))
    trace = mean * 3.0
    minors = (a * d - b * b) + (a * f - c * c) + (d * f - e * e)
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    df = df.withColumn("_poly", ((low0 - trace) * low0 + minors) * low0 - det)
    df = df.withColumn("_slope", (low0 * 3.0 - trace * 2.0) * low0 + minors)
    safe = (p2 > 0) & (F.abs("_slope") > p2 * 1e-9)
    df = df.withColumn(
        out_low, F.when(safe, low0 - F.col("_poly") / F.nullif(F.col("_slope"), F.lit(0.0))).when(p2 > 0, low0).otherwise(mean)
    )
    df = df.withColumn(out_mid, trace - F.col(out_low) - F.col(out_high))
    return df.drop("_mean", "_p2", "_p", "_phi", "_low0", "_poly", "_slope")


def add_low_vector(df: DataFrame, entries: Sequence[str], low: str) -> DataFrame:
    """Unit eigenvector (nx, ny, nz) of the eigenvalue ``low``; null where it is not defined.

    The vector is the longest cross product of two rows of ``A - low * I``.
    """
    a, b, c, d, e, f = (F.col(n) for n in entries)
    v = F.col(low)
    r0, r1, r2 = (a - v, b, c), (b, d - v, e), (c, e, f - v)

    def cross(s, t):
        x, y, z = s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0]
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    for i, (s, t) in enumerate([(r0, r1), (r0, r2), (r1, r2)]):
        df = df.withColumn(f"_c{i}", cross(s, t))
    ranked = [
        F.struct(
            (F.col(f"_c{i}.x") * F.col(f"_c{i}.x") + F.col(f"_c{i}.y") * F.col(f"_c{i}.y") + F.col(f"_c{i}.z") * F.col(f"_c{i}.z")).alias("n2"),
            F.col(f"_c{i}").alias("v"),
        )
        for i in range(3)
    ]
    df = df.withColumn("_best", F.greatest(*ranked)).withColumn("_len", F.nullif(F.sqrt("_best.n2"), F.lit(0.0)))
    for n in "xyz":
        df = df.withColumn("n" + n, F.col("_best.v." + n) / F.col("_len"))
    return df.drop("_c0", "_c1", "_c2", "_best", "_len")
