"""Local geometry from neighbour tables: moments, surface variation, normals, open boundary."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.columns import add_eigenvalues, add_low_vector
from pointweave.session import cut

POINT = ["cloud_id", "point_id"]
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def offsets(points: DataFrame, pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Neighbour offsets (dx, dy, dz) from the source of every pair; ``pairs`` may bring them."""
    if "dx" in pairs.columns:
        return pairs.select("cloud_id", "src", "dst", *keep, "dx", "dy", "dz")
    a = points.select("cloud_id", F.col("point_id").alias("src"), *[F.col(c).alias("s" + c) for c in "xyz"])
    b = points.select("cloud_id", F.col("point_id").alias("dst"), "x", "y", "z")
    both = pairs.select("cloud_id", "src", "dst", *keep).join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    return both.select("cloud_id", "src", "dst", *keep, *[(F.col(c) - F.col("s" + c)).alias("d" + c) for c in "xyz"])


def scatter_aggs(condition=None, suffix: str = "") -> list:
    """Count, sums and second moments of the offsets, optionally of part of the rows."""

    def part(v):
        return F.sum(v if condition is None else F.when(condition, v).otherwise(0.0))

    n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return (
        [n.alias("n" + suffix)]
        + [part(F.col("d" + a)).alias("s" + a + suffix) for a in "xyz"]
        + [part(F.col("d" + a) * F.col("d" + b)).alias("s" + a + b + suffix) for a, b in _PAIRS]
    )


def scatter_matrix(suffix: str = "") -> list:
    """Centred scatter entries (xx, xy, xz, yy, yz, zz), not yet divided by anything."""
    n = F.col("n" + suffix)
    return [
        F.col("s" + a + b + suffix) - F.col("s" + a + suffix) * F.col("s" + b + suffix) / n for a, b in _PAIRS
    ]


def surface_variation(points: DataFrame, knn: DataFrame, scales: Sequence[int] = (12, 24, 48), fusion: str = "max") -> DataFrame:
    """(cloud_id, point_id, sv): smallest share of the neighbourhood covariance, fused over scales.

    All scales come from one pass over the widest neighbour table; neighbours
    exclude the point, the covariance divides by k - 1.
    """
    scales = sorted({int(k) for k in scales if k > 0})
    rows = offsets(points, knn.where(F.col("rank") <= max(scales)), ["rank"])
    aggs = [a for k in scales for a in scatter_aggs(F.col("rank") <= k, f"_{k}")]
    moments = rows.groupBy("cloud_id", F.col("src").alias("point_id")).agg(*aggs)
    shares = []
    entries = ["m" + a + b for a, b in _PAIRS]
    for k in scales:
        for name, e in zip(entries, scatter_matrix(f"_{k}")):
            moments = moments.withColumn(name, e / F.greatest(F.col(f"n_{k}") - 1, F.lit(1)))
        moments = add_eigenvalues(moments, entries)
        parts = [F.greatest(F.col(v), F.lit(0.0)) for v in ("low", "mid", "high")]
        share = parts[0] / (parts[0] + parts[1] + parts[2] + 1e-8)
        moments = moments.withColumn(f"share_{k}", F.when(F.col(f"n_{k}") < 3, 0.0).otherwise(share))
        moments = moments.drop(*entries, "low", "mid", "high")
        shares.append(F.col(f"share_{k}"))
    if fusion == "max":
        fused = F.greatest(*shares) if len(shares) > 1 else shares[0]
    elif fusion == "mean":
        fused = sum(shares[1:], shares[0]) / len(shares)
    else:  # 75th percentile over the scales
        ordered = F.array_sort(F.array(*shares))
        spot = 0.75 * (len(shares) - 1)
        low_i = int(math.floor(spot))
        a, b = F.get(ordered, F.lit(low_i)), F.get(ordered, F.lit(min(low_i + 1, len(shares) - 1)))
        fused = a + (b - a) * (spot - low_i)
    out = moments.select(*POINT, fused.alias("sv"))
    return points.select(*POINT).join(out, POINT, "left").select(*POINT, F.coalesce("sv", F.lit(0.0)).alias("sv"))


def moments_of(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The :func:`scatter_aggs` of every point's neighbourhood."""
    return offsets(points, pairs).groupBy("cloud_id", F.col("src").alias("point_id")).agg(*scatter_aggs())


def nearest_moments(points: DataFrame, k: int) -> DataFrame:
    """The same of the k nearest of every point; the search sums them itself where it can, so no neighbours are listed."""
    from pointweave.operators.neighbors import knn_join, knn_moments

    moments = knn_moments(points, k)
    return moments_of(points, knn_join(points, k, extra=["dx", "dy", "dz"])) if moments is None else moments


def pca_features(points: DataFrame, pairs: DataFrame, min_neighbors: int = 3, divisor: str = "k") -> DataFrame:
    """Normals (nx, ny, nz), curvature, centroid and neighbour count of every point's neighbourhood."""
    # written out, because a later filter on a normal would be pushed down through every stage and inlined there
    return cut(features_of(moments_of(points, pairs), min_neighbors, divisor), "features")


def features_of(moments: DataFrame, min_neighbors: int = 3, divisor: str = "k", keep: Sequence[str] = ()) -> DataFrame:
    """:func:`pca_features` from the moments; ``keep`` columns ride along."""
    moments = moments.where(F.col("n") >= min_neighbors)
    count = F.col("n") if divisor == "k" else F.greatest(F.col("n") - 1, F.lit(1))
    entries = ["m" + a + b for a, b in _PAIRS]
    for name, e in zip(entries, scatter_matrix()):
        moments = moments.withColumn(name, e / count)
    moments = add_low_vector(add_eigenvalues(moments, entries), entries, "low")
    moments = moments.withColumn("low0", F.greatest("low", F.lit(0.0))).withColumn(
        "total", F.col("low0") + F.greatest("mid", F.lit(0.0)) + F.greatest("high", F.lit(0.0))
    )
    return moments.select(
        *POINT,
        *keep,
        F.col("n").alias("neighbors"),
        "nx",
        "ny",
        "nz",
        F.when(F.col("total") > 1e-15, F.col("low0") / F.nullif("total", F.lit(0.0))).alias("curvature"),
        *[(F.col("s" + a) / F.col("n")).alias("m" + a) for a in "xyz"],
    )


def plane_smooth(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Project every point onto the plane of its neighbourhood; ids stay."""
    f = pca_features(points, pairs)
    # the moments are offsets from the point, so the point sits at the origin
    height = -(F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") + F.col("mz") * F.col("nz"))
    moved = points.join(f, POINT)
    return moved.select(
        *POINT, *[(F.col(a) - height * F.col("n" + a)).alias(a) for a in "xyz"]
    )


def add_tangent_basis(df: DataFrame) -> DataFrame:
    """Two unit vectors (ux..uz, vx..vz) spanning the plane of the normal nx, ny, nz.

    The reference axis is that of the smallest normal component (the first on a tie).
    """
    nx, ny, nz = F.col("nx"), F.col("ny"), F.col("nz")
    ax, ay, az = F.abs(nx), F.abs(ny), F.abs(nz)
    df = df.withColumn("_axis", F.when((ax <= ay) & (ax <= az), 0).when(ay <= az, 1).otherwise(2))
    first, second = F.col("_axis") == 0, F.col("_axis") == 1
    df = df.withColumn("ux", F.when(first, 0.0).when(second, -nz).otherwise(ny))
    df = df.withColumn("uy", F.when(first, nz).when(second, 0.0).otherwise(-nx))
    df = df.withColumn("uz", F.when(first, -ny).when(second, nx).otherwise(0.0))
    ux, uy, uz = F.col("ux"), F.col("uy"), F.col("uz")
    df = df.withColumn("_len", F.sqrt(ux * ux + uy * uy + uz * uz))
    df = df.withColumns({c: F.col(c) / F.col("_len") for c in ("ux", "uy", "uz")})
    return df.withColumns({"vx": ny * uz - nz * uy, "vy": nz * ux - nx * uz, "vz": nx * uy - ny * ux}).drop("_axis", "_len")


def open_boundary(
    points: DataFrame, edges: DataFrame, angle_deg: float = 110.0, min_neighbors: int = 8, low_policy: str = "boundary"
) -> DataFrame:
    """(cloud_id, point_id, degree, max_gap, boundary): widest empty angle around a point in its tangent plane."""
    # all edges of a point meet once, in one row with its list: its moments, its normal and its angles come from there
    way = F.struct("dx", "dy", "dz")
    lists = offsets(points, edges).groupBy("cloud_id", F.col("src").alias("point_id"))
    lists = lists.agg(*scatter_aggs(), F.collect_list(way).alias("ways"))
    # written out, because a filter on a normal would be pushed down through every stage and inlined there
    normals = cut(features_of(lists, 3, keep=["ways"]), "normals").where(F.col("nx").isNotNull())
    few = F.col("neighbors") < min_neighbors
    frames = add_tangent_basis(normals.select(*POINT, "neighbors", "nx", "ny", "nz", F.when(~few, F.col("ways")).alias("ways")))
    flat = F.transform(
        "ways",
        lambda e: F.struct(
            (e["dx"] * F.col("ux") + e["dy"] * F.col("uy") + e["dz"] * F.col("uz")).alias("px"),
            (e["dx"] * F.col("vx") + e["dy"] * F.col("vy") + e["dz"] * F.col("vz")).alias("py"),
        ),
    )
    frames = frames.select(*POINT, "neighbors", flat.alias("flat"))
    seen = F.filter("flat", lambda e: e["px"] * e["px"] + e["py"] * e["py"] > 1e-18)
    two_pi = 2.0 * math.pi
    angles = F.array_sort(F.transform(seen, lambda e: F.pmod(F.atan2(e["py"], e["px"]), F.lit(two_pi))))
    turned = frames.select(*POINT, "neighbors", angles.alias("a"))
    n = F.size("a")
    gaps = F.zip_with(F.slice("a", 2, F.greatest(n - 1, F.lit(0))), F.slice("a", 1, F.greatest(n - 1, F.lit(0))), lambda high, low: high - low)
    widest = F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)), F.lit(two_pi) - F.get("a", n - 1) + F.get("a", F.lit(0)))
    known = turned.select(*POINT, "neighbors", F.when(n >= 2, widest).alias("max_gap"))
    low = (F.col("neighbors") < min_neighbors) if low_policy == "boundary" else F.lit(False)
    wide = F.coalesce(F.col("max_gap") > math.radians(angle_deg), F.lit(False))
    return (
        points.select(*POINT)
        .join(known, POINT, "left")
        .select(
            *POINT,
            F.coalesce("neighbors", F.lit(0)).cast("long").alias("degree"),
            "max_gap",
            (F.coalesce(low, F.lit(False)) | wide).alias("boundary"),
        )
    )


def gaussian_weights(edges: DataFrame, rows_bound: int | None = None) -> DataFrame:
    """exp(-d^2 / (2 s^2)) with s the median positive edge length of the cloud."""
    from pointweave.functions.order_stats import percentiles

    sigma = percentiles(edges.where(F.col("dist") > 0), ["cloud_id"], "dist", [0.5], ["sigma"], rows_bound)
    s = F.col("sigma")
    w = F.exp(-(F.col("dist") * F.col("dist")) / (s * s * 2.0))
    return edges.join(sigma, "cloud_id").select("cloud_id", "src", "dst", "dist", w.alias("weight"))


def variation_weights(edges: DataFrame, variation: DataFrame, gamma: float = 10.0) -> DataFrame:
    """exp(-gamma * max(c_src, c_dst) * d / mean d); ``variation`` is (cloud_id, point_id, sv)."""
    mean = edges.where(F.col("dist") > 0).groupBy("cloud_id").agg(F.avg("dist").alias("mean_dist"))
    a = variation.select("cloud_id", F.col("point_id").alias("src"), F.col("sv").alias("c0"))
    b = variation.select("cloud_id", F.col("point_id").alias("dst"), F.col("sv").alias("c1"))
    both = edges.join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"]).join(mean, "cloud_id")
    w = F.exp(-(F.greatest("c0", "c1") * gamma * F.col("dist")) / (F.col("mean_dist") + 1e-8))
    return both.select("cloud_id", "src", "dst", "dist", w.alias("weight"))


def normalized_laplacian(points: DataFrame, weights: DataFrame) -> DataFrame:
    """Entries of I - D^-1/2 W D^-1/2 as (cloud_id, src, dst, value); an isolated point keeps its 1."""
    degree = weights.groupBy("cloud_id", "src").agg(F.sum("weight").alias("deg"))
    inv = degree.select(
        "cloud_id", F.col("src").alias("point_id"), F.when(F.col("deg") > 1e-12, 1.0 / F.sqrt("deg")).otherwise(0.0).alias("inv")
    )
    a = inv.withColumnsRenamed({"point_id": "src", "inv": "i0"})
    b = inv.withColumnsRenamed({"point_id": "dst", "inv": "i1"})
    off = weights.join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    off = off.select("cloud_id", "src", "dst", (-(F.col("weight") * F.col("i0") * F.col("i1"))).alias("value"))
    eye = points.select("cloud_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(1.0).alias("value"))
    return off.where(F.col("value") != 0).unionByName(eye)
