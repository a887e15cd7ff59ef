"""Queries over point values: scaling, normalising, gating, scoring, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.functions.columns import half_even_round
from pointweave.functions.order_stats import average_rank_percent, percentiles
from pointweave.operators import normalize as N
from pointweave.plans.registry import r6, register
from pointweave.plans.sqltext import cloud, query, rnd
from pointweave.sources import tables as T

IDS = ["cloud_id", "point_id"]
BOUNDS = (
    "s AS (SELECT cloud_id, quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi, min(z) AS mn, max(z) AS mx, "
    "min(CASE WHEN z > 0 THEN z END) AS pos FROM p GROUP BY cloud_id)"
)
CLIP = "least(greatest({}, 0.0::DOUBLE), 1.0::DOUBLE)"
TINY = "1e-12::DOUBLE"


def _per_point(expr: str, name: str, extra: list[str] | None = None, digits: int = 6) -> str:
    return query(
        [cloud("evt"), BOUNDS, *(extra or [])],
        f"SELECT p.cloud_id, p.point_id, {rnd(expr, digits)} AS {name} FROM p JOIN s ON s.cloud_id = p.cloud_id",
    )


@register(
    "scale_isotropic",
    query(
        [
            cloud("evt"),
            "b AS (SELECT cloud_id, (min(x)+max(x))*0.5 AS cx, (min(y)+max(y))*0.5 AS cy, (min(z)+max(z))*0.5 AS cz, "
            "64.0::DOUBLE/greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS f FROM p GROUP BY cloud_id)",
        ],
        f"SELECT p.cloud_id, point_id, {rnd('(x-cx)*f')} AS x, {rnd('(y-cy)*f')} AS y, {rnd('(z-cz)*f')} AS z "
        "FROM p JOIN b ON b.cloud_id = p.cloud_id",
    ),
)
def scale_isotropic(spark, d):
    return N.isotropic_scale(T.events_cloud(spark, d)).select(*IDS, r6("x"), r6("y"), r6("z")).toDF(*IDS, "x", "y", "z")


@register(
    "zscore",
    query(
        [
            cloud("evt"),
            "m AS (SELECT cloud_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, "
            "stddev_pop(z) AS sz FROM p GROUP BY cloud_id)",
        ],
        "SELECT p.cloud_id, point_id, "
        + ", ".join(rnd(f"({a}-m{a})/(CASE WHEN s{a} < 1e-12 THEN 1.0 ELSE s{a} END)") + f" AS z_{a}" for a in "xyz")
        + " FROM p JOIN m ON m.cloud_id = p.cloud_id",
    ),
)
def zscore(spark, d):
    out = N.zscore(T.events_cloud(spark, d), ["x", "y", "z"])
    return out.select(*IDS, *[r6("z_" + a).alias("z_" + a) for a in "xyz"])


@register("minmax_norm", _per_point(f"CASE WHEN mx <= mn THEN 0.0 ELSE {CLIP.format(f'(z-mn)/(mx-mn+{TINY})')} END", "norm"))
def minmax_norm(spark, d):
    return N.minmax_norm(T.events_cloud(spark, d), "z", "norm").select(*IDS, r6("norm").alias("norm"))


@register("q1q99_norm", _per_point(f"CASE WHEN hi <= lo THEN 0.0 ELSE {CLIP.format(f'(z-lo)/(hi-lo+{TINY})')} END", "norm"))
def q1q99_norm(spark, d):
    return N.quantile_norm(T.events_cloud(spark, d), "z", "norm").select(*IDS, r6("norm").alias("norm"))


@register(
    "q1q99_norm_eps_test",
    _per_point(f"CASE WHEN hi <= lo + {TINY} THEN 0.0 ELSE {CLIP.format(f'(z-lo)/(hi-lo+{TINY})')} END", "norm"),
)
def q1q99_norm_eps_test(spark, d):
    out = N.quantile_norm(T.events_cloud(spark, d), "z", "norm", degenerate="le_eps")
    return out.select(*IDS, r6("norm").alias("norm"))


@register("q1q99_norm_untested", _per_point(CLIP.format(f"(z-lo)/(hi-lo+{TINY})"), "norm"))
def q1q99_norm_untested(spark, d):
    out = N.quantile_norm(T.events_cloud(spark, d), "z", "norm", degenerate="never")
    return out.select(*IDS, r6("norm").alias("norm"))


@register(
    "q1q99_positive_fallback",
    query(
        [
            cloud("evt"),
            "v AS (SELECT cloud_id, point_id, CASE WHEN z > (SELECT quantile_cont(z, 0.995) FROM p) THEN z ELSE 0.0 END AS v FROM p)",
            "s AS (SELECT cloud_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, "
            "min(CASE WHEN v > 0 THEN v END) AS pos FROM v GROUP BY cloud_id)",
            "t AS (SELECT cloud_id, lo, (hi = 0.0 AND pos IS NOT NULL) AS fb, CASE WHEN hi = 0.0 AND pos IS NOT NULL THEN pos "
            "ELSE hi END AS hi FROM s)",
        ],
        "SELECT v.cloud_id, point_id, "
        + rnd(
            "CASE WHEN hi <= lo THEN 0.0 WHEN fb THEN "
            + CLIP.format("(v-lo)/(hi-lo)")
            + " ELSE "
            + CLIP.format(f"(v-lo)/(hi-lo+{TINY})")
            + " END"
        )
        + " AS norm FROM v JOIN t ON t.cloud_id = v.cloud_id",
    ),
)
def q1q99_positive_fallback(spark, d):
    p = T.events_cloud(spark, d)
    high = percentiles(p.withColumn("one", F.lit(1)), ["one"], "z", [0.995], ["t"])
    v = p.withColumn("one", F.lit(1)).join(high, "one").withColumn("v", F.when(F.col("z") > F.col("t"), F.col("z")).otherwise(0.0))
    return N.quantile_norm_positive_fallback(v, "v", "norm").select(*IDS, r6("norm").alias("norm"))


@register(
    "nonzero_pctl_gate",
    query(
        [cloud("cust"), "s AS (SELECT cloud_id, quantile_cont(z, 0.5) FILTER (WHERE z <> 0) AS t FROM p GROUP BY cloud_id)"],
        f"SELECT p.cloud_id, point_id, {rnd('t')} AS threshold, CASE WHEN z >= t THEN z ELSE 0.0 END AS gated "
        "FROM p JOIN s ON s.cloud_id = p.cloud_id",
    ),
)
def nonzero_pctl_gate(spark, d):
    p = T.customer_cloud(spark, d)
    t = N.nonzero_percentile(p, "z", 50.0)
    return p.join(t, "cloud_id").select(
        *IDS, r6("threshold").alias("threshold"), N.gate(F.col("z"), F.col("threshold")).alias("gated")
    )


def _mask_sql(op: str) -> str:
    return query(
        [cloud("evt"), "s AS (SELECT cloud_id, quantile_cont(z, 0.97) AS t FROM p GROUP BY cloud_id)"],
        f"SELECT p.cloud_id, point_id, z {op} t AS kept FROM p JOIN s ON s.cloud_id = p.cloud_id",
    )


@register("pctl_mask", _mask_sql(">="))
def pctl_mask(spark, d):
    return N.percentile_mask(T.events_cloud(spark, d), "z", 97.0, "kept").select(*IDS, "kept")


@register("pctl_mask_strict", _mask_sql(">"))
def pctl_mask_strict(spark, d):
    return N.percentile_mask(T.events_cloud(spark, d), "z", 97.0, "kept", strict=True).select(*IDS, "kept")


@register(
    "attenuate_boundary",
    query(
        [cloud("evt"), "s AS (SELECT cloud_id, quantile_cont(z, 0.9) AS t FROM p GROUP BY cloud_id)"],
        f"SELECT p.cloud_id, point_id, {rnd('CASE WHEN z >= t THEN z * 0.01::DOUBLE ELSE z END')} AS response "
        "FROM p JOIN s ON s.cloud_id = p.cloud_id",
    ),
)
def attenuate_boundary(spark, d):
    m = N.percentile_mask(T.events_cloud(spark, d), "z", 90.0, "rim")
    return m.select(*IDS, r6(N.attenuate(F.col("z"), F.col("rim"))).alias("response"))


LEVELS = " + ".join(f"CASE WHEN norm >= {c}::DOUBLE THEN 1 ELSE 0 END" for c in (0.2, 0.4, 0.6, 0.8))
NORMED = (
    f"n AS (SELECT p.cloud_id, point_id, CASE WHEN hi <= lo + {TINY} THEN 0.0 ELSE {CLIP.format(f'(z-lo)/(hi-lo+{TINY})')} END "
    "AS norm FROM p JOIN s ON s.cloud_id = p.cloud_id)"
)


@register("display_levels", query([cloud("evt"), BOUNDS, NORMED], f"SELECT cloud_id, point_id, CAST({LEVELS} AS INTEGER) AS level FROM n"))
def display_levels(spark, d):
    n = N.quantile_norm(T.events_cloud(spark, d), "z", "norm", degenerate="le_eps")
    return n.select(*IDS, N.display_level(F.col("norm")).alias("level"))


@register(
    "hop_budget",
    query(
        [cloud("evt"), BOUNDS, NORMED],
        f"SELECT cloud_id, point_id, CAST(CASE WHEN norm >= 0.6::DOUBLE THEN ([1, 2, 3, 4, 6])[1 + {LEVELS}] ELSE -1 END AS INTEGER) "
        "AS budget FROM n",
    ),
)
def hop_budget(spark, d):
    n = N.quantile_norm(T.events_cloud(spark, d), "z", "norm", degenerate="le_eps")
    return n.select(*IDS, N.hop_budget(N.display_level(F.col("norm")), F.col("norm") >= 0.6).alias("budget"))


@register(
    "rank_percentile",
    "SELECT l_returnflag AS cloud_id, l_quantity AS value, CAST(count(*) AS BIGINT) AS rows_at, "
    + rnd("100.0::DOUBLE * (any_value(r) + (count(*) - 1) / 2.0::DOUBLE - 1) / (any_value(n) - 1)")
    + " AS rank_pct FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, "
    "count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1, 2",
)
def rank_percentile(spark, d):
    li = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cloud_id"), F.col("l_quantity").alias("value"))
    ranked = average_rank_percent(li, ["cloud_id"], "value")
    return ranked.groupBy("cloud_id", "value").agg(
        F.count(F.lit(1)).alias("rows_at"), F.round(F.first("rank_pct"), 6).alias("rank_pct")
    )


def _maha_sql(dims: str) -> str:
    if dims == "x":
        form, cols = "dx*dx/(vx+1e-6::DOUBLE)", "var_samp(x) AS vx, avg(x) AS mx"
        diff = "x-mx AS dx, vx"
    elif dims == "xy":
        cols = "var_samp(x)+1e-6::DOUBLE AS a, covar_samp(x,y) AS b, var_samp(y)+1e-6::DOUBLE AS c, avg(x) AS mx, avg(y) AS my"
        diff = "x-mx AS dx, y-my AS dy, a, b, c"
        form = "(c*dx*dx - 2*b*dx*dy + a*dy*dy)/(a*c-b*b)"
    else:
        cols = (
            "var_samp(x)+1e-6::DOUBLE AS a, covar_samp(x,y) AS b, covar_samp(x,z) AS c, var_samp(y)+1e-6::DOUBLE AS d, "
            "covar_samp(y,z) AS e, var_samp(z)+1e-6::DOUBLE AS f, avg(x) AS mx, avg(y) AS my, avg(z) AS mz"
        )
        diff = "x-mx AS dx, y-my AS dy, z-mz AS dz, a, b, c, d, e, f"
        form = (
            "((d*f-e*e)*dx*dx + (a*f-c*c)*dy*dy + (a*d-b*b)*dz*dz + 2*(c*e-b*f)*dx*dy + 2*(b*e-c*d)*dx*dz + "
            "2*(b*c-a*e)*dy*dz) / (a*(d*f-e*e) + b*(c*e-b*f) + c*(b*e-c*d))"
        )
    return query(
        [cloud("evt"), f"m AS (SELECT cloud_id, {cols} FROM p GROUP BY cloud_id)",
         f"q AS (SELECT p.cloud_id, point_id, {diff} FROM p JOIN m ON m.cloud_id = p.cloud_id)"],
        f"SELECT cloud_id, point_id, {rnd(f'greatest({form}, 0.0::DOUBLE)')} AS score FROM q",
    )


@register("mahalanobis_1d", _maha_sql("x"))
def mahalanobis_1d(spark, d):
    return N.mahalanobis(T.events_cloud(spark, d), ["x"], "score").select(*IDS, r6("score").alias("score"))


@register("mahalanobis_2d", _maha_sql("xy"))
def mahalanobis_2d(spark, d):
    return N.mahalanobis(T.events_cloud(spark, d), ["x", "y"], "score").select(*IDS, r6("score").alias("score"))


@register("mahalanobis_3d", _maha_sql("xyz"))
def mahalanobis_3d(spark, d):
    return N.mahalanobis(T.events_cloud(spark, d), ["x", "y", "z"], "score").select(*IDS, r6("score").alias("score"))


@register(
    "mahalanobis_calibrated",
    query(
        [
            cloud("evt"),
            "m AS (SELECT var_samp(x)+1e-6::DOUBLE AS a, covar_samp(x,z) AS b, var_samp(z)+1e-6::DOUBLE AS c, avg(x) AS mx, "
            "avg(z) AS mz FROM p)",
            "q AS (SELECT cloud_id, point_id, x-mx AS dx, z-mz AS dz, a, b, c FROM p, m)",
        ],
        f"SELECT cloud_id, point_id, {rnd('greatest((c*dx*dx - 2*b*dx*dz + a*dz*dz)/(a*c-b*b), 0.0::DOUBLE)')} AS score FROM q",
    ),
)
def mahalanobis_calibrated(spark, d):
    """Every cloud scored by the statistics of all of them together."""
    p = T.events_cloud(spark, d)
    pooled = N.covariance_stats(p.withColumn("cloud_id", F.lit("all")), ["x", "z"]).drop("cloud_id")
    stats = p.select("cloud_id").distinct().withColumn("one", F.lit(1)).join(pooled.withColumn("one", F.lit(1)), "one")
    return N.mahalanobis(p, ["x", "z"], "score", stats=stats.drop("one")).select(*IDS, r6("score").alias("score"))


@register(
    "distribution_summary",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, "
    + ", ".join(
        f"{rnd(e, 4)} AS {n}"
        for e, n in [
            ("avg(l_extendedprice)", "mean"), ("max(l_extendedprice)", "max"),
            ("quantile_cont(l_extendedprice, 0.5)", "median"), ("quantile_cont(l_extendedprice, 0.75)", "p75"),
            ("quantile_cont(l_extendedprice, 0.9)", "p90"), ("quantile_cont(l_extendedprice, 0.95)", "p95"),
        ]
    )
    + " FROM lineitem GROUP BY 1, 2",
)
def distribution_summary(spark, d):
    li = T.table(spark, d, "lineitem")
    out = N.summary(li, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    cols = ["mean", "max", "median", "p75", "p90", "p95"]
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 4).alias(c) for c in cols])


@register(
    "adaptive_point_threshold",
    query(
        [cloud("cust"), "s AS (SELECT cloud_id, quantile_cont(x, 0.5) AS m FROM p GROUP BY cloud_id)"],
        f"SELECT cloud_id, {rnd('least(greatest(m / 100 * 0.25::DOUBLE, 0.08::DOUBLE), 0.25::DOUBLE)')} AS threshold FROM s",
    ),
)
def adaptive_point_threshold(spark, d):
    from pointweave.operators.rules import adaptive_threshold

    m = percentiles(T.customer_cloud(spark, d), ["cloud_id"], "x", [0.5], ["m"])
    return m.select("cloud_id", r6(adaptive_threshold(F.col("m") / 100)).alias("threshold"))


@register(
    "finite_and_depth_filter",
    query([cloud("cust")], "SELECT cloud_id, count(*) AS kept FROM p WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND z > 0 GROUP BY 1"),
)
def finite_and_depth_filter(spark, d):
    from pointweave.sources.raster import valid_points

    return valid_points(T.customer_cloud(spark, d)).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("kept"))


@register(
    "half_even_rounding",
    query([cloud("cust")], "SELECT cloud_id, point_id, round_even(x, 1) AS x1 FROM p"),
)
def half_even_rounding(spark, d):
    return T.customer_cloud(spark, d).select(*IDS, half_even_round(F.col("x"), 1).alias("x1"))


@register(
    "voxel_representative",
    query(
        [
            cloud("evt"),
            "c AS (SELECT cloud_id, point_id, floor(x/50) AS vx, floor(y/10) AS vy, floor(z/25) AS vz, "
            "pow(x-(floor(x/50)+0.5)*50, 2)+pow(y-(floor(y/10)+0.5)*10, 2)+pow(z-(floor(z/25)+0.5)*25, 2) AS d2 FROM p)",
        ],
        "SELECT cloud_id, point_id, CAST(vx AS BIGINT) AS vx, CAST(vy AS BIGINT) AS vy, CAST(vz AS BIGINT) AS vz, n FROM "
        "(SELECT *, row_number() OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY d2, point_id) AS rn, "
        "count(*) OVER (PARTITION BY cloud_id, vx, vy, vz) AS n FROM c) WHERE rn = 1",
    ),
)
def voxel_representative(spark, d):
    from pointweave.operators.sampling import voxel_representatives

    return voxel_representatives(T.events_cloud(spark, d), (50.0, 10.0, 25.0)).select(*IDS, "vx", "vy", "vz", "n")


@register(
    "score_fusion",
    query(
        [cloud("evt"), "b AS (SELECT cloud_id, quantile_cont(z,0.01) AS a, quantile_cont(z,0.99) AS b, quantile_cont(y,0.01) AS c, quantile_cont(y,0.99) AS d FROM p GROUP BY 1)"],
        "SELECT p.cloud_id, point_id, "
        + rnd(f"greatest({CLIP.format(f'(z-a)/(b-a+{TINY})')}, {CLIP.format(f'(y-c)/(d-c+{TINY})')})")
        + " AS score FROM p JOIN b ON b.cloud_id = p.cloud_id",
    ),
)
def score_fusion(spark, d):
    return N.fuse_scores(T.events_cloud(spark, d), "z", "y", "score").select(*IDS, r6("score").alias("score"))
