"""Queries over neighbour tables and graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointweave.functions.columns import sq_dist
from pointweave.functions.order_stats import percentiles
from pointweave.operators import balls, graph as G, neighbors as NB, normalize as N, rules, surface
from pointweave.plans.registry import r6, register
from pointweave.plans.sqltext import capped, cloud, graph, hops, knn, labels, mutual, query, rnd, top_mask
from pointweave.session import cut
from pointweave.sources import tables as T

IDS = ["cloud_id", "point_id"]
#: the way to a neighbour, where only that is needed of it
WAY = ["dx", "dy", "dz"]
# the recursive comparisons run on whole clouds of customers, the others on whole clouds of events
CUST = graph("cust", 6)
EVT = graph("evt", 8)


def cust(spark, d):
    p = cut(T.customer_cloud(spark, d), "cloud")
    return p, cut(NB.mutual_knn(p, 6, 2.5), "edges")


def evt(spark, d):
    p = cut(T.events_cloud(spark, d), "cloud")
    return p, cut(NB.mutual_knn(p, 8, 2.5), "edges")


def top(p, column, percent):
    return cut(N.percentile_mask(p, column, percent, "kept").where("kept").select(*IDS), "mask")


@register("knn_edges", query([cloud("evt"), knn(8)], f"SELECT cloud_id, src, dst, rank, {rnd('dist')} AS dist FROM k"))
def knn_edges(spark, d):
    k = NB.knn_join(T.events_cloud(spark, d), 8)
    return k.select("cloud_id", "src", "dst", "rank", r6("dist").alias("dist"))


@register("knn_edges_orders", query([cloud("ord"), knn(4)], f"SELECT cloud_id, src, dst, rank, {rnd('dist')} AS dist FROM k"))
def knn_edges_orders(spark, d):
    k = NB.knn_join(T.orders_cloud(spark, d), 4)
    return k.select("cloud_id", "src", "dst", "rank", r6("dist").alias("dist"))


@register("knn_radius_cap", query([cloud("evt"), knn(8), capped(1.5)], f"SELECT cloud_id, src, dst, {rnd('dist')} AS dist FROM c"))
def knn_radius_cap(spark, d):
    k = cut(NB.knn_join(T.events_cloud(spark, d), 8), "knn")
    return NB.radius_cap(k, 1.5).select("cloud_id", "src", "dst", r6("dist").alias("dist"))


@register("mutual_knn", query(EVT, f"SELECT cloud_id, src, dst, {rnd('dist')} AS dist FROM e"))
def mutual_knn(spark, d):
    return NB.mutual_knn(T.events_cloud(spark, d), 8, 2.5).select("cloud_id", "src", "dst", r6("dist").alias("dist"))


@register(
    "graph_degree",
    query(
        EVT,
        f"SELECT p.cloud_id, p.point_id, count(e.dst) AS degree, {rnd('avg(e.dist)')} AS mean_dist FROM p LEFT JOIN e "
        "ON e.cloud_id = p.cloud_id AND e.src = p.point_id GROUP BY 1, 2",
    ),
)
def graph_degree(spark, d):
    p, e = evt(spark, d)
    return NB.degrees(p, e).select(*IDS, "degree", r6("mean_dist").alias("mean_dist"))


@register(
    "graph_summary",
    query(
        CUST
        + [
            labels("p"),
            "d AS (SELECT p.cloud_id, p.point_id, count(e.dst) AS degree FROM p LEFT JOIN e ON e.cloud_id = p.cloud_id AND "
            "e.src = p.point_id GROUP BY 1, 2)",
            "s AS (SELECT cloud_id, component, count(*) AS size FROM comp GROUP BY 1, 2)",
        ],
        "SELECT d.cloud_id, count(*) AS points, CAST(sum(degree) // 2 AS BIGINT) AS edges, min(degree) AS min_degree, "
        "max(degree) AS max_degree, CAST(count_if(degree = 0) AS BIGINT) AS isolated, "
        "any_value(c.n) AS components, any_value(c.largest) AS largest FROM d JOIN (SELECT cloud_id, count(*) AS n, max(size) AS "
        "largest FROM s GROUP BY 1) c ON c.cloud_id = d.cloud_id GROUP BY d.cloud_id",
        True,
    ),
)
def graph_summary(spark, d):
    p, e = cust(spark, d)
    return G.summary(p, e)


@register(
    "radius_edges",
    query(
        [cloud("cust")],
        "SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, "
        + rnd("sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))")
        + " AS dist FROM p a JOIN p b ON a.cloud_id = b.cloud_id AND "
        "sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) <= 12",
    ),
)
def radius_edges(spark, d):
    return NB.radius_join(T.customer_cloud(spark, d), 12.0).select("cloud_id", "src", "dst", r6(F.sqrt("d2")).alias("dist"))


@register(
    "annulus_edges",
    query(
        [cloud("cust"),
         "d AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+"
         "(b.z-a.z)*(b.z-a.z)) AS dist FROM p a JOIN p b ON a.cloud_id = b.cloud_id)"],
        "SELECT cloud_id, src, count(*) AS n FROM d WHERE dist > 6 AND dist <= 12 GROUP BY 1, 2",
    ),
)
def annulus_edges(spark, d):
    return NB.radius_join(T.customer_cloud(spark, d), 12.0, inner=6.0).groupBy("cloud_id", "src").agg(F.count(F.lit(1)).alias("n"))


@register(
    "nearest_with_tolerance",
    query(
        [cloud("evt"), "q AS (SELECT cloud_id, point_id, x + 0.37 AS x, y - 0.21 AS y, z + 0.5 AS z FROM p)", knn(1, "k", "q", "p", False)],
        f"SELECT cloud_id, src, dst, {rnd('dist')} AS dist FROM k WHERE dist <= 2.5",
    ),
)
def nearest_with_tolerance(spark, d):
    p = cut(T.events_cloud(spark, d), "cloud")
    q = p.select(*IDS, (F.col("x") + 0.37).alias("x"), (F.col("y") - 0.21).alias("y"), (F.col("z") + 0.5).alias("z"))
    return NB.nearest_within(p, q, 2.5).select("cloud_id", "src", "dst", r6("dist").alias("dist"))


FEATURES = ["quantity", "price", "discount", "tax", "lines"]


@register(
    "feature_space_nearest",
    query(
        [
            "p AS (SELECT o.o_orderpriority AS cloud_id, l_orderkey AS point_id, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, "
            "round(sum(l_discount), 4) AS discount, round(sum(l_tax), 4) AS tax, CAST(count(*) AS DOUBLE) AS lines FROM lineitem JOIN orders o ON "
            "o.o_orderkey = l_orderkey GROUP BY 1, 2)",
            "m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM p WHERE quantity < 60)",
            "f AS (SELECT cloud_id, point_id, quantity AS raw, " + ", ".join(f"({c}-m_{c})/s_{c} AS {c}" for c in FEATURES) + " FROM p, m)",
            "b AS (SELECT * FROM f WHERE raw < 60)",
            "d AS (SELECT a.cloud_id, a.point_id, min(" + "+".join(f"(b.{c}-a.{c})*(b.{c}-a.{c})" for c in FEATURES) + ") AS d2 FROM f a, b GROUP BY 1, 2)",
        ],
        f"SELECT cloud_id, point_id, {rnd('d2')} AS score FROM d",
    ),
)
def feature_space_nearest(spark, d):
    """Squared distance to the nearest baseline row in z-scored feature space, five features (baseline: small orders)."""
    li = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("point_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum("l_discount"), 4).alias("discount"),
        F.round(F.sum("l_tax"), 4).alias("tax"), F.count(F.lit(1)).cast("double").alias("lines"),
    )
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderpriority").alias("cloud_id"))
    p = cut(li.join(o, "point_id"), "features")
    return NB.baseline_distance(p, p.where(F.col("quantity") < 60), FEATURES).select(*IDS, r6("score").alias("score"))


@register(
    "seed_local_graph",
    query(
        [
            cloud("cust"),
            top_mask("x", 0.6, "seed"),
            "q AS (SELECT p.* FROM p JOIN seed USING (cloud_id, point_id))",
            knn(8, "k", "q", "p"),
            "s AS (SELECT cloud_id, src, median(dist) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, src "
            "ORDER BY rank) AS pr FROM k WHERE dist > 0) WHERE pr <= 6 GROUP BY 1, 2)",
        ],
        f"SELECT a.cloud_id, a.src, a.dst, {rnd('a.dist')} AS dist FROM k a JOIN k b ON a.cloud_id = b.cloud_id AND a.src = b.dst AND "
        "a.dst = b.src JOIN s s1 ON s1.cloud_id = a.cloud_id AND s1.src = a.src JOIN s s2 ON s2.cloud_id = a.cloud_id AND "
        "s2.src = a.dst WHERE a.dist <= 1.6::DOUBLE * sqrt(s1.scale * s2.scale)",
    ),
)
def seed_local_graph(spark, d):
    p = cut(T.customer_cloud(spark, d), "cloud")
    return NB.seed_graph(p, top(p, "x", 60.0)).select("cloud_id", "src", "dst", r6("dist").alias("dist"))


# ---- neighbourhood aggregates -------------------------------------------------------------


@register(
    "knn_smooth",
    query(
        EVT
        + [
            "n AS (SELECT cloud_id, src, dst FROM e UNION ALL SELECT cloud_id, point_id, point_id FROM p)",
            "s1 AS (SELECT n.cloud_id, n.src AS point_id, avg(p.z) AS z FROM n JOIN p ON p.cloud_id = n.cloud_id AND p.point_id = n.dst GROUP BY 1, 2)",
            "s2 AS (SELECT n.cloud_id, n.src AS point_id, avg(s1.z) AS z FROM n JOIN s1 ON s1.cloud_id = n.cloud_id AND s1.point_id = n.dst GROUP BY 1, 2)",
        ],
        f"SELECT cloud_id, point_id, {rnd('z', 9)} AS z FROM s2",
    ),
)
def knn_smooth(spark, d):
    p, e = evt(spark, d)
    return G.smooth(p, ["z"], e, 2).select(*IDS, r6("z", 9).alias("z"))


PAIRS = (
    "d AS (SELECT a.cloud_id, a.point_id, a.{v} AS own, b.{v} AS other, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+"
    "(b.z-a.z)*(b.z-a.z) AS d2 FROM p a JOIN p b ON a.cloud_id = b.cloud_id)"
)


@register(
    "local_contrast",
    query(
        [cloud("evt"), PAIRS.format(v="z"),
         "m AS (SELECT cloud_id, point_id, any_value(own) AS own, "
         + ", ".join(f"avg(other) FILTER (WHERE d2 <= {r * r}) AS m{r}" for r in (10, 20, 40)) + " FROM d GROUP BY 1, 2)"],
        f"SELECT cloud_id, point_id, {rnd('greatest(own-m10, own-m20, own-m40, 0.0::DOUBLE)', 9)} AS contrast FROM m",
    ),
)
def local_contrast(spark, d):
    out = balls.local_contrast(cut(T.events_cloud(spark, d), "cloud"), ["z"], [10.0, 20.0, 40.0])
    return out.select(*IDS, r6("z", 9).alias("contrast"))


@register(
    "ball_mean",
    query(
        [cloud("evt"), PAIRS.format(v="z")],
        f"SELECT cloud_id, point_id, {rnd('CASE WHEN count(*) < 4 THEN any_value(own) ELSE avg(other) END', 9)} AS mean "
        "FROM d WHERE d2 <= 225 GROUP BY 1, 2",
    ),
)
def ball_mean(spark, d):
    out = balls.ball_mean(cut(T.events_cloud(spark, d), "cloud"), "z", 15.0, 4, "mean")
    return out.select(*IDS, r6("mean", 9).alias("mean"))


@register(
    "annulus_mean",
    query(
        [cloud("evt"), PAIRS.format(v="z")],
        f"SELECT cloud_id, point_id, {rnd('CASE WHEN count_if(d2 > 144) < 8 THEN any_value(own) ELSE avg(other) FILTER (WHERE d2 > 144) END', 9)} "
        "AS mean FROM d WHERE d2 <= 900 GROUP BY 1, 2",
    ),
)
def annulus_mean(spark, d):
    out = balls.annulus_mean(cut(T.events_cloud(spark, d), "cloud"), "z", 12.0, 30.0, 8, "mean")
    return out.select(*IDS, r6("mean", 9).alias("mean"))


@register(
    "local_robust_z",
    query(
        [
            cloud("cust"),
            PAIRS.format(v="x"),
            "r AS (SELECT cloud_id, point_id, own, other FROM d WHERE sqrt(d2) > 6 AND sqrt(d2) <= 20)",
            "m AS (SELECT cloud_id, point_id, any_value(own) AS own, median(other) AS med, count(*) AS n FROM r GROUP BY 1, 2)",
            "a AS (SELECT r.cloud_id, r.point_id, median(abs(other - med)) AS mad FROM r JOIN m USING (cloud_id, point_id) GROUP BY 1, 2)",
        ],
        f"SELECT p.cloud_id, p.point_id, {rnd('CASE WHEN n >= 8 THEN (own - med) / (1.4826::DOUBLE * mad + 1e-12::DOUBLE) ELSE 0.0 END', 5)} AS z "
        "FROM p LEFT JOIN m USING (cloud_id, point_id) LEFT JOIN a USING (cloud_id, point_id)",
    ),
)
def local_robust_z(spark, d):
    p = cut(T.customer_cloud(spark, d), "cloud")
    return balls.local_robust_z(p, "x", 6.0, 20.0, 8, "z_score").select(*IDS, r6("z_score", 5).alias("z"))


# ---- local geometry ------------------------------------------------------------------------

MOMENTS = (
    "o AS (SELECT k.cloud_id, k.src AS point_id, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz FROM {edges} k JOIN p a ON a.cloud_id = k.cloud_id "
    "AND a.point_id = k.src JOIN p b ON b.cloud_id = k.cloud_id AND b.point_id = k.dst)"
)
# closed-form eigenvalues of the sample covariance, largest first by the trigonometric formula
EIGEN = [
    "m AS (SELECT cloud_id, point_id, count(*) AS n, covar_samp(dx,dx) AS a, covar_samp(dx,dy) AS b, covar_samp(dx,dz) AS c, "
    "covar_samp(dy,dy) AS d, covar_samp(dy,dz) AS e, covar_samp(dz,dz) AS f FROM o GROUP BY 1, 2)",
    "q AS (SELECT *, (a+d+f)/3 AS q FROM m)",
    "pp AS (SELECT *, sqrt(((a-q)*(a-q)+(d-q)*(d-q)+(f-q)*(f-q)+2*(b*b+c*c+e*e))/6) AS s FROM q)",
    "ph AS (SELECT *, acos(least(greatest(((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-e*c)+c*(b*e-(d-q)*c))/(s*s*s)/2, -1.0), 1.0))/3 AS phi FROM pp)",
    f"ev AS (SELECT *, q+2*s*cos(phi) AS hi, q+2*s*cos(phi+2*{math.pi}/3) AS lo FROM ph)",
]


@register(
    "surface_moments",
    query(
        [cloud("evt"), knn(8), MOMENTS.format(edges="k"), EIGEN[0]],
        "SELECT cloud_id, point_id, n, "
        + ", ".join(f"{rnd(v, 8)} AS {n}" for v, n in [("a", "xx"), ("b", "xy"), ("c", "xz"), ("d", "yy"), ("e", "yz"), ("f", "zz")])
        + " FROM m",
    ),
)
def surface_moments(spark, d):
    p = cut(T.events_cloud(spark, d), "cloud")
    m = surface.nearest_moments(p, 8)
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    entries = [F.round(v / (F.col("n") - 1), 8).alias(n) for v, n in zip(surface.scatter_matrix(), names)]
    return m.select(*IDS, "n", *entries)


def _variation_sql() -> str:
    ctes, shares = [cloud("evt"), knn(48)], []
    for k in (12, 24, 48):
        ctes.append(MOMENTS.format(edges=f"(SELECT * FROM k WHERE rank <= {k})").replace("o AS", f"o{k} AS", 1))
        for c in EIGEN:
            name = c.split(" AS", 1)[0]
            src = {"m": "o", "q": "m", "pp": "q", "ph": "pp", "ev": "ph"}[name]
            ctes.append(c.replace(f"{name} AS", f"{name}{k} AS", 1).replace(f"FROM {src}", f"FROM {src}{k}"))
        ctes.append(f"v{k} AS (SELECT cloud_id, point_id, greatest(lo,0.0)/(a+d+f+1e-8::DOUBLE) AS v FROM ev{k})")
        shares.append(f"v{k}.v")
    return query(
        ctes,
        f"SELECT v12.cloud_id, v12.point_id, {rnd('greatest(' + ', '.join(shares) + ')')} AS sv FROM v12 JOIN v24 USING (cloud_id, point_id) "
        "JOIN v48 USING (cloud_id, point_id)",
    )


@register("surface_variation", _variation_sql())
def surface_variation(spark, d):
    p = cut(T.events_cloud(spark, d), "cloud")
    return surface.surface_variation(p, NB.knn_join(p, 48, extra=WAY)).select(*IDS, r6("sv").alias("sv"))


@register(
    "curvature",
    query(
        [cloud("evt"), knn(8), MOMENTS.format(edges="k"), *EIGEN],
        f"SELECT cloud_id, point_id, {rnd('greatest(lo,0.0)/(a+d+f)')} AS curvature FROM ev",
    ),
)
def curvature(spark, d):
    p = cut(T.events_cloud(spark, d), "cloud")
    return surface.features_of(surface.nearest_moments(p, 8)).select(*IDS, r6("curvature").alias("curvature"))


NORMALS = [
    "s0 AS (SELECT *, b*e-c*(d-lo) AS x1, c*b-(a-lo)*e AS y1, (a-lo)*(d-lo)-b*b AS z1, b*(f-lo)-c*e AS x2, c*c-(a-lo)*(f-lo) AS y2, "
    "(a-lo)*e-b*c AS z2, (d-lo)*(f-lo)-e*e AS x3, e*c-b*(f-lo) AS y3, b*e-(d-lo)*c AS z3 FROM ev)",
    "s1 AS (SELECT *, x1*x1+y1*y1+z1*z1 AS n1, x2*x2+y2*y2+z2*z2 AS n2, x3*x3+y3*y3+z3*z3 AS n3 FROM s0)",
    "nv AS (SELECT cloud_id, point_id, n, CASE WHEN n1>=n2 AND n1>=n3 THEN x1/sqrt(n1) WHEN n2>=n3 THEN x2/sqrt(n2) ELSE x3/sqrt(n3) END AS nx, "
    "CASE WHEN n1>=n2 AND n1>=n3 THEN y1/sqrt(n1) WHEN n2>=n3 THEN y2/sqrt(n2) ELSE y3/sqrt(n3) END AS ny, "
    "CASE WHEN n1>=n2 AND n1>=n3 THEN z1/sqrt(n1) WHEN n2>=n3 THEN z2/sqrt(n2) ELSE z3/sqrt(n3) END AS nz FROM s1)",
]


@register(
    "pca_normals",
    query(
        [cloud("evt"), knn(8), MOMENTS.format(edges="k"), *EIGEN, *NORMALS],
        f"SELECT cloud_id, point_id, {rnd('nx*nx', 4)} AS nxx, {rnd('ny*ny', 4)} AS nyy, {rnd('nx*ny', 4)} AS nxy FROM nv",
    ),
)
def pca_normals(spark, d):
    """Normals without their arbitrary sign: entries of n n^T."""
    p = cut(T.events_cloud(spark, d), "cloud")
    f = cut(surface.features_of(surface.nearest_moments(p, 8)), "features")
    nx, ny = F.col("nx"), F.col("ny")
    return f.select(*IDS, r6(nx * nx, 4).alias("nxx"), r6(ny * ny, 4).alias("nyy"), r6(nx * ny, 4).alias("nxy"))


@register(
    "open_boundary",
    query(
        EVT
        + [MOMENTS.format(edges="e"), *EIGEN, *NORMALS,
           "t0 AS (SELECT *, abs(nx)<=abs(ny) AND abs(nx)<=abs(nz) AS fx, abs(ny)<=abs(nz) AS fy FROM nv WHERE n >= 3)",
           "t1 AS (SELECT *, CASE WHEN fx THEN 0 WHEN fy THEN -nz ELSE ny END AS ux, CASE WHEN fx THEN nz WHEN fy THEN 0 ELSE -nx END AS uy, "
           "CASE WHEN fx THEN -ny WHEN fy THEN nx ELSE 0 END AS uz FROM t0)",
           "t2 AS (SELECT cloud_id, point_id, n, nx, ny, nz, ux/sqrt(ux*ux+uy*uy+uz*uz) AS ux, uy/sqrt(ux*ux+uy*uy+uz*uz) AS uy, uz/sqrt(ux*ux+uy*uy+uz*uz) AS uz FROM t1)",
           "t3 AS (SELECT o.cloud_id, o.point_id, dx*ux+dy*uy+dz*uz AS px, dx*(ny*uz-nz*uy)+dy*(nz*ux-nx*uz)+dz*(nx*uy-ny*ux) AS py "
           "FROM o JOIN t2 USING (cloud_id, point_id) WHERE n >= 5)",
           f"t4 AS (SELECT cloud_id, point_id, (atan2(py,px) + CASE WHEN atan2(py,px) < 0 THEN 2*{math.pi} ELSE 0 END) AS ang FROM t3 WHERE px*px+py*py > 1e-18)",
           "t5 AS (SELECT *, ang - lag(ang) OVER (PARTITION BY cloud_id, point_id ORDER BY ang) AS gap FROM t4)",
           f"t6 AS (SELECT cloud_id, point_id, greatest(max(gap), 2*{math.pi}-max(ang)+min(ang)) AS g FROM t5 GROUP BY 1,2 HAVING count(*) >= 2)"],
        "SELECT p.cloud_id, p.point_id, " + rnd("t6.g", 4) + f" AS max_gap, coalesce(t2.n < 5, false) OR coalesce(t6.g > {math.radians(110.0)}, false) "
        "AS boundary FROM p LEFT JOIN t2 USING (cloud_id, point_id) LEFT JOIN t6 USING (cloud_id, point_id)",
    ),
)
def open_boundary(spark, d):
    """Widest angular gap; five neighbours are enough in this sparse graph."""
    p = cut(T.events_cloud(spark, d), "cloud")
    b = surface.open_boundary(p, NB.mutual_knn(p, 8, 2.5, WAY), 110.0, 5)  # reads the edges once
    return b.select(*IDS, r6("max_gap", 4).alias("max_gap"), "boundary")


@register(
    "gauss_weights",
    query(EVT + ["s AS (SELECT cloud_id, median(dist) AS s FROM e WHERE dist > 0 GROUP BY 1)"],
          f"SELECT e.cloud_id, src, dst, {rnd('exp(-(dist*dist)/(2*s*s))')} AS weight FROM e JOIN s ON s.cloud_id = e.cloud_id"),
)
def gauss_weights(spark, d):
    _, e = evt(spark, d)
    return surface.gaussian_weights(e).select("cloud_id", "src", "dst", r6("weight").alias("weight"))


VA = [
    "s AS (SELECT cloud_id, avg(dist) AS m FROM e WHERE dist > 0 GROUP BY 1)",
    "w AS (SELECT e.cloud_id, src, dst, exp(-(greatest(a.y, b.y)/1000*10*dist)/(m+1e-8::DOUBLE)) AS weight FROM e JOIN s ON s.cloud_id = e.cloud_id "
    "JOIN p a ON a.cloud_id = e.cloud_id AND a.point_id = src JOIN p b ON b.cloud_id = e.cloud_id AND b.point_id = dst)",
]


@register("va_weights", query(EVT + VA, f"SELECT cloud_id, src, dst, {rnd('weight')} AS weight FROM w"))
def va_weights(spark, d):
    p, e = evt(spark, d)
    w = surface.variation_weights(e, p.select(*IDS, (F.col("y") / 1000).alias("sv")), 10.0)
    return w.select("cloud_id", "src", "dst", r6("weight").alias("weight"))


@register(
    "norm_laplacian_edges",
    query(
        EVT + VA + ["g AS (SELECT cloud_id, src, CASE WHEN sum(weight) > 1e-12 THEN 1/sqrt(sum(weight)) ELSE 0 END AS i FROM w GROUP BY 1, 2)"],
        f"SELECT w.cloud_id, w.src, w.dst, {rnd('-weight*a.i*b.i')} AS value FROM w JOIN g a ON a.cloud_id = w.cloud_id AND a.src = w.src "
        "JOIN g b ON b.cloud_id = w.cloud_id AND b.src = w.dst WHERE weight*a.i*b.i <> 0 UNION ALL "
        "SELECT cloud_id, point_id, point_id, 1.0::DOUBLE FROM p",
    ),
)
def norm_laplacian_edges(spark, d):
    p, e = evt(spark, d)
    w = surface.variation_weights(e, p.select(*IDS, (F.col("y") / 1000).alias("sv")), 10.0)
    return surface.normalized_laplacian(p, w).select("cloud_id", "src", "dst", r6("value").alias("value"))


@register(
    "restoration_laplacian",
    query(
        EVT + ["w AS (SELECT cloud_id, src, dst, 1/(dist+1e-12::DOUBLE) AS weight FROM e)"],
        f"SELECT cloud_id, src, dst, {rnd('-weight')} AS value FROM w UNION ALL "
        f"SELECT cloud_id, src, src, {rnd('sum(weight)')} FROM w GROUP BY 1, 2",
    ),
)
def restoration_laplacian(spark, d):
    from pointweave.operators.restore import graph_laplacian, restoration_weights

    _, e = evt(spark, d)
    return graph_laplacian(restoration_weights(e)).select("cloud_id", "src", "dst", r6("value").alias("value"))


# ---- components and morphology ------------------------------------------------------------


@register("components", query(CUST + [top_mask("z", 0.5), labels("mask")], "SELECT cloud_id, point_id, component FROM comp", True))
def components(spark, d):
    p, e = cust(spark, d)
    return G.mask_components(top(p, "z", 50.0), e)


@register(
    "component_stats",
    query(
        CUST + [top_mask("z", 0.5), labels("mask")],
        f"SELECT c.cloud_id, component, count(*) AS size, {rnd('avg(x)')} AS cx, {rnd('avg(y)')} AS cy, {rnd('avg(z)')} AS cz, "
        f"{rnd('quantile_cont(x, 0.9)')} AS x_p90 FROM comp c JOIN p ON p.cloud_id = c.cloud_id AND p.point_id = c.point_id GROUP BY 1, 2",
        True,
    ),
)
def component_stats(spark, d):
    p, e = cust(spark, d)
    rows = cut(G.mask_components(top(p, "z", 50.0), e).join(p, IDS), "rows")
    keys = ["cloud_id", "component"]
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *[r6(F.avg(a)).alias("c" + a) for a in "xyz"])
    return base.join(percentiles(rows, keys, "x", [0.9], ["p90"]).select(*keys, r6("p90").alias("x_p90")), keys)


@register(
    "small_component_filter",
    query(
        CUST + [top_mask("z", 0.5), labels("mask"), "s AS (SELECT cloud_id, component FROM comp GROUP BY 1, 2 HAVING count(*) >= 4)"],
        "SELECT comp.cloud_id, point_id, comp.component FROM comp JOIN s ON s.cloud_id = comp.cloud_id AND s.component = comp.component",
        True,
    ),
)
def small_component_filter(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 50.0), e), "comp")
    big = G.component_sizes(c).where(F.col("size") >= 4)
    return c.join(big, ["cloud_id", "component"], "left_semi").select(*IDS, "component")


@register(
    "small_red_filter",
    query(
        CUST
        + [
            top_mask("z", 0.8), labels("mask"),
            "t AS (SELECT cloud_id, quantile_cont(x, 0.7) AS red FROM p GROUP BY 1)",
            "b AS (SELECT c.cloud_id, component FROM comp c JOIN p ON p.cloud_id = c.cloud_id AND p.point_id = c.point_id JOIN t ON "
            "t.cloud_id = c.cloud_id GROUP BY 1, 2 HAVING count(*) < 2 AND bool_and(x >= red))",
        ],
        "SELECT c.cloud_id, point_id, c.component FROM comp c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.cloud_id = c.cloud_id AND "
        "b.component = c.component)",
        True,
    ),
)
def small_red_filter(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 80.0), e), "comp")
    red = percentiles(p, ["cloud_id"], "x", [0.7], ["red"])
    return rules.drop_small_and_red(c, p.select(*IDS, F.col("x").alias("value")), red, 2).select(*IDS, "component")


@register(
    "relative_size",
    query(
        CUST + [top_mask("z", 0.5), labels("mask"), "s AS (SELECT cloud_id, component, count(*) AS size FROM comp GROUP BY 1, 2)",
                "m AS (SELECT cloud_id, max(size) AS largest FROM s GROUP BY 1)"],
        "SELECT s.cloud_id, component, size, largest, 2*size >= largest AS eligible FROM s JOIN m ON m.cloud_id = s.cloud_id",
        True,
    ),
)
def relative_size(spark, d):
    p, e = cust(spark, d)
    return rules.relative_size(G.component_sizes(G.mask_components(top(p, "z", 50.0), e)))


@register(
    "elongation_filter",
    query(
        CUST
        + [
            top_mask("z", 0.5), labels("mask"),
            "j AS (SELECT comp.component, p.* FROM comp JOIN p ON p.cloud_id = comp.cloud_id AND p.point_id = comp.point_id)",
            "m AS (SELECT cloud_id, component, count(*) AS n, avg(x) AS energy, covar_pop(x,x) AS a, covar_pop(x,y) AS b, covar_pop(x,z) AS c, "
            "covar_pop(y,y) AS d, covar_pop(y,z) AS e, covar_pop(z,z) AS f FROM j GROUP BY 1, 2)",
            *EIGEN[1:],
            "t AS (SELECT cloud_id, avg(x) AS bar FROM p GROUP BY 1)",
        ],
        f"SELECT ev.cloud_id, component, n AS size, {rnd('hi/(3*q-hi-lo)', 4)} AS elongation FROM ev JOIN t ON t.cloud_id = ev.cloud_id WHERE n >= 10 "
        "AND energy >= bar * CASE WHEN hi/(3*q-hi-lo) > 3.5 THEN 1.5 ELSE 1.0 END",
        True,
    ),
)
def elongation_filter(spark, d):
    p, e = cust(spark, d)
    c = G.mask_components(top(p, "z", 50.0), e)
    bar = p.groupBy("cloud_id").agg(F.avg("x").alias("bar"))
    kept = rules.elongation_filter(c, p, p.select(*IDS, F.col("x").alias("energy")), bar)
    return kept.select("cloud_id", "component", "size", r6("elongation", 4).alias("elongation"))


@register("dilate", query(CUST + [top_mask("z", 0.95), hops("mask", 2)], "SELECT cloud_id, point_id FROM h", True))
def dilate(spark, d):
    p, e = cust(spark, d)
    return G.dilate(top(p, "z", 95.0), e, 2)


def _erode_sql(isolated: bool, steps: int = 2) -> str:
    ctes = CUST + [top_mask("z", 0.3, "m0")]
    for i in range(steps):
        ctes.append(
            f"m{i + 1} AS (SELECT m.cloud_id, m.point_id FROM m{i} m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.cloud_id = m.cloud_id AND "
            f"e.src = m.point_id AND NOT EXISTS (SELECT 1 FROM m{i} o WHERE o.cloud_id = e.cloud_id AND o.point_id = e.dst)))"
        )
    end = f"SELECT cloud_id, point_id FROM m{steps} m"
    if isolated:
        end += " WHERE EXISTS (SELECT 1 FROM e WHERE e.cloud_id = m.cloud_id AND e.src = m.point_id)"
    return query(ctes, end)


@register("erode", _erode_sql(False))
def erode(spark, d):
    p, e = cust(spark, d)
    return G.erode(top(p, "z", 30.0), e, 2)


@register("erode_drop_isolated", _erode_sql(True))
def erode_drop_isolated(spark, d):
    p, e = cust(spark, d)
    return G.erode(top(p, "z", 30.0), e, 2, isolated="drop")


@register(
    "erode_by_complement",
    query(
        CUST + [top_mask("z", 0.3), "out0 AS (SELECT cloud_id, point_id FROM p EXCEPT SELECT cloud_id, point_id FROM mask)", hops("out0", 2)],
        "SELECT cloud_id, point_id FROM p EXCEPT SELECT cloud_id, point_id FROM h",
        True,
    ),
)
def erode_by_complement(spark, d):
    """The third erosion: everything the dilated complement does not reach."""
    p, e = cust(spark, d)
    outside = p.join(top(p, "z", 30.0), IDS, "left_anti")
    return p.select(*IDS).join(G.dilate(outside, e, 2), IDS, "left_anti")


@register(
    "close_gaps",
    query(
        CUST
        + [
            top_mask("z", 0.8), hops("mask", 2), "m0 AS (SELECT cloud_id, point_id FROM h)",
            *[
                f"m{i + 1} AS (SELECT m.cloud_id, m.point_id FROM m{i} m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.cloud_id = m.cloud_id "
                f"AND e.src = m.point_id AND NOT EXISTS (SELECT 1 FROM m{i} o WHERE o.cloud_id = e.cloud_id AND o.point_id = e.dst)))"
                for i in range(2)
            ],
        ],
        "SELECT cloud_id, point_id FROM m2 UNION SELECT cloud_id, point_id FROM mask",
        True,
    ),
)
def close_gaps(spark, d):
    p, e = cust(spark, d)
    return G.close(top(p, "z", 80.0), e, 2, 2, keep_original=True)


@register(
    "close_per_component",
    query(
        CUST
        + [
            top_mask("z", 0.8), labels("mask"), hops("comp", 2, group="component"), "m0 AS (SELECT cloud_id, component, point_id FROM h)",
            *[
                f"m{i + 1} AS (SELECT m.cloud_id, m.component, m.point_id FROM m{i} m WHERE NOT EXISTS (SELECT 1 FROM e WHERE "
                f"e.cloud_id = m.cloud_id AND e.src = m.point_id AND NOT EXISTS (SELECT 1 FROM m{i} o WHERE o.cloud_id = e.cloud_id AND "
                f"o.component = m.component AND o.point_id = e.dst)) AND EXISTS (SELECT 1 FROM e WHERE e.cloud_id = m.cloud_id AND e.src = m.point_id))"
                for i in range(2)
            ],
        ],
        "SELECT cloud_id, component, point_id FROM m2 UNION SELECT cloud_id, component, point_id FROM comp",
        True,
    ),
)
def close_per_component(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 80.0), e), "comp")
    return G.close(c, e, 2, 2, ["component"], keep_original=True, isolated="drop")


@register("hop_distance", query(CUST + [top_mask("z", 0.97), hops("mask", None)],
          "SELECT p.cloud_id, p.point_id, coalesce(h.hop, -1) AS hop FROM p LEFT JOIN h USING (cloud_id, point_id)", True))
def hop_distance(spark, d):
    p, e = cust(spark, d)
    h = G.hop_distance(top(p, "z", 97.0), e)
    return p.select(*IDS).join(h, IDS, "left").select(*IDS, F.coalesce("hop", F.lit(-1)).alias("hop"))


@register("hop_distance_capped", query(CUST + [top_mask("z", 0.97), hops("mask", 5)],
          "SELECT p.cloud_id, p.point_id, CAST(coalesce(h.hop, 6) AS DOUBLE) AS hop FROM p LEFT JOIN h USING (cloud_id, point_id)", True))
def hop_distance_capped(spark, d):
    """Unreached points get one more than the largest hop."""
    p, e = cust(spark, d)
    h = G.hop_distance(top(p, "z", 97.0), e, 5)
    return p.select(*IDS).join(h, IDS, "left").select(*IDS, F.coalesce("hop", F.lit(6)).cast("double").alias("hop"))


@register("shells", query(CUST + [top_mask("z", 0.9), hops("mask", 2)], "SELECT cloud_id, point_id, hop AS shell FROM h WHERE hop > 0", True))
def shells(spark, d):
    p, e = cust(spark, d)
    return G.hop_distance(top(p, "z", 90.0), e, 2).where("hop > 0").select(*IDS, F.col("hop").alias("shell"))


@register(
    "rings",
    query(
        CUST + [top_mask("z", 0.85), labels("mask"), hops("comp", 3, group="component", blocked="comp")],
        "SELECT cloud_id, component, point_id, hop FROM h WHERE hop > 0",
        True,
    ),
)
def rings(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 85.0), e), "comp")
    return G.rings(c, e, 3)


@register(
    "component_adjacency",
    query(
        EVT + ["b AS (SELECT cloud_id, point_id, CAST(least(floor(z / 20), 9) AS BIGINT) AS component FROM p)"],
        "SELECT DISTINCT e.cloud_id, a.component AS a, b.component AS b FROM e JOIN b a ON a.cloud_id = e.cloud_id AND a.point_id = e.src "
        "JOIN b b ON b.cloud_id = e.cloud_id AND b.point_id = e.dst WHERE a.component < b.component",
    ),
)
def component_adjacency(spark, d):
    p, e = evt(spark, d)
    band = p.select(*IDS, F.least(F.floor(F.col("z") / 20), F.lit(9)).cast("long").alias("component"))
    return G.adjacent_components(band, e)


@register(
    "gap_groups",
    query(
        CUST
        + [
            top_mask("z", 0.85), labels("mask"), hops("comp", 2, group="component"),
            "l AS (SELECT DISTINCT h.cloud_id, h.component AS src, c.component AS dst FROM h JOIN comp c ON c.cloud_id = h.cloud_id AND "
            "c.point_id = h.point_id WHERE c.component <> h.component)",
            "n AS (SELECT DISTINCT cloud_id, component AS point_id FROM comp)",
            labels("n", "l", "g"),
        ],
        "SELECT cloud_id, point_id AS component, component AS grp FROM g",
        True,
    ),
)
def gap_groups(spark, d):
    p, e = cust(spark, d)
    return G.gap_groups(cut(G.mask_components(top(p, "z", 85.0), e), "comp"), e, 2)


@register(
    "descending_growth",
    query(
        CUST
        + [
            top_mask("z", 0.9),
            "root AS (SELECT mask.cloud_id, mask.point_id, CASE WHEN x >= 50 THEN 4 ELSE 2 END AS budget FROM mask JOIN p USING (cloud_id, point_id))",
            "lg AS (SELECT e.cloud_id, src, dst FROM e JOIN p a ON a.cloud_id = e.cloud_id AND a.point_id = src JOIN p b ON "
            "b.cloud_id = e.cloud_id AND b.point_id = dst WHERE b.z <= a.z + 1e-12 AND b.z >= 20 - 1e-12)",
            "w(cloud_id, point_id, remaining, depth, via) AS (SELECT cloud_id, point_id, budget, 0, NULL::BIGINT FROM root UNION SELECT w.cloud_id, lg.dst, "
            "w.remaining - 1, w.depth + 1, w.point_id FROM w JOIN lg ON lg.cloud_id = w.cloud_id AND lg.src = w.point_id WHERE w.remaining > 0)",
        ],
        "SELECT cloud_id, point_id, max(remaining) AS remaining, min(depth) AS depth, min({'r': -remaining, 'd': depth, 'v': via}).v AS parent FROM w GROUP BY 1, 2",
        True,
    ),
)
def descending_growth(spark, d):
    p, e = cust(spark, d)
    root = top(p, "z", 90.0).join(p, IDS).select(*IDS, F.when(F.col("x") >= 50, 4).otherwise(2).alias("budget"))
    grown = G.descending_growth(root, p.select(*IDS, F.col("z").alias("response")), e, 20.0)
    return grown.select(*IDS, "remaining", "depth", "parent")


@register(
    "seed_relative_growth",
    query(
        CUST
        + [
            top_mask("z", 0.9), labels("mask"),
            "f AS (SELECT c.cloud_id, component, greatest(0.08, quantile_cont(z, 0.9) * 0.49::DOUBLE) AS floor FROM comp c JOIN p USING (cloud_id, point_id) GROUP BY 1, 2)",
            "ok AS (SELECT e.cloud_id, e.src, e.dst, p.z FROM e JOIN p ON p.cloud_id = e.cloud_id AND p.point_id = e.dst)",
            "w(cloud_id, component, point_id, hop) AS (SELECT cloud_id, component, point_id, 0 FROM comp UNION SELECT w.cloud_id, w.component, ok.dst, "
            "w.hop + 1 FROM w JOIN ok ON ok.cloud_id = w.cloud_id AND ok.src = w.point_id JOIN f ON f.cloud_id = w.cloud_id AND "
            "f.component = w.component WHERE w.hop < 3 AND ok.z >= f.floor)",
        ],
        "SELECT cloud_id, component, point_id, min(hop) AS hop FROM w GROUP BY 1, 2, 3",
        True,
    ),
)
def seed_relative_growth(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 90.0), e), "comp")
    floor = percentiles(c.join(p, IDS), ["cloud_id", "component"], "z", [0.9], ["level"])
    floor = floor.select("cloud_id", "component", F.greatest(F.col("level") * 0.49, F.lit(0.08)).alias("floor"))
    energy = p.select(*IDS, F.col("z").alias("energy"))
    return G.energy_growth(c, energy, e, floor, 3, descend="any").select("cloud_id", "component", "point_id", "hop")


ALPHAS, ALPHA_SIZE = (0.2, 0.4, 0.6, 0.8), 5


@register(
    "adaptive_alpha_growth",
    query(
        CUST
        + [
            top_mask("z", 0.97), labels("mask"), hops("comp", 3, group="component"),
            "s AS (SELECT c.cloud_id, component, quantile_cont(z, 0.9) AS s FROM comp c JOIN p USING (cloud_id, point_id) GROUP BY 1, 2)",
            "b AS (SELECT h.cloud_id, component, quantile_cont(z, 0.5) AS b FROM h JOIN p USING (cloud_id, point_id) WHERE hop > 0 GROUP BY 1, 2)",
            "c0 AS (SELECT cloud_id, quantile_cont(z, 0.5) AS b0 FROM p GROUP BY 1)",
            "lv AS (SELECT s.cloud_id, s.component, s, coalesce(b, b0) AS b FROM s LEFT JOIN b ON b.cloud_id = s.cloud_id AND b.component = s.component "
            "JOIN c0 ON c0.cloud_id = s.cloud_id)",
            f"f AS (SELECT cloud_id, component, i, a, least(greatest(b + a * (s - b), 20), greatest(s * 0.95::DOUBLE, 20)) AS floor FROM lv, "
            f"(VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate(ALPHAS))}) v(i, a))",
            # every alpha grown by itself
            "w(cloud_id, component, i, point_id, hop) AS (SELECT c.cloud_id, c.component, i, point_id, 0 FROM comp c JOIN f ON f.cloud_id = c.cloud_id AND "
            "f.component = c.component UNION SELECT w.cloud_id, w.component, w.i, e.dst, hop + 1 FROM w JOIN e ON e.cloud_id = w.cloud_id AND e.src = w.point_id "
            "JOIN p ON p.cloud_id = e.cloud_id AND p.point_id = e.dst JOIN f ON f.cloud_id = w.cloud_id AND f.component = w.component AND f.i = w.i "
            "WHERE hop < 3 AND z >= floor)",
            "g AS (SELECT DISTINCT cloud_id, component, i, point_id FROM w)",
            "n AS (SELECT cloud_id, component, i, count(*) AS size FROM g GROUP BY 1, 2, 3)",
            f"pick AS (SELECT cloud_id, component, coalesce(min(i) FILTER (WHERE size <= {ALPHA_SIZE}), min({{'s': size, 'i': i}}).i) AS i FROM n GROUP BY 1, 2)",
        ],
        f"SELECT g.cloud_id, g.component, g.point_id, a AS alpha, {rnd('floor')} AS floor, size, size > {ALPHA_SIZE} AS oversized FROM pick JOIN g "
        "USING (cloud_id, component, i) JOIN n USING (cloud_id, component, i) JOIN f USING (cloud_id, component, i)",
        True,
    ),
)
def adaptive_alpha_growth(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 97.0), e), "comp")
    energy = p.select(*IDS, F.col("z").alias("energy"))
    grown = G.adaptive_growth(c, energy, e, ALPHAS, ALPHA_SIZE, 20.0, max_hops=3)
    return grown.select("cloud_id", "component", "point_id", "alpha", r6("floor").alias("floor"), "size", "oversized")


@register(
    "energy_descent_growth",
    query(
        CUST
        + [
            top_mask("z", 0.9), labels("mask"),
            "f AS (SELECT c.cloud_id, component, greatest(0.08, quantile_cont(z, 0.9) * 0.49::DOUBLE) AS floor FROM comp c JOIN p USING (cloud_id, point_id) GROUP BY 1, 2)",
            "dn AS (SELECT e.cloud_id, e.src, e.dst, b.z FROM e JOIN p a ON a.cloud_id = e.cloud_id AND a.point_id = e.src JOIN p b ON "
            "b.cloud_id = e.cloud_id AND b.point_id = e.dst WHERE b.z < a.z - 1e-6::DOUBLE)",
            "w(cloud_id, component, point_id) AS (SELECT cloud_id, component, point_id FROM comp UNION SELECT w.cloud_id, w.component, dn.dst "
            "FROM w JOIN dn ON dn.cloud_id = w.cloud_id AND dn.src = w.point_id JOIN f ON f.cloud_id = w.cloud_id AND f.component = w.component "
            "WHERE dn.z >= f.floor)",
        ],
        "SELECT cloud_id, component, point_id FROM w",
        True,
    ),
)
def energy_descent_growth(spark, d):
    """With a hop budget no downhill chain here can use up, membership is plain reachability."""
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 90.0), e), "comp")
    floor = percentiles(c.join(p, IDS), ["cloud_id", "component"], "z", [0.9], ["level"])
    floor = floor.select("cloud_id", "component", F.greatest(F.col("level") * 0.49, F.lit(0.08)).alias("floor"))
    return G.energy_growth(c, p.select(*IDS, F.col("z").alias("energy")), e, floor, 1000).drop("hop")


@register(
    "widest_path",
    query(
        CUST
        + [
            top_mask("z", 0.97),
            "cand AS (SELECT DISTINCT cloud_id, z/100 AS t FROM p UNION SELECT DISTINCT cloud_id, 1.0::DOUBLE FROM p)",
            # reach(t): points connected to a source through points of response >= t
            "w(cloud_id, t, point_id) AS (SELECT c.cloud_id, c.t, m.point_id FROM cand c JOIN mask m ON m.cloud_id = c.cloud_id UNION "
            "SELECT w.cloud_id, w.t, e.dst FROM w JOIN e ON e.cloud_id = w.cloud_id AND e.src = w.point_id JOIN p ON p.cloud_id = e.cloud_id AND "
            "p.point_id = e.dst WHERE p.z/100 >= w.t)",
            "best AS (SELECT cloud_id, point_id, max(t) AS c FROM w GROUP BY 1, 2)",
            "tight AS (SELECT e.cloud_id, e.src, e.dst FROM e JOIN p ON p.cloud_id = e.cloud_id AND p.point_id = e.dst JOIN best a ON a.cloud_id = e.cloud_id "
            "AND a.point_id = e.src JOIN best b ON b.cloud_id = e.cloud_id AND b.point_id = e.dst WHERE least(a.c, p.z/100) = b.c)",
            hops("mask", None, edges="tight"),
        ],
        f"SELECT best.cloud_id, best.point_id, {rnd('c')} AS capacity, hop AS path_hops FROM best LEFT JOIN h ON h.cloud_id = best.cloud_id AND "
        "h.point_id = best.point_id",
        True,
    ),
)
def widest_path(spark, d):
    p, e = cust(spark, d)
    w = G.widest_paths(top(p, "z", 97.0), p.select(*IDS, (F.col("z") / 100).alias("response")), e)
    return w.select(*IDS, r6("capacity").alias("capacity"), "path_hops")


@register(
    "sor_outliers",
    query(
        [cloud("evt"), knn(5, "k", "p", "p", False),
         "m AS (SELECT cloud_id, src AS point_id, avg(dist) AS d FROM k GROUP BY 1, 2)",
         "s AS (SELECT cloud_id, avg(d) AS mu, stddev_samp(d) AS sd FROM m GROUP BY 1)"],
        "SELECT m.cloud_id, point_id, d > mu + 0.25 * sd AS outlier FROM m JOIN s ON s.cloud_id = m.cloud_id",
    ),
)
def sor_outliers(spark, d):
    from pointweave.plans.baselines import statistical_outliers

    return statistical_outliers(T.events_cloud(spark, d)).select(*IDS, "outlier")


@register(
    "hysteresis",
    query(
        CUST + [top_mask("z", 0.95, "strong"), top_mask("z", 0.6, "weak"), labels("weak"),
                "ok AS (SELECT DISTINCT comp.cloud_id, component FROM comp JOIN strong USING (cloud_id, point_id))"],
        "SELECT comp.cloud_id, point_id FROM comp JOIN ok ON ok.cloud_id = comp.cloud_id AND ok.component = comp.component",
        True,
    ),
)
def hysteresis(spark, d):
    p, e = cust(spark, d)
    return G.hysteresis(top(p, "z", 95.0), top(p, "z", 60.0), e)


@register(
    "fill_holes",
    query(
        CUST
        + [
            top_mask("z", 0.5, "m"), labels("m"), hops("comp", 4, name="roi", group="component"),
            "pass AS (SELECT cloud_id, component, point_id FROM roi WHERE hop > 0)",
            "start AS (SELECT DISTINCT a.cloud_id, a.component, a.point_id FROM pass a LEFT JOIN e ON e.cloud_id = a.cloud_id AND e.src = a.point_id "
            "LEFT JOIN roi r ON r.cloud_id = a.cloud_id AND r.component = a.component AND r.point_id = e.dst WHERE r.point_id IS NULL)",
            "seen(cloud_id, component, point_id) AS (SELECT * FROM start UNION SELECT s.cloud_id, s.component, x.dst FROM seen s JOIN e x ON "
            "x.cloud_id = s.cloud_id AND x.src = s.point_id JOIN pass q ON q.cloud_id = s.cloud_id AND q.component = s.component AND q.point_id = x.dst)",
            "hole AS (SELECT * FROM pass EXCEPT SELECT * FROM seen)",
            "n AS (SELECT cloud_id, component, count(*) AS n FROM comp GROUP BY 1, 2)",
            "good AS (SELECT h.cloud_id, h.component FROM hole h JOIN n ON n.cloud_id = h.cloud_id AND n.component = h.component "
            "GROUP BY 1, 2, n.n HAVING n.n + count(*) <= 3 * n.n)",
        ],
        "SELECT cloud_id, component, point_id FROM comp UNION ALL SELECT h.cloud_id, h.component, h.point_id FROM hole h JOIN good g "
        "ON g.cloud_id = h.cloud_id AND g.component = h.component",
        True,
    ),
)
def fill_holes(spark, d):
    p, e = cust(spark, d)
    return G.fill_holes(cut(G.mask_components(top(p, "z", 50.0), e), "comp"), e)


@register(
    "relative_size_fraction",
    query(
        CUST + [top_mask("z", 0.5), labels("mask"), "s AS (SELECT cloud_id, component, count(*) AS size FROM comp GROUP BY 1, 2)",
                "m AS (SELECT cloud_id, max(size) AS largest FROM s GROUP BY 1)", "n AS (SELECT cloud_id, count(*) AS n FROM p GROUP BY 1)"],
        "SELECT s.cloud_id, component, size, largest, size >= 0.25::DOUBLE*largest AND size/n.n >= 0.05::DOUBLE AS eligible FROM s JOIN m ON "
        "m.cloud_id = s.cloud_id JOIN n ON n.cloud_id = s.cloud_id",
        True,
    ),
)
def relative_size_fraction(spark, d):
    p, e = cust(spark, d)
    sizes = G.component_sizes(G.mask_components(top(p, "z", 50.0), e))
    return rules.relative_size(sizes, 0.25, p.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n")), 0.05)


@register(
    "expand_closed",
    query(
        CUST
        + [
            top_mask("z", 0.85), labels("mask"), hops("comp", 1, name="cl", group="component"),
            # the closed core: components and their first ring, a shared point to the smallest component
            "core AS (SELECT cloud_id, min(component) AS component, point_id FROM cl GROUP BY cloud_id, point_id)",
            "w(cloud_id, component, point_id, hop) AS (SELECT cloud_id, component, point_id, 0 FROM core UNION SELECT w.cloud_id, w.component, x.dst, w.hop + 1 "
            "FROM w JOIN e x ON x.cloud_id = w.cloud_id AND x.src = w.point_id WHERE w.hop < 2 AND NOT EXISTS (SELECT 1 FROM comp c WHERE "
            "c.cloud_id = x.cloud_id AND c.point_id = x.dst AND c.component <> w.component))",
            "n AS (SELECT w.cloud_id, w.point_id, min({'h': hop, 'c': w.component}) AS o FROM w ANTI JOIN core k ON k.cloud_id = w.cloud_id AND "
            "k.point_id = w.point_id GROUP BY 1, 2)",
        ],
        "SELECT cloud_id, component, point_id, 0 AS distance FROM core UNION ALL SELECT cloud_id, o.c, point_id, o.h FROM n",
        True,
    ),
)
def expand_closed(spark, d):
    p, e = cust(spark, d)
    c = cut(G.mask_components(top(p, "z", 85.0), e), "comp")
    core = G.hop_distance(c, e, 1, ["component"]).groupBy(*IDS).agg(F.min("component").alias("component"))
    return G.expand_closed(core, c, e, 2).select("cloud_id", "component", "point_id", "distance")


@register(
    "suppress_peaks",
    query(
        CUST
        + [
            top_mask("z", 0.9),
            "k1 AS (SELECT row_number() OVER (PARTITION BY p.cloud_id ORDER BY z DESC, p.point_id) AS r, p.cloud_id, p.point_id, z FROM p JOIN mask USING (cloud_id, point_id))",
            hops("(SELECT cloud_id, point_id AS peak, point_id FROM mask)", 2, name="a", group="peak"),
            "m AS (SELECT DISTINCT x.cloud_id, x.peak AS a, y.peak AS b FROM a x JOIN a y ON x.cloud_id = y.cloud_id AND x.point_id = y.point_id AND x.peak <> y.peak)",
            # one peak after the other: kept when it meets none of those kept so far
            "g(cloud_id, r, kept) AS (SELECT cloud_id, 1::BIGINT, [point_id] FROM k1 WHERE r = 1 UNION ALL SELECT g.cloud_id, k1.r, CASE WHEN EXISTS (SELECT 1 FROM m "
            "WHERE m.cloud_id = g.cloud_id AND m.a = k1.point_id AND list_contains(g.kept, m.b)) THEN g.kept ELSE list_append(g.kept, k1.point_id) END "
            "FROM g JOIN k1 ON k1.cloud_id = g.cloud_id AND k1.r = g.r + 1)",
            "f AS (SELECT cloud_id, unnest(arg_max(kept, r)) AS point_id FROM g GROUP BY cloud_id)",
        ],
        f"SELECT f.cloud_id, f.point_id, {rnd('z')} AS score FROM f JOIN k1 ON k1.cloud_id = f.cloud_id AND k1.point_id = f.point_id",
        True,
    ),
)
def suppress_peaks(spark, d):
    p, e = cust(spark, d)
    peaks = top(p, "z", 90.0).join(p, IDS).select(*IDS, F.col("z").alias("score"))
    return G.suppress_peaks(peaks, e, 2).select(*IDS, r6("score").alias("score"))


@register(
    "stage_diagnostics",
    query(
        CUST
        + [
            top_mask("z", 0.8), labels("mask"), "n AS (SELECT cloud_id, count(*) AS edges FROM e GROUP BY 1)",
            "j AS (SELECT p.*, c.component + 1 AS grown FROM p LEFT JOIN comp c ON c.cloud_id = p.cloud_id AND c.point_id = p.point_id)",
        ],
        f"SELECT j.cloud_id, count(*) AS points, {rnd('avg(x)', 4)} AS response_mean, count(*) FILTER (z > 50) AS high_points, count(grown) AS grown_points, "
        f"count(DISTINCT grown) AS grown_components, {rnd('quantile_cont(x, 0.95)', 4)} AS response_p95, coalesce(max(edges), 0) AS edges, "
        f"{rnd('coalesce(max(edges), 0) / count(*)', 4)} AS mean_degree FROM j LEFT JOIN n ON n.cloud_id = j.cloud_id GROUP BY j.cloud_id",
        True,
    ),
)
def stage_diagnostics(spark, d):
    from pointweave.operators import metrics as M

    p, e = cust(spark, d)
    y = G.mask_components(top(p, "z", 80.0), e).select(*IDS, (F.col("component") + 1).alias("grown"))
    out = M.stage_diagnostics(p.withColumn("high", F.col("z") > 50).join(y, IDS, "left"), e, ["high"], ["grown"], "x")
    for c in ("response_mean", "response_p95", "mean_degree"):
        out = out.withColumn(c, r6(c, 4))
    return out


@register(
    "displacement_mask",
    "SELECT l_orderkey AS cloud_id, l_linenumber + 10 * l_partkey AS point_id, round(CASE WHEN l_returnflag = 'R' THEN sqrt(l_tax*l_tax + "
    "l_discount*l_discount) ELSE 0.0 END, 6) AS displacement, l_returnflag = 'R' AND sqrt(l_tax*l_tax + l_discount*l_discount) > 0.08 AS displaced FROM "
    "(SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag)",
)
def displacement_mask(spark, d):
    """Lines as points at (tax, discount, 0); returned ones are put back at the origin."""
    from pointweave.operators import restore

    li = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.min(F.struct("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")).alias("r")
    )
    p = li.select(
        F.col("l_orderkey").alias("cloud_id"), (F.col("l_linenumber") + 10 * F.col("l_partkey")).alias("point_id"), F.col("r.l_tax").alias("x"),
        F.col("r.l_discount").alias("y"), F.lit(0.0).alias("z"), (F.col("r.l_returnflag") == "R").alias("inside"),
    )
    home = p.select(*IDS, *[F.lit(0.0).alias(a) for a in "xyz"])
    out = restore.displacement_mask(p, home, p.where("inside").select(*IDS), 0.08)
    return out.select(*IDS, r6("displacement").alias("displacement"), "displaced")


@register(
    "restoration_gaussian",
    query(
        EVT + ["m AS (SELECT cloud_id, median(dist) AS s FROM e GROUP BY 1)"],
        f"SELECT e.cloud_id, src, dst, {rnd('exp(-(dist*dist)/(2.0::DOUBLE*s*s))')} AS weight FROM e JOIN m ON m.cloud_id = e.cloud_id",
    ),
)
def restoration_gaussian(spark, d):
    from pointweave.operators.restore import restoration_weights

    _, e = evt(spark, d)
    return restoration_weights(e, "gaussian").select("cloud_id", "src", "dst", r6("weight").alias("weight"))


@register(
    "strain_veto",
    query(
        CUST
        + [
            top_mask("z", 0.7),
            # the upper points are put back at the height 50
            "q AS (SELECT p.cloud_id, p.point_id, x, y, CASE WHEN m.point_id IS NULL THEN z ELSE 50.0::DOUBLE END AS z FROM p LEFT JOIN mask m ON m.cloud_id = p.cloud_id AND m.point_id = p.point_id)",
            "t AS (SELECT e.cloud_id, e.src AS point_id, avg(abs(dist - sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)))/(dist+1e-8::DOUBLE)) AS strain "
            "FROM e JOIN q a ON a.cloud_id = e.cloud_id AND a.point_id = e.src JOIN q b ON b.cloud_id = e.cloud_id AND b.point_id = e.dst GROUP BY 1, 2)",
        ],
        f"SELECT mask.cloud_id, mask.point_id, {rnd('strain')} AS strain FROM mask JOIN t ON t.cloud_id = mask.cloud_id AND t.point_id = mask.point_id WHERE strain < 0.3",
    ),
)
def strain_veto(spark, d):
    from pointweave.operators import restore

    p, e = cust(spark, d)
    mask = top(p, "z", 70.0)
    back = mask.join(p, IDS).select(*IDS, F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit(50.0).alias("rz"))
    strain = cut(restore.edge_strain(p, back, e), "strain")
    return restore.strain_veto(mask, strain, 0.3).join(strain, IDS).select(*IDS, r6("strain").alias("strain"))


@register(
    "point_filter",
    query(
        [
            cloud("cust"), "s AS (SELECT cloud_id, least(greatest(quantile_cont(x, 0.5) / 100 * 0.25::DOUBLE, 0.08::DOUBLE), 0.25::DOUBLE) AS t FROM p GROUP BY cloud_id)",
            "m AS (SELECT cloud_id, quantile_cont(z, 0.5) AS h FROM p GROUP BY cloud_id)",
        ],
        "SELECT p.cloud_id, point_id FROM p JOIN s ON s.cloud_id = p.cloud_id JOIN m ON m.cloud_id = p.cloud_id WHERE z >= h AND (y / 100 >= t OR point_id % 11 = 0)",
    ),
)
def point_filter(spark, d):
    p = cut(T.customer_cloud(spark, d), "cloud")
    m = percentiles(p, ["cloud_id"], "x", [0.5], ["m"])
    t = m.select("cloud_id", rules.adaptive_threshold(F.col("m") / 100).alias("threshold"))
    fields = p.select(*IDS, (F.col("y") / 100).alias("displacement"))
    return rules.point_filter(top(p, "z", 50.0), fields, t, p.where("point_id % 11 = 0"))


@register(
    "random_rows",
    query(
        [cloud("evt"), "h AS (SELECT cloud_id, point_id, CAST('0x' || substr(md5('7:' || cloud_id || ':' || point_id), 1, 15) AS BIGINT) AS v FROM p)"],
        "SELECT cloud_id, point_id FROM h QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY v) <= 90",
    ),
)
def random_rows(spark, d):
    from pointweave.operators import sampling

    return sampling.random_rows(T.events_cloud(spark, d), 90, 7).select(*IDS)


@register(
    "sample_summary",
    query(
        [
            cloud("evt"), "h AS (SELECT cloud_id, point_id, y, CAST('0x' || substr(md5('7:' || cloud_id || ':' || point_id), 1, 15) AS BIGINT) AS v FROM p)",
            "s AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY v) <= 90)",
            "t AS (SELECT cloud_id, count(*) AS defects FROM p WHERE y % 10 = 0 GROUP BY 1)",
        ],
        "SELECT s.cloud_id, count(*) AS points, md5(string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY point_id)) AS indices_md5, max(defects) AS defects, "
        f"count(*) FILTER (y % 10 = 0) AS kept, {rnd('count(*) FILTER (y % 10 = 0) / max(defects)')} AS retention FROM s JOIN t ON t.cloud_id = s.cloud_id GROUP BY 1",
    ),
)
def sample_summary(spark, d):
    from pointweave.operators import sampling

    p = cut(T.events_cloud(spark, d), "cloud")
    s = sampling.random_rows(p, 90, 7).select(*IDS, F.col("point_id").alias("sample_rank"))
    out = sampling.sample_summary(cut(s, "sample"), p.select(*IDS, (F.col("y") % 10 == 0).alias("defect")))
    return out.withColumn("retention", r6("retention"))
