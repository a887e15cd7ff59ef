"""Queries that run composite operators; checked by brute force in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.config import Settings
from pointweave.functions.order_stats import percentiles
from pointweave.operators import graph as G
from pointweave.operators import neighbors as NB
from pointweave.operators import normalize as N
from pointweave.operators import restore as R
from pointweave.operators import sampling, spectral, surface
from pointweave.plans import baselines, batch, pipeline
from pointweave.plans.registry import r6, register
from pointweave.plans.sqltext import cloud, graph, labels, query, rnd, top_mask
from pointweave.session import cut
from pointweave.sources import tables as T

IDS = ["cloud_id", "point_id"]


FLAGSHIP_SQL = query(
    graph("emb", 8)
    + [
        "st AS (SELECT cloud_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_samp(x)+1e-6::DOUBLE AS a, covar_samp(x,y) AS b, covar_samp(x,z) AS c, "
        "var_samp(y)+1e-6::DOUBLE AS d, covar_samp(y,z) AS e, var_samp(z)+1e-6::DOUBLE AS f FROM p GROUP BY 1)",
        "dv AS (SELECT p.cloud_id, point_id, x-mx AS dx, y-my AS dy, z-mz AS dz, a, b, c, d, e, f FROM p JOIN st ON st.cloud_id = p.cloud_id)",
        "sc AS (SELECT cloud_id, point_id, ((d*f-e*e)*dx*dx + (a*f-c*c)*dy*dy + (a*d-b*b)*dz*dz + 2*(c*e-b*f)*dx*dy + 2*(b*e-c*d)*dx*dz + "
        "2*(b*c-a*e)*dy*dz) / (a*(d*f-e*e) + b*(c*e-b*f) + c*(b*e-c*d)) AS s FROM dv)",
        "nb AS (SELECT cloud_id, src, dst FROM e UNION ALL SELECT cloud_id, point_id, point_id FROM p)",
        "sm AS (SELECT nb.cloud_id, nb.src AS point_id, avg(sc.s) AS s FROM nb JOIN sc ON sc.cloud_id = nb.cloud_id AND sc.point_id = nb.dst GROUP BY 1, 2)",
        "q AS (SELECT cloud_id, quantile_cont(s, 0.7) AS t FROM sm GROUP BY 1)",
        "mask AS (SELECT sm.cloud_id, sm.point_id, s FROM sm JOIN q ON q.cloud_id = sm.cloud_id WHERE s >= t)",
        labels("mask"),
    ],
    f"SELECT comp.cloud_id, component, count(*) AS size, {rnd('avg(s)')} AS mean_score, {rnd('max(s)')} AS top_score FROM comp JOIN mask ON "
    "mask.cloud_id = comp.cloud_id AND mask.point_id = comp.point_id GROUP BY 1, 2",
    True,
)


@register("anomalous_regions", FLAGSHIP_SQL)
def anomalous_regions(spark, d):
    """Graph -> Mahalanobis score -> smoothing -> top 30 % -> regions -> report."""
    p = cut(T.embeddings_cloud(spark, d), "cloud")
    e = cut(NB.mutual_knn(p, 8, 2.5), "edges")
    score = G.smooth(N.mahalanobis(p, ["x", "y", "z"], "s"), ["s"], e, 1)
    high = cut(N.percentile_mask(score, "s", 70.0, "kept").where("kept").select(*IDS, "s"), "mask")
    rows = G.mask_components(high, e).join(high, IDS)
    return rows.groupBy("cloud_id", "component").agg(
        F.count(F.lit(1)).alias("size"), r6(F.avg("s")).alias("mean_score"), r6(F.max("s")).alias("top_score")
    )


@register(
    "graph_by_label",
    query(graph("emb", 8), f"SELECT cloud_id, count(*) AS edges, {rnd('avg(dist)')} AS mean_length FROM e GROUP BY 1"),
)
def graph_by_label(spark, d):
    e = NB.mutual_knn(T.embeddings_cloud(spark, d), 8, 2.5)
    return e.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("edges"), r6(F.avg("dist")).alias("mean_length"))


@register("fps_sample")
def fps_sample(spark, d):
    return sampling.farthest_points(T.events_cloud(spark, d), 200)


K = 60
DIST = "(q.x-{c}.x)*(q.x-{c}.x)+(q.y-{c}.y)*(q.y-{c}.y)+(q.z-{c}.z)*(q.z-{c}.z)"


@register(
    "fps_from_first",
    query(
        [
            cloud("evt"), "a AS (SELECT cloud_id, list({'id': point_id, 'x': x, 'y': y, 'z': z} ORDER BY point_id) AS pts FROM p GROUP BY cloud_id)",
            f"r(cloud_id, sample_rank, pick, d) AS (SELECT cloud_id, 0, 1::BIGINT, list_transform(pts, lambda q: {DIST.format(c='pts[1]')}) FROM a WHERE len(pts) > {K} "
            f"UNION ALL SELECT r.cloud_id, sample_rank + 1, n.i, list_transform(a.pts, lambda q, k: least(r.d[k], {DIST.format(c='a.pts[n.i]')})) FROM r JOIN a ON "
            f"a.cloud_id = r.cloud_id, LATERAL (SELECT list_position(r.d, list_max(r.d)) AS i) n WHERE sample_rank < {K - 1} AND list_max(r.d) > 0)",
        ],
        "SELECT r.cloud_id, sample_rank, a.pts[r.pick].id AS point_id FROM r JOIN a ON a.cloud_id = r.cloud_id UNION ALL SELECT cloud_id, "
        f"CAST(row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS INTEGER), point_id FROM p JOIN (SELECT cloud_id FROM a WHERE len(pts) <= {K}) USING (cloud_id)",
        True,
    ),
)
def fps_from_first(spark, d):
    return sampling.farthest_points(T.events_cloud(spark, d), K, None)


@register("voxel_then_fps")
def voxel_then_fps(spark, d):
    return sampling.working_sample(T.customer_cloud(spark, d), 40, "voxel").select(*IDS, "sample_rank")


def _scaled(spark, d):
    """The whole clouds, scaled."""
    p = cut(N.isotropic_scale(T.customer_cloud(spark, d)), "points")
    return p, cut(NB.mutual_knn(p, 8, 2.5), "edges")


@register("hks_features")
def hks_features(spark, d):
    p, e = _scaled(spark, d)
    lap = surface.normalized_laplacian(p, surface.gaussian_weights(e))
    h = spectral.heat_signatures(spectral.smallest_eigenpairs(lap, Settings().eigenpairs, p))
    return h.select(*IDS, *[r6(f"hks{i}").alias(f"hks{i}") for i in range(3)])


@register("eigen_residuals", query([cloud("cust")], "SELECT cloud_id, least(60, count(*) - 1)::INT AS pairs, true AS rising, true AS solved, true AS orthonormal FROM p GROUP BY 1"))
def eigen_residuals(spark, d):
    """Eigenpairs by what defines them: L phi = lambda phi, and vectors of unit length at right angles (to those with near values)."""
    p, e = _scaled(spark, d)
    lap = cut(surface.normalized_laplacian(p, surface.gaussian_weights(e)), "laplacian")
    pairs = spectral.smallest_eigenpairs(lap, 60, p)
    rising = pairs.groupBy("cloud_id").agg(F.first(F.size("lambdas")).alias("pairs"), F.first(F.col("lambdas") == F.array_sort("lambdas")).alias("rising"))
    # all pairs of a point stay one row: entries of the matrix are not multiplied by pairs
    there = lap.join(pairs.select("cloud_id", F.col("point_id").alias("dst"), "phi"), ["cloud_id", "dst"])
    terms = there.groupBy("cloud_id", F.col("src").alias("point_id")).agg(F.collect_list(F.struct("value", "phi")).alias("terms"))
    image = F.aggregate("terms", F.transform("phi", lambda v: F.lit(0.0)), lambda total, t: F.zip_with(total, t["phi"], lambda a, v: a + t["value"] * v))
    miss = F.zip_with(image, F.zip_with("lambdas", "phi", lambda v, p: v * p), lambda a, b: (a - b) * (a - b))
    miss = pairs.join(terms, IDS).select("cloud_id", F.posexplode(miss).alias("pair", "miss"))
    worst = miss.groupBy("cloud_id", "pair").agg(F.sqrt(F.sum("miss")).alias("r")).groupBy("cloud_id").agg((F.max("r") < 1e-6).alias("solved"))
    products = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda o: F.zip_with("phi", F.slice("phi", o + 1, F.greatest(F.size("phi") - o, F.lit(0))), lambda a, b: a * b))
    angle = pairs.select("cloud_id", F.posexplode(products).alias("offset", "v")).select("cloud_id", "offset", F.posexplode("v").alias("pair", "v")).where("v is not null")
    angle = angle.groupBy("cloud_id", "offset", "pair").agg((F.abs(F.sum("v") - (F.col("offset") == 0).cast("int"))).alias("off"))
    angle = angle.groupBy("cloud_id").agg((F.max("off") < 1e-8).alias("orthonormal"))
    return rising.join(worst, "cloud_id").join(angle, "cloud_id")


@register("restore_points")
def restore_points(spark, d):
    p, e = _scaled(spark, d)
    high = N.percentile_mask(p, "x", 80.0, "kept").where("kept").select(*IDS)
    parts = cut(G.mask_components(cut(high, "mask"), e), "parts")
    fields = R.displacement_and_stress(p, cut(R.restore_regions(p, e, parts), "restored"), e)
    return fields.select("cloud_id", "component", "point_id", r6("displacement").alias("displacement"), r6("stress").alias("stress"))


@register(
    "restore_residuals",
    query([*graph("cust", 8), top_mask("x", 0.8), labels("mask")], "SELECT cloud_id, component, count(*) AS points, true AS solved, true AS moved FROM comp GROUP BY 1, 2", True),
)
def restore_residuals(spark, d):
    """Restored regions by what defines them: the energy |L x|^2 + eps |x|^2 has no slope at any unknown."""
    p, e = _scaled(spark, d)
    parts = cut(G.mask_components(cut(N.percentile_mask(p, "x", 80.0, "kept").where("kept").select(*IDS), "mask"), e), "parts")
    restored = cut(R.restore_regions(p, e, parts), "restored")
    key, lap = ["cloud_id", "component"], cut(R.graph_laplacian(R.restoration_weights(e)), "laplacian")
    rows = G.dilate(parts, e, 1, ["component"]).select(*key, F.col("point_id").alias("r"))
    entry = rows.join(lap.select("cloud_id", F.col("src").alias("r"), F.col("dst").alias("point_id"), "value"), ["cloud_id", "r"])
    entry = cut(entry.join(restored, [*key, "point_id"], "left").join(p, IDS), "entry")
    image = entry.groupBy(*key, "r").agg(*[F.sum(F.col("value") * F.coalesce(f"r{a}", a)).alias(f"i{a}") for a in "xyz"])
    slope = entry.where("rx is not null").join(image, [*key, "r"]).groupBy(*key, "point_id")
    slope = slope.agg(*[(F.sum(F.col("value") * F.col(f"i{a}")) + 1e-8 * F.first(f"r{a}")).alias(f"g{a}") for a in "xyz"], F.sum(F.col("value") * F.col("value")).alias("scale"))
    worst = F.max(F.greatest(*[F.abs(f"g{a}") for a in "xyz"]) / (F.col("scale") + 1e-8))
    count = restored.groupBy(*key).agg(F.count(F.lit(1)).alias("points"), (F.max(F.abs("rx")) >= 0).alias("moved"))
    solved = slope.groupBy(*key).agg((worst < 1e-6).alias("solved"))
    return count.join(solved, key, "left").select(*key, "points", F.coalesce("solved", F.lit(True)).alias("solved"), "moved")


@register("region_growing")
def region_growing(spark, d):
    return baselines.region_growing(T.customer_cloud(spark, d), 12, 1, 16, 12, 20.0, 0.05)


@register("label_aware_merge")
def label_aware_merge(spark, d):
    p = cut(T.customer_cloud(spark, d), "cloud")
    e = cut(NB.mutual_knn(p, 6, 2.5), "edges")
    seeds = cut(G.mask_components(N.percentile_mask(p, "z", 90.0, "kept").where("kept"), e), "seeds")
    energy = p.select(*IDS, F.col("z").alias("energy"))
    floor = percentiles(seeds.join(p, IDS), ["cloud_id", "component"], "z", [0.9], ["level"])
    floor = floor.select("cloud_id", "component", (F.col("level") * 0.49).alias("floor"))
    grown = G.energy_growth(seeds, energy, e, cut(floor, "floor"), 4)
    return G.label_aware_merge(grown, energy, e)[0]


@register("detection_pipeline")
def detection_pipeline(spark, d):
    """The whole pipeline over customer clouds; one row per working point with its evidence and verdict."""
    st = pipeline.run_pipeline(T.customer_cloud(spark, d), Settings())
    return pipeline.point_report(st).select(
        *IDS, "sample_rank", *[r6(c).alias(c) for c in ("r_sv", "r_p", "r_v")], "suppressed", "on_boundary", "defect"
    )


def _batch(spark, d):
    """Event clouds as samples: found are the highest values, true the most active users' events; one cloud counts as good."""
    p = cut(T.events_cloud(spark, d), "cloud")
    kind = F.when(F.col("cloud_id") == "view", "good").otherwise("defective")
    samples = p.select("cloud_id").distinct().select(
        "cloud_id", F.lit("events").alias("dataset"), F.substring("cloud_id", 1, 1).alias("category"), F.col("cloud_id").alias("sample_id"), kind.alias("sample_kind")
    )
    truth = p.where("cloud_id <> 'view'").select(*IDS, (F.col("y") % 10 == 0).alias("defect"))
    found = N.percentile_mask(p, "z", 90.0, "kept").where("kept")
    return batch.sample_metrics(samples, p, found, truth)


BATCH_SQL = [
    "p AS (SELECT event_type AS cloud_id, event_id AS point_id, CAST(user_id AS DOUBLE) AS y, value AS z FROM events)",
    "m AS (SELECT cloud_id, quantile_cont(z, 0.9) AS t FROM p GROUP BY 1)",
    "j AS (SELECT p.cloud_id, z >= t AS found, p.cloud_id <> 'view' AND y % 10 = 0 AS defect FROM p JOIN m ON m.cloud_id = p.cloud_id)",
    "c AS (SELECT cloud_id AS sample_id, substr(cloud_id, 1, 1) AS category, CASE WHEN cloud_id = 'view' THEN 'good' ELSE 'defective' END AS sample_kind, "
    "count(*) FILTER (found AND defect) AS tp, count(*) FILTER (found AND NOT defect) AS fp, count(*) FILTER (NOT found AND defect) AS fn, "
    "count(*) FILTER (NOT found AND NOT defect) AS tn FROM j GROUP BY 1, 2, 3)",
]


@register(
    "batch_samples",
    "WITH " + ", ".join(BATCH_SQL) + " SELECT sample_id, category, sample_kind, tp, fp, fn, tn, true AS success, "
    "round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END, 6) AS f1 FROM c",
)
def batch_samples(spark, d):
    return _batch(spark, d).select("sample_id", "category", "sample_kind", "tp", "fp", "fn", "tn", "success", r6("f1").alias("f1"))


@register(
    "batch_categories",
    "WITH " + ", ".join(BATCH_SQL) + " SELECT category, count(*) AS sample_count, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, "
    "round(avg(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END), 6) AS macro_f1, "
    "round(CASE WHEN sum(2*tp+fp+fn) = 0 THEN 0.0 ELSE 2.0*sum(tp)/sum(2*tp+fp+fn) END, 6) AS micro_f1 FROM c WHERE sample_kind = 'defective' GROUP BY 1",
)
def batch_categories(spark, d):
    out = batch.summaries(cut(_batch(spark, d), "batch")).categories
    return out.select("category", "sample_count", "tp", "fp", r6("macro_f1").alias("macro_f1"), r6("micro_f1").alias("micro_f1"))


@register(
    "batch_good",
    "WITH " + ", ".join(BATCH_SQL) + ", g AS (SELECT category, fp / (fp + tn) AS fpr FROM c WHERE sample_kind = 'good') SELECT category, count(*) AS samples, "
    "round(avg(fpr), 6) AS mean_fpr, round(quantile_cont(fpr, 0.95), 6) AS p95_fpr FROM g GROUP BY 1 UNION ALL SELECT 'balanced_overall', count(*), "
    "round(avg(fpr), 6), round(quantile_cont(fpr, 0.95), 6) FROM g",
)
def batch_good(spark, d):
    out = batch.summaries(cut(_batch(spark, d), "batch")).good
    return out.select("category", "samples", r6("mean_fpr").alias("mean_fpr"), r6("p95_fpr").alias("p95_fpr"))
