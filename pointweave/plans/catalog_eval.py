"""Queries over decisions, labels and run tables: rules, set operations, metrics, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointweave.functions.order_stats import percentiles
from pointweave.operators import labels as L
from pointweave.operators import metrics as M
from pointweave.operators import normalize as N
from pointweave.operators import rules
from pointweave.plans import sweep
from pointweave.plans.registry import r6, register
from pointweave.plans.sqltext import cloud, query, rnd
from pointweave.sources import discover
from pointweave.session import cut
from pointweave.sources import tables as T

IDS = ["cloud_id", "point_id"]

# seeds from orders: sizes of growing scope
SEEDS = (
    "s AS (SELECT o_orderpriority AS cloud_id, o_custkey % 50 AS y_id, o_orderkey AS q_id, 1 + o_orderkey % 7 AS q_size, "
    "1 + o_orderkey % 31 AS u_size, 1 + o_custkey % 53 AS y_size, 1 + o_orderkey % 43 AS z_size, 1 + o_custkey % 61 AS w_size, "
    "1 + (o_orderkey * 3) % 71 AS gtr_size FROM orders)"
)
STATE = """CASE WHEN (w_size <= 4*z_size AND y_size <= 4*q_size) OR (w_size >= 8*z_size AND u_size >= 8*q_size AND y_size >= 8*q_size
AND gtr_size >= 8*q_size AND z_size >= 8*q_size) THEN 'defect_anchor'
WHEN (gtr_size >= 2*y_size AND w_size <= u_size) OR (2*gtr_size >= 3*y_size AND 4*w_size <= y_size) OR
(z_size >= 4*q_size AND gtr_size >= 4*w_size) OR (2*y_size <= 3*u_size AND gtr_size >= 4*u_size) THEN 'strong_normal'
WHEN (q_size = 1 AND 2*gtr_size >= 3*y_size) OR (y_size >= 8*u_size AND 2*gtr_size >= 3*w_size) THEN 'weak_normal' ELSE 'unknown' END"""


def _seeds(spark, d):
    o = T.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.col("o_orderpriority").alias("cloud_id"), (c % 50).alias("y_id"), k.alias("q_id"), (k % 7 + 1).alias("q_size"),
        (k % 31 + 1).alias("u_size"), (c % 53 + 1).alias("y_size"), (k % 43 + 1).alias("z_size"), (c % 61 + 1).alias("w_size"),
        ((k * 3) % 71 + 1).alias("gtr_size"),
    )


@register("scale_rules", query([SEEDS], f"SELECT cloud_id, q_id, {STATE} AS seed_state FROM s"))
def scale_rules(spark, d):
    return _seeds(spark, d).select("cloud_id", "q_id", rules.seed_state().alias("seed_state"))


@register(
    "y_vote",
    query(
        [SEEDS, f"t AS (SELECT *, {STATE} AS seed_state FROM s)",
         "g AS (SELECT cloud_id, y_id, CAST(sum(q_size) AS BIGINT) AS total_mass, CAST(coalesce(sum(q_size) FILTER (WHERE seed_state = "
         "'strong_normal'), 0) AS BIGINT) AS strong_mass, bool_or(seed_state = 'defect_anchor') AS has_anchor FROM t GROUP BY 1, 2)"],
        "SELECT *, CASE WHEN 2*strong_mass > total_mass THEN 'normal' WHEN has_anchor THEN 'defect' ELSE 'unknown' END AS y_state FROM g",
    ),
)
def y_vote(spark, d):
    return rules.vote_regions(_seeds(spark, d).withColumn("seed_state", rules.seed_state()))


@register(
    "ds_quadrants",
    query(
        [cloud("evt"), "b AS (SELECT cloud_id, quantile_cont(z,0.01) AS a, quantile_cont(z,0.99) AS b, quantile_cont(y,0.01) AS c, quantile_cont(y,0.99) AS d FROM p GROUP BY 1)",
         "n AS (SELECT p.cloud_id, point_id, least(greatest((z-a)/(b-a+1e-12::DOUBLE),0),1) >= 0.5 AS hd, least(greatest((y-c)/(d-c+1e-12::DOUBLE),0),1) >= 0.5 AS hs FROM p JOIN b ON b.cloud_id = p.cloud_id)"],
        "SELECT cloud_id, point_id, CASE WHEN hd AND hs THEN 1 WHEN hs THEN 2 WHEN hd THEN 3 ELSE 4 END AS quadrant FROM n",
    ),
)
def ds_quadrants(spark, d):
    p = N.quantile_norm(T.events_cloud(spark, d), "z", "nd")
    return N.quantile_norm(p, "y", "ns").select(*IDS, rules.quadrant(F.col("nd"), F.col("ns")).alias("quadrant"))


REGIONS = (
    "r AS (SELECT l_suppkey AS component, count(*) AS size, 60000::BIGINT AS cloud_size, quantile_cont(l_tax, 0.9)*10 AS d_p90, "
    "quantile_cont(l_tax, 0.95)*10 AS d_p95, quantile_cont(l_discount, 0.9)*10 AS s_p90, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE "
    "(l_suppkey % 10)/10.0::DOUBLE END AS d_ratio_p95, (l_suppkey % 7)/7.0::DOUBLE AS s_ratio_p95 FROM lineitem GROUP BY l_suppkey)"
)


def _regions(spark, d):
    li = T.table(spark, d, "lineitem")
    li = li.withColumnRenamed("l_suppkey", "component")
    tax = percentiles(li, ["component"], "l_tax", [0.9, 0.95], ["t90", "t95"])
    discount = percentiles(li, ["component"], "l_discount", [0.9], ["d90"])
    r = li.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(tax, "component").join(discount, "component")
    r = r.select("component", "size", (F.col("t90") * 10).alias("d_p90"), (F.col("t95") * 10).alias("d_p95"), (F.col("d90") * 10).alias("s_p90"))
    s = F.col("component")
    return r.select(
        "*", F.lit(60000).cast("long").alias("cloud_size"), F.when(s % 3 == 0, None).otherwise((s % 10) / 10.0).alias("d_ratio_p95"),
        ((s % 7) / 7.0).alias("s_ratio_p95"),
    )


REL = "coalesce(d_ratio_p95 <= 0.5 AND s_ratio_p95 <= 0.5, false)"
SHALLOW = "(size/cloud_size >= 0.0101 AND d_p95/64 <= 0.0118)"


@register(
    "adaptive_classify",
    query(
        [REGIONS],
        f"SELECT component, CASE WHEN size < 590 THEN 'too_small' WHEN {REL} AND {SHALLOW} THEN 'relative_normal_and_large_shallow' WHEN {REL} THEN "
        f"'relative_normal' WHEN {SHALLOW} THEN 'large_shallow' WHEN s_p90 > 0.9 THEN 'stress_veto' ELSE 'accepted' END AS verdict FROM r",
    ),
)
def adaptive_classify(spark, d):
    v = rules.classify_regions(min_size=590, min_large_fraction=0.0101, max_shallow=0.0118)
    return _regions(spark, d).select("component", v.alias("verdict"))


@register(
    "legacy_classify",
    query(
        [REGIONS],
        "SELECT component, CASE WHEN size < 590 THEN 'too_small_closed_component' WHEN d_p90 < 0.75 THEN 'low_displacement' WHEN s_p90 > 0.9 "
        "THEN 'stress_veto' ELSE 'accepted' END AS verdict FROM r",
    ),
)
def legacy_classify(spark, d):
    return _regions(spark, d).select(
        "component", rules.classify_regions(mode="legacy", min_size=590, min_displacement=0.75).alias("verdict")
    )


@register(
    "fixed_threshold_classify",
    query(
        [REGIONS],
        "SELECT component, CASE WHEN size < 590 THEN 'too_small' WHEN d_p90 < 0.7 THEN 'fixed_absolute' WHEN s_p90 > 0.9 "
        "THEN 'stress_veto' ELSE 'accepted' END AS verdict FROM r",
    ),
)
def fixed_threshold_classify(spark, d):
    return _regions(spark, d).select(
        "component", rules.classify_regions(mode="fixed", min_size=590, absolute_threshold=0.7).alias("verdict")
    )


@register(
    "overlap_owner",
    "SELECT l_returnflag AS cloud_id, l_partkey AS point_id, l_suppkey AS component FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, "
    "l_partkey ORDER BY CASE WHEN l_linenumber = 1 AND l_tax = 0 THEN 0 ELSE 1 END, -l_discount, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1",
)
def overlap_owner(spark, d):
    from pointweave.plans.pipeline import overlap_owner as owner

    li = T.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("cloud_id"), F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("component"),
        ((F.col("l_linenumber") == 1) & (F.col("l_tax") == 0)).alias("original"), F.col("l_discount").alias("priority"),
        F.col("l_linenumber").alias("hop"),
    )
    return owner(li)


@register("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join(spark, d):
    rich = T.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return T.table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@register("anti_join", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def anti_join(spark, d):
    rich = T.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return T.table(spark, d, "orders").join(rich, "o_custkey", "left_anti").select("o_orderkey")


A, B = "(p_size > 25)", "(p_retailprice > 1500)"


@register(
    "mask_setops",
    f"SELECT p_brand AS cloud_id, count(*) FILTER ({A} OR {B}) AS either, count(*) FILTER ({A} AND {B}) AS both, "
    f"count(*) FILTER ({A} AND NOT {B}) AS only_a, count(*) FILTER ({A} <> {B}) AS differ FROM part GROUP BY 1",
)
def mask_setops(spark, d):
    a, b = F.col("p_size") > 25, F.col("p_retailprice") > 1500
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("cloud_id")).agg(
        F.count_if(a | b).alias("either"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"),
        F.count_if(a != b).alias("differ"),
    )


JUDGED = "j AS (SELECT d.lang AS category, d.source AS sample_id, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l USING (doc_id))"
SCORED = (
    "c AS (SELECT category, sample_id, count(*) FILTER (quality=1 AND toxic=1) AS tp, count(*) FILTER (quality=1 AND toxic=0) AS fp, "
    "count(*) FILTER (quality=0 AND toxic=1) AS fn, count(*) FILTER (quality=0 AND toxic=0) AS tn, sum(n_chars)/1000.0::DOUBLE AS seconds "
    "FROM j GROUP BY 1, 2)",
    "m AS (SELECT *, CASE WHEN category IN ('en', 'de') THEN 'west' ELSE 'south' END AS dataset, tp+fn+fp+tn > 1 AS success, "
    "CASE WHEN tp+fp=0 THEN 0.0 ELSE tp/(tp+fp) END AS precision, "
    "CASE WHEN tp+fn=0 THEN 0.0 ELSE tp/(tp+fn) END AS recall, CASE WHEN 2*tp+fp+fn=0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END AS f1, "
    "CASE WHEN tp+fp+fn=0 THEN 0.0 ELSE tp/(tp+fp+fn) END AS iou FROM c)",
)


def _judged(spark, d):
    j = T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id")
    return j.select(F.col("lang").alias("category"), F.col("source").alias("sample_id"), "quality", "toxic", "n_chars")


def samples(spark, d):
    """One metric row per (language, source): prediction = quality, truth = toxic."""
    j = _judged(spark, d)
    m = M.confusion(j, ["category", "sample_id"], F.col("quality") == 1, F.col("toxic") == 1)
    t = j.groupBy("category", "sample_id").agg((F.sum("n_chars") / 1000.0).alias("seconds"))
    m = m.join(t, ["category", "sample_id"])
    return m.withColumn("dataset", F.when(F.col("category").isin("en", "de"), "west").otherwise("south")).withColumn(
        "success", F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn") > 1
    )


def _rounded(df, names, digits=6):
    return df.select(*[r6(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


SC = ["precision", "recall", "f1", "iou"]


@register("binary_metrics", query([JUDGED, *SCORED], "SELECT category, sample_id, tp, fp, fn, tn, " + ", ".join(f"{rnd(c)} AS {c}" for c in SC) + " FROM m"))
def binary_metrics(spark, d):
    return _rounded(samples(spark, d).select("category", "sample_id", "tp", "fp", "fn", "tn", *SC), SC)


@register(
    "category_macro",
    query(
        [JUDGED, *SCORED,
         "g AS (SELECT category, count(*) AS sample_count, count(*) FILTER (success) AS success_count, avg(precision) FILTER (success) AS macro_precision, "
         "avg(recall) FILTER (success) AS macro_recall, avg(f1) FILTER (success) AS macro_f1, CAST(coalesce(sum(tp) FILTER (success), 0) AS BIGINT) AS tp, "
         "CAST(coalesce(sum(fp) FILTER (success), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn) FILTER (success), 0) AS BIGINT) AS fn, "
         "CAST(coalesce(sum(tn) FILTER (success), 0) AS BIGINT) AS tn, avg(seconds) FILTER (success) AS mean_seconds, median(seconds) FILTER (success) "
         "AS median_seconds FROM m GROUP BY 1)"],
        f"SELECT category, sample_count, success_count, {rnd('macro_precision')} AS macro_precision, {rnd('macro_recall')} AS macro_recall, "
        f"{rnd('macro_f1')} AS macro_f1, tp, fp, fn, tn, {rnd('mean_seconds')} AS mean_seconds, {rnd('median_seconds')} AS median_seconds, "
        f"{rnd('CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END')} AS micro_precision, {rnd('CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END')} AS micro_recall, "
        f"{rnd('CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2.0*tp/(2*tp+fp+fn) END')} AS micro_f1, {rnd('CASE WHEN tp+fp+fn=0 THEN 0 ELSE tp/(tp+fp+fn) END')} "
        "AS micro_iou FROM g",
    ),
)
def category_macro(spark, d):
    out = M.category_summary(samples(spark, d))
    return _rounded(out, [c for c in out.columns if c.startswith(("macro", "micro", "me"))])


@register(
    "balanced_macro",
    query([JUDGED, *SCORED, "g AS (SELECT category, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f FROM m WHERE success GROUP BY 1)"],
          f"SELECT count(*) AS categories, {rnd('avg(p)')} AS balanced_precision, {rnd('avg(r)')} AS balanced_recall, {rnd('avg(f)')} AS balanced_f1 FROM g"),
)
def balanced_macro(spark, d):
    return _rounded(M.balanced_macro(samples(spark, d)), ["balanced_precision", "balanced_recall", "balanced_f1"])


@register(
    "balanced_complete",
    query([JUDGED, *SCORED, "x AS (SELECT category, count(*) AS all_ FROM m GROUP BY 1)",
           "g AS (SELECT m.category, avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, count(*) AS n, max(all_) AS all_ FROM m JOIN x ON x.category = m.category "
           "WHERE success GROUP BY 1)"],
          f"SELECT count(*) AS categories, {rnd('avg(p)')} AS balanced_precision, {rnd('avg(r)')} AS balanced_recall, {rnd('avg(f)')} AS balanced_f1 FROM g WHERE n = all_"),
)
def balanced_complete(spark, d):
    """Only categories all of whose samples succeeded."""
    s = samples(spark, d)
    expected = s.groupBy("category").agg(F.count(F.lit(1)).alias("expected"))
    return _rounded(M.balanced_macro(s, expected), ["balanced_precision", "balanced_recall", "balanced_f1"])


@register(
    "group_sets",
    query([JUDGED, *SCORED],
          "SELECT coalesce(dataset, 'all') AS dataset, coalesce(category, 'all') AS category, count(*) AS samples, CAST(sum(tp) AS BIGINT) AS tp, "
          f"CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {rnd('avg(f1)')} AS mean_f1 FROM m WHERE success GROUP BY GROUPING SETS "
          "((dataset, category), (dataset), ())"),
)
def group_sets(spark, d):
    return _rounded(M.grouped_scores(samples(spark, d)), ["mean_f1"])


@register(
    "method_summary",
    query([JUDGED, *SCORED],
          "SELECT coalesce(category, 'overall') AS category, count(*) AS samples, "
          + ", ".join(f"{rnd(f'avg({c})')} AS {c}_mean" for c in [*SC, "seconds"]) + ", "
          + ", ".join(f"{rnd(f'stddev_pop({c})')} AS {c}_std" for c in [*SC, "seconds"])
          + " FROM m WHERE success GROUP BY GROUPING SETS ((category), ())"),
)
def method_summary(spark, d):
    out = M.method_summary(samples(spark, d))
    return _rounded(out, [c for c in out.columns if c.endswith(("_mean", "_std"))])


@register(
    "fpr_good",
    query([JUDGED, *SCORED, "f AS (SELECT category, CASE WHEN fp+tn=0 THEN 0.0 ELSE fp/(fp+tn) END AS fpr FROM m WHERE success)",
           "g AS (SELECT category, count(*) AS samples, avg(fpr) AS a, quantile_cont(fpr, 0.95) AS q FROM f GROUP BY 1)"],
          f"SELECT category, samples, {rnd('a')} AS mean_fpr, {rnd('q')} AS p95_fpr FROM g UNION ALL SELECT 'balanced_overall', (SELECT count(*) FROM f), "
          f"{rnd('avg(a)')}, (SELECT {rnd('quantile_cont(fpr, 0.95)')} FROM f) FROM g"),
)
def fpr_good(spark, d):
    good = samples(spark, d).select("category", "sample_id", "success", "fp", (F.col("fp") + F.col("tn")).alias("num_points"))
    return _rounded(M.false_positive_rates(good), ["mean_fpr", "p95_fpr"])


@register(
    "object_score",
    "WITH r AS (SELECT l_orderkey AS cloud_id, quantile_cont(l_tax, 0.85) AS a, quantile_cont(l_tax, 0.9) AS b, quantile_cont(l_tax, 0.95) AS c FROM "
    "lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linestatus) SELECT o_orderkey AS cloud_id, "
    + ", ".join(f"{rnd(f'coalesce(max({c}), 0.0)')} AS score_s_p{p}" for c, p in (("a", 85), ("b", 90), ("c", 95)))
    + " FROM orders LEFT JOIN r ON r.cloud_id = o_orderkey GROUP BY 1",
)
def object_score(spark, d):
    li = T.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    regions = li.groupBy(F.col("l_orderkey").alias("cloud_id"), "l_linestatus").agg(
        *[F.percentile("l_tax", F.lit(p / 100)).alias(f"s_p{p}") for p in (85, 90, 95)]
    )
    all_ = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("cloud_id"))
    return _rounded(M.object_scores(regions, all_), [f"score_s_p{p}" for p in (85, 90, 95)])


RUNS = "r AS (SELECT value AS seconds, event_type = 'view' AS resumed, event_type <> 'signup' AS success FROM events)"


@register(
    "runtime_summary",
    query([RUNS],
          "SELECT count(*) FILTER (NOT resumed AND success) AS executed, count(*) FILTER (resumed) AS resumed, "
          + ", ".join(f"{rnd(f'{e} FILTER (NOT resumed AND success)', 4)} AS {n}" for e, n in [("sum(seconds)", "total"), ("avg(seconds)", "mean"),
             ("median(seconds)", "median"), ("quantile_cont(seconds, 0.95)", "p95"), ("min(seconds)", "fastest"), ("max(seconds)", "slowest")])
          + " FROM r"),
)
def runtime_summary(spark, d):
    runs = T.table(spark, d, "events").select(F.col("value").alias("seconds"), (F.col("event_type") == "view").alias("resumed"), (F.col("event_type") != "signup").alias("success"))
    return _rounded(M.runtime_summary(runs), ["total", "mean", "median", "p95", "fastest", "slowest"], 4)


VARIANTS = (
    "v AS (SELECT l_quantity AS threshold, l_returnflag AS category, l_linestatus AS group_key, l_linenumber AS variant, avg(l_discount)*10 AS f1, "
    "avg(l_tax)*10 AS iou FROM lineitem GROUP BY 1, 2, 3, 4)",
    "a AS (SELECT threshold, category, group_key, avg(f1) AS f1, avg(iou) AS iou, count(*) AS n FROM v GROUP BY 1, 2, 3)",
    "b AS (SELECT threshold, category, avg(f1) AS f1, avg(iou) AS iou, count(*) AS g, min(n) AS n FROM a GROUP BY 1, 2)",
    "o AS (SELECT threshold, avg(f1) AS f1, avg(iou) AS iou, count(*) AS categories, bool_and(g = 2 AND n = 2) AS complete FROM b GROUP BY 1)",
)


def _objective(spark, d):
    rows = T.table(spark, d, "lineitem").groupBy(
        F.col("l_quantity").alias("threshold"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("group_key"),
        F.col("l_linenumber").alias("variant"),
    ).agg((F.avg("l_discount") * 10).alias("f1"), (F.avg("l_tax") * 10).alias("iou"))
    return M.variant_objective(rows)


@register("variant_objective", query(list(VARIANTS), f"SELECT threshold, {rnd('f1')} AS f1, {rnd('iou')} AS iou, categories, complete FROM o"))
def variant_objective(spark, d):
    return _rounded(_objective(spark, d), ["f1", "iou"])


@register("threshold_select", query(list(VARIANTS), f"SELECT threshold, {rnd('f1')} AS f1 FROM o ORDER BY o.f1 DESC, o.iou DESC, threshold LIMIT 1"))
def threshold_select(spark, d):
    return M.select_threshold(_objective(spark, d)).select("threshold", r6("f1").alias("f1"))


FIT = (
    "s AS (SELECT l_linenumber AS category, l_linestatus AS group_key, l_returnflag AS variant, l_suppkey % 9 AS component, "
    "sum(round(l_discount * 100)::BIGINT) / count(*)::DOUBLE AS d_p90, count(*) FILTER (l_quantity > 25 - l_suppkey % 9) AS tp, count(*) FILTER (l_quantity <= 25 - l_suppkey % 9) AS fp FROM lineitem GROUP BY 1, 2, 3, 4)",
    "dev AS (SELECT category, group_key, variant, sum(tp) + 5 AS positives FROM s GROUP BY 1, 2, 3)",
    "t AS (SELECT 0.0::DOUBLE AS threshold UNION SELECT nextafter(d_p90, 'infinity'::DOUBLE) FROM s)",
    "r AS (SELECT threshold, category, group_key, variant, positives, coalesce(sum(tp) FILTER (d_p90 >= threshold), 0) AS tp, "
    "coalesce(sum(fp) FILTER (d_p90 >= threshold), 0) AS fp FROM t, dev JOIN s USING (category, group_key, variant) GROUP BY 1, 2, 3, 4, 5)",
    "g AS (SELECT threshold, category, group_key, avg(2.0*tp/(tp+fp+positives)) AS f1, avg(tp/(fp+positives)) AS iou FROM r GROUP BY 1, 2, 3)",
    "b AS (SELECT threshold, category, avg(f1) AS f1, avg(iou) AS iou FROM g GROUP BY 1, 2)",
    "o AS (SELECT threshold, avg(f1) AS f1, avg(iou) AS iou FROM b GROUP BY 1)",
)


def _development(spark, d):
    """Components of samples made of order lines: line numbers as categories, line states as groups, return flags as variants."""
    key = ["category", "group_key", "variant"]
    lines = T.table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("category"), F.col("l_linestatus").alias("group_key"), F.col("l_returnflag").alias("variant"),
        (F.col("l_suppkey") % 9).alias("component"), "l_discount", (F.col("l_quantity") > 25 - F.col("l_suppkey") % 9).alias("hit"),
    )
    parts = cut(
        lines.groupBy(*key, "component").agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1))).alias("d_p90"), F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp")), "parts"
    )
    return parts, parts.groupBy(*key).agg((F.sum("tp") + 5).alias("positives"))


@register("threshold_curve", query(list(FIT), f"SELECT {rnd('threshold', 9)} AS threshold, {rnd('f1')} AS f1, {rnd('iou')} AS iou FROM o"))
def threshold_curve(spark, d):
    out = M.threshold_curve(*_development(spark, d))
    return out.select((F.round("threshold", 9) + 0.0).alias("threshold"), r6("f1").alias("f1"), r6("iou").alias("iou"))


@register(
    "fitted_threshold",
    query(list(FIT), f"SELECT {rnd('threshold', 9)} AS threshold, {rnd('f1')} AS f1, {rnd('iou')} AS iou FROM o ORDER BY round(o.f1, 12) DESC, round(o.iou, 12) DESC, o.threshold LIMIT 1"),
)
def fitted_threshold(spark, d):
    out = M.fit_threshold(*_development(spark, d))
    return out.select((F.round("threshold", 9) + 0.0).alias("threshold"), r6("f1").alias("f1"), r6("iou").alias("iou"))


@register(
    "result_compare",
    query([JUDGED, *SCORED,
           "a AS (SELECT category, sample_id, tp, fp, fn, f1 FROM m WHERE fn < 3)",
           "b AS (SELECT category, sample_id, CASE WHEN tp > 2 THEN tp + 1 ELSE tp END AS tp, fp, fn, f1 FROM m WHERE tn < 12)"],
          "SELECT coalesce(a.category, b.category) AS category, coalesce(a.sample_id, b.sample_id) AS sample_id, CASE WHEN a.category IS NULL THEN 'missing' WHEN "
          "b.category IS NULL THEN 'extra' WHEN a.tp = b.tp AND a.fp = b.fp AND a.fn = b.fn AND a.f1 = b.f1 THEN 'equal' ELSE 'different' END AS status "
          "FROM a FULL JOIN b ON a.category = b.category AND a.sample_id = b.sample_id"),
)
def result_compare(spark, d):
    m = samples(spark, d)
    before = m.where("tn < 12").withColumn("tp", F.when(F.col("tp") > 2, F.col("tp") + 1).otherwise(F.col("tp")))
    out = M.compare_runs(m.where("fn < 3"), before, ("category", "sample_id"))
    return out.select("category", "sample_id", "status")


@register(
    "limit_per_category",
    query([JUDGED, *SCORED], "SELECT category, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sample_id) AS rn FROM m) WHERE rn <= 3"),
)
def limit_per_category(spark, d):
    return M.limit_per_category(samples(spark, d), 3).select("category", "sample_id")


@register(
    "defect_and_good_rows",
    query([JUDGED, *SCORED], "SELECT category, sample_id, 1 AS label FROM m WHERE tp + fn > 0 UNION ALL SELECT category, sample_id, 0 FROM m WHERE tp + fn = 0"),
)
def defect_and_good_rows(spark, d):
    m = samples(spark, d).select("category", "sample_id", "tp", "fn")
    return M.defect_and_good(m.where("tp + fn > 0"), m.where("tp + fn = 0")).select("category", "sample_id", "label")


@register(
    "sweep_cross",
    query([JUDGED, *SCORED], "SELECT family, count(*) AS runs, count(DISTINCT digits) AS configs FROM (SELECT * FROM (VALUES "
          + ", ".join(f"('{f}', '{f}{i}')" for f, n in (("graph_scale", 6), ("va_gamma", 6), ("boundary_angle", 5), ("seed_and_hops", 15), ("normal_ratio", 5)) for i in range(n))
          + ") t(family, digits), m) GROUP BY 1"),
)
def sweep_cross(spark, d):
    runs = sweep.plan_runs(samples(spark, d).select("category", "sample_id"))
    return runs.groupBy("family").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("config_hash").alias("configs"))


@register(
    "heldout_scope",
    "SELECT d.doc_id, lower(replace(d.source, '_cut', '')) AS group_key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE "
    "concat('src', b.item_id) = lower(replace(d.source, '_cut', '')) AND b.item_id < 10)",
)
def heldout_scope(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.col("source").alias("sample_id"))
    dev = T.table(spark, d, "benchmark").where("item_id < 10").select(F.concat(F.lit("src"), F.col("item_id")).alias("group_key"))
    return sweep.held_out(docs, dev).select("doc_id", "group_key")


@register(
    "resume_filter",
    "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F')",
)
def resume_filter(spark, d):
    """Samples still to run: no finished row with the same fingerprint (here: line status F)."""
    todo = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit("F").alias("fingerprint"))
    done = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("fingerprint"))
    return sweep.remaining(todo, done, ["sample_id"]).select(F.col("sample_id").alias("o_orderkey"))


@register(
    "coord_hash_join",
    query(
        [cloud("evt"), "g AS (SELECT cloud_id, point_id AS gt_id, round_even(x, 5) AS x, y, z, z > 60 AS defect FROM p)"],
        "SELECT p.cloud_id, p.point_id, bool_or(g.defect) AS defect FROM p JOIN g ON g.cloud_id = p.cloud_id AND round_even(p.x, 4) = round_even(g.x, 4) "
        "AND round_even(p.y, 4) = round_even(g.y, 4) AND round_even(p.z, 4) = round_even(g.z, 4) GROUP BY 1, 2",
    ),
)
def coord_hash_join(spark, d):
    from pointweave.functions.columns import half_even_round

    p = T.events_cloud(spark, d)
    gt = p.select("cloud_id", half_even_round(F.col("x"), 5).alias("x"), "y", "z", (F.col("z") > 60).alias("defect"))
    return L.match_rounded(p, gt, 4).groupBy(*IDS).agg(F.bool_or("defect").alias("defect"))


@register(
    "label_column_test",
    "SELECT l_linestatus AS cloud_id, count(DISTINCT l_linenumber) <= greatest(16, CAST(floor(sqrt(count(*))) AS BIGINT)) OR "
    "count(DISTINCT l_linenumber) <= greatest(8, count(*) // 4) AS linenumber, count(DISTINCT l_extendedprice) <= greatest(8, count(*) // 4) AS price "
    "FROM lineitem GROUP BY 1",
)
def label_column_test(spark, d):
    li = T.table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "cloud_id")
    a = L.looks_like_labels(li, "l_linenumber").withColumnRenamed("is_label", "linenumber")
    b = L.looks_like_labels(li, "l_extendedprice").withColumnRenamed("is_label", "price")
    return a.join(b, "cloud_id")


@register(
    "sample_discovery",
    "WITH f AS (SELECT lang AS category, source AS stem, CASE WHEN doc_id % 3 = 0 THEN '.pcd' WHEN doc_id % 3 = 1 THEN '.ply' ELSE '.npy' END AS suffix, doc_id "
    "FROM documents), g AS (SELECT DISTINCT category, stem FROM f WHERE doc_id % 2 = 0) SELECT category, stem AS sample_id, suffix FROM (SELECT f.*, "
    "row_number() OVER (PARTITION BY f.category, f.stem ORDER BY CASE suffix WHEN '.pcd' THEN 0 WHEN '.ply' THEN 1 ELSE 2 END) AS rn FROM f JOIN g "
    "ON g.category = f.category AND g.stem = f.stem) WHERE rn = 1",
)
def sample_discovery(spark, d):
    """Truth files matched to the cloud file of the same stem with the preferred suffix."""
    k = F.col("doc_id") % 3
    f = T.table(spark, d, "documents").select(
        F.col("lang").alias("category"), F.col("source").alias("stem"),
        F.when(k == 0, ".pcd").when(k == 1, ".ply").otherwise(".npy").alias("suffix"), "doc_id",
    )
    gt = f.where("doc_id % 2 = 0").select("category", "stem")
    return discover.match_truth(f.select("category", "stem", "suffix"), gt, (".pcd", ".ply", ".npy")).select(
        "category", F.col("stem").alias("sample_id"), "suffix"
    )


@register(
    "manifest_members",
    "SELECT item_id, unnest(string_split(text, ' ')) AS member FROM benchmark",
)
def manifest_members(spark, d):
    b = T.table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("member_sample_ids"))
    return discover.explode_members(b, " ").select("item_id", "member")
