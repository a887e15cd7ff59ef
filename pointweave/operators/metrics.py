"""Quality and runtime tables. Everything is a partial aggregation over rows of predictions or samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.columns import ratio_or_zero
from pointweave.functions.order_stats import percentiles, prefix_sums
from pointweave.session import cut


def confusion(df: DataFrame, keys: Sequence[str], pred: Column, truth: Column) -> DataFrame:
    counts = df.groupBy(*keys).agg(
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    )
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, iou from tp fp fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio_or_zero(tp, tp + fp))
        .withColumn("recall", ratio_or_zero(tp, tp + fn))
        .withColumn("f1", ratio_or_zero(2.0 * tp, 2 * tp + fp + fn))
        .withColumn("iou", ratio_or_zero(tp, tp + fp + fn))
    )


def category_summary(samples: DataFrame, by: str = "category") -> DataFrame:
    """Macro means over successful samples and micro scores from pooled counts.

    samples: <by>, success, tp, fp, fn, tn, precision, recall, f1, seconds
    """
    ok = F.col("success")
    pooled = samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(ok).alias("success_count"),
        *[F.avg(F.when(ok, F.col(c))).alias("macro_" + c) for c in ("precision", "recall", "f1")],
        *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.avg(F.when(ok, F.col("seconds"))).alias("mean_seconds"),
    )
    middle = percentiles(samples.where(ok), [by], "seconds", [0.5], ["median_seconds"])
    return with_scores(pooled.join(middle, by, "left")).withColumnsRenamed(
        {"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1", "iou": "micro_iou"}
    )


def balanced_macro(samples: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Mean over categories of the mean over samples; with ``expected`` only over complete categories."""
    per = samples.where("success").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    )
    if expected is not None:
        per = per.join(expected, "category").where(F.col("n") == F.col("expected"))
    return per.agg(F.count(F.lit(1)).alias("categories"), *[F.avg(c).alias("balanced_" + c) for c in ("precision", "recall", "f1")])


def grouped_scores(samples: DataFrame) -> DataFrame:
    """One pass for category rows, dataset rows and the grand row (grouping sets over dataset, category)."""
    return (
        samples.where("success")
        .groupingSets([["dataset", "category"], ["dataset"], []], "dataset", "category")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
            F.avg("f1").alias("mean_f1"),
        )
        .select(
            F.coalesce("dataset", F.lit("all")).alias("dataset"), F.coalesce("category", F.lit("all")).alias("category"),
            "samples", "tp", "fp", "fn", "mean_f1",
        )
    )


def method_summary(samples: DataFrame) -> DataFrame:
    """Per category plus ``overall``: mean and population deviation over samples (overall is a plain sample mean)."""
    cols = ["precision", "recall", "f1", "iou", "seconds"]
    return (
        samples.where("success")
        .groupingSets([["category"], []], "category")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            *[F.avg(c).alias(c + "_mean") for c in cols],
            *[F.stddev_pop(c).alias(c + "_std") for c in cols],
        )
        .withColumn("category", F.coalesce("category", F.lit("overall")))
    )


def false_positive_rates(good: DataFrame) -> DataFrame:
    """good: category, sample_id, success, fp, num_points -> mean and p95 rate per category, and one row over all.

    Failed samples are left out. The row over all has the mean of the categories' means.
    """
    rate = cut(good.where("success").select("category", ratio_or_zero(F.col("fp"), F.col("num_points")).alias("fpr")), "rates")
    per = rate.groupBy("category").agg(F.count(F.lit(1)).alias("samples"), F.avg("fpr").alias("mean_fpr"))
    whole = per.agg(F.sum("samples").alias("samples"), F.avg("mean_fpr").alias("mean_fpr")).where("samples is not null")
    both = per.unionByName(whole.withColumn("category", F.lit("balanced_overall")))
    pooled = rate.withColumn("category", F.lit("balanced_overall")).unionByName(rate)
    return both.join(percentiles(pooled, ["category"], "fpr", [0.95], ["p95_fpr"]), "category")


def object_scores(regions: DataFrame, samples: DataFrame) -> DataFrame:
    """Largest p85, p90 and p95 stress over a sample's restored regions; 0.0 where there are none."""
    top = regions.groupBy("cloud_id").agg(*[F.max(c).alias("score_" + c) for c in ("s_p85", "s_p90", "s_p95")])
    return samples.join(top, "cloud_id", "left").na.fill(0.0, ["score_s_p85", "score_s_p90", "score_s_p95"])


def runtime_summary(runs: DataFrame) -> DataFrame:
    """runs: seconds, resumed, success -> totals over the successful runs that were executed."""
    done = ~F.col("resumed") & F.col("success")
    s = F.when(done, F.col("seconds"))
    runs = runs.withColumn("batch", F.lit("all"))
    totals = runs.groupBy("batch").agg(
        F.count_if(done).alias("executed"), F.count_if(F.col("resumed")).alias("resumed"),
        F.sum(s).alias("total"), F.avg(s).alias("mean"), F.min(s).alias("fastest"), F.max(s).alias("slowest"),
    )
    spread = percentiles(runs.where(done), ["batch"], "seconds", [0.5, 0.95], ["median", "p95"])
    return totals.join(spread, "batch", "left").drop("batch")


def variant_objective(rows: DataFrame, expected_per_category: int = 2) -> DataFrame:
    """threshold, category, group_key, variant, f1, iou -> three equal-weight means and a completeness flag."""
    group = rows.groupBy("threshold", "category", "group_key").agg(
        F.avg("f1").alias("f1"), F.avg("iou").alias("iou"), F.count(F.lit(1)).alias("variants")
    )
    cat = group.groupBy("threshold", "category").agg(
        F.avg("f1").alias("f1"), F.avg("iou").alias("iou"), F.count(F.lit(1)).alias("groups"),
        F.min("variants").alias("variants"),
    )
    return cat.groupBy("threshold").agg(
        F.avg("f1").alias("f1"), F.avg("iou").alias("iou"), F.count(F.lit(1)).alias("categories"),
        F.bool_and((F.col("groups") == expected_per_category) & (F.col("variants") == expected_per_category)).alias("complete"),
    )


def select_threshold(objective: DataFrame) -> DataFrame:
    """Best row by F1, then IoU, then the smaller threshold."""
    return objective.orderBy(F.desc("f1"), F.desc("iou"), F.asc("threshold")).limit(1)


def breakpoints(values: DataFrame, value: str = "d_p90") -> DataFrame:
    """Every threshold at which a decision ``value < t`` can change: 0 and the next double after each finite value."""
    steps = values.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))).select(next_double(F.col(value)).alias("threshold"))
    zero = values.sparkSession.range(1).select(F.lit(0.0).alias("threshold"))
    return steps.unionByName(zero).distinct()


def next_double(v: Column) -> Column:
    """The smallest double above a finite, non-negative ``v``: the next bit pattern."""
    # a double just above is at most one unit in the last place away; adding half of it rounds to even, so a whole unit is added
    exponent = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(2.0**-1022)))), F.lit(-1022))
    steps = [F.pow(F.lit(2.0), e - 52) for e in (exponent - 1, exponent, exponent + 1)]
    ahead = [v + s for s in steps]
    return F.coalesce(*[F.when(a > v, a) for a in ahead])


def threshold_curve(components: DataFrame, samples: DataFrame) -> DataFrame:
    """(threshold, f1, iou): the category-balanced scores at every threshold of the components' ``d_p90``.

    ``samples`` (category, group_key, variant, positives) are the development
    samples with their true points; ``components`` (category, group_key, variant,
    component, d_p90, tp, fp) what is accepted at threshold 0. A component stays
    while ``d_p90 >= threshold``, so raising the threshold only removes whole
    components and a sample's scores are steps at its own values. Steps are
    weighted (variants of a group, groups of a category and categories count
    alike) and summed up over all thresholds at once; no threshold is replayed.
    """
    key = ["category", "group_key", "variant"]
    groups = samples.groupBy("category", "group_key").agg(F.count(F.lit(1)).alias("variants"))
    cats = groups.groupBy("category").agg(F.count(F.lit(1)).alias("groups"))
    weight = samples.join(groups, key[:2]).join(cats, "category")
    weight = weight.select(*key, "positives", (1.0 / (F.col("variants") * F.col("groups") * max(1, cats.count()))).alias("weight"))
    usable = components.where(F.col("d_p90").isNotNull() & ~F.isnan("d_p90"))
    steps = usable.groupBy(*key, "d_p90").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    # what is left once every component up to this value has gone; values of a sample are a sample's own
    later = Window.partitionBy(*key).orderBy("d_p90").rowsBetween(1, Window.unboundedFollowing)
    left = steps.select(*key, next_double(F.col("d_p90")).alias("threshold"), *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("tp", "fp")])
    whole = steps.groupBy(*key).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    start = samples.select(*key).join(whole, key, "left").select(*key, F.lit(0.0).alias("threshold"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp")])
    states = left.unionByName(start).join(weight, key)
    missed = F.col("positives") - F.col("tp")
    f1 = F.when(2 * F.col("tp") + F.col("fp") + missed == 0, 0.0).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + missed))
    iou = F.when(F.col("tp") + F.col("fp") + missed == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp") + missed))
    scored = states.select(*key, "threshold", "weight", f1.alias("f1"), iou.alias("iou"))
    before = Window.partitionBy(*key).orderBy("threshold")
    events = scored.select("threshold", *[((F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0.0))) * F.col("weight")).alias(c) for c in ("f1", "iou")])
    return prefix_sums(events, "threshold", {"f1": "f1", "iou": "iou"})


def fit_threshold(components: DataFrame, samples: DataFrame) -> DataFrame:
    """The threshold with the best balanced F1, then IoU, then the smallest (threshold, f1, iou); scores that agree to 12 digits tie."""
    curve = threshold_curve(components, samples)
    best = F.max_by(F.struct("threshold", "f1", "iou"), F.struct(F.round("f1", 12), F.round("iou", 12), -F.col("threshold"))).alias("best")
    return curve.agg(best).where("best is not null").select("best.threshold", "best.f1", "best.iou")


def compare_runs(now: DataFrame, before: DataFrame, keys=("dataset", "category", "sample_id")) -> DataFrame:
    """Full outer comparison of two result tables: status and exact equality per row."""
    cols = ["tp", "fp", "fn", "f1"]
    a = now.select(*keys, *[F.col(c).alias("now_" + c) for c in cols], F.lit(True).alias("in_now"))
    b = before.select(*keys, *[F.col(c).alias("ref_" + c) for c in cols], F.lit(True).alias("in_ref"))
    both = a.join(b, list(keys), "full")
    same = F.lit(True)
    for c in cols:
        same = same & F.col("now_" + c).eqNullSafe(F.col("ref_" + c))
    status = (
        F.when(F.col("in_now").isNull(), "missing").when(F.col("in_ref").isNull(), "extra")
        .when(same, "equal").otherwise("different")
    )
    return both.select(
        *keys, status.alias("status"), (F.col("now_f1") - F.col("ref_f1")).alias("f1_delta"),
        *[F.col(p + c) for p in ("now_", "ref_") for c in cols],
    )


def limit_per_category(samples: DataFrame, n: int, by: str = "category", order: str = "sample_id") -> DataFrame:
    """First ``n`` per category; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy(by).orderBy(order)
    return samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def defect_and_good(defective: DataFrame, good: DataFrame) -> DataFrame:
    """Object-level rows with label 1 for defective and 0 for good samples."""
    return defective.withColumn("label", F.lit(1)).unionByName(good.withColumn("label", F.lit(0)), allowMissingColumns=True)


def stage_diagnostics(points: DataFrame, edges: DataFrame, masks: Sequence[str], labels: Sequence[str], response: str) -> DataFrame:
    """One row per cloud: directed edges, mean degree, mean and p95 of ``response``, points per mask, points and components per label.

    ``masks`` are boolean columns of ``points``, ``labels`` integer ones (null or 0: none).
    """
    count = points.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("points"), F.avg(response).alias("response_mean"),
        *[F.count_if(m).alias(f"{m}_points") for m in masks],
        *[F.count_if(F.col(c) > 0).alias(f"{c}_points") for c in labels],
        *[F.count_distinct(F.when(F.col(c) > 0, F.col(c))).alias(f"{c}_components") for c in labels],
    )
    high = percentiles(points, ["cloud_id"], response, [0.95], ["response_p95"])
    links = edges.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("edges"))
    both = count.join(high, "cloud_id", "left").join(links, "cloud_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return both.withColumn("mean_degree", F.col("edges") / F.col("points"))
