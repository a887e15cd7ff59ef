"""The batch run: discovery -> truth -> pipeline -> sample, category and good-sample tables, with resume."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.config import Settings
from pointweave.operators import labels as L
from pointweave.operators import metrics as M
from pointweave.plans.pipeline import run_pipeline
from pointweave.plans.sweep import remaining
from pointweave.session import _files, _path, cut
from pointweave.sources import discover, formats

SAMPLE = ["dataset", "category", "sample_id", "sample_kind"]


@dataclass
class Batch:
    samples: DataFrame
    categories: DataFrame
    good: DataFrame


def read_truth(points: DataFrame, rows: DataFrame) -> DataFrame:
    """(cloud_id, point_id, defect) from label rows (cloud_id, row, values), told apart by their shape and values.

    One column, or one row of any width but three: a value per point or a list
    of indices; a vector with as many values as the cloud has points counts as
    values. Three columns: coordinates of defect points. Four or more:
    coordinates with the label last where the last column looks like labels,
    else coordinates of defect points. A file whose rows differ in width, or
    with two columns, gives no labels.
    """
    width = rows.groupBy("cloud_id").agg(F.min(F.size("values")).alias("w"), F.max(F.size("values")).alias("w1"), F.count(F.lit(1)).alias("lines")).where("w = w1")
    flat = (F.col("lines") == 1) & (F.col("w") != 3)
    rows = cut(rows.join(width.select("cloud_id", F.when(flat, 1).otherwise(F.col("w")).alias("w"), flat.alias("flat")), "cloud_id"), "truth-rows")
    item = lambda i: F.get("values", F.lit(i))
    vector = rows.where("w = 1 and not flat").select("cloud_id", "row", item(0).alias("value"))
    vector = vector.unionByName(rows.where("flat").select("cloud_id", F.posexplode("values").alias("row", "value")).withColumn("row", F.col("row").cast("long")))
    last = F.element_at("values", -1)
    wide = rows.where("w >= 4").withColumn("last", last)
    marked = wide.join(L.looks_like_labels(wide, "last").where("is_label"), "cloud_id", "left_semi").select("cloud_id").distinct()
    label = F.when(F.col("marked"), last).otherwise(F.lit(1.0))
    spots = rows.where("w >= 3").join(marked.withColumn("marked", F.lit(True)), "cloud_id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    spots = spots.select("cloud_id", *[item(i).alias(a) for i, a in enumerate("xyz")], label.alias("label"))
    by_place = points.join(spots.select("cloud_id").distinct(), "cloud_id", "left_semi")
    return L.from_vector(points.join(vector.select("cloud_id").distinct(), "cloud_id", "left_semi"), vector).unionByName(
        L.align_coordinates(by_place, spots)
    )


def sample_metrics(samples: DataFrame, points: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per sample (cloud_id and SAMPLE) with its confusion counts and scores.

    ``points`` are the working points, ``predicted`` the ids found defective,
    ``truth`` carries ``defect``. Good samples have no defect anywhere; a
    defective sample without truth, or one without points, is a failure.
    """
    marks = points.select("cloud_id", "point_id").join(
        predicted.select("cloud_id", "point_id", F.lit(True).alias("found")), ["cloud_id", "point_id"], "left"
    )
    marks = marks.join(truth.select("cloud_id", "point_id", "defect"), ["cloud_id", "point_id"], "left")
    known = truth.select("cloud_id", F.lit(True).alias("known")).distinct()
    rows = marks.na.fill(False, ["found", "defect"])
    counts = M.confusion(rows, ["cloud_id"], F.col("found"), F.col("defect"))
    out = samples.join(counts, "cloud_id", "left").join(known, "cloud_id", "left")
    num = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    success = num.isNotNull() & ((F.col("sample_kind") == "good") | F.coalesce("known", F.lit(False)))
    reason = F.when(num.isNull(), "no points").when(~success, "no truth")
    return out.withColumn("num_points", num).withColumn("success", success).withColumn("failure_type", reason).drop("known")


def summaries(rows: DataFrame) -> Batch:
    """Category table of the defective samples and false-positive table of the good ones."""
    defective = rows.where("sample_kind = 'defective'").withColumn("seconds", F.lit(None).cast("double"))
    good = rows.where("sample_kind = 'good'")
    return Batch(rows, M.category_summary(defective).drop("mean_seconds", "median_seconds"), M.false_positive_rates(good))


def run_batch(spark: SparkSession, root: str, out: str, settings: Settings | None = None, dataset: str = "data") -> Batch:
    """All samples below ``root``/<category>/{test,gt,good}; metric rows are appended to ``out`` and finished samples skipped.

    A failed sample has a row of its own and is tried again by the next run.
    """
    settings = settings or Settings()
    mark = settings.digest()
    files = cut(discover.list_files(spark, root), "files")
    samples = discover.defective_samples(files, dataset).unionByName(discover.good_samples(files, dataset))
    samples = cut(samples.withColumn("fingerprint", F.lit(mark)), "samples")
    folder = f"{out.rstrip('/')}/sample_metrics"
    done = spark.read.parquet(folder) if _files(spark, folder).exists(_path(spark, folder)) else None
    todo = samples if done is None else remaining(samples, done.where("success"), ["dataset", "category", "sample_id"])
    todo = cut(todo.withColumn("cloud_id", F.col("pc_path")), "todo", rows=F.count(F.lit(1)))
    if todo.seen["rows"]:
        only = todo.select(F.col("pc_path").alias("path"))
        raw = cut(formats.read_clouds(spark, root, only).withColumnRenamed("path", "cloud_id"), "raw")
        stages = run_pipeline(raw, settings)
        paths = todo.where("gt_path is not null").select(F.col("gt_path").alias("path"), "cloud_id")
        rows = formats.read_text_clouds(spark, root).join(paths, "path").select("cloud_id", F.col("point_id").alias("row"), "values")
        truth = L.through_sample(cut(read_truth(raw, rows), "truth"), stages.points.select("cloud_id", "point_id"))
        truth = truth.join(rows.select("cloud_id").distinct(), "cloud_id", "left_semi")
        found = sample_metrics(todo, stages.points, stages.final, truth)
        found.select("cloud_id", *SAMPLE, "fingerprint", *[c for c in found.columns if c not in ("cloud_id", *SAMPLE, "fingerprint", "pc_path", "gt_path")]).write.mode("append").parquet(folder)
    rows = spark.read.parquet(folder).where(F.col("fingerprint") == mark)
    # of several tries the successful one counts
    best = rows.groupBy("dataset", "category", "sample_id").agg(F.max_by(F.struct(*rows.columns), "success").alias("r")).select("r.*")
    return summaries(cut(best, "batch"))
