"""From file lists to sample tables: which cloud belongs to which truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes in order of preference.
SUFFIXES = (".pcd", ".ply", ".npy", ".txt", ".xyz", ".csv")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """category, folder, stem, suffix and path of every file under root/<category>/<folder>/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    tail = F.split("path", "/")
    name = F.element_at(tail, -1)
    return files.select(
        F.element_at(tail, -3).alias("category"), F.element_at(tail, -2).alias("folder"),
        F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("stem"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), "path",
    )


def match_truth(files: DataFrame, truth: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One cloud file per truth stem: the one with the preferred suffix."""
    order = F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.col("suffix"))
    known = files.where(F.col("suffix").isin(*suffixes)).join(
        truth.select("category", "stem").distinct(), ["category", "stem"], "left_semi"
    )
    rest = [c for c in files.columns if c not in ("category", "stem")]
    best = known.groupBy("category", "stem").agg(F.min(F.struct(order.alias("o"), *rest)).alias("b"))
    return best.select("category", "stem", *[F.col("b." + c).alias(c) for c in rest])


def is_good(stem: F.Column | str = "stem"):
    """A stem with the token ``good`` names a defect-free cloud."""
    col = F.col(stem) if isinstance(stem, str) else stem
    return F.array_contains(F.split(F.lower(col), "_"), "good")


def defective_samples(files: DataFrame, dataset: str) -> DataFrame:
    truth = files.where((F.col("folder") == "gt") & ~is_good())
    clouds = files.where((F.col("folder") == "test") & ~is_good())
    found = match_truth(clouds, truth)
    gt = truth.select("category", "stem", F.col("path").alias("gt_path"))
    return found.join(gt, ["category", "stem"]).select(
        F.lit(dataset).alias("dataset"), "category", F.col("stem").alias("sample_id"), F.col("path").alias("pc_path"),
        "gt_path", F.lit("defective").alias("sample_kind"),
    )


def good_samples(files: DataFrame, dataset: str) -> DataFrame:
    truth = files.where(F.col("folder") == "gt").select("category", "stem")
    clouds = files.where((F.col("folder") == "good") | ((F.col("folder") == "test") & is_good()))
    clouds = clouds.join(truth, ["category", "stem"], "left_anti")
    found = match_truth(clouds, clouds)
    return found.select(
        F.lit(dataset).alias("dataset"), "category", F.col("stem").alias("sample_id"), F.col("path").alias("pc_path"),
        F.lit(None).cast("string").alias("gt_path"), F.lit("good").alias("sample_kind"),
    )


def explode_members(manifest: DataFrame, separator: str = "|") -> DataFrame:
    """Manifest rows with a separated member list -> one row per member."""
    import re

    return manifest.withColumn("member", F.explode(F.split("member_sample_ids", re.escape(separator)))).drop("member_sample_ids")
