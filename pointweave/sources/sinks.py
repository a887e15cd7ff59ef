"""Writers: tables by category, and point / label files per cloud."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cache(points: DataFrame, path: str, digest: str) -> None:
    """Prepared clouds partitioned by the settings hash and category."""
    points.withColumn("config_hash", F.lit(digest)).write.mode("overwrite").partitionBy("config_hash", "category").parquet(path)


def read_cache(spark, path: str, digest: str) -> DataFrame:
    """Reload; another settings hash or a repeated point is an error at once."""
    df = spark.read.parquet(path)
    # a partition column: only the folder names are read
    if [r[0] for r in df.select("config_hash").distinct().limit(2).collect()] not in ([digest], []):
        raise ValueError(f"the cache at {path} was written with other settings")
    twice = df.groupBy("category", "cloud_id", "point_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the cache holds point {twice[0].point_id} of cloud {twice[0].cloud_id} more than once")
    return df


def pcd_bytes(xyz: np.ndarray) -> bytes:
    head = (
        "# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\n"
        f"WIDTH {len(xyz)}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(xyz)}\nDATA binary\n"
    )
    return head.encode() + np.ascontiguousarray(xyz, dtype="<f4").tobytes()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def encode_clouds(points: DataFrame) -> DataFrame:
    """(cloud_id, content): one binary PCD image per sampled cloud, rows in id order (bounded clouds only)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "content": [pcd_bytes(pdf[["x", "y", "z"]].to_numpy())]})

    return points.groupBy("cloud_id").applyInPandas(one, "cloud_id string, content binary")
