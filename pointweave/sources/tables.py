"""Ordinary tables seen as point clouds: DataFrame -> points(cloud_id, point_id, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """Three axes that every dimension enters: the sums of each third dimension, from the first, second and third on."""
    e = table(spark, folder, "embeddings")
    v = F.col("embedding").cast("array<double>")

    def axis_sum(i):
        own = F.filter(v, lambda x, k: k % 3 == i)
        return F.round(F.aggregate(own, F.lit(0.0), lambda s, x: s + x), 9)

    axis = [axis_sum(i) for i in range(3)]
    return e.select(
        F.col("label").cast("string").alias("cloud_id"),
        F.col("vec_id").alias("point_id"),
        axis[0].alias("x"),
        axis[1].alias("y"),
        axis[2].alias("z"),
    )


def events_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """Hour of time, user and value: three axes of comparable extent."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_type").alias("cloud_id"),
        F.col("event_id").alias("point_id"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9).alias("x"),
        F.col("user_id").cast("double").alias("y"),
        F.col("value").alias("z"),
    )


def customer_cloud(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_mktsegment").alias("cloud_id"),
        F.col("c_custkey").alias("point_id"),
        (F.col("c_acctbal") / 100.0).alias("x"),
        F.col("c_nationkey").cast("double").alias("y"),
        (F.col("c_custkey") % 97).cast("double").alias("z"),
    )


def orders_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """One point per order from its lines; one cloud per order priority."""
    li = table(spark, folder, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("point_id")).agg(
        F.round(F.sum("l_quantity"), 4).alias("x"),
        (F.round(F.sum("l_extendedprice"), 2) / 1000.0).alias("y"),
        F.round(F.sum("l_discount") * 100.0, 2).alias("z"),
    )
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("point_id"), F.col("o_orderpriority").alias("cloud_id")
    )
    return lines.join(o, "point_id").select("cloud_id", "point_id", "x", "y", "z")


#: the same clouds for the DuckDB side, as WITH-clause bodies
SQL = {
    "emb": (
        "SELECT CAST(label AS VARCHAR) AS cloud_id, vec_id AS point_id, "
        + ", ".join(
            f"round(list_sum(list_transform(range({i}, len(embedding) + 1, 3), lambda k: CAST(embedding[k] AS DOUBLE))), 9) AS {a}"
            for i, a in ((1, "x"), (2, "y"), (3, "z"))
        )
        + " FROM embeddings"
    ),
    "evt": (
        "SELECT event_type AS cloud_id, event_id AS point_id, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS x, "
        "CAST(user_id AS DOUBLE) AS y, value AS z FROM events"
    ),
    "cust": (
        "SELECT c_mktsegment AS cloud_id, c_custkey AS point_id, c_acctbal / 100.0::DOUBLE AS x, "
        "CAST(c_nationkey AS DOUBLE) AS y, CAST(c_custkey % 97 AS DOUBLE) AS z FROM customer"
    ),
    "ord": (
        "SELECT o.o_orderpriority AS cloud_id, l.point_id, l.x, l.y, l.z FROM (SELECT l_orderkey AS point_id, "
        "round(sum(l_quantity), 4) AS x, round(sum(l_extendedprice), 2) / 1000.0::DOUBLE AS y, "
        "round(sum(l_discount) * 100.0::DOUBLE, 2) AS z FROM lineitem GROUP BY l_orderkey) l "
        "JOIN orders o ON o.o_orderkey = l.point_id"
    ),
}
