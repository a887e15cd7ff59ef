"""Exact quantiles and ranks per group.

Two ways that give the same numbers:

* the built-in ``percentile`` when the caller can prove a bound on the rows of a
  group (a sampled working cloud), because it keeps the group in one buffer;
* otherwise a range-partitioned cumulative count. Equal values are collapsed
  first (partial aggregation), a hot group is spread over many range
  partitions, and no task ever sees more than its own range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.session import cut

#: a group of at most this many rows may live in one aggregation buffer
BUFFER_ROWS = 100_000


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): ``cnt`` rows here, ``before`` rows below, ``n`` rows in the group."""
    keys = list(keys)
    distinct = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    ranged = cut(
        distinct.repartitionByRange(*[F.col(k) for k in keys], F.col("v")).withColumn(
            "slice", F.spark_partition_id()
        ),
        "ranges",
    )
    slices = ranged.groupBy(*keys, "slice").agg(F.sum("cnt").alias("rows"))
    over = Window.partitionBy(*keys)
    offsets = slices.select(
        *keys,
        "slice",
        (F.sum("rows").over(over.orderBy("slice")) - F.col("rows")).alias("offset"),
        F.sum("rows").over(over).alias("n"),
    )
    inside = Window.partitionBy(*keys, "slice").orderBy("v")
    return (
        ranged.withColumn("upto", F.sum("cnt").over(inside))
        .join(offsets, [*keys, "slice"])
        .select(*keys, "v", "cnt", (F.col("offset") + F.col("upto") - F.col("cnt")).alias("before"), "n")
    )


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """One row per value of ``order`` with the running totals ``sums`` (name -> column) up to and including it.

    Rows of equal ``order`` are added first; range partitions are added up by
    themselves and shifted by the totals of those before, so no task sees all rows.
    """
    distinct = df.groupBy(F.col(order)).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    ranged = cut(distinct.repartitionByRange(order).withColumn("slice", F.spark_partition_id()), "prefix")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("slice").agg(*[F.sum(name).alias(f"_{name}") for name in sums])  # one row per range partition
    offsets = totals.select("slice", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0.0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.select(order, "slice", *[F.sum(name).over(inside).alias(name) for name in sums])
    return run.join(offsets, "slice").select(order, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    names: Sequence[str],
    rows_bound: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group, one named column per fraction."""
    keys, fractions, names = list(keys), list(fractions), list(names)
    if rows_bound is not None and rows_bound <= BUFFER_ROWS:
        return df.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(float(q))).alias(name) for q, name in zip(fractions, names)]
        )
    ranks = cumulative_counts(df.where(F.col(value).isNotNull()), keys, value)
    picks = []
    for q, name in zip(fractions, names):
        spot = (F.col("n") - 1) * F.lit(float(q))
        low = F.floor(spot)
        here = F.col("before")
        last = here + F.col("cnt") - 1
        lower = F.max(F.when((here <= low) & (low <= last), F.col("v")))
        high = F.least(low + 1, F.col("n") - 1)
        upper = F.max(F.when((here <= high) & (high <= last), F.col("v")))
        share = F.max(spot - low)
        picks.append((lower + (upper - lower) * share).alias(name))
    return ranks.groupBy(*keys).agg(*picks)


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """The value with 0-based rank ``rank`` per group; ``ranks`` holds keys and ``rank``."""
    table = cumulative_counts(df, keys, value).join(ranks, list(keys))
    hit = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("cnt"))
    return table.where(hit).select(*keys, "rank", F.col("v").alias(value))


def average_rank_percent(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank_pct") -> DataFrame:
    """100 * (average rank - 1) / (n - 1) per row; 0 for a group of one."""
    keys = list(keys)
    table = cumulative_counts(df, keys, value)
    rank = F.col("before") + (F.col("cnt") - 1) / 2.0
    table = table.select(
        *keys,
        F.col("v").alias(value),
        F.when(F.col("n") == 1, 0.0).otherwise(rank * 100.0 / (F.col("n") - 1)).alias(out),
    )
    return df.join(table, [*keys, value])
