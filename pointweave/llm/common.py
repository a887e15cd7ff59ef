"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointweave.session import cut

#: what counts as a word when sizes are counted: a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def folded(df: DataFrame, *own: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """A caller's columns (all, or ``columns``) as one struct named ``row``, and an operator's ``own`` beside it.

    So names an operator makes for itself cannot clash with a caller's, whatever these are.
    """
    names = df.columns if columns is None else columns
    return df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *own)


def unfolded(columns: Sequence[str], row: str = "row") -> list[Column]:
    """The caller's columns again."""
    return [F.col(row).getField(c).alias(c) for c in columns]


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread_key(seed: str, id_col: str | Column) -> Column:
    """A repeatable shuffle key: 32 hex digits, uniform whatever the ids are."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def key_block(key: str | Column, blocks: str | Column) -> Column:
    """Which of ``blocks`` equal slices of the key space holds ``key``; grows with the key."""
    key, blocks = (F.col(c) if isinstance(c, str) else c for c in (key, blocks))
    part = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(part * blocks / F.lit(1 << 32)).cast("long")


def running_total(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str | Column], value: str | Column, out: str
) -> DataFrame:
    """Cumulative sum of ``value`` in ``order`` inside ``group``, without a task that owns a group.

    ``block`` is an integer column that never falls along ``order`` and cuts a
    group into slices of bounded size. Slices are summed first (partial
    aggregation), their running offsets come from a window over slices only, and
    the rows of one slice are summed by themselves. ``df`` is read twice, so
    pass a written table. No group column may be null.
    """
    value = F.col(value) if isinstance(value, str) else value
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
    past = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select(*group, block, F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_before")), "offsets")
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, [*group, block])
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")
