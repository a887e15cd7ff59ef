"""All pairs of a group compared in bounded tasks, without a row per pair.

A group of any size is cut into blocks by hash; one task gets two blocks at a
time, compares their rows, and gives back sums per row and the edges of a
spanning forest, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.graph import components


def with_block_pairs(df: DataFrame, size: str | Column, key: str, rows: int) -> DataFrame:
    """Adds ``_i`` <= ``_j`` and ``_block``: a row of block b meets every block once.

    ``size`` is the rows of the row's group, ``rows`` the rows of a block on average.
    """
    size = F.col(size) if isinstance(size, str) else size
    blocks = F.greatest(F.lit(1), F.ceil(size / rows)).cast("int")
    dealt = df.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (
        dealt.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_blocks", "_other")
    )


def group_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first ``keys`` columns (none null, all integers)."""
    held: list[pa.RecordBatch] = []

    def key_of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        change[0] = bool(held) and key_of(held[-1], 0) != key_of(batch, 0)
        cuts = np.flatnonzero(change)
        if not held or change[0]:
            if held:
                yield pa.Table.from_batches(held)
            held = []
        start = 0
        for c in [*cuts[cuts > 0], n]:
            held.append(batch.slice(start, c - start))
            if c < n:
                yield pa.Table.from_batches(held)
                held = []
            start = c
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n rows: the smallest row it is connected with by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def forest_edges(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs (row, root) that connect what the pairs (a, b) connect."""
    label = local_roots(n, a, b)
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def run_groups(df: DataFrame, keys: Sequence[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on the rows of every key; a key's rows meet in one task, sorted so that they arrive in one run."""
    ordered = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        rows = 0
        for group in group_runs(batches, len(keys)):
            for out in work(group):
                ready.append(out)
                rows += out.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready, rows = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return ordered.mapInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the component is its smallest node."""
    whole = edges.select(F.lit("").alias("cloud_id"), F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = whole.select("cloud_id", F.explode(F.array("src", "dst")).alias("point_id")).distinct()
    return components(nodes, whole).select(F.col("point_id").alias("node"), "component")
