"""Packing by optimal length buckets.

A dynamic program over the histogram of all lengths chooses the bucket
boundaries that leave the least padding; inside each bucket documents are put,
in a repeatable random order, into batches that a token budget bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import key_block, running_total, spread_key, word_count
from pointweave.session import cut

#: bins per doubling of the length: lengths below 2 * RESOLUTION keep a bin each, longer ones share one with lengths
#: at most 1/RESOLUTION larger, so the histogram has at most 64 * RESOLUTION rows whatever the corpus
RESOLUTION = 128
BUCKETS = 16
BATCH_TOKENS = 16384
SLICE_ROWS = 500
SEED = "pack"


def length_bin(length: str | Column) -> Column:
    """The largest length that shares a bin with ``length``."""
    length = F.col(length) if isinstance(length, str) else length
    width = F.greatest(F.lit(0), F.length(F.bin(length)) - F.lit(RESOLUTION.bit_length()))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), width.cast("int"))
    return (F.ceil(length / step) * step).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least padding; the last is the largest length.

    ``lengths`` ascending. Padding is the sum of boundary minus length over all
    documents; cost[j] is the least sum of boundaries over the first j bins.
    """
    n = len(lengths)
    if n == 0:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    back: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        now, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            options = cost[:j] + (total[j] - total[:j]) * float(lengths[j - 1])
            came[j] = int(np.argmin(options))
            now[j] = options[came[j]]
        cost = now
        back.append(came)
    found, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        found.append(int(lengths[j - 1]))
        j = int(came[j])
    return sorted(found)


def histogram(sized: DataFrame, length: str = "length") -> tuple[np.ndarray, np.ndarray]:
    """(longest length, documents) of every bin over all rows; at most 64 * RESOLUTION bins come to the driver."""
    rows = sized.groupBy(length_bin(length).alias("bin")).agg(F.max(length).alias("upper"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    return np.array([r.upper for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=np.int64)


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
    buckets: int = BUCKETS, budget: int = BATCH_TOKENS,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_tokens``, ``padded_to``, ``batch_id``, ``slot``.

    ``length`` counts the tokens of a row, by default its words; null texts have
    none. A batch holds rows of one bucket, each padded to the bucket's
    boundary, and at most ``budget`` padded tokens; a document longer than the
    budget has a batch to itself and is not cut. Repeated rows are packed each
    for itself, an empty table gives no rows, other columns are not looked at.
    ``batch_id`` is the boundary, then the batch's number inside the bucket.
    """
    sized = cut(
        df.select(
            F.col(id_col).alias("_id"),
            (word_count(text_col) if length is None else F.coalesce(length, F.lit(0)).cast("long")).alias("length"),
            spread_key(SEED, id_col).alias("_key"),
        ),
        "lengths",
    )
    uppers, counts = histogram(sized)
    bounds = best_boundaries(uppers, counts, buckets)
    inside = [int(counts[(uppers > low) & (uppers <= high)].sum()) for low, high in zip([-1, *bounds[:-1]], bounds)]
    if not bounds:
        bounds, inside = [0], [0]
    choose = lambda values: F.coalesce(*[F.when(F.col("length") <= b, F.lit(v).cast("long")) for b, v in zip(bounds, values)])
    placed = cut(
        sized.withColumn("padded_to", choose(bounds)).withColumn("_slice", key_block("_key", choose([-(-n // SLICE_ROWS) for n in inside]))),
        "placed",
    )
    place = running_total(placed, ["padded_to"], "_slice", ["_key", "_id", "length"], F.lit(1), "_place")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("long")
    return place.withColumn("_rows", rows).select(
        F.col("_id").alias(id_col),
        F.col("length").alias("n_tokens"),
        "padded_to",
        F.concat_ws("-", "padded_to", F.floor((F.col("_place") - 1) / F.col("_rows"))).alias("batch_id"),
        ((F.col("_place") - 1) % F.col("_rows")).cast("int").alias("slot"),
    )
