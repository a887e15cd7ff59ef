"""Sparse symmetric systems cut into row blocks of bounded size, and rounds of work on them.

A system (a cloud's matrix, or a region's) is spread over tasks as blocks of
consecutive rows in some order that keeps neighbours together. A block is one
table row that carries its part of the matrix and of the vectors. A product with
the matrix needs the vector rows of other blocks that the block's columns name:
blocks send those to each other as messages, so one shuffle is one product, and
a chain of products is one job. A system that fits one block sends nothing and
goes on in its task. Sums over blocks leave as ordinary rows for Spark to add.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.order_stats import cumulative_counts
from pointweave.session import cut

KEY = ["cloud_id", "component"]
#: rows of a block at most where a system is spread; with 120 vectors its state stays below 10 MB
BLOCK_ROWS = 4096
#: blocks a task holds on average, and tasks up to which every block has one to itself
BLOCKS_PER_TASK, OWN_TASKS = 4, 32
#: kinds of rows: a block's state, a message to a block, what a block is told by its system, a term of a sum, a result
STATE, MESSAGE, ORDER, TERM, RESULT = range(5)

SCHEMA = "cloud_id string, component long, block int, kind int, sender int, data binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
GIVEN = "cloud_id string, component long, block int, kind int, data binary, i int, j int, g double, h double"
GIVEN_NAMES = [c.split()[0] for c in GIVEN.split(", ")]
TERM_TYPES = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]


def freeze(thing) -> bytes:
    return pickle.dumps(thing, protocol=5)


def thaw(data: bytes):
    return pickle.loads(data)


def _spread_bits(v: Column) -> Column:
    """Ten bits with two free places between each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def space_order(points: DataFrame, *keep: str) -> DataFrame:
    """(cloud_id, point_id, at, *keep): places along a space-filling curve through the cloud's box, so that near points are near in order."""
    box = points.groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    extent = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"], F.lit(1e-300))
    parts = [F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / extent * 1024.0), F.lit(1023)).cast("long") for c in "xyz"]
    key = _spread_bits(parts[0])
    for axis in (1, 2):
        key = key.bitwiseOR(F.shiftleft(_spread_bits(parts[axis]), axis))
    return points.join(box, "cloud_id").select("cloud_id", "point_id", F.struct(key.alias("cell"), F.col("point_id").alias("id")).alias("at"), *keep)


def row_places(ordered: DataFrame, rows: int | Column) -> DataFrame:
    """(cloud_id, component, point_id, block, row) for points (cloud_id, component, point_id, at); equal blocks of at most ``rows``, which may go by the system's ``n``."""
    ranks = cumulative_counts(ordered, KEY, "at").select(*KEY, F.col("v").alias("at"), "before", "n")
    placed = ordered.join(ranks, [*KEY, "at"])
    size = F.ceil(F.col("n") / F.ceil(F.col("n") / rows))
    block, row = F.floor(F.col("before") / size).cast("int"), (F.col("before") % size).cast("int")
    return placed.select(*KEY, "point_id", block.alias("block"), row.alias("row"), "n")


def _structure(pdf: pd.DataFrame) -> dict:
    """A block's part of the matrix: own rows in order, own columns first, then those of other blocks by (block, row)."""
    block = int(pdf["block"].iloc[0])
    row, other, col = (pdf[c].to_numpy() for c in ("row", "dblock", "drow"))
    value = pdf["value"].to_numpy(dtype=float)
    named = pdf.drop_duplicates("row")
    n = int(row.max()) + 1
    ids = np.zeros(n, dtype=np.int64)
    ids[named["row"].to_numpy()] = named["point_id"].to_numpy()
    extra = {c: np.zeros(n) for c in pdf.columns if c.startswith("v_")}
    for c, values in extra.items():
        values[named["row"].to_numpy()] = named[c].to_numpy(dtype=float)
    away = other != block
    halo = np.unique(np.column_stack([other[away], col[away]]), axis=0) if away.any() else np.zeros((0, 2), dtype=np.int64)
    place = col.astype(np.int64)
    if len(halo):
        code = halo[:, 0].astype(np.int64) << 32 | halo[:, 1]
        place[away] = n + np.searchsorted(code, other[away].astype(np.int64) << 32 | col[away])
    order = np.lexsort((place, row))
    send = {int(b): np.unique(row[other == b]) for b in np.unique(other[away])}
    full, starts = np.unique(row[order], return_index=True)
    return {
        "cloud": pdf["cloud_id"].iloc[0], "block": block, "n": int(pdf["n"].iloc[0]), "ids": ids, "row": full, "starts": starts, "col": place[order], "value": value[order], "send": send,
        "halo": [(b, int((halo[:, 0] == b).sum())) for b in np.unique(halo[:, 0])] if len(halo) else [], **extra,
    }


def product(block: dict, own: np.ndarray, messages: dict[int, np.ndarray]) -> np.ndarray:
    """The block's rows of matrix times vectors; ``messages`` holds what other blocks sent."""
    full = np.concatenate([own, *[messages[b] for b, _ in block["halo"]]]) if block["halo"] else own
    out = np.zeros_like(own)
    for at in range(0, own.shape[1], 16):  # a few vectors at once, so the products stay small
        terms = block["value"][:, None] * full[block["col"], at : at + 16]
        out[block["row"], at : at + 16] = np.add.reduceat(terms, block["starts"], axis=0)
    return out


def products_alone(block: dict) -> Callable[[np.ndarray], np.ndarray]:
    """Products with the matrix of a system of one block, for many of them: a pass over the rows for their first entries, one for their second and so on."""
    count = np.diff(np.append(block["starts"], len(block["col"])))
    order = np.argsort(-count, kind="stable")
    longer = np.searchsorted(-count[order], -np.arange(count.max()), side="left")
    at = [block["starts"][order[:m]] + k for k, m in enumerate(longer)]
    passes, rows = [(block["col"][i], block["value"][i][:, None]) for i in at], block["row"][order]

    def times(x: np.ndarray) -> np.ndarray:
        total, out = np.zeros((len(rows), x.shape[1])), np.zeros_like(x)
        for col, value in passes:
            term = x[col]
            term *= value
            total[: len(col)] += term
        out[rows] = total
        return out

    return times


def build_blocks(entries: DataFrame, places: DataFrame) -> DataFrame:
    """The written table of blocks, one row each: (cloud_id, component, block, blocks, n, data).

    ``entries`` (cloud_id, component, src, dst, value) are symmetric, every row
    has its diagonal. Columns of ``places`` that begin with ``v_`` become
    vectors of the block.
    """
    extra = [c for c in places.columns if c.startswith("v_")]
    a = places.select(*KEY, F.col("point_id").alias("src"), "block", "row", "n", *extra)
    b = places.select(*KEY, F.col("point_id").alias("dst"), F.col("block").alias("dblock"), F.col("row").alias("drow"))
    placed = entries.join(a, [*KEY, "src"]).join(b, [*KEY, "dst"]).withColumnRenamed("src", "point_id")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _structure(pdf)
        return pd.DataFrame({"cloud_id": [block["cloud"]], "component": [pdf["component"].iloc[0]], "block": [block["block"]], "data": [freeze(block)]})

    packed = placed.groupBy(*KEY, "block").applyInPandas(pack, "cloud_id string, component long, block int, data binary")
    sizes = places.groupBy(*KEY).agg((F.max("block") + 1).alias("blocks"), F.first("n").alias("n"))
    return cut(packed.join(sizes, KEY), "blocks")


#: what a block does when it is its turn: (state, messages by sender, order or None) -> rows (kind, to which block, data)
Turn = Callable[[dict, dict[int, np.ndarray], object], Iterator[tuple[int, int, bytes]]]


def _rows_of(table: DataFrame, kind: int) -> DataFrame:
    return table.select(*KEY, "block", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("sender"), "data")


def state(table: DataFrame) -> DataFrame:
    return _rows_of(table, STATE)


def orders(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """``told`` (cloud_id, component, data) as an order to each block of the system."""
    return _rows_of(blocks.select(*KEY, "block").join(told.select(*KEY, "data"), KEY), ORDER)


def one_round(rows: DataFrame, turn: Turn, tasks: int) -> DataFrame:
    """Every block gets the rows addressed to it (states, messages, orders) and takes its turn."""
    dealt = rows.repartition(tasks, *KEY, "block").sortWithinPartitions(*KEY, "block", "kind", "sender")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for r in range(batch.num_rows):
                yield tuple(c[r].as_py() for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cloud, component, block), group in groupby(records(batches), key=lambda r: r[:3]):
            own, messages, order = None, {}, None
            for _, _, _, kind, sender, data in group:
                if kind == STATE:
                    own = thaw(data)
                elif kind == MESSAGE:
                    messages[sender] = thaw(data)
                else:
                    order = thaw(data)
            out = [(cloud, component, to, kind, block if kind == MESSAGE else None, data) for kind, to, data in turn(own, messages, order)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    return dealt.mapInArrow(run, SCHEMA)


def chain(rows: DataFrame, blocks: DataFrame, turn: Turn, products: int, tasks: int) -> DataFrame:
    """All blocks take turns until ``products`` products with the matrix are done.

    Systems of one block need no messages and go through in one turn; the
    others exchange once a product.
    """
    alone = blocks.groupBy(*KEY).agg(F.max("blocks").alias("blocks"))
    named = rows.join(alone, KEY)
    out = one_round(named.where("blocks = 1").select(*NAMES), turn, tasks)
    if products:
        spread = one_round(named.where("blocks > 1").select(*NAMES), turn, tasks)
        for _ in range(products):
            spread = one_round(spread, turn, tasks)
        out = out.unionByName(spread)
    return out


def release(rows: DataFrame, give: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """What blocks have to give, (kind, data, i, j, g, h): their state, terms of sums named by (i, j), results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cloud, component, block, data = (batch.column(c)[r].as_py() for c in ("cloud_id", "component", "block", "data"))
                for kind, held, i, j, g, h in give(thaw(data)):
                    n = len(g)
                    same = [pa.array([x] * n, t) for x, t in zip((cloud, component, block, kind, held), (*TYPES[:4], TYPES[5]))]
                    yield pa.RecordBatch.from_arrays([*same, *[pa.array(x, t) for x, t in zip((i, j, g, h), TERM_TYPES)]], names=GIVEN_NAMES)

    return rows.mapInArrow(run, GIVEN)


def send(own: dict, vectors: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Messages with the rows of ``vectors`` that other blocks need."""
    for block, rows in own["send"].items():
        yield MESSAGE, block, freeze(vectors[rows])


def keep(own: dict) -> tuple[int, int, bytes]:
    return STATE, own["block"], freeze(own)


def whole(kind: int, thing) -> tuple:
    """One row without a term."""
    return kind, freeze(thing), [None], [None], [None], [None]


def task_count(blocks: int) -> int:
    return max(min(2 * blocks, OWN_TASKS), -(-blocks // BLOCKS_PER_TASK))
