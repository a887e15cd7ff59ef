"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= c are those at most sqrt(2 - 2c) apart. Every
vector has its home in the cell of its nearest pivot and is copied into each
cell that may hold a neighbour; cells are then compared independently. With r
the radius, d the distances to own and other pivot and D that of the pivots,
the triangle inequality allows a neighbour at home in the other cell only if
d_other <= d_own + 2r; in Euclidean space the distance to the plane between the
two pivots gives the sharper (d_other^2 - d_own^2) / (2 D) <= r, and both are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.blocks import connected, forest_edges, run_groups
from pointweave.session import cut

#: pivots, a repeatable choice by hash; more of them make smaller cells and more copies
PIVOTS = 32
#: rows of one side that a task compares at a time
BLOCK_ROWS = 1024
#: allowance for rounding in the bounds; it only adds copies
SLACK = 1e-6


def link_vectors(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    pivots: int = PIVOTS,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked when their labels are equal and not null (where
    ``label_col`` is given) and their cosine in double precision reaches
    ``threshold``. Vectors that are null, empty, zero, or hold a null or
    non-finite component link with nothing, and so do vectors of different
    length. Equal vectors of one label are compared once and counted as often
    as they occur. ``component_id`` is the smallest id that links reach, an
    id that nothing links with is its own component (null for a null id).
    """
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label_col).isNotNull() if label_col else F.lit(True)
    usable = v.isNotNull() & label & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.when(usable, F.struct((F.col(label_col) if label_col else F.lit(0)).alias("label"), v.alias("v"))).alias("_vector"),
    )
    distinct = rows.where("_vector is not null").groupBy("_vector").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("least"))
    # numbered once and written: the numbers name the distinct vectors from here on
    reps = cut(
        distinct.select(
            F.monotonically_increasing_id().alias("rep"), "copies", "least", "_vector", F.xxhash64("_vector.label").alias("part"),
            F.size("_vector.v").alias("dim"),
        ),
        "vectors",
    )
    links, edges = _compare(reps, threshold, pivots)
    parts = connected(edges)
    named = parts.join(reps.select("rep", "least"), parts.node == F.col("rep"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = (
        reps.select("rep", "_vector", "copies")
        .join(links, "rep", "left")
        .join(named.select("rep", "component").join(smallest, "component"), "rep", "left")
        .join(reps.select("rep", "least"), "rep")
        .select("_vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    found = cut(found, "linked")
    return rows.join(found, "_vector", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(True)).alias("kept"),
    )


def _compare(reps: DataFrame, threshold: float, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and forest edges (a, b) between distinct vectors."""
    # at most ``pivots`` vectors per length come to the driver; any choice gives the same links
    dims = [r.dim for r in reps.select("dim").distinct().limit(64).collect()]
    centres: dict[int, np.ndarray] = {}
    for dim in dims:
        got = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("_vector.v"), "rep").limit(pivots).select("_vector.v").collect()
        c = np.array([r.v for r in got], dtype=float)
        centres[dim] = c / np.linalg.norm(c, axis=1, keepdims=True)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, part, copies, dims_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3))
            for dim in np.unique(dims_):
                take = np.flatnonzero(dims_ == dim)
                x = np.array([batch.column(4)[int(k)].values.to_numpy() for k in take])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                c = centres.get(int(dim))
                if c is None:  # a length without pivots: one cell
                    near, home = np.ones((len(x), 1), dtype=bool), np.zeros(len(x), dtype=int)
                else:
                    # squared distances from inner products, then corrected for rounding by the slack
                    d2 = np.maximum(0.0, 2 - 2 * (x @ c.T))
                    d = np.sqrt(d2)
                    home = d.argmin(axis=1)
                    own, own2 = d[np.arange(len(x)), home], d2[np.arange(len(x)), home]
                    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))[home]
                    near = d <= own[:, None] + 2 * radius + SLACK
                    near &= d2 - own2[:, None] <= 2 * radius * apart + SLACK
                    near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                vectors = np.ascontiguousarray(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[take][row]), pa.array(cell.astype(np.int64) + int(dim) * 1_000_000), pa.array(cell == home[row]),
                        pa.array(rep[take][row]), pa.array(copies[take][row]), pa.array([vectors[k].tobytes() for k in row], pa.binary()),
                    ],
                    names=["part", "cell", "home", "rep", "copies", "unit"],
                )

    placed = cut(
        reps.select("rep", "part", "copies", "dim", "_vector.v").mapInArrow(place, "part bigint, cell bigint, home boolean, rep bigint, copies bigint, unit binary"),
        "cells",
    )
    sizes = placed.groupBy("part", "cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("visits"))
    sizes = cut(sizes.where("homes > 0 and visits > 1"), "cell-sizes")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_ROWS)).cast("int")
    dealt = placed.join(sizes, ["part", "cell"]).withColumn("_hb", blocks("homes")).withColumn("_vb", blocks("visits"))
    columns = ["rep", "copies", "unit"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    at_home = dealt.where("home").select("part", "cell", own("_hb").alias("_i"), every("_vb").alias("_j"), F.lit(True).alias("home"), *columns)
    visiting = dealt.select("part", "cell", every("_hb").alias("_i"), own("_vb").alias("_j"), F.lit(False).alias("home"), *columns)

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        home = group.column("home").to_numpy()
        rep = group.column("rep").to_numpy()
        copies = group.column("copies").to_numpy()
        x = np.frombuffer(b"".join(group.column("unit").to_pylist()), dtype=np.float64).reshape(len(rep), -1)
        h, v = np.flatnonzero(home), np.flatnonzero(~home)
        if not len(h) or not len(v):
            return
        linked = (x[v] @ x[h].T >= threshold) & (rep[v][:, None] != rep[h][None, :])
        counts = linked @ copies[h]
        some = np.flatnonzero(counts)
        if not len(some):
            return
        # rows of one vector on both sides are one node
        nodes, at = np.unique(rep, return_inverse=True)
        a, b = np.nonzero(linked)
        low, root = forest_edges(len(nodes), at[v][a], at[h][b])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rep[v][some], nodes[low]])),
                pa.array(np.concatenate([rep[v][some], nodes[root]])),
                pa.array(np.concatenate([counts[some], np.zeros(len(low), dtype=np.int64)]).astype(np.int64)),
            ],
            names=["a", "b", "n"],
        )

    found = cut(run_groups(at_home.unionByName(visiting), ["part", "cell", "_i", "_j"], work, "a bigint, b bigint, n bigint"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    return links, found.where("a <> b").select("a", "b")


ORACLE = """
WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
"""
