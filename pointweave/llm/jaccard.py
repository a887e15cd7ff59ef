"""Near-duplicate documents: a Jaccard join on word shingles with Bayesian pruning.

1. Every document becomes a set of five-word shingles and 128 MinHash values;
   documents with the same set are one node from here on.
2. Nodes that agree in any of 32 bands of four values are candidates. A pair's
   values are compared 16 at a time; with a uniform prior on the similarity the
   posterior probability of reaching the threshold follows from the agreements
   so far, and the pair is dropped once it is below the tolerance. What is left
   connects candidates to clusters.
3. Inside a cluster all pairs that survive the same pruning are verified on the
   whole shingle sets. Tasks return counts and a spanning forest, never pairs.

A pair at the threshold of 0.8 misses all bands with probability 5e-8 and is
pruned with about the tolerance per step, more similar pairs more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.blocks import connected, forest_edges, run_groups, with_block_pairs
from pointweave.llm.common import folded, unfolded
from pointweave.llm.dedup import flag_members, member_filter
from pointweave.llm.shingles import HASHES, distinct_sets, minhashes, shingle_arrays
from pointweave.session import cut

THRESHOLD = 0.8
BAND = 4
STEP = 16
TOLERANCE = 1e-7
#: nodes of a block while bands are compared, and while sets are
BAND_ROWS, SET_ROWS = 512, 512


@lru_cache(maxsize=4)
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 16, 32, .. compared values: the fewest agreements that keep a pair.

    With a uniform prior the posterior of the similarity after m of n agreements is
    Beta(m + 1, n - m + 1), and the probability that it reaches t is that of at most
    m successes in n + 1 trials of probability t.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        needed.append(m)
    return tuple(needed)


def survivors(signatures: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (a, b) of rows may reach the threshold."""
    # the smaller set can cover at most its own share of the larger
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    alive = np.flatnonzero(low >= threshold * high - 1e-9)
    agreed = np.zeros(len(alive), dtype=np.int64)
    for k, needed in enumerate(least_agreements(threshold, tolerance)):
        if not len(alive):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        agreed += (signatures[a[alive], part] == signatures[b[alive], part]).sum(axis=1)
        keep = agreed >= needed
        alive, agreed = alive[keep], agreed[keep]
    return alive


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a[i]] and sets[b[i]]; ``a`` ascending."""
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    mark = np.zeros(len(vocabulary), dtype=bool)
    out = np.zeros(len(a), dtype=np.int64)
    heads = np.flatnonzero(np.diff(a, prepend=-1))
    for start, stop in zip(heads, [*heads[1:], len(a)]):
        own = ids[begin[a[start]] : begin[a[start] + 1]]
        mark[own] = True
        others = b[start:stop]
        pieces = [ids[begin[o] : begin[o + 1]] for o in others]
        lengths = np.array([len(p) for p in pieces])
        out[start:stop] = np.add.reduceat(mark[np.concatenate(pieces)], np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64)
        mark[own] = False
    return out


def _pairs_between(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of block i and block j (all pairs of one block where i = j), first row ascending."""
    if i == j:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text_key, set, n, signature) of every row; ``set`` names the shingle set, null without words. Written."""
    source = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_key"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, signatures = [], [], []
            for shingles, counts in shingle_arrays(batch.column(2)):
                for own in distinct_sets(shingles, counts):
                    names.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sizes.append(len(own))
                signatures += [row.tobytes() for row in minhashes(shingles, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())],
                names=["_id", "_text_key", "set", "n", "signature"],
            )

    return cut(source.mapInArrow(run, f"_id {id_type}, _text_key bigint, set binary, n int, signature binary"), "sketches")


def _row_digest(id_col: str, key_col: str) -> Column:
    return F.sha2(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(key_col).cast("string")), 256)


def _nodes(sketches: DataFrame) -> DataFrame:
    """One numbered row per distinct shingle set."""
    grouped = sketches.where("set is not null").groupBy("set").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("_id").alias("least"),
        F.min(F.struct("_id", "_text_key")).alias("sample"),
        F.first("n").alias("n"),
        F.first("signature").alias("signature"),
    )
    return cut(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _clusters(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, cluster) of the nodes that candidate pairs connect."""
    keys = [F.xxhash64(F.lit(k), F.substring("signature", 2 * BAND * k + 1, 2 * BAND)) for k in range(HASHES // BAND)]
    banded = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = banded.join(shared, "key").join(nodes.select("node", "n", "signature"), "node")
    dealt = with_block_pairs(members, "size", "node", BAND_ROWS).select("key", "_i", "_j", "_block", "node", "n", "signature")

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        block, node, n = (group.column(c).to_numpy() for c in ("_block", "node", "n"))
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint16).reshape(len(node), HASHES)
        a, b = _pairs_between(block, group.column("_i")[0].as_py(), group.column("_j")[0].as_py())
        alive = survivors(signatures, n, a, b, threshold, tolerance)
        rows, roots = forest_edges(len(node), a[alive], b[alive])
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[roots])], names=["a", "b"])

    edges = run_groups(dealt, ["key", "_i", "_j"], work, "a bigint, b bigint").distinct()
    return cut(connected(edges).withColumnRenamed("component", "cluster"), "clusters")


def _verify(df: DataFrame, nodes: DataFrame, clusters: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float) -> DataFrame:
    """(a, b, n): rows with a = b hold links of node a, the others are forest edges of verified links."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    wanted = cut(clusters.join(sizes, "cluster").join(nodes.select("node", "sample", "copies", "n", "signature"), "node"), "wanted")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_key"))
    # a filter of bounded size keeps texts that are in no cluster out of the shuffle
    named = wanted.select("sample.*").withColumn("_sha", _row_digest("_id", "_text_key"))
    texts = flag_members(texts.withColumn("_sha", _row_digest("_id", "_text_key")), member_filter(named, "_sha"), "_sha").where("_maybe").drop("_maybe", "_sha")
    found = texts.join(wanted, texts._id.eqNullSafe(F.col("sample._id")) & (texts._text_key == F.col("sample._text_key")))
    found = found.select("cluster", "size", "node", "copies", "n", "signature", "_text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for shingles, counts in shingle_arrays(batch.column(6)) for s in distinct_sets(shingles, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sets, pa.binary())], names=[*batch.schema.names[:6], "shingles"])

    schema = "cluster bigint, size bigint, node bigint, copies bigint, n int, signature binary, shingles binary"
    dealt = with_block_pairs(found.mapInArrow(to_sets, schema), "size", "node", SET_ROWS)
    dealt = dealt.select("cluster", "_i", "_j", "_block", "node", "copies", "n", "signature", "shingles")

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        # a document that occurs twice as a whole row stands for its node once
        node = group.column("node").to_numpy()
        first = np.sort(np.unique(node, return_index=True)[1])
        group = group.take(pa.array(first))
        block, node, copies, n = (group.column(c).to_numpy() for c in ("_block", "node", "copies", "n"))
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=np.uint16).reshape(len(node), HASHES)
        a, b = _pairs_between(block, group.column("_i")[0].as_py(), group.column("_j")[0].as_py())
        alive = survivors(signatures, n, a, b, threshold, tolerance)
        a, b = a[alive], b[alive]
        if not len(a):
            return
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
        common = intersections(sets, a, b)
        linked = common >= threshold * (n[a].astype(np.int64) + n[b] - common) - 1e-9
        a, b = a[linked], b[linked]
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        some, (rows, roots) = np.flatnonzero(links), forest_edges(len(node), a, b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[some], node[rows]])),
                pa.array(np.concatenate([node[some], node[roots]])),
                pa.array(np.concatenate([links[some], np.zeros(len(rows), dtype=np.int64)])),
            ],
            names=["a", "b", "n"],
        )

    return cut(run_groups(dealt, ["cluster", "_i", "_j"], work, "a bigint, b bigint, n bigint"), "verified")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row per row of ``df``: id, ``class_id``, ``n_links``, ``kept``, and ``_text_key``.

    Two documents are linked when the Jaccard similarity of their sets of
    five-word shingles reaches ``threshold``; words are runs of anything but
    ASCII white space, and a text of fewer than five words has one shingle of
    all of them. ``n_links`` counts the other documents linked directly, copies
    included; ``class_id`` is the smallest id that links reach. Null, empty
    and blank texts link with nothing and are a class of their own (null for a
    null id). Of rows that tie in id and text every one is ``kept``.
    """
    sketches = sketch(df, id_col, text_col)
    nodes = _nodes(sketches)
    verified = _verify(df, nodes, _clusters(nodes, threshold, tolerance), id_col, text_col, threshold, tolerance)
    links = verified.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    parts = connected(verified.where("a <> b").select("a", "b"))
    named = parts.join(nodes.select("node", "least"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("class_id"))
    classes = named.select("node", "component").join(smallest, "component").select("node", "class_id")
    found = nodes.select("node", "set", "copies", "least").join(links, "node", "left").join(classes, "node", "left")
    found = found.select(
        "set", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("class_id", "least").alias("class_id")
    ).where("n_links > 0")
    result = sketches.select("_id", "_text_key", "set").join(cut(found, "classes"), "set", "left")
    own = F.coalesce("class_id", "_id")
    return result.select(
        F.col("_id").alias(id_col),
        own.alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("_id") == own, F.lit(True)).alias("kept"),
        "_text_key",
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are the first, by id, of their class; same columns, whatever their names and types.

    Null, empty and blank texts stay, and so do all rows that tie in id and text
    with the first of their class; an empty table stays empty.
    """
    gone = near_duplicates(df, id_col, text_col).where("not kept").select(F.col(id_col).alias("gone_id"), F.col("_text_key").alias("gone_key"))
    gone = cut(gone.distinct(), "gone")
    keyed = folded(df, F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    # rows that are certainly not among those pass straight on; the filter's size is bounded
    bloom = member_filter(gone.withColumn("sha", _row_digest("gone_id", "gone_key")), "sha")
    flagged = flag_members(keyed.withColumn("sha", _row_digest("id", "key")), bloom, "sha")
    sure, maybe = flagged.where("not _maybe").select("row"), flagged.where("_maybe")
    left = maybe.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    return sure.unionByName(left.select("row")).select(*unfolded(df.columns))
