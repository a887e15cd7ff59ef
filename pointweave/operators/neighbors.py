"""Exact nearest-neighbour and radius joins, and the graphs made from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.columns import sq_dist
from pointweave.operators.blocksearch import self_search
from pointweave.operators.featureblocks import nearest_sq
from pointweave.operators.octree import (
    CELL,
    FINE,
    CellIndex,
    build_index,
    cell_at,
    covering_cells,
    far_sq,
    near_sq,
    with_fine_cell,
)
from pointweave.session import cut, is_empty

LEAF = ["leaf_lv", "lx", "ly", "lz"]


def _rank_filter(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("cloud_id", "src").orderBy("d2", "dst")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(queries: DataFrame, index: CellIndex, k: int, skip_same_id: bool) -> DataFrame:
    """k nearest indexed points of every query row (cloud_id, src, qx, qy, qz).

    1. Upper bound: the k-th distance inside the query's home, the deepest
       enclosing cell that holds enough points (never beyond its far corner).
    2. Candidates: points of the leaves whose box meets that ball.
    Both steps are equi-joins with a residual test, so Spark may split a hot leaf.
    """
    need = k + 1 if skip_same_id else k
    depth = index.depth
    q = with_fine_cell(
        queries.withColumnsRenamed({"qx": "x", "qy": "y", "qz": "z"}), index.frame, depth
    ).withColumnsRenamed({"x": "qx", "y": "qy", "z": "qz"})
    places = q.select("cloud_id", *FINE, "n").distinct()
    path = places.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    for name, c in zip(CELL, cell_at(F.col("lv"), depth)):
        path = path.withColumn(name, c)
    path = path.join(index.cells, ["cloud_id", "lv", *CELL])
    enough = F.col("cnt") >= F.least(F.lit(need).cast("long"), F.col("n"))
    # the deepest cell on the way down that holds enough points is the query's home
    homes = path.where(enough).groupBy("cloud_id", *FINE).agg(
        F.max(F.struct("lv", *CELL, "cnt", "x0", "x1", "y0", "y1", "z0", "z1")).alias("home")
    )
    q = q.join(homes, ["cloud_id", *FINE]).select(
        "cloud_id", "src", "qx", "qy", "qz", "ox", "oy", "oz", "ext",
        *[F.col("home." + c).alias(c) for c in ("lv", *CELL, "cnt", "x0", "x1", "y0", "y1", "z0", "z1")],
    )
    q = q.withColumn("bound", far_sq(F.col("qx"), F.col("qy"), F.col("qz"))).drop("x0", "x1", "y0", "y1", "z0", "z1")
    q = cut(q, "query")
    pts = index.points.select("cloud_id", *LEAF, F.col("point_id").alias("dst"), "x", "y", "z", *FINE)
    d2 = sq_dist(F.col("x"), F.col("y"), F.col("z"), F.col("qx"), F.col("qy"), F.col("qz"))
    same_cell = [c == F.col(n) for n, c in zip(CELL, cell_at(F.col("lv"), depth))]
    same_cell = same_cell[0] & same_cell[1] & same_cell[2]
    leaves = index.lookup.select("cloud_id", "lv", *CELL, *LEAF)
    # a home far larger than the answer (a sparse corner beside a dense spot) keeps the corner bound alone
    inside = q.where(F.col("cnt") <= 12 * max(need, index.cap)).join(leaves, ["cloud_id", "lv", *CELL])
    inside = inside.join(pts, ["cloud_id", *LEAF]).where(same_cell)
    if skip_same_id:
        inside = inside.where(F.col("src") != F.col("dst"))
    kth = inside.groupBy("cloud_id", "src").agg(
        F.get(F.array_sort(F.collect_list(d2)), F.lit(k - 1)).alias("kth")
    )
    q = q.join(kth, ["cloud_id", "src"], "left").withColumn("bound", F.least("bound", "kth"))
    q = q.select("cloud_id", "src", "qx", "qy", "qz", "ox", "oy", "oz", "ext", "bound")
    cover = covering_cells(q, index, F.sqrt("bound"))
    cover = cover.select("cloud_id", "lv", *CELL, "src", "qx", "qy", "qz", F.pow("reach", F.lit(2.0)).alias("reach2"))
    leaves = index.lookup.select("cloud_id", "lv", *CELL, *LEAF, "x0", "x1", "y0", "y1", "z0", "z1")
    hits = cover.join(leaves, ["cloud_id", "lv", *CELL])
    hits = hits.where(near_sq(F.col("qx"), F.col("qy"), F.col("qz")) <= F.col("reach2"))
    hits = hits.drop("x0", "x1", "y0", "y1", "z0", "z1")
    # a leaf larger than a covering cell is met once per cell; the point's own cell decides which one counts
    cands = hits.join(pts, ["cloud_id", *LEAF]).where(same_cell)
    cands = cands.select("cloud_id", "src", "dst", d2.alias("d2"), "reach2").where(F.col("d2") <= F.col("reach2"))
    if skip_same_id:
        cands = cands.where(F.col("src") != F.col("dst"))
    return _rank_filter(cands.select("cloud_id", "src", "dst", "d2"), k)


def ids_repeat(points: DataFrame) -> bool:
    return not is_empty(points.groupBy("cloud_id", "point_id").count().where(F.col("count") > 1))


def copies_crowd(points: DataFrame, k: int) -> bool:
    """Whether a coordinate has so many points that its copies fill the k nearest of one of them."""
    return not is_empty(points.groupBy("cloud_id", "x", "y", "z").count().where(F.col("count") > k + 1))


def knn_join(
    points: DataFrame, k: int, queries: DataFrame | None = None, cap: int | None = None, skip_same_id: bool | None = None,
    extra: Sequence[str] = (), repeated: bool | None = None,
) -> DataFrame:
    """(cloud_id, src, dst, dist, rank): the k nearest points of every query, ties by id.

    Without ``queries``, or with the points themselves, it is the self join;
    without ``queries`` a point is excluded by its id. Copies: only the first
    k+1 ids at one coordinate can ever be an answer, and all copies share one
    answer, so a heavily repeated coordinate is searched once and the result is
    joined back to its copies.

    ``extra`` names further columns of the search among itself: dx, dy, dz (the
    way to the neighbour) and back (see :func:`self_search`; null where copies
    were folded). They are left out where ids repeat, as such an id names
    several points; ``repeated`` says so where the caller knows.
    """
    self_join = queries is None or queries is points
    skip = queries is None if skip_same_id is None else skip_same_id
    cap = cap or max(32, k + 1)
    base = points.select("cloud_id", "point_id", "x", "y", "z")
    spot = ["cloud_id", "x", "y", "z"]
    if self_join and repeated is None:
        repeated = ids_repeat(base)
    if repeated:
        extra, self_join = [], queries is None
    alone = not copies_crowd(base, k)
    if alone and self_join:
        return self_search(base, k, skip, repeated=repeated).select("cloud_id", "src", "dst", F.sqrt("d2").alias("dist"), "rank", *extra)
    if alone:
        ask = queries.select("cloud_id", F.col("point_id").alias("src"), *[F.col(a).alias("q" + a) for a in "xyz"])
        found = _search(ask, build_index(base, cap), k, skip)
        return found.select("cloud_id", "src", "dst", F.sqrt("d2").alias("dist"), "rank")
    first = F.row_number().over(Window.partitionBy(*spot).orderBy("point_id"))
    kept = cut(base.withColumn("rn", first).where(F.col("rn") <= k + 1).drop("rn"), "kept")
    if self_join and not repeated:
        return _copies_join(base, kept, k, skip, extra)
    members = base if self_join else queries.select("cloud_id", "point_id", "x", "y", "z")
    places = members.groupBy(*spot).agg(F.min("point_id").alias("src"))
    if self_join:
        # the first of the copies answers for all of them
        shared = self_search(kept, k + 1 if skip else k, False, repeated=True).select("cloud_id", "src", "dst", "d2")
    else:
        ask = places.withColumnsRenamed({a: "q" + a for a in "xyz"})
        shared = _search(ask, build_index(kept, cap), k + 1 if skip else k, False)
    shared = shared.join(places, ["cloud_id", "src"]).select(*spot, "dst", "d2")
    found = members.select(*spot, F.col("point_id").alias("src")).join(shared, spot)
    if skip:
        found = found.where(F.col("src") != F.col("dst"))
    found = _rank_filter(found.select("cloud_id", "src", "dst", "d2"), k)
    return found.select("cloud_id", "src", "dst", F.sqrt("d2").alias("dist"), "rank")


def _copies_join(base: DataFrame, kept: DataFrame, k: int, skip: bool, extra: Sequence[str]) -> DataFrame:
    """The self join where coordinates repeat; ``kept`` holds the first k+1 ids of every coordinate.

    Coordinates are searched, each by its smallest id. The answer of one is a
    list of at most k+1 ids from the coordinates found, and its copies leave out
    themselves in that list, so no list is ranked again for every copy.
    """
    spot = ["cloud_id", "x", "y", "z"]
    need = k + 1 if skip else k
    spots = cut(kept.groupBy(*spot).agg(F.min("point_id").alias("point_id"), F.array_sort(F.collect_list("point_id")).alias("ids")), "spots")
    near = self_search(spots.drop("ids"), need, False)
    held = spots.select("cloud_id", F.col("point_id").alias("dst"), F.explode("ids").alias("id"))
    entry = F.struct("d2", "id", "dx", "dy", "dz")
    lists = near.join(held, ["cloud_id", "dst"]).groupBy("cloud_id", "src").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, need).alias("near"))
    lists = spots.select(*spot, F.col("point_id").alias("src")).join(lists, ["cloud_id", "src"]).drop("src")
    found = base.select(*spot, F.col("point_id").alias("src")).join(cut(lists, "lists"), spot)
    answers = F.slice(F.filter("near", lambda e: e["id"] != F.col("src")), 1, k) if skip else F.col("near")
    found = found.select("cloud_id", "src", F.posexplode(answers).alias("place", "e"))
    more = {c: F.lit(None).cast("boolean") if c == "back" else F.col(f"e.{c}") for c in extra}
    return found.select(
        "cloud_id", "src", F.col("e.id").alias("dst"), F.sqrt("e.d2").alias("dist"), (F.col("place") + 1).alias("rank"), *[c.alias(n) for n, c in more.items()]
    )


def radius_cap(knn: DataFrame, factor: float) -> DataFrame:
    """Keep neighbours closer than ``factor`` times the mean positive neighbour distance of the cloud."""
    mean = knn.where(F.col("dist") > 0).groupBy("cloud_id").agg(F.avg("dist").alias("mean_dist"))
    return (
        knn.join(mean, "cloud_id")
        .where((F.col("dist") <= F.col("mean_dist") * factor) & (F.col("dist") > 0))
        .drop("mean_dist")
    )


def mutual(directed: DataFrame) -> DataFrame:
    """Edges present in both directions, stored in both directions."""
    back = directed.select(
        "cloud_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("seen")
    )
    return directed.join(back, ["cloud_id", "src", "dst"]).select("cloud_id", "src", "dst", "dist")


#: sums of the offsets to the nearest neighbours and of their products, as :func:`pointweave.operators.surface.scatter_aggs` names them
MOMENTS = "cloud_id string, point_id long, n long, " + ", ".join(f"s{c} double" for c in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz"))


def knn_moments(points: DataFrame, k: int) -> DataFrame | None:
    """Count, sums and second moments of the offsets to every point's k nearest, summed where they are found.

    None where ids repeat or copies crowd a coordinate: then only the listed neighbours tell.
    """
    base = points.select("cloud_id", "point_id", "x", "y", "z")
    if ids_repeat(base) or copies_crowd(base, k):
        return None

    def sums(ids: np.ndarray, row: np.ndarray, found: np.ndarray, d2: np.ndarray, way: np.ndarray, back: np.ndarray, inside: np.ndarray) -> list[pa.Array]:
        n = np.bincount(row, minlength=len(ids))
        some = n > 0
        terms = [*(way[:, a] for a in range(3)), *(way[:, a] * way[:, b] for a in range(3) for b in range(a, 3))]
        return [pa.array(ids[some]), pa.array(n[some]), *[pa.array(np.bincount(row, t, minlength=len(ids))[some]) for t in terms]]

    return self_search(base, k, True, digest=sums, schema=MOMENTS)


def _mutual_pairs(points: DataFrame, k: int, way: Sequence[str]) -> DataFrame:
    """What a block knows of mutual pairs (cloud_id, src, dst, dist, back, dx, dy, dz), longer than 0, by the search itself.

    A pair inside a block comes once, with src below dst and ``back`` true, if it
    is mutual; an answer in another block comes with ``back`` null. A row without
    ``src`` holds the number (dst) and the sum (dist) of all the block's positive distances.
    """
    ways = ["dx", "dy", "dz"] if way else []

    def pairs(ids: np.ndarray, row: np.ndarray, found: np.ndarray, d2: np.ndarray, way: np.ndarray, back: np.ndarray, inside: np.ndarray) -> list[pa.Array]:
        dist, src = np.sqrt(d2), ids[row]
        apart = dist > 0
        keep = apart & (~inside | (back & (src < found)))
        rows = [pa.array(np.append(v[keep], last)) for v, last in ((src, 0), (found, apart.sum()), (dist, dist[apart].sum()))]
        none = np.append(np.zeros(keep.sum(), dtype=bool), True)
        rows[0] = pa.array(np.append(src[keep], 0), mask=none)
        known = pa.array(np.append(back[keep], False), mask=np.append(~inside[keep], True))
        return [*rows, known, *[pa.array(np.append(way[keep, a], 0.0)) for a in range(len(ways))]]

    schema = "cloud_id string, src long, dst long, dist double, back boolean" + "".join(f", {c} double" for c in ways)
    return self_search(points.select("cloud_id", "point_id", "x", "y", "z"), k, True, digest=pairs, schema=schema)


def mutual_knn(points: DataFrame, k: int = 16, cap_factor: float = 2.5, way: Sequence[str] = ()) -> DataFrame:
    """Edges between points that are among each other's k nearest, stored in both directions.

    ``way`` may ask for dx, dy, dz, the way along the edge; see :func:`knn_join`.
    The search knows of most pairs whether they are mutual, as both ends lie in
    one block; only the others are brought together.
    """
    if ids_repeat(points):
        return mutual(radius_cap(cut(knn_join(points, k, repeated=True), "knn"), cap_factor))
    if copies_crowd(points, k):
        near = radius_cap(cut(knn_join(points, k, extra=[*way, "back"], repeated=False).drop("rank"), "knn"), cap_factor)
    else:
        found = cut(_mutual_pairs(points, k, way), "knn")
        mean = found.where("src is null").groupBy("cloud_id").agg((F.sum("dist") / F.sum("dst")).alias("mean_dist"))
        near = found.where("src is not null").join(mean, "cloud_id").where(F.col("dist") <= F.col("mean_dist") * cap_factor).drop("mean_dist")
    forward = F.col("src") < F.col("dst")
    turned = [F.when(forward, F.col(c)).otherwise(-F.col(c)).alias(c) for c in way]
    pairs = near.where(F.col("back").isNull()).select("cloud_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), "dist", *turned)
    met = pairs.groupBy("cloud_id", "low", "high").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("dist", *way)]).where("n = 2")
    # a pair inside a block is here once, or in both directions where answers were listed
    known = near.where("back").where(forward).select("cloud_id", F.col("src").alias("low"), F.col("dst").alias("high"), "dist", *way)
    both = known.unionByName(met.select("cloud_id", "low", "high", "dist", *way))
    ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *[v(F.col(c)).alias(c) for c in way]) for a, b, v in (("low", "high", lambda c: c), ("high", "low", lambda c: 0.0 - c))]
    return both.select("cloud_id", "dist", F.explode(F.array(*ends)).alias("e")).select("cloud_id", "e.src", "e.dst", "dist", *[f"e.{c}" for c in way])


def mutual_from_knn(knn: DataFrame, k: int, cap_factor: float) -> DataFrame:
    """Same graph from a wider neighbour table that is already there."""
    return mutual(radius_cap(knn.where(F.col("rank") <= k), cap_factor))


def radius_join(points: DataFrame, radius: float, inner: float | None = None, include_self: bool = True) -> DataFrame:
    """All pairs with ``inner < dist <= radius`` (cloud_id, src, dst, d2).

    Cells as wide as the ball: each query meets at most two per axis. The output
    is the neighbourhood list itself; where only an aggregate over the ball is
    wanted use :func:`pointweave.operators.balls.ball_sums`, which never
    lists pairs.
    """
    side = 2.0 * radius
    grid = [F.floor(F.col(a) / side).alias("c" + a) for a in "xyz"]
    targets = points.select("cloud_id", F.col("point_id").alias("dst"), "x", "y", "z", *grid)
    asks = points.select("cloud_id", F.col("point_id").alias("src"), *[F.col(a).alias("q" + a) for a in "xyz"])
    pad = radius * (1 + 1e-9)
    for a in "xyz":
        low, high = F.floor((F.col("q" + a) - pad) / side), F.floor((F.col("q" + a) + pad) / side)
        asks = asks.withColumn("c" + a, F.explode(F.sequence(low, high)))
    d2 = sq_dist(F.col("x"), F.col("y"), F.col("z"), F.col("qx"), F.col("qy"), F.col("qz"))
    pairs = asks.join(targets, ["cloud_id", "cx", "cy", "cz"]).withColumn("d2", d2)
    keep = F.sqrt("d2") <= radius
    if inner is not None:
        keep = keep & (F.sqrt("d2") > inner)
    if not include_self:
        keep = keep & (F.col("src") != F.col("dst"))
    return pairs.where(keep).select("cloud_id", "src", "dst", "d2")


def nearest_within(points: DataFrame, queries: DataFrame, tolerance: float | DataFrame) -> DataFrame:
    """Nearest point of every query, kept when it is within the tolerance (a number or a per-cloud table)."""
    if isinstance(tolerance, DataFrame):
        one = knn_join(points, 1, queries=queries, skip_same_id=False)
        one = one.join(tolerance, "cloud_id").where(F.col("dist") <= F.col("tolerance"))
        return one.select("cloud_id", "src", "dst", "dist")
    # points and queries lie in the same blocks and none looks farther than it may; a place answers by its first id (null: the first of all)
    lost = F.lit(np.iinfo(np.int64).min)
    asks = queries.select("cloud_id", F.coalesce("point_id", lost).alias("point_id"), "x", "y", "z")
    spots = points.groupBy("cloud_id", "x", "y", "z").agg(F.min(F.coalesce("point_id", lost)).alias("point_id"))
    found = self_search(spots, 1, False, queries=asks, reach=float(tolerance) * (1 + 1e-9), digest=_one_answer, schema="cloud_id string, src long, dst long, d2 double")
    # an id that several queries share has one answer
    one = found.groupBy("cloud_id", "src").agg(F.min(F.struct("d2", "dst")).alias("e")).select("cloud_id", "src", "e.dst", F.sqrt("e.d2").alias("dist"))
    return one.where(F.col("dist") <= tolerance).select("cloud_id", F.nullif("src", lost).alias("src"), F.nullif("dst", lost).alias("dst"), "dist")


def _one_answer(ids: np.ndarray, row: np.ndarray, found: np.ndarray, d2: np.ndarray, way: np.ndarray, back: np.ndarray, inside: np.ndarray) -> list[pa.Array]:
    return [pa.array(ids[row]), pa.array(found), pa.array(d2)]


def degrees(points: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.groupBy("cloud_id", F.col("src").alias("point_id")).agg(
        F.count(F.lit(1)).alias("degree"), F.avg("dist").alias("mean_dist")
    )
    return points.select("cloud_id", "point_id").join(d, ["cloud_id", "point_id"], "left").select(
        "cloud_id", "point_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), "mean_dist"
    )


def seed_graph(points: DataFrame, seeds: DataFrame, k: int = 8, scale_k: int = 6, factor: float = 1.6) -> DataFrame:
    """Edges among seeds: mutual within the k nearest of all points, no longer than
    ``factor`` times the geometric mean of the two local scales (median of the
    first ``scale_k`` positive distances)."""
    seeds = seeds.select("cloud_id", "point_id")
    if not ids_repeat(points):
        return _seed_edges(knn_join(points, max(k, scale_k), repeated=False), seeds, k, scale_k, factor)
    ask = points.join(seeds, ["cloud_id", "point_id"], "left_semi")
    wide = cut(knn_join(points, max(k, scale_k), queries=ask, skip_same_id=True), "seedknn")
    nth = F.row_number().over(Window.partitionBy("cloud_id", "src").orderBy("rank"))
    scale = wide.where(F.col("dist") > 0).withColumn("nth", nth).where(F.col("nth") <= scale_k)
    scale = scale.groupBy("cloud_id", "src").agg(F.percentile("dist", F.lit(0.5)).alias("scale"))
    both = mutual(wide.where(F.col("rank") <= k).drop("rank"))
    both = both.join(scale.withColumnRenamed("scale", "s0"), ["cloud_id", "src"])
    both = both.join(scale.withColumnsRenamed({"src": "dst", "scale": "s1"}), ["cloud_id", "dst"])
    pair = F.sqrt(F.col("s0") * F.col("s1"))
    keep = (pair > 0) & (F.col("dist") <= pair * factor)
    return both.where(keep).select("cloud_id", "src", "dst", "dist")


def _seed_edges(near: DataFrame, seeds: DataFrame, k: int, scale_k: int, factor: float) -> DataFrame:
    """The edges of :func:`seed_graph` by two groupings and no join, so nothing of the seeds' size is broadcast.

    A point's neighbours and its mark as a seed meet in one row, which has its
    scale; every neighbour brings the scale to its pair, where both ends meet.
    """
    entry = F.struct("rank", "dst", "dist")
    none = F.lit(None).cast(near.select(entry.alias("e")).schema["e"].dataType)
    rows = near.select("cloud_id", "src", entry.alias("e"), F.lit(False).alias("seed"))
    rows = rows.unionByName(seeds.select("cloud_id", F.col("point_id").alias("src"), none.alias("e"), F.lit(True).alias("seed")))
    # one list of at most max(k, scale_k) neighbours a point
    lists = rows.groupBy("cloud_id", "src").agg(F.max("seed").alias("seed"), F.array_sort(F.collect_list("e")).alias("near")).where("seed")
    first = F.array_sort(F.slice(F.transform(F.filter("near", lambda e: e["dist"] > 0), lambda e: e["dist"]), 1, scale_k))
    n = F.size("first")
    middle = (F.get("first", F.floor((n - 1) / 2).cast("int")) + F.get("first", F.floor(n / 2).cast("int"))) / 2
    lists = lists.withColumn("first", first).select("cloud_id", "src", F.when(n > 0, middle).alias("scale"), F.explode("near").alias("e"))
    lists = lists.where(F.col("e.rank") <= k).select("cloud_id", "src", F.col("e.dst").alias("dst"), F.col("e.dist").alias("dist"), "scale")
    ends = lists.groupBy("cloud_id", F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    met = ends.agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("dist"), F.min("scale").alias("s0"), F.max("scale").alias("s1"), F.count("scale").alias("scales"))
    pair = F.sqrt(F.col("s0") * F.col("s1"))
    kept = met.where((F.col("n") == 2) & (F.col("scales") == 2) & (pair > 0) & (F.col("dist") <= pair * factor))
    both = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("low", "high"), ("high", "low"))])
    return kept.select("cloud_id", F.explode(both).alias("e"), "dist").select("cloud_id", "e.src", "e.dst", "dist")


#: rows of the sample whose planes cut the feature space, at most
PIVOTS = 4096


def baseline_distance(rows: DataFrame, baseline: DataFrame, values: list[str]) -> DataFrame:
    """Squared distance of every row to its nearest baseline row, all features z-scored by the baseline.

    Exact in any number of dimensions: equal baseline rows count once, the search goes by
    blocks of the feature space (see :func:`pointweave.operators.featureblocks.nearest_sq`).
    A row that lacks a feature has no distance and is left out.
    """
    stats = baseline.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias("m_" + v) for v in values], *[F.stddev_pop(v).alias("s_" + v) for v in values]
    ).first()  # one row of 2 * len(values) + 1 numbers

    def scaled(df):
        axes = []
        for v in values:
            std = stats["s_" + v]
            std = 1.0 if std is None or std < 1e-12 else std
            axes.append(((F.col(v) - F.lit(stats["m_" + v])) / F.lit(std)).cast("double"))
        return df.select("cloud_id", "point_id", F.array(*axes).alias("f"))

    def finite(f):
        return F.forall(f, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))

    whole = F.forall("f", lambda x: x.isNotNull())
    base = cut(scaled(baseline).where(whole & finite("f")).select("f").distinct(), "baseline")
    asks = scaled(rows).where(whole)
    chosen = base.orderBy(F.xxhash64("f")).limit(min(PIVOTS, max(1, int((stats["n"] or 0) ** 0.5)))).collect()  # at most PIVOTS rows
    # a feature that is not a number or not finite leaves no nearest row
    score = F.when(F.exists("f", lambda x: F.isnan(x)), float("nan")).otherwise(float("inf")).alias("score")
    lost = asks.where(~finite("f")).select("cloud_id", "point_id", score)
    if not chosen:
        return lost
    box = base.agg(*[f(F.get("f", F.lit(k))).alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in range(len(values))]).first()
    low, high = (np.array([box[f"{n}{k}"] for k in range(len(values))]) for n in ("low", "high"))
    numbered = asks.where(finite("f")).select(F.monotonically_increasing_id().alias("id"), "f", "cloud_id", "point_id")
    found = nearest_sq(base, numbered, np.array([r.f for r in chosen]), low, high)
    return found.select("cloud_id", "point_id", "score").unionByName(lost)
