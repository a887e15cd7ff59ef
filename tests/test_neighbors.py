import numpy as np
from helpers import brute_knn, cloud
from pyspark.sql import functions as F

from pointweave.operators import balls, blocksearch, graph, neighbors as NB, surface
from pointweave.session import cut


def got(df):
    pdf = df.toPandas().sort_values(["src", "rank"])
    return pdf.groupby("src")["dst"].apply(list).to_dict()


def test_knn_with_a_hot_coordinate_and_a_dense_spot(spark):
    rng = np.random.default_rng(0)
    xyz = np.concatenate([np.zeros((150, 3)), rng.normal(size=(150, 3)), 5 + 1e-7 * rng.normal(size=(150, 3)), [[400.0, 0, 0]]])
    rng.shuffle(xyz)
    want = brute_knn(xyz, 5)
    have = got(NB.knn_join(cloud(spark, xyz), 5))
    assert all(have[i] == want[i] for i in range(len(xyz)))


def test_knn_small_clouds(spark):
    assert NB.knn_join(cloud(spark, [[0, 0, 0]]), 3).count() == 0
    assert got(NB.knn_join(cloud(spark, [[0, 0, 0], [1, 0, 0], [3, 0, 0]]), 5)) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_queries_outside_the_cloud(spark):
    rng = np.random.default_rng(1)
    base, ask = rng.normal(size=(300, 3)), rng.normal(size=(40, 3)) * 20
    have = got(NB.knn_join(cloud(spark, base), 2, queries=cloud(spark, ask), skip_same_id=False))
    d2 = ((ask[:, None] - base[None]) ** 2).sum(-1)
    assert all(have[i] == np.argsort(d2[i], kind="stable")[:2].tolist() for i in range(40))


def test_mutual_graph_is_symmetric_and_without_zero_edges(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.normal(size=(100, 3)), np.zeros((5, 3))])
    e = NB.mutual_knn(cloud(spark, xyz), 8).toPandas()
    pairs = set(zip(e.src, e.dst))
    assert pairs and all((b, a) in pairs for a, b in pairs) and (e.dist > 0).all()


def test_ball_sums_open_dense_cells(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(size=(400, 3)) * 0.01, rng.normal(size=(200, 3)), np.zeros((60, 3))])
    v = rng.normal(size=len(xyz))
    df = cloud(spark, xyz).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "point_id long, v double"), "point_id")
    sums = df.join(balls.ball_sums(df, ["v"], [0.02, 0.5], cap=16), ["cloud_id", "x", "y", "z"]).toPandas()
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    for r in (0.02, 0.5):
        part = sums[sums.radius == r].sort_values("point_id")
        inside = d2 <= r * r
        assert (part.weight.to_numpy() == inside.sum(1)).all()
        assert np.allclose(part.sum_v.to_numpy(), inside @ v)


def test_radius_join_counts(spark):
    rng = np.random.default_rng(4)
    xyz = rng.normal(size=(200, 3))
    n = NB.radius_join(cloud(spark, xyz), 0.7).groupBy("src").agg(F.count("*").alias("n")).toPandas().sort_values("src").n
    assert (n.to_numpy() == ((((xyz[:, None] - xyz[None]) ** 2).sum(-1)) <= 0.49).sum(1)).all()


def test_search_over_many_blocks_equals_brute_force(spark):
    """Dense spots, an outlier, a flat cloud and a tiny one together; ties by id."""
    rng = np.random.default_rng(5)
    clouds = {
        "dense": np.concatenate([rng.normal(size=(250, 3)) * 1e-4, rng.normal(size=(150, 3)), [[500.0, 0, 0]]]),
        "grid": np.array([[i % 15, i // 15, 0.0] for i in range(225)]),
        "tiny": rng.normal(size=(3, 3)),
    }
    df = None
    for name, xyz in clouds.items():
        one = cloud(spark, xyz, name, rng.permutation(len(xyz)))
        df = one if df is None else df.unionByName(one)
    found = blocksearch.self_search(cut(df), 6, True, block_points=40).toPandas().sort_values(["cloud_id", "src", "rank"])
    for name, part in df.toPandas().groupby("cloud_id"):
        part = part.sort_values("point_id")
        want = brute_knn(part[["x", "y", "z"]].to_numpy(), 6)
        have = found[found.cloud_id == name].groupby("src")["dst"].apply(list).to_dict()
        assert all(have[i] == want[i][: len(part) - 1] for i in range(len(part)))
    blocks = blocksearch.space_blocks(df, 40).toPandas()
    assert blocks.groupby("cloud_id").size().to_dict() == {"dense": 11, "grid": 6, "tiny": 1}


def test_search_brings_the_way_and_what_is_mutual(spark):
    """Over many blocks; without blocks of its own a neighbour leaves ``back`` open."""
    rng = np.random.default_rng(9)
    xyz = np.round(rng.normal(size=(300, 3)), 2)
    found = blocksearch.self_search(cut(cloud(spark, xyz)), 5, True, block_points=40).toPandas()
    way = xyz[found.dst] - xyz[found.src]
    assert (found[["dx", "dy", "dz"]].to_numpy() == way).all()
    pairs = set(zip(found.src, found.dst))
    known = found[found.back.notna()]
    assert 0 < len(known) < len(found)
    assert all(back == ((dst, src) in pairs) for src, dst, back in zip(known.src, known.dst, known.back))


def test_mutual_edges_of_repeated_places_and_ids(spark):
    """Copies are searched once, edges and their ways equal brute force; an id that repeats takes the general way."""
    rng = np.random.default_rng(10)
    xyz = rng.integers(0, 4, size=(260, 3)).astype(float)
    want = brute_knn(xyz, 3)
    d = [{j: ((xyz[i] - xyz[j]) ** 2).sum() ** 0.5 for j in want[i]} for i in range(len(xyz))]
    assert got(NB.knn_join(cloud(spark, xyz), 3)) == dict(enumerate(want))
    distances = [v for row in d for v in row.values() if v > 0]
    cap = 1.2 * sum(distances) / len(distances) if distances else 0
    edges = NB.mutual_knn(cloud(spark, xyz), 3, 1.2, ["dx", "dy", "dz"]).toPandas()
    assert set(zip(edges.src, edges.dst)) == {(i, j) for i in range(len(xyz)) for j in want[i] if i in want[j] and 0 < d[i][j] <= cap}
    assert (edges[["dx", "dy", "dz"]].to_numpy() == xyz[edges.dst] - xyz[edges.src]).all()
    line = cloud(spark, [[0, 0, 0], [1, 0, 0], [3, 0, 0]])
    twice = NB.mutual_knn(line.unionByName(line.where("point_id < 2")), 2, 9.0).toPandas()
    assert {(0, 1), (1, 0)} <= set(zip(twice.src, twice.dst))


def test_points_without_a_coordinate_ask_for_nothing(spark):
    """Their runs look no farther than the other points' balls, and these find all their neighbours over many blocks."""
    rng = np.random.default_rng(12)
    xyz = rng.random((300, 3))
    xyz[::20, 2] = np.nan
    low, high = blocksearch._boxes(xyz, np.where(np.isfinite(xyz[:, 2]), 0.01, np.inf), 1.0)
    assert (high - low).max() < 1.3
    df = cut(cloud(spark, xyz).withColumn("z", F.nanvl("z", F.lit(None).cast("double"))))
    have = got(blocksearch.self_search(df, 4, True, block_points=40))
    whole = np.flatnonzero(np.isfinite(xyz[:, 2]))
    want = brute_knn(xyz[whole], 4)
    assert have == {int(whole[i]): [int(whole[j]) for j in want[i]] for i in range(len(whole))}


def test_balls_over_many_blocks_equal_brute_force_and_no_pair_is_formed(spark, monkeypatch):
    """Sums, contrasts and ring medians by blocks; lists of pairs and the walk down the cells are not needed."""
    rng = np.random.default_rng(13)
    xyz = np.concatenate([rng.random((500, 3)) * [10, 2, 5], rng.normal(size=(200, 3)) * 0.01, [[300.0, 0, 0]]])
    v = np.round(rng.normal(size=len(xyz)), 1)
    df = cut(cloud(spark, xyz).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "point_id long, v double"), "point_id"))
    monkeypatch.setattr(balls, "radius_join", None)
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    sums = df.join(balls.ball_sums(df, ["v"], [0.5, 3.0], cap=50), ["cloud_id", "x", "y", "z"]).toPandas().sort_values(["radius", "point_id"])
    assert len(sums) == 2 * len(xyz)
    for r, part in sums.groupby("radius"):
        assert (part.weight.to_numpy() == (d2 <= r * r).sum(1)).all() and np.allclose(part.sum_v, (d2 <= r * r) @ v)
    got_z = balls.local_robust_z(df, "v", 0.4, 2.0, 4, "out", cap=50).toPandas().sort_values("point_id").out.to_numpy()
    d = np.sqrt(d2)
    for i in range(len(xyz)):
        ring = v[(d[i] > 0.4) & (d[i] <= 2.0)]
        med = np.median(ring) if len(ring) else 0
        want = (v[i] - med) / (np.median(np.abs(ring - med)) * 1.4826 + 1e-12) if len(ring) >= 4 else 0.0
        assert np.isclose(got_z[i], want), i


def test_seed_graph_joins_nothing_of_the_seeds_size(spark):
    """Equal to brute force; its plan holds no join after the search, so no table of seeds or scales can be broadcast."""
    rng = np.random.default_rng(14)
    xyz = np.concatenate([rng.normal(size=(150, 3)), np.zeros((3, 3))])
    df, seeds = cloud(spark, xyz), np.flatnonzero(rng.random(len(xyz)) < 0.5)
    mask = cut(df.where(F.col("point_id").isin([int(i) for i in seeds])))
    near = cut(NB.knn_join(df, 8, repeated=False))
    plan = NB._seed_edges(near, mask, 8, 6, 1.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    have = NB.seed_graph(df, mask).toPandas()
    want, d = brute_knn(xyz, 8), np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    scale = {i: np.median([d[i, j] for j in want[i] if d[i, j] > 0][:6]) for i in seeds}
    pairs = {(i, j) for i in seeds for j in want[i] if j in scale and i in want[j] and d[i, j] <= 1.6 * np.sqrt(scale[i] * scale[j])}
    assert set(zip(have.src, have.dst)) == pairs and len(have) == len(pairs)
    assert np.allclose(have.dist, d[have.src, have.dst])


def test_nearest_within_goes_through_the_blocks(spark, monkeypatch):
    """Equal to brute force with shared ids, copies, ties, a null id and a missing coordinate; the cell walk is not needed."""
    monkeypatch.setattr(NB, "_search", None)
    rng = np.random.default_rng(15)
    base, ask = rng.integers(0, 6, size=(300, 3)).astype(float), rng.random((200, 3)) * 8
    points = cloud(spark, base).withColumn("point_id", F.expr("nullif(point_id, 7)"))
    asks = cloud(spark, ask, ids=np.arange(200) // 2).withColumn("z", F.expr("if(x < 0.5, null, z)"))
    have = {r.src: (r.dst, r.dist) for r in NB.nearest_within(points, asks, 1.0).collect()}
    d = np.sqrt(((ask[:, None] - base[None]) ** 2).sum(-1))
    d[ask[:, 0] < 0.5] = np.inf
    order = np.array([-1 if i == 7 else i for i in range(300)])
    for src in range(100):
        rows = d[2 * src : 2 * src + 2]
        if rows.min() > 1.0:
            assert src not in have
            continue
        dist = rows.min()
        best = order[np.flatnonzero((rows == dist).any(axis=0))].min()
        assert have[src] == (None if best < 0 else best, dist)


def test_search_sums_moments_where_neighbours_are_found(spark):
    """The same sums as from listed neighbours, over many blocks too; none where ids repeat or copies crowd a place."""
    rng = np.random.default_rng(16)
    df = cut(cloud(spark, rng.normal(size=(300, 3))))
    names = ["n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
    want = surface.moments_of(df, NB.knn_join(df, 6)).toPandas().sort_values("point_id")
    have = NB.knn_moments(df, 6).toPandas().sort_values("point_id")
    assert np.allclose(have[["point_id", *names]].to_numpy(float), want[["point_id", *names]].to_numpy(float))
    assert NB.knn_moments(df.unionByName(df.where("point_id < 2")), 6) is None
    assert NB.knn_moments(cloud(spark, np.zeros((9, 3))), 6) is None


def test_mutual_pairs_leave_a_block_once(spark):
    """No directed neighbour lists are written: pairs inside a block come once, and only if they are mutual."""
    rng = np.random.default_rng(17)
    xyz = rng.normal(size=(200, 3))
    rows = NB._mutual_pairs(cloud(spark, xyz), 5, []).toPandas()
    pairs = rows[rows.src.notna()]
    want = brute_knn(xyz, 5)
    assert set(zip(pairs.src, pairs.dst)) == {(i, j) for i in range(200) for j in want[i] if i < j and i in want[j]} and len(rows) == len(pairs) + 1
    assert rows[rows.src.isna()].dst.item() == 1000


def test_open_boundary_and_adjacency_read_an_edge_once(spark):
    """The edges of a point meet in one grouping, and an undirected edge is asked for its two components once."""
    rng = np.random.default_rng(18)
    df = cut(cloud(spark, rng.normal(size=(60, 3))))
    edges = cut(NB.mutual_knn(df, 5, way=["dx", "dy", "dz"]))
    names = cut(df.select("cloud_id", "point_id", (F.col("point_id") % 4).alias("component")))
    plan = graph.adjacent_components(names, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "(src" in plan and "<= dst" in plan
    have = {(r.a, r.b) for r in graph.adjacent_components(names, edges).collect()}
    assert have == {(r.src % 4, r.dst % 4) for r in edges.collect() if r.src % 4 < r.dst % 4}
    plan = surface.open_boundary(df, edges, 110.0, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
