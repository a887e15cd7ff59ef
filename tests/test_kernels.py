import numpy as np
import pandas as pd
import pytest
from helpers import brute_knn, cloud, points
from pyspark.sql import functions as F

from pointweave.operators import neighbors as NB, normalize as N, restore as R, sampling, spectral, surface
from pointweave.functions.order_stats import percentiles
from pointweave.plans import baselines
from pointweave.session import cut


def sequential_fps(x, k, seed=0):
    picks = [int(np.random.default_rng(seed).integers(0, len(x)))]
    far = ((x - x[picks[0]]) ** 2).sum(1)
    while len(picks) < k:
        picks.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[picks[-1]]) ** 2).sum(1))
    return picks


def test_fps_equals_the_sequential_rule(spark):
    x = np.random.default_rng(1).normal(size=(1500, 3)) * [3, 2, 1]
    out = sampling.farthest_points(cloud(spark, x), 200).toPandas().sort_values("sample_rank")
    assert out.point_id.tolist() == sequential_fps(x, 200)


def test_fps_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(sampling, "OFFER_ROWS", 100)
    x = np.random.default_rng(2).normal(size=(900, 3))
    out = sampling.farthest_points(cloud(spark, x), 60).toPandas().sort_values("sample_rank")
    assert out.point_id.tolist() == sequential_fps(x, 60)


def test_fps_returns_small_clouds_whole(spark):
    out = sampling.farthest_points(cloud(spark, np.eye(3)), 10).toPandas()
    assert sorted(out.point_id) == [0, 1, 2]


def test_quantiles_agree_on_both_ways(spark):
    v = np.random.default_rng(3).normal(size=501).round(1)
    df = points(spark, range(501), v=v)
    for bound in (None, 1000):
        r = percentiles(df, ["cloud_id"], "v", [0.0, 0.01, 0.5, 0.993, 1.0], list("abcde"), bound).first()
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], np.quantile(v, [0.0, 0.01, 0.5, 0.993, 1.0]))


def grid(n, seed=0, jitter=0.05):
    rng = np.random.default_rng(seed)
    g = np.stack(np.meshgrid(np.arange(n), np.arange(n)), -1).reshape(-1, 2) + rng.normal(0, jitter, (n * n, 2))
    return np.column_stack([g, np.zeros(n * n)])


def test_surface_variation_and_normals_match_numpy(spark):
    x = np.random.default_rng(4).normal(size=(200, 3)) * [2, 1, 0.3]
    p = cloud(spark, x)
    knn = cut(NB.knn_join(p, 12))
    nb = brute_knn(x, 12)
    want, normal = [], []
    for i in range(200):
        best = 0
        for k in (6, 12):
            w = np.linalg.eigvalsh(np.cov(x[nb[i][:k]].T))
            best = max(best, w[0] / (w.sum() + 1e-8))
        want.append(best)
        normal.append(np.linalg.eigh(np.cov(x[nb[i]].T))[1][:, 0])
    sv = surface.surface_variation(p, knn, (6, 12)).toPandas().sort_values("point_id").sv
    assert np.allclose(sv, want, atol=1e-9)
    f = surface.pca_features(p, knn).toPandas().sort_values("point_id")
    dots = np.abs((f[["nx", "ny", "nz"]].to_numpy() * np.array(normal)).sum(1))
    assert np.allclose(dots, 1.0, atol=1e-6)


def test_boundary_of_a_flat_grid_is_its_rim(spark):
    p = cloud(spark, grid(15, jitter=0.01))
    e = cut(NB.mutual_knn(p, 8))
    b = surface.open_boundary(p, e, 110.0, 4).where("boundary").toPandas().point_id.to_numpy()
    rim = {i for i in range(225) if i // 15 in (0, 14) or i % 15 in (0, 14)}
    assert set(b) <= rim and len(b) > 0.8 * len(rim)


def test_heat_signatures_match_dense_numpy(spark):
    x = np.random.default_rng(6).normal(size=(120, 3))
    p = cloud(spark, x)
    lap = cut(surface.normalized_laplacian(p, surface.gaussian_weights(cut(NB.mutual_knn(p, 8)))))
    rows = lap.toPandas()
    m = np.zeros((120, 120))
    np.add.at(m, (rows.src, rows.dst), rows.value)
    assert np.allclose(m, m.T)
    lam, phi = np.linalg.eigh(m)
    lam, phi = np.clip(lam[:40], 0, 2), phi[:, :40]
    span = 4 * np.log(10)
    t = np.logspace(np.log10(span / lam.max()), np.log10(span / lam[lam > 1e-6][0]), 3)
    h = spectral.heat_signatures(spectral.smallest_eigenpairs(lap, 40)).toPandas().sort_values("point_id")
    for i in range(3):
        assert np.allclose(h[f"hks{i}"], (phi**2) @ np.exp(-lam * t[i]), atol=1e-8)


def _random_laplacian(spark, n, name="a", seed=7, share=0.97):
    rng = np.random.default_rng(seed)
    a = np.triu((rng.random((n, n)) > share).astype(float), 1)
    a[np.arange(n - 1), np.arange(1, n)] = 1
    a = a + a.T
    d = a.sum(1)
    m = np.eye(n) - a / np.sqrt(np.outer(d, d))
    s, t = np.nonzero(m)
    return m, spark.createDataFrame(pd.DataFrame({"cloud_id": name, "src": s, "dst": t, "value": m[s, t]}))


@pytest.mark.parametrize("block_rows", [37, 4096])
def test_filtered_subspace_matches_eigh(spark, block_rows):
    big, a = _random_laplacian(spark, 300)
    tiny, b = _random_laplacian(spark, 5, "tiny", share=0.5)
    got = spectral.smallest_eigenpairs(a.unionByName(b), 20, block_rows=block_rows).toPandas().sort_values("point_id")
    for name, m, k in (("a", big, 20), ("tiny", tiny, 4)):
        rows = got[got.cloud_id == name]
        values, vectors = np.array(rows.lambdas.iloc[0]), np.vstack(rows.phi)
        assert len(rows) == len(m) and np.allclose(values, np.linalg.eigvalsh(m)[:k], atol=1e-8)
        assert np.abs(m @ vectors - vectors * values).max() < 1e-6 and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-8)


def test_eigenpairs_of_one_large_cloud(spark):
    """50,000 points in four parts that nothing connects, spread over 13 blocks: the value 0 four times, then a gap."""
    n, part = 50_000, 12_500
    rng = np.random.default_rng(1)
    at = np.arange(n)
    pairs = np.concatenate([np.column_stack([at, at // part * part + rng.permutation(part)[at % part]]) for _ in range(6)])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    degree = np.bincount(pairs[:, 0], minlength=n)
    off = -1 / np.sqrt(degree[pairs[:, 0]] * degree[pairs[:, 1]])
    rows = pd.DataFrame({"cloud_id": "a", "src": np.append(pairs[:, 0], at), "dst": np.append(pairs[:, 1], at), "value": np.append(off, np.ones(n))})
    got = spectral.smallest_eigenpairs(cut(spark.createDataFrame(rows)), 4).toPandas().sort_values("point_id")
    assert len(got) == n and np.allclose(got.lambdas.iloc[0], 0, atol=1e-9)
    vectors = np.vstack(got.phi)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8)
    # vectors of the value 0 are the roots of the degrees times one number for each part
    shares = vectors / np.sqrt(degree)[:, None]
    assert all(np.ptp(shares[k : k + part], axis=0).max() < 1e-7 for k in range(0, n, part))


def test_restoring_a_flat_patch_moves_nothing_and_blocks_agree(spark):
    x = grid(12, jitter=0.0)
    x[66, 2] = 0.3
    p = cloud(spark, x)
    e = cut(NB.mutual_knn(p, 4, 1.2))
    hole = [i for i in range(144) if 4 <= i // 12 <= 7 and 4 <= i % 12 <= 7]
    unknown = points(spark, hole, component=[1] * len(hole))
    for mode in ("biharmonic", "laplacian"):
        r = R.restore_regions(p, e, unknown, mode).toPandas().sort_values("point_id")
        assert np.allclose(r.rz, 0.0, atol=1e-5) and len(r) == 16
        cg = R.restore_regions(p, e, unknown, mode, block_unknowns=9).toPandas().sort_values("point_id")
        assert np.allclose(cg[["rx", "ry", "rz"]], r[["rx", "ry", "rz"]], atol=1e-5)
    d = R.displacement_and_stress(p, cut(R.restore_regions(p, e, unknown)), e).toPandas().set_index("point_id").displacement
    assert abs(d[66] - 0.3) < 0.1 and d.drop(66).max() < 0.1


def test_iterative_solvers_raise_without_convergence(spark):
    n = 300
    i = np.arange(n - 1)
    d = np.full(n, 2.0)
    d[[0, -1]] = 1
    off = -1 / np.sqrt(d[:-1] * d[1:])
    s, t, v = np.concatenate([np.arange(n), i, i + 1]), np.concatenate([np.arange(n), i + 1, i]), np.concatenate([np.ones(n), off, off])
    lap = spark.createDataFrame(pd.DataFrame({"cloud_id": "a", "src": s, "dst": t, "value": v}))
    with pytest.raises(ArithmeticError):
        spectral.smallest_eigenpairs(lap, 20, rounds=1)
    # not definite: conjugate gradients have no step to take
    with pytest.raises(Exception, match="not positive definite"):
        _solve(spark, [(0, 0, 0.5), (1, 1, 0.5), (0, 1, 1.0), (1, 0, 1.0)], [(0, 1.0), (1, -2.0)])


def test_a_hub_of_many_points_has_eigenpairs(spark):
    n = 20_001  # a star: eigenvalues 0, 1, ..., 1, 2
    hub, leaf = np.zeros(n - 1, dtype=int), np.arange(1, n)
    off = np.full(n - 1, -1 / np.sqrt(n - 1))
    rows = {"cloud_id": "a", "src": np.concatenate([np.arange(n), hub, leaf]), "dst": np.concatenate([np.arange(n), leaf, hub]), "value": np.concatenate([np.ones(n), off, off])}
    got = spectral.smallest_eigenpairs(spark.createDataFrame(pd.DataFrame(rows)), 2)
    assert got.count() == n and np.allclose(got.first().lambdas, [0, 1], atol=1e-6)


def _solve(spark, entries, right, **how):
    """Solutions of one small system, all axes alike, in the order of the points."""
    entries = spark.createDataFrame([("a", 1, s, t, float(v)) for s, t, v in entries], "cloud_id string, component long, src long, dst long, value double")
    sides = spark.createDataFrame([("a", 1, p, *[float(v)] * 3) for p, v in right], "cloud_id string, component long, point_id long, v_x double, v_y double, v_z double")
    order = sides.select("cloud_id", "point_id", F.struct(F.col("point_id").alias("cell"), F.col("point_id").alias("id")).alias("at"))
    return R.solve_regions(entries, sides, order, **how).toPandas().sort_values("point_id").rx.to_numpy()


@pytest.mark.parametrize("block", [20, 1000])
def test_systems_of_many_blocks_equal_a_dense_solve(spark, block):
    rng = np.random.default_rng(4)
    n = 60
    a = np.where(rng.random((n, n)) < 0.1, rng.normal(size=(n, n)), 0.0)
    m, b = 0.1 * a.T @ a + np.eye(n), rng.normal(size=n)
    entries = [(i, j, m[i, j]) for i in range(n) for j in range(n) if m[i, j] or i == j]
    got = _solve(spark, entries, list(enumerate(b)), block_unknowns=block)
    assert np.allclose(got, np.linalg.solve(m, b), atol=1e-8)


def test_the_fallback_to_the_harmonic_form(spark):
    # a far neighbour without a position spoils the biharmonic rows only
    chain = [(r, c, 2.0 if r == c else -1.0) for r in range(1, 6) for c in (r - 1, r, r + 1)]
    pdf = pd.DataFrame(chain, columns=["r", "c", "value"])
    own = pdf.r.isin([2, 3])
    pdf = pdf.assign(cloud_id="a", component=1, unknown=pdf.c.isin([2, 3]), own=own, x=pdf.c.astype(float), y=0.0, z=1.0)
    pdf.loc[pdf.c.isin([5, 6]), ["x", "y", "z"]] = np.nan
    entries, right = R.region_systems(cut(spark.createDataFrame(pdf)), True, 1e-8)
    order = right.select("cloud_id", "point_id", F.struct(F.col("point_id").alias("cell"), F.col("point_id").alias("id")).alias("at"))
    got = R.solve_regions(entries, right, order).toPandas().sort_values("point_id")
    assert np.allclose(got.rx, [2, 3], atol=1e-6) and np.allclose(got.rz, 1, atol=1e-6)


def test_an_axis_without_places_is_lost_alone(spark):
    x = grid(6, jitter=0.0)
    x[0] = [0.0, 0.0, np.nan]
    p = cloud(spark, x)
    e = cut(NB.mutual_knn(cloud(spark, grid(6, jitter=0.0)), 4, 1.2))
    r = R.restore_regions(p, e, points(spark, [7, 8, 13], component=[1] * 3)).toPandas().sort_values("point_id")
    flat = R.restore_regions(cloud(spark, grid(6, jitter=0.0)), e, points(spark, [7, 8, 13], component=[1] * 3), "laplacian").toPandas().sort_values("point_id")
    assert np.allclose(r[["rx", "ry"]], flat[["rx", "ry"]], atol=1e-6)


def test_region_growing_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(8)
    n = 150
    x = rng.normal(size=(n, 3))
    near = brute_knn(x, 6)
    normals = rng.normal(size=(n, 3)) * [0.5, 0.5, 2]
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    curv = rng.random(n).round(2)
    cos, label = np.cos(np.radians(30)), np.full(n, -1)
    for s in np.argsort(curv, kind="stable"):
        if label[s] >= 0:
            continue
        label[s], queue = s, [s]
        while queue:
            q = queue.pop(0)
            for j in near[q]:
                if label[j] < 0 and abs(normals[q] @ normals[j]) >= cos:
                    label[j] = s
                    if curv[j] < 0.5:
                        queue.append(j)
    f = points(spark, range(n), nx=normals[:, 0], ny=normals[:, 1], nz=normals[:, 2], curvature=curv)
    nb = spark.createDataFrame([("a", i, j) for i in range(n) for j in near[i]], "cloud_id string, src long, dst long")
    out = baselines.grow_regions(f, nb, 30.0, 0.5).toPandas().sort_values("point_id")
    assert out.region.tolist() == label.tolist()


def test_isotropic_scale_fills_the_cube(spark):
    s = N.isotropic_scale(cloud(spark, np.random.default_rng(9).normal(size=(50, 3)))).toPandas()
    spans = [s[a].max() - s[a].min() for a in "xyz"]
    assert np.isclose(max(spans), 64.0)


def test_cloud_without_extent_is_an_error(spark):
    with pytest.raises(Exception, match="no extent"):
        N.isotropic_scale(cloud(spark, [[1.0, 1.0, 1.0]] * 3)).collect()


def test_baseline_distance_uses_every_feature(spark):
    from pointweave.operators.neighbors import baseline_distance

    rng = np.random.default_rng(2)
    base, ask = rng.normal(size=(300, 6)), rng.normal(size=(80, 6))
    cols = [f"f{i}" for i in range(6)]
    frame = lambda m: spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(m)], ["cloud_id", "point_id", *cols])
    got = {r.point_id: r.score for r in baseline_distance(frame(ask), frame(base), cols).collect()}
    z = (base - base.mean(0)) / base.std(0)
    a = (ask - base.mean(0)) / base.std(0)
    want = ((a[:, None] - z[None]) ** 2).sum(-1).min(1)
    assert len(got) == 80 and all(abs(got[i] - want[i]) < 1e-9 for i in range(80))


def test_baseline_rows_that_lack_a_feature_are_nobodys_nearest(spark):
    from pointweave.operators.neighbors import baseline_distance

    frame = lambda rows: spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], "cloud_id string, point_id long, f double, g double")
    base = [(float(i), None) for i in range(30)] + [(0.0, 0.0), (9.0, 2.0)]
    got = {r.point_id: r.score for r in baseline_distance(frame([(0.0, 0.0), (9.0, 2.0), (1.0, None), (9.0, 3.0)]), frame(base), ["f", "g"]).collect()}
    assert got.keys() == {0, 1, 3} and got[0] == got[1] == 0.0 and got[3] == pytest.approx(1.0)


def test_feature_blocks_find_the_nearest_of_all(spark):
    from pointweave.operators.featureblocks import nearest_sq

    rng = np.random.default_rng(12)
    base = np.concatenate([rng.normal(size=(700, 5)), rng.normal(size=(300, 5)) * 1e-3 + 2])
    ask = np.concatenate([rng.normal(size=(300, 5)) * 3, base[:40]])
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, f array<double>")
    found = nearest_sq(frame(base), frame(ask), base[:5], base.min(0), base.max(0), block_rows=16).toPandas().sort_values("id")
    assert found.id.tolist() == list(range(len(ask)))
    assert np.allclose(found.score, ((ask[:, None] - base[None]) ** 2).sum(-1).min(1), rtol=1e-12, atol=0)


def test_feature_search_sends_far_rows_to_few_blocks(spark, monkeypatch):
    from pointweave.operators import featureblocks as B

    rng = np.random.default_rng(5)
    base, ask = rng.random((20_000, 5)), rng.random((4_000, 5)) * 3 + 1
    frame = lambda m: spark.createDataFrame(pd.DataFrame({"id": np.arange(len(m)), "f": list(m)}))
    real, sent = B._visits, []

    def visits(blocks, rows):
        sent.append(rows.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0])
        return real(blocks, rows)

    monkeypatch.setattr(B, "_visits", visits)
    found = B.nearest_sq(frame(base), frame(ask), base[:150], base.min(0), base.max(0), block_rows=512).toPandas().sort_values("id")
    want = np.concatenate([((part[:, None] - base[None]) ** 2).sum(-1).min(1) for part in np.array_split(ask, 40)])
    assert np.allclose(found.score, want, rtol=1e-12, atol=0)
    assert sent[1] < 2 * sent[0]


def test_factor_of_a_region_by_levels_and_by_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    n = 700
    pairs = np.array([(i, j) for i in range(n) for j in (i + 1, i + 25) if j < n and not 300 <= i < 326])
    dense = np.zeros((n, n))
    dense[pairs[:, 0], pairs[:, 1]] = dense[pairs[:, 1], pairs[:, 0]] = -rng.random(len(pairs))
    dense += np.diag(0.1 - dense.sum(axis=1))
    row, col = np.nonzero(dense)
    full, starts = np.unique(row, return_index=True)
    own = {"ids": np.arange(n), "row": full, "starts": starts, "col": col, "value": dense[row, col]}
    x = rng.normal(size=(n, 3))
    factor = R._Factor(own)
    assert len(factor.inverse) > 3 and np.allclose(dense @ factor.solve(x), x)
    monkeypatch.setattr(R, "FACTOR_BYTES", 0)
    monkeypatch.setattr(R, "PIECE_UNKNOWNS", 100)
    got, edge = R._Factor(own).solve(x), np.linspace(0, n, 8).astype(int)
    assert all(np.allclose(dense[a:b, a:b] @ got[a:b], x[a:b]) for a, b in zip(edge, edge[1:]))


def test_products_of_a_system_of_one_block():
    from pointweave.operators.rowblocks import products_alone

    rng = np.random.default_rng(4)
    dense = np.where(rng.random((60, 60)) < rng.random((60, 1)), rng.normal(size=(60, 60)), 0.0) + 9 * np.eye(60)
    row, col = np.nonzero(dense)
    full, starts = np.unique(row, return_index=True)
    x = rng.normal(size=(60, 7))
    assert np.allclose(products_alone({"row": full, "starts": starts, "col": col, "value": dense[row, col]})(x), dense @ x)


def test_strain_of_points_without_edges(spark):
    from helpers import edges

    p = cloud(spark, [[0.0, 0, 0], [1.0, 0, 0], [5.0, 0, 0]])
    back = p.where("point_id = 1").selectExpr("cloud_id", "point_id", "1.5d as rx", "0d as ry", "0d as rz")
    got = {r.point_id: r.strain for r in R.edge_strain(p, back, edges(spark, [(0, 1)])).collect()}
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.5) and got[2] == float("inf")
    kept = R.strain_veto(points(spark, range(3)), R.edge_strain(p, back, edges(spark, [(0, 1)])), 0.6)
    assert sorted(r.point_id for r in kept.collect()) == [0, 1]


def test_eigenpairs_of_a_cloud_that_goes_through_in_its_task(spark):
    """A cloud of 15,000 points with 40 more parts of their own, so the value 0 comes 41 times: more often than a block has vectors."""
    from pointweave.operators import krylov

    rng = np.random.default_rng(3)
    n, lone, part = 15_000, 40, 12
    at = np.arange(n)
    pairs = [np.column_stack([at[:-1], at[1:]]), np.column_stack([at, rng.permutation(n)])]
    pairs += [n + part * c + np.column_stack([np.arange(part - 1), np.arange(1, part)]) for c in range(lone)]
    pairs = np.concatenate(pairs)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    total = n + lone * part
    degree = np.bincount(pairs[:, 0], minlength=total)
    row, col = np.append(pairs[:, 0], np.arange(total)), np.append(pairs[:, 1], np.arange(total))
    value = np.append(-1 / np.sqrt(degree[pairs[:, 0]] * degree[pairs[:, 1]]), np.ones(total))
    lap = cut(spark.createDataFrame(pd.DataFrame({"cloud_id": "a", "src": row, "dst": col, "value": value})))
    got = spectral.smallest_eigenpairs(lap, 60).toPandas().sort_values("point_id")
    values, vectors = np.array(got.lambdas.iloc[0]), np.vstack(got.phi)
    # a path of 12 points has the values 1 - cos(pi j / 11)
    assert len(got) == total and np.allclose(values[:41], 0, atol=1e-9) and np.allclose(values[41:], 1 - np.cos(np.pi / 11), atol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(60), atol=1e-9)
    matrix = krylov.Matrix(row, col, value, total)
    image = np.hstack([matrix.times(np.ascontiguousarray(vectors[matrix.order, a : a + 16])) for a in range(0, 60, 16)])
    assert np.abs(image - vectors[matrix.order] * values).max() < 1e-7
