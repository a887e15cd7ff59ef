import numpy as np
from helpers import cloud

from pointweave.config import Settings
from pointweave.plans import pipeline


def test_a_dent_is_found(spark):
    rng = np.random.default_rng(3)
    n = 40
    g = np.stack(np.meshgrid(np.arange(n), np.arange(n)), -1).reshape(-1, 2) + rng.normal(0, 0.08, (n * n, 2))
    z = -1.6 * np.exp(-((g - 20) ** 2).sum(1) / (2 * 1.6**2)) + rng.normal(0, 0.01, n * n)
    st = pipeline.run_pipeline(cloud(spark, np.column_stack([g, z])), Settings(sample_points=2000))
    hit = st.final.toPandas().point_id.to_numpy()
    assert len(hit) > 10 and np.abs(g[hit].mean(0) - 20).max() < 1.5
    assert pipeline.point_report(st).count() == n * n


def test_batch_run_and_resume(spark, tmp_path):
    from pointweave.plans.batch import run_batch
    from pointweave.sources.sinks import pcd_bytes

    rng = np.random.default_rng(3)
    n = 20
    g = np.stack(np.meshgrid(np.arange(n), np.arange(n)), -1).reshape(-1, 2) + rng.normal(0, 0.05, (n * n, 2))
    dent = -1.6 * np.exp(-((g - 10) ** 2).sum(1) / (2 * 1.4**2))
    for folder in ("test", "gt", "good"):
        (tmp_path / "data/plate" / folder).mkdir(parents=True)
    xyz = np.column_stack([g, dent + rng.normal(0, 0.01, n * n)]).astype("<f4").astype(float)
    (tmp_path / "data/plate/test/a.pcd").write_bytes(pcd_bytes(xyz))
    (tmp_path / "data/plate/test/b.pcd").write_bytes(pcd_bytes(xyz))
    (tmp_path / "data/plate/good/c_good.pcd").write_bytes(pcd_bytes(np.column_stack([g, rng.normal(0, 0.01, n * n)])))
    truth = dent < -0.3
    np.savetxt(tmp_path / "data/plate/gt/a.txt", truth.astype(int), fmt="%d")
    np.savetxt(tmp_path / "data/plate/gt/b.txt", np.column_stack([xyz, truth]), fmt="%.7f")
    small = Settings(sample_points=1000, variation_scales=(6, 8, 12), eigenpairs=20, min_context=50)
    result = run_batch(spark, str(tmp_path / "data"), str(tmp_path / "out"), small)
    rows = {r.sample_id: r for r in result.samples.collect()}
    assert set(rows) == {"a", "b", "c_good"} and all(r.success and r.num_points == n * n for r in rows.values())
    # the same truth in two formats, the same cloud: the same counts
    assert [rows["a"][c] for c in ("tp", "fp", "fn", "tn")] == [rows["b"][c] for c in ("tp", "fp", "fn", "tn")]
    assert rows["a"].tp + rows["a"].fn == truth.sum()
    assert result.categories.first().sample_count == 2 and result.good.count() == 2
    again = run_batch(spark, str(tmp_path / "data"), str(tmp_path / "out"), small)
    assert again.samples.count() == 3
    assert spark.read.parquet(str(tmp_path / "out/sample_metrics")).count() == 3


def test_a_mode_runs_and_all_differ(spark):
    from pointweave.plans import sweep

    rng = np.random.default_rng(3)
    n = 18
    g = np.stack(np.meshgrid(np.arange(n), np.arange(n)), -1).reshape(-1, 2) + rng.normal(0, 0.05, (n * n, 2))
    dent = -1.6 * np.exp(-((g - 9) ** 2).sum(1) / (2 * 1.4**2))
    p = cloud(spark, np.column_stack([g, dent + rng.normal(0, 0.01, n * n)]))
    samples = p.select("cloud_id").distinct().selectExpr("cloud_id", "'d' as dataset", "'c' as category", "cloud_id as sample_id", "'defective' as sample_kind")
    small = Settings(sample_points=1000, variation_scales=(6, 8, 12), eigenpairs=20, min_context=50)
    modes = [m for m in sweep.ablation_settings(small) if m[0] == "wo_counterfactual_verification"]
    rows = {r.family: r for r in sweep.run_settings(p, samples, p.selectExpr("cloud_id", "point_id", "z < -0.3 as defect"), modes).collect()}
    assert set(rows) == {"wo_counterfactual_verification"}
    assert all(r.success and r.num_points == n * n for r in rows.values())
    assert len({m[2].digest() for m in sweep.ablation_settings(small)}) == len(sweep.ABLATIONS)
    assert {m[0] for m in sweep.ablation_settings()} == set(sweep.ABLATIONS)


def test_the_fixed_threshold_is_fitted_and_used(spark, monkeypatch):
    from pointweave.plans import sweep

    asked = []
    points = spark.range(20).selectExpr("'a' as cloud_id", "id as point_id")
    final = points.where("point_id < 12").selectExpr("*", "floor(point_id / 4) as component")
    regions = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.1), ("a", 2, 0.2)], "cloud_id string, component long, d_p90 double")
    truth = points.selectExpr("*", "point_id < 4 or point_id >= 18 as defect")
    samples = spark.createDataFrame([("a", "c", "1", "base")], "cloud_id string, category string, group_key string, variant string")

    def run(raw, settings):
        asked.append(settings)
        return pipeline.Stages(points, None, regions=regions, final=final)

    monkeypatch.setattr(pipeline, "run_pipeline", run)
    fitted = sweep.fixed_threshold_settings(points, samples, truth)
    # the components at 0.1 and 0.2 hold no true point: the first threshold above both keeps the one at 0.5
    assert fitted.classifier == "fixed" and fitted.absolute_threshold == np.nextafter(0.2, 1)
    assert [s.absolute_threshold for s in asked] == [0.0]
