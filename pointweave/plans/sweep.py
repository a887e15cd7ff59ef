"""Configuration families, held-out scope and resume: all joins on small keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.config import Settings
from pointweave.session import cut

# The swept settings of the five families.
FAMILIES: dict[str, list[dict]] = {
    "graph_scale": [
        {"graph_k": k, "variation_scales": s}
        for k, s in ((10, (8, 16, 32)), (14, (12, 24, 48)), (16, (12, 24, 48)), (18, (12, 24, 48)), (24, (18, 36, 72)), (32, (24, 48, 96)))
    ],
    "va_gamma": [{"va_gamma": g} for g in (0.0, 2.0, 5.0, 10.0, 20.0, 50.0)],
    "boundary_angle": [{"boundary_angle": a} for a in (90.0, 100.0, 110.0, 120.0, 130.0)],
    "seed_and_hops": [{"seed_threshold": t, "grow_hops": h} for t in (0.3, 0.4, 0.5, 0.6, 0.7) for h in (5, 9, 13)],
    "normal_ratio": [{"max_normal_ratio": r} for r in (0.25, 0.4, 0.5, 0.6, 0.75)],
}

# The names of the ablation modes and what each changes.
ABLATIONS: dict[str, dict] = {
    "full": {},
    "laplacian_restoration": {"restoration": "laplacian"},
    "wo_va_hks": {"use_va": False},
    "wo_structural_suppression": {"use_suppression": False},
    "wo_seed_growth": {"use_growth": False},
    "wo_counterfactual_verification": {"use_verification": False},
    "wo_local_control_calibration": {"max_normal_ratio": -1.0},
    "fixed_absolute_threshold_verification": {"classifier": "fixed"},
}


def family_settings(base: Settings | None = None) -> list[tuple[str, int, Settings]]:
    base = base or Settings()
    return [(name, i, base.with_changes(**change)) for name, changes in FAMILIES.items() for i, change in enumerate(changes)]


def run_settings(raw: DataFrame, samples: DataFrame, truth: DataFrame, runs: list[tuple[str, int, Settings]]) -> DataFrame:
    """Sample metrics of every (family, slot, settings) of ``runs``; the clouds go through the pipeline once per entry.

    ``samples`` carries cloud_id and the sample columns, ``truth`` the defect flag of raw points.
    """
    from pointweave.operators.labels import through_sample
    from pointweave.plans.batch import sample_metrics
    from pointweave.plans.pipeline import run_pipeline

    out = None
    for family, slot, settings in runs:
        stages = run_pipeline(raw, settings)
        carried = through_sample(truth, stages.points.select("cloud_id", "point_id"))
        rows = cut(sample_metrics(samples, stages.points, stages.final, carried), "run")
        rows = rows.select(F.lit(family).alias("family"), F.lit(slot).alias("slot"), F.lit(settings.digest()).alias("config_hash"), *rows.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def development_components(stages, samples: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run at threshold 0 accepted, for ``fit_threshold``: its components with true and false points, and the samples' true points.

    ``samples`` carries cloud_id, category, group_key and variant.
    """
    from pointweave.operators.labels import through_sample

    name = ["category", "group_key", "variant"]
    marks = cut(through_sample(truth, stages.points.select("cloud_id", "point_id")), "marks")
    found = stages.final.select("cloud_id", "component", "point_id").join(marks, ["cloud_id", "point_id"])
    parts = found.groupBy("cloud_id", "component").agg(F.count_if("defect").alias("tp"), F.count_if(~F.col("defect")).alias("fp"))
    parts = parts.join(stages.regions.select("cloud_id", "component", "d_p90"), ["cloud_id", "component"]).join(samples.select("cloud_id", *name), "cloud_id")
    positives = marks.groupBy("cloud_id").agg(F.count_if("defect").alias("positives")).join(samples.select("cloud_id", *name), "cloud_id")
    return parts.select(*name, "component", "d_p90", "tp", "fp"), positives.select(*name, "positives")


def fixed_threshold_settings(raw: DataFrame, samples: DataFrame, truth: DataFrame, base: Settings | None = None) -> Settings:
    """The settings of the eighth mode: the fixed displacement threshold fitted on development samples in one run of the pipeline."""
    from pointweave.operators.metrics import fit_threshold
    from pointweave.plans.pipeline import run_pipeline

    base = (base or Settings()).with_changes(**ABLATIONS["fixed_absolute_threshold_verification"])
    stages = run_pipeline(raw, base.with_changes(absolute_threshold=0.0))
    best = fit_threshold(*(cut(t, "development") for t in development_components(stages, samples, truth))).first()
    if best is None:
        raise ValueError("no development samples")
    return base.with_changes(absolute_threshold=best.threshold)


def ablation_settings(base: Settings | None = None) -> list[tuple[str, int, Settings]]:
    base = base or Settings()
    return [(name, 0, base.with_changes(**changes)) for name, changes in ABLATIONS.items()]


def plan_runs(samples: DataFrame, base: Settings | None = None) -> DataFrame:
    """Every sample with every configuration (family, config_hash, settings); the configurations are a fixed list."""
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(i).alias("slot"), F.sha2(F.lit(f"{f}:{i}:{s.digest()}"), 256).alias("config_hash"), F.lit(s.canonical()).alias("settings"))
            for f, i, s in family_settings(base)
        ]
    )
    return samples.withColumn("run", F.explode(rows)).select(*samples.columns, "run.*")


def group_key(sample_id: str = "sample_id"):
    """A cut copy belongs to the group of its base."""
    return F.lower(F.trim(F.replace(F.col(sample_id), F.lit("_cut"), F.lit(""))))


def held_out(samples: DataFrame, development: DataFrame) -> DataFrame:
    """Samples whose group is not one of the development groups."""
    return samples.withColumn("group_key", group_key()).join(development, "group_key", "left_anti")


def remaining(samples: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples without a finished row of the same key and fingerprint."""
    return samples.join(finished.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")
