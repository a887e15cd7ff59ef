"""Fitting of the fixed threshold, prefix sums, label files of every shape."""

import math
import random

import numpy as np
import pytest
from helpers import cloud
from pyspark.sql import functions as F

from pointweave.functions.order_stats import prefix_sums
from pointweave.operators import metrics as M
from pointweave.plans.batch import read_truth


def test_next_double(spark):
    values = [0.0, 5e-324, 1e-310, 1.0, 0.1, 2.0**52, 2.0**53, 0.9999999999999999, 1.7976931348623157e308 / 2, math.pi, *np.random.default_rng(0).random(200) * 10.0 ** np.arange(-100, 100)]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", M.next_double(F.col("v")).alias("n")).collect()
    assert all(r.n == math.nextafter(r.v, math.inf) for r in got)


def test_prefix_sums_over_range_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k, v in rng.integers(0, 300, (2000, 2))]
    got = prefix_sums(spark.createDataFrame(rows, "k long, v long"), "k", {"total": "v"}).collect()
    assert {r.k: r.total for r in got} == {k: sum(v for q, v in rows if q <= k) for k, _ in rows}


def brute_curve(parts, samples):
    taus = sorted({0.0} | {math.nextafter(p[4], math.inf) for p in parts if p[4] is not None and not math.isnan(p[4])})
    curve = {}
    for tau in taus:
        groups = {}
        for category, group, variant, positives in samples:
            own = [p for p in parts if p[:3] == (category, group, variant) and p[4] is not None and not math.isnan(p[4]) and p[4] >= tau]
            tp, fp = sum(p[5] for p in own), sum(p[6] for p in own)
            f1 = 2 * tp / (tp + fp + positives) if tp + fp + positives else 0.0
            iou = tp / (fp + positives) if fp + positives else 0.0
            groups.setdefault(category, {}).setdefault(group, []).append((f1, iou))
        curve[tau] = np.mean([np.mean([np.mean(v, axis=0) for v in g.values()], axis=0) for g in groups.values()], axis=0)
    return curve


def test_fitted_threshold_equals_a_replay_of_every_threshold(spark):
    rng = random.Random(3)
    samples = [(c, g, v, rng.randint(0, 30)) for c in ("fish", "gem") for g in "12" for v in ("base", "cut")] + [("gem", "1", "none", 4)]
    parts = [
        (c, g, v, k, rng.choice([0.1, 0.2, 0.25, rng.random(), None, math.nan]), rng.randint(0, 5), rng.randint(0, 9))
        for c, g, v, _ in samples[:-1] for k in range(rng.randint(1, 8))
    ]
    parts_df = spark.createDataFrame(parts, "category string, group_key string, variant string, component int, d_p90 double, tp long, fp long")
    samples_df = spark.createDataFrame(samples, "category string, group_key string, variant string, positives long")
    want = brute_curve(parts, samples)
    got = {r.threshold: (r.f1, r.iou) for r in M.threshold_curve(parts_df, samples_df).collect()}
    assert set(got) == set(want) and all(np.allclose(got[t], want[t]) for t in want)
    assert {r.threshold for r in M.breakpoints(parts_df).collect()} == set(want)
    best = max(want, key=lambda t: (round(want[t][0], 12), round(want[t][1], 12), -t))
    assert M.fit_threshold(parts_df, samples_df).first().threshold == best
    assert M.fit_threshold(parts_df.where("false"), samples_df.where("false")).count() == 0


@pytest.mark.parametrize(
    "values, defects",
    [
        ([[v] for v in (0, 1, 0, 0, 1, 0)], {1, 4}),  # a value per point
        ([[0, 1, 0, 0, 1, 0]], {1, 4}),  # the same in one row
        ([[5], [2]], {2, 5}),  # a list of indices
        ([[5, 2]], {2, 5}),  # the same in one row
        ([[1, 0, 0], [3, 0, 0]], {1, 3}),  # places of defect points
        ([[k, 0, 0, k % 2] for k in range(6)], {1, 3, 5}),  # places with a label last
        ([[k, 0, 0, 7, k % 3] for k in range(6)], {1, 2, 4, 5}),  # more columns, label last
        ([[k, 0, 0, -0.5 * k - 1] for k in (1, 3, 4)], {1, 3, 4}),  # the last column is no label: all rows are defect points
        ([[1, 0, 0, 1], [2, 0, 0]], None),  # rows of different widths
        ([[1, 0], [2, 0]], None),  # two columns
    ],
)
def test_label_files_of_every_shape(spark, values, defects):
    points = cloud(spark, [[k, 0, 0] for k in range(6)])
    rows = spark.createDataFrame([("a", k, [float(x) for x in v]) for k, v in enumerate(values)], "cloud_id string, row long, values array<double>")
    got = read_truth(points, rows).collect()
    assert ({r.point_id for r in got if r.defect} if got else None) == defects
