"""A sample of the registered queries against DuckDB; ``check.py`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import frames_equal

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = (
    "scale_isotropic q1q99_norm mahalanobis_3d rank_percentile knn_edges scale_rules y_vote adaptive_classify group_sets result_compare "
    "random_rows sample_summary point_filter balanced_complete batch_good fpr_good runtime_summary feature_space_nearest displacement_mask fps_from_first threshold_curve fitted_threshold"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert frames_equal(got, con.sql(entry.oracle_sql()[name]).df()) == ""


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
