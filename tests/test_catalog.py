"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_queries import difference, duck
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = queries()[name](spark, SF).toPandas()
    assert len(ours)
    sql = oracle_sql().get(name)
    if sql:
        assert difference(ours, con.execute(sql).df()) is None


HOT = [
    "sample_index", "locf", "boxplot_stats", "mad_filter_pre", "mad_filter_long", "trough_windows", "profile",
    "baseline_median", "baseline_counts", "percent_of_baseline", "marker_relative_time", "between_markers",
    "slice_min_ties", "recovery_curve", "cohort_summary", "cohort_split", "saved_duration_glm",
]


@pytest.mark.usefixtures("tiny_limits", "no_broadcast")
@pytest.mark.parametrize("name", HOT)
def test_query_with_hot_groups(spark, con, name):
    ours = queries()[name](spark, SF).toPandas()
    assert difference(ours, con.execute(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).columns == ["user_id", "bin", "n_points", "marker_time", "pct_value"]
