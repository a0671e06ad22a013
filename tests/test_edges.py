"""Missing values, empty cases and size switches."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import is_exactly
from tidemark.operators import recovery, summaries
from tidemark.operators.baseline import baseline_medians
from tidemark.operators.outliers import mad_filter
from tidemark.operators.roles import Roles
from tidemark.session import HOT_ROWS

ROLES = Roles("k", "t", "v", "c")
SCHEMA = "k string, t double, v double, c string"


@pytest.fixture
def gaps(spark):
    """NaN and NULL among the values, a recording of missing values only, a NULL key."""
    nan = float("nan")
    rows = [("a", float(t), nan if t % 4 == 0 else float(t % 7), "x" if t == 39 else "") for t in range(40)]
    rows += [("b", float(t), None, "x" if t == 39 else "") for t in range(40)]
    rows += [(None, float(t), float(t % 5), "x" if t == 39 else "") for t in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


def both_paths(spark, run):
    cold = run()
    spark.conf.set(HOT_ROWS[0], "20")
    try:
        return cold, run()
    finally:
        spark.conf.unset(HOT_ROWS[0])


def test_medians_do_not_depend_on_size(spark, gaps):
    before = lambda t, anchor: (t >= 0) & (t < anchor)
    cold, hot = both_paths(spark, lambda: {
        r.k: r.baseline
        for r in baseline_medians(gaps, ROLES, is_exactly(F.col("c"), "x"), before).collect()
    })
    assert cold == hot and set(cold) == {"a", "b", None} and cold["b"] is None


def test_filter_does_not_depend_on_size(spark, gaps):
    cold, hot = both_paths(spark, lambda: sorted(
        (r.k or "", r.t) for r in mad_filter(gaps, ["k"], "v", 1.0).collect()
    ))
    assert cold == hot and cold


def test_summaries_take_nan_as_missing(spark, gaps):
    row = summaries.cohort_summary(gaps, ["k"], "v").where("k = 'a'").first()
    assert (row.max_value, row.n) == (6.0, 40)
    assert not math.isnan(summaries.stage_summary(gaps, ["k"], "v").where("k = 'a'").first().mean_value)
    assert sum(r.n for r in summaries.histogram(gaps, "v").collect()) == 70


@pytest.mark.parametrize("low,high,wanted,edges", [
    (42, 252, 4, (50.0, 0, 6)), (0, 99, 8, (10.0, 0, 10)), (4, 167, 6, (20.0, 0, 9)), (602, 1910, 4, (500.0, 1, 4)),
    (0.1, 0.97, 5, (0.2, 0, 5)), (-3.2, 4.1, 5, (2.0, -2, 3)),
])
def test_round_bins(low, high, wanted, edges):
    step, first, last = summaries.pretty_bins(low, high, wanted)
    assert (pytest.approx(step), first, last) == edges


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 10, 11, 20, 30, 99)], "v double")
    found = {r.bin_start: r.n for r in summaries.histogram(df, "v").collect()}
    assert found == {0.0: 5, 20.0: 1, 80.0: 1}


def test_nobody_recovered(spark):
    df = spark.createDataFrame([(1, "c", "s", None)], "animal int, cohort string, stage string, seconds double")
    assert recovery.recovery_curve(df, "animal", "cohort", "stage", "seconds", ["s"]).count() == 0
    assert recovery.recovery_grid(df, "animal", "cohort", ["c"], 0).count() == 0
    binned = recovery.with_bin(df, "seconds", 60.0)
    assert recovery.filled_grid(binned, "animal", "cohort", "stage", ["c"], 3).count() == 3
