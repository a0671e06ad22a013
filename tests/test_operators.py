import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import TROUGHS
from tidemark.functions.columns import before_marker, is_exactly, mentions
from tidemark.operators import cohorts, epochs, markers, summaries, timebase, troughs
from tidemark.operators.baseline import baseline_medians, percent_of_baseline, percent_of_table
from tidemark.operators.roles import Roles

ROLES = Roles("k", "t", "v", "c")
SCHEMA = "k string, t double, v double, c string"


@pytest.fixture
def rows(spark):
    data = [("a", 0, 5, ""), ("a", 1, 3, "stun on"), ("a", 2, 3, "Stun off"), ("a", 3, 0, "in slurry"),
            ("a", 9, 7, "in slurry"), ("b", 0, 1, "In slurry -2.5degC"), ("b", 4, 1, "stun off")]
    return spark.createDataFrame([(k, float(t), float(v), c) for k, t, v, c in data], SCHEMA)


def test_marker_times(rows):
    c = F.col("c")
    out = markers.marker_times(
        rows, ROLES, exact=is_exactly(c, "in slurry"), loose=mentions(c, "in slurry"), off=is_exactly(c, "stun off")
    )
    assert {tuple(r) for r in out.collect()} == {("a", 3.0, 3.0, None), ("b", None, 0.0, 4.0)}


def test_rows_between_markers_and_interval(rows):
    on, end = is_exactly(F.col("c"), "stun on"), is_exactly(F.col("c"), "in slurry")
    found = markers.between_markers(rows, ROLES, on, end, 0.0)
    assert sorted(r.t for r in found.collect()) == [1.0, 2.0, 3.0]
    intervals = markers.marker_interval(rows, ROLES, on, end).collect()
    assert {(r.k, r.interval) for r in intervals} == {("a", 2.0), ("b", None)}


def test_crop_without_marker_is_empty(rows):
    found = markers.crop_around_marker(rows, ROLES, is_exactly(F.col("c"), "in slurry"), 1, 5)
    assert sorted((r.k, r.t) for r in found.collect()) == [("a", 2.0), ("a", 3.0)]


def test_first_and_smallest(rows):
    first = markers.first_per_group(rows, ["k"], ["t"])
    assert first.columns == rows.columns
    assert {(r.k, r.t) for r in first.collect()} == {("a", 0.0), ("b", 0.0)}
    ties = markers.smallest_with_ties(rows, ["k"], "v")
    assert sorted((r.k, r.t) for r in ties.collect()) == [("a", 3.0), ("b", 0.0), ("b", 4.0)]


def test_baseline_medians_give_hundred_percent(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(t), float(rng.random() + 1), "x" if t == 300 else "") for t in range(401)]
    df = spark.createDataFrame(data, SCHEMA)
    marker, span = is_exactly(F.col("c"), "x"), before_marker(0, 100)
    percent = percent_of_baseline(df, ROLES, marker, span)
    inside = percent.where(F.col("t") < 200)
    assert inside.agg(F.median("pct_v")).first()[0] == pytest.approx(100)
    table = percent_of_table(df, baseline_medians(df, ROLES, marker, span), ["k"], {"v": "baseline"})
    assert table.exceptAll(percent.select(table.columns[:4] + [F.col("baseline_v"), "pct_v"])).count() == 0


def test_zero_baseline_gives_null(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, ""), ("a", 5.0, 1.0, "x")], SCHEMA)
    out = percent_of_baseline(df, ROLES, is_exactly(F.col("c"), "x"), before_marker(0, 1))
    assert {r.pct_v for r in out.collect()} == {None}


def test_epochs_start_at_the_first_sample_and_include_the_horizon(spark):
    times = [-1.0, 3.0, 22.9, 23.0, 60.0, 79.9, 80.0, 3600.0, 3600.5]
    df = spark.createDataFrame([("a", t, t) for t in times], "k string, marker_time double, v double")
    out = epochs.epoch_means(df, "k", ["v"])
    found = {r.bin: (r.marker_time, r.n_points) for r in out.collect()}
    assert found == {0: (3.0, 2), 1: (60.0, 2), 60: (3600.0, 1)}


def test_long_and_wide_are_inverse(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "id int, x double, y double")
    long = epochs.to_long(df, ["x", "y"], ["id"])
    assert long.count() == 4
    assert sorted(map(tuple, epochs.to_wide(long, ["id"], ["x", "y"]).collect())) == sorted(map(tuple, df.collect()))


def test_condition_tags(spark):
    texts = {
        "In slurry ice +2,6degC": 2.5, "In slurry +2.3degC": 2.5, "In slurry -2.5degC": -2.5,
        "into slurry -2.5": -2.5, "into slurry 5 degrees": 5.0, "In slurry -2.4degC": -2.5,
        "tail flip": None, "in slurry": None,
    }
    data = [(i, text) for i, text in enumerate(texts)] + [(i, "tail flip") for i in range(len(texts))]
    df = spark.createDataFrame(data, "k int, c string")
    tags = cohorts.group_tags(df, "k", F.col("c"), cohorts.TEMPERATURE_RULES)
    assert [r.tag for r in tags.orderBy("k").collect()] == list(texts.values())
    merged = cohorts.merge_levels(tags, "tag", [2.5, 5.0], 2.55)
    assert merged.where("tag = 2.55").count() == 3


def test_cohort_membership(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    listed = spark.createDataFrame([("x",), ("x",)], "k string")
    assert [r.k for r in cohorts.members(df, listed, "k").collect()] == ["x"]
    assert sorted(r.k for r in cohorts.non_members(df, listed, "k").collect()) == ["y", "z"]
    labels = cohorts.split_cohort(df, listed, "k", "in", "out").collect()
    assert {(r.k, r.cohort) for r in labels} == {("x", "in"), ("y", "out"), ("z", "out")}


def test_trough_durations(spark):
    """A dip at the published second inside a wider window, then its duration."""
    samples = [
        (name, float(t), 0.1 if t in (trough, trough + 1) else 1.0, "In slurry" if t == marker else "")
        for name, trough, marker, _ in TROUGHS
        for t in range(marker - 5, trough + 20)
    ]
    df = spark.createDataFrame(samples, SCHEMA)
    windows = spark.createDataFrame(
        [(n, float(t - 7), float(t + 7), 1.0 if c == "3V" else None) for n, t, _, c in TROUGHS],
        "k string, lo double, hi double, fixed double",
    )
    found = troughs.trough_in_windows(df, windows, ROLES)
    assert {(r.k, r.noise_time) for r in found.collect()} == {(n, float(t)) for n, t, _, _ in TROUGHS}
    anchors = markers.marker_times(df, ROLES, start=mentions(F.col("c"), "in slurry"))
    fixed = found.join(windows.select("k", "fixed"), "k")
    totals = troughs.trough_duration(fixed, anchors, "k", "start", "fixed")
    cohort_of = spark.createDataFrame([(n, c) for n, _, _, c in TROUGHS], "k string, cohort string")
    summary = summaries.cohort_summary(totals.join(cohort_of, "k"), ["cohort"], "total")
    assert {r.cohort: (r.n, r.median_value, r.min_value, r.max_value) for r in summary.collect()} == {
        "-2.5": (5, 51, 21, 67), "0": (5, 89, 57, 123), "2.5_5": (5, 168, 55, 194),
        "2.5V": (6, 18.5, 6, 38), "3V": (4, 1, 1, 1),
    }


def test_many_windows_of_one_recording(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 500)
    df = spark.createDataFrame([("a", float(t), float(v), "") for t, v in enumerate(values)], SCHEMA)
    starts = rng.integers(-5, 480, 40)
    spans = {(float(s), float(s + n)) for s, n in zip(starts, [0, 1, 3, 400] * 10)}
    windows = spark.createDataFrame([("a", lo, hi) for lo, hi in spans], "k string, lo double, hi double")
    found = troughs.trough_in_windows(df, windows, ROLES).collect()
    expected = {}
    for lo, hi in spans:
        inside = [(v, t) for t, v in enumerate(values) if lo <= t <= hi]
        if inside:
            expected[lo, hi] = tuple(map(float, min(inside)))
    assert {(r.lo, r.hi): (r.v, r.noise_time) for r in found} == expected
    assert len(found) == len(expected)


def test_relative_time_and_shift(rows):
    clocked = rows.withColumn("clock", F.col("t") + 100)
    out = timebase.relative_time(clocked.drop("t"), ROLES, "clock")
    assert out.select("k", "t").exceptAll(rows.select("k", "t")).count() == 0
    anchors = rows.where("k = 'a'").groupBy("k").agg(F.lit(3.0).alias("zero"))
    shifted = timebase.shift_to_marker(rows, anchors, ROLES, "zero").collect()
    assert {r.marker_time for r in shifted if r.k == "b"} == {None}
    assert sorted(r.marker_time for r in shifted if r.k == "a") == [-3, -2, -1, 0, 6]


def test_boxplot_whiskers_and_histogram(spark):
    values = [1.0, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    r = summaries.boxplot_stats(df, ["k"], "v").first()
    assert (r.q1, r.median, r.q3, r.lower_whisker, r.upper_whisker, r.outliers) == (3, 5, 7, 1, 8, 1)
    counts = summaries.histogram(df, "v").collect()
    assert sum(c.n for c in counts) == 9
    assert summaries.histogram(spark.createDataFrame([("a", 0.0), ("a", 1.0)], "k string, v double"), "v", log=True).first().n == 1
