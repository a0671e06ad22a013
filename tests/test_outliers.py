import statistics

from pyspark.sql import functions as F

from tidemark.functions.columns import after_marker, before_marker, is_exactly
from tidemark.operators.outliers import mad_filter, mad_filter_in_window
from tidemark.operators.roles import Roles

ROLES = Roles("k", "t", "v", "c")
SCHEMA = "k string, t double, v double, c string"


def recording(key, marker_at, text="in slurry", n=400):
    return [
        (key, float(t), float((t * 37) % 101), text if t == marker_at else "") for t in range(n)
    ]


def keep_all(rows, inside, k):
    values = [r[2] for r in rows if inside(r[1])]
    if not values:
        return rows
    middle = statistics.median(values)
    dev = 1.4826 * statistics.median([abs(v - middle) for v in values])
    return [r for r in rows if not inside(r[1]) or abs(r[2] - middle) <= k * dev]


def test_window_before_the_marker(spark):
    rows = recording("a", 250) + recording("b", 90)
    out = mad_filter_in_window(
        spark.createDataFrame(rows, SCHEMA), ROLES, is_exactly(F.col("c"), "in slurry"),
        before_marker(0, 100), 0.5,
    )
    expected = keep_all(recording("a", 250), lambda t: 0 <= t < 150, 0.5) + recording("b", 90)
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def test_window_after_the_marker(spark):
    rows = recording("a", 100)
    out = mad_filter_in_window(
        spark.createDataFrame(rows, SCHEMA), ROLES, is_exactly(F.col("c"), "in slurry"),
        after_marker(120), 1.0,
    )
    assert sorted(map(tuple, out.collect())) == sorted(keep_all(rows, lambda t: t >= 220, 1.0))


def test_recording_without_exact_marker_is_dropped(spark):
    rows = recording("a", 100, "In slurry -2.5degC") + recording("b", -1)
    out = mad_filter_in_window(
        spark.createDataFrame(rows, SCHEMA), ROLES, is_exactly(F.col("c"), "in slurry"),
        before_marker(0, 100), 0.5,
    )
    assert out.count() == 0


def test_filter_per_group(spark):
    rows = recording("a", -1) + recording("b", -1, n=77)
    out = mad_filter(spark.createDataFrame(rows, SCHEMA), ["k"], "v", 1.0)
    expected = [r for key in "ab" for r in keep_all([x for x in rows if x[0] == key], lambda t: True, 1.0)]
    assert sorted(map(tuple, out.collect())) == sorted(expected)
