"""Nearest samples, range minima and file order against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.epochs import anchored_bins
from tidemark.operators.nearest import nearest_samples
from tidemark.operators.range_minimum import lowest_in_windows
from tidemark.operators.roles import Roles
from tidemark.operators.troughs import trough_in_windows
from tidemark.sources.file_order import read_in_file_order

ROLES = Roles("k", "t", "x", "c", ("i",))
SAMPLES = "k string, t double, x double, c string, i long"


def walk(seed: int, n: int, keys=("a", "b", None), step=5):
    """Samples on few different times, so that there are many ties."""
    rng = random.Random(seed)
    rows = [(rng.choice(keys), float(rng.randrange(n // step)), float(rng.randrange(9)), f"c{i}", i)
            for i in range(n)]
    return rows + [("a", None, 1.0, "no time", n), ("a", float("nan"), 1.0, "no time", n + 1)]


def nearest_brute(samples, anchors):
    out = []
    for key, name, at in anchors:
        own = [s for s in samples if s[0] == key and s[1] is not None and s[1] == s[1]]
        usable = own and at is not None and at == at
        best = min(own, key=lambda s: (abs(s[1] - at), s[1], s[4])) if usable else None
        out.append((key, name, best and best[1], best and best[4], best and best[2]))
    return sorted(out, key=str)


def nearest(spark, samples, anchors):
    found = nearest_samples(
        spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(anchors, "k string, name long, at double"),
        ROLES, "at", ["x"])
    rows = found.select("k", "name", "nearest_time", "nearest_i", "nearest_x").collect()
    return sorted(map(tuple, rows), key=str)


def moments(seed: int, n: int, span: float):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "empty", None]), i, rng.choice([rng.uniform(-5, span + 5), float(rng.randrange(int(span)))]))
            for i in range(n)]
    return rows + [("a", n, None), ("a", n + 1, float("nan")), ("b", n + 2, 0.5), ("b", n + 2, 0.5)]


def test_nearest_equals_brute_force(spark):
    samples, anchors = walk(1, 300), moments(2, 200, 60.0)
    assert nearest(spark, samples, anchors) == nearest_brute(samples, anchors)


def test_nearest_over_several_parts(spark, tiny_limits, no_broadcast):
    """Recordings cut inside runs of equal times, and candidates beyond the part ends."""
    samples = walk(3, 400, step=20) + [("a", 5000.0, 1.0, "far", 9000), ("b", -900.0, 1.0, "far", 9001)]
    anchors = moments(4, 150, 20.0) + [("a", 800 + i, 2000.0 + 20 * i) for i in range(100)]
    assert nearest(spark, samples, anchors) == nearest_brute(samples, anchors)


def test_nearest_without_rows(spark):
    assert nearest(spark, [], [("a", 1, 2.0)]) == [("a", 1, None, None, None)]
    assert nearest(spark, walk(5, 20), []) == []


def test_bins_are_the_nearest_samples(spark):
    """A bin starts at its anchor: there the general form gives the bin's own start."""
    rows = [("a", float(t), 1.0, "", t) for t in range(3, 3600, 7)]
    df = spark.createDataFrame(rows, SAMPLES)
    bins = anchored_bins(df, "k", "t").select("k", "bin", "anchor_time", "start_time").distinct()
    found = nearest_samples(df, bins.select("k", "bin", "anchor_time"), ROLES, "anchor_time")
    both = found.join(bins, ["k", "bin"]).select("nearest_time", "start_time").collect()
    late = [r for r in both if r["nearest_time"] != r["start_time"]]
    assert len(both) == 60 and all(r["nearest_time"] < r["start_time"] for r in late)


def windows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, lo double, hi double")


def low_rows(df):
    return sorted(map(tuple, df.select("k", "lo", "hi", "noise_time", "x", "c", "i").collect()), key=str)


def low_brute(samples, windows):
    out = []
    for key, lo, hi in set(windows):
        own = [s for s in samples if s[0] == key and s[1] is not None and s[2] is not None and lo <= s[1] <= hi]
        if own:
            s = min(own, key=lambda s: (s[2], s[1], s[4]))
            out.append((key, lo, hi, s[1], s[2], s[3], s[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [40, 1500])
def test_lowest_equals_brute_force(spark, n):
    samples = [s for s in walk(6, n) if s[1] is None or s[1] == s[1]] + [("a", 1.0, None, "no value", -1)]
    span = n // 5
    rng = random.Random(7)
    windows = [(rng.choice(["a", "b", "empty", None]), *sorted([rng.uniform(-3, span + 3), rng.uniform(-3, span + 3)]))
               for _ in range(150)]
    windows += [("a", float(i), float(span - i)) for i in range(span)] + [("a", 5.0, 5.0)] * 2 + [("b", 3.0, 2.0)]
    df = spark.createDataFrame(samples, SAMPLES)
    expected = low_brute(samples, windows)
    assert low_rows(lowest_in_windows(df, windows_of(spark, windows), ROLES)) == expected
    assert low_rows(trough_in_windows(df, windows_of(spark, windows), ROLES)) == expected


def test_lowest_over_several_parts(spark, tiny_limits, no_broadcast):
    samples = [s for s in walk(8, 3000, keys=("a",)) if s[1] is not None and s[1] == s[1]]
    windows = [("a", float(i), float(600 - i)) for i in range(0, 300, 4)] + [("a", i + 0.5, i + 7.0) for i in range(40)]
    df = spark.createDataFrame(samples, SAMPLES)
    assert low_rows(lowest_in_windows(df, windows_of(spark, windows), ROLES)) == low_brute(samples, windows)


def test_a_thousand_nested_windows_read_each_sample_once(spark):
    """What a window costs does not depend on its length."""
    df = spark.range(20_000).select(
        F.lit("a").alias("k"), F.col("id").cast("double").alias("t"),
        F.abs(F.col("id") - 10_000.0).alias("x"), F.lit("").alias("c"), F.col("id").alias("i"))
    windows = spark.range(1000).select(
        F.lit("a").alias("k"), F.col("id").cast("double").alias("lo"), (20_000.0 - F.col("id")).alias("hi"))
    rows = lowest_in_windows(df, windows, ROLES).collect()
    assert len(rows) == 1000 and {r["noise_time"] for r in rows} == {10_000.0}


@pytest.mark.parametrize("split_bytes", ["4096", "134217728"])
def test_file_order_does_not_depend_on_splits(spark, tmp_path, split_bytes):
    rng = random.Random(9)
    expected = {}
    for name, n in (("one.csv", 1500), ("two words.csv", 700), ("short.csv", 1), ("a_double.csv", 30)):
        lines = ["h" + ",h" * 10, "s" + ",V" * 10, "s" + ",V" * 10]
        lines += [f"00:00:0{rng.randrange(3)},{i}" + ",1" * 8 + ",note" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        expected[name] = n
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = read_in_file_order(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    del expected["a_double.csv"]
    assert {(r["source_file"], r["row"]) for r in rows} == {(f, i) for f, n in expected.items() for i in range(n)}
    assert all(int(r["raw_eeg"]) == r["row"] for r in rows)
