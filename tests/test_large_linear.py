"""Conjugate gradients against the dense fit, and a factor of very many levels."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import large_linear
from tidemark.operators.large_linear import fit_linear_large
from tidemark.operators.linear_models import fit_linear
from tidemark.session import LISTED_CELLS


def rows(n: int, seed: int = 1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randrange(40), rng.choice("xyz"), rng.randrange(6) ** 2
        y = 0.1 * a + {"x": 0, "y": 3, "z": -2}[b] - 0.05 * c + rng.gauss(0, 1)
        out.append((a, b, c, y if rng.random() < 0.97 else None))
    return out


@pytest.mark.parametrize("factors", [["a", "b", "c"], ["b", "a"], ["b"]])
def test_equals_the_dense_fit(spark, factors):
    df = spark.createDataFrame(rows(400), "a int, b string, c int, y double")
    dense = fit_linear(df, "y", factors)
    asked = [("b", "y"), ("b", "z")] if len(factors) > 1 else []
    large = fit_linear_large(df, "y", factors, asked)
    wanted = {r["term"]: r for r in dense.coefficients.collect()}
    found = {f"{r['factor']}{r['level'] or ''}": r for r in large.effects.collect()}
    assert set(found) == set(wanted)
    for term, r in found.items():
        assert r["estimate"] == pytest.approx(wanted[term]["estimate"], abs=1e-8)
        if r["std_error"] is not None:
            assert r["std_error"] == pytest.approx(wanted[term]["std_error"], rel=1e-8)
    assert sum(r["std_error"] is not None for r in found.values()) == len(asked)
    for x, y in zip(large.fit.first(), dense.fit.first()):
        assert x == pytest.approx(y, rel=1e-9)


def test_shuffled_joins_and_hot_levels(spark, tiny_limits, no_broadcast):
    df = spark.createDataFrame(rows(200, 2) + [(1, "x", 0, 1.0)] * 150, "a int, b string, c int, y double")
    dense = {r["term"]: r["estimate"] for r in fit_linear(df, "y", ["a", "b"]).coefficients.collect()}
    large = {f"{r['factor']}{r['level'] or ''}": r["estimate"] for r in fit_linear_large(df, "y", ["a", "b"]).effects.collect()}
    assert large == pytest.approx(dense, abs=1e-8)


def test_two_hundred_thousand_levels(spark):
    """Noise-free data: every effect comes back."""
    df = spark.range(800_000).select(
        F.pmod(F.xxhash64("id"), F.lit(200_000)).alias("a"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(12)).alias("b"))
    df = df.withColumn("y", F.sin(F.col("a").cast("double")) + F.col("b") * 2.0)
    large = fit_linear_large(df, "y", ["a", "b"])
    off = {r["level"]: r["estimate"] for r in large.effects.where("factor = 'b'").collect()}
    assert off == pytest.approx({str(b): 2.0 * b for b in range(1, 12)}, abs=1e-6)
    worst = large.effects.where("factor = 'a'").agg(
        F.count("level"), F.max(F.abs(F.col("estimate") - F.sin(F.col("level").cast("double"))))).first()
    assert worst[0] > 190_000 and worst[1] < 1e-6
    assert large.steps < 40


def test_refused(spark):
    apart = [(1, "x", 0, 1.0), (1, "y", 0, 2.0), (2, "z", 0, 3.0), (3, "z", 0, 4.0)]
    df = spark.createDataFrame(apart, "a int, b string, c int, y double")
    with pytest.raises(ValueError, match="unconnected"):
        fit_linear_large(df, "y", ["a", "b"])
    with pytest.raises(ValueError, match="no complete"):
        fit_linear_large(df.where("a > 9"), "y", ["a", "b"])
    chain = [(i + d, f"{i:02d}", 0, 1.0 * i) for i in range(12) for d in (0, 1)]  # labels move one level a round
    assert fit_linear_large(spark.createDataFrame(chain, df.schema), "y", ["a", "b"]).fit.first()["n"] == 24
    joined = spark.createDataFrame(rows(50), df.schema)
    with pytest.raises(ValueError, match="absorbed"):
        fit_linear_large(joined, "y", ["a", "b"], [("a", 3)])


@pytest.fixture(params=["listed", "joined"])
def path(request, spark):
    """Cells in lists, as with few other levels, or joined at every step."""
    if request.param == "joined":
        spark.conf.set(LISTED_CELLS[0], "0")
    yield request.param
    spark.conf.unset(LISTED_CELLS[0])


def test_steps_move_no_cells(spark, monkeypatch):
    """The cells are saved once flat and once as lists; nothing is joined to them."""
    saved, save = [], large_linear.save_stage

    def counted(df):
        table = save(df)
        saved.append(table.count())
        return table

    def refused(*args, **kwargs):
        raise AssertionError("cells joined")

    monkeypatch.setattr(large_linear, "save_stage", counted)
    monkeypatch.setattr(large_linear, "attach", refused)
    df = spark.range(6_000).select(
        F.pmod("id", F.lit(1_000)).alias("a"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("b"), F.rand(1).alias("y"))
    large = fit_linear_large(df, "y", ["a", "b"], [("b", 1), ("b", 2)])
    assert large.effects.count() == 1_000 + 2
    assert [n for n in saved if n > 100] == [df.select("a", "b").distinct().count(), 1_000]


def test_paths_equal_the_dense_fit(spark, path, tiny_limits, no_broadcast):
    made = rows(300, 3) + [(1, "x", 0, 1.0)] * 150 + [(2, "y", 1, 2.0), (2, "y", 1, None), (3, None, 1, 5.0)]
    df = spark.createDataFrame(made, "a int, b string, c int, y double").withColumn("one", F.lit("all"))
    dense = fit_linear(df, "y", ["a", "b", "c"])
    large = fit_linear_large(df, "y", ["one", "c", "a", "b"], [("b", "z"), ("c", 25)])
    wanted = {r["term"]: r for r in dense.coefficients.collect()}
    found = {f"{r['factor']}{r['level'] or ''}": r for r in large.effects.collect()}
    assert set(found) == set(wanted)
    for term, r in found.items():
        assert r["estimate"] == pytest.approx(wanted[term]["estimate"], abs=1e-8)
    for term in ("bz", "c25"):
        assert found[term]["std_error"] == pytest.approx(wanted[term]["std_error"], rel=1e-8)
    for x, y in zip(large.fit.first(), dense.fit.first()):
        assert x == pytest.approx(y, rel=1e-9)


def test_paths_refuse_the_same(spark, path):
    schema = "a int, b string, c int, y double"
    apart = [(1, "x", 0, 1.0), (1, "y", 0, 2.0), (2, "z", 1, 3.0), (3, "z", 1, 4.0), (4, "w", 2, 5.0)]
    for factors in (["a", "b"], ["a", "c", "b"]):
        with pytest.raises(ValueError, match="3 unconnected"):
            fit_linear_large(spark.createDataFrame(apart, schema), "y", factors)
    held = spark.createDataFrame([*apart, (1, "w", 1, 0.0)], schema)
    with pytest.raises(ValueError, match="2 unconnected"):
        fit_linear_large(held, "y", ["a", "b"])
    assert fit_linear_large(held, "y", ["a", "c", "b"]).fit.first()["n"] == 6  # connected by c
