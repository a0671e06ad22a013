from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_models import simulated
from tidemark.operators import wide_mixed_models
from tidemark.operators.mixed_models import fit_random_intercept
from tidemark.operators.wide_mixed_models import fit_random_intercept_wide

NUMBERS = ["estimate", "std_error", "statistic", "df", "p_value"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file string, bin int, y double").repartition(4)


def dense(rows):
    """Restricted likelihood, estimates, errors and degrees of freedom from whole matrices."""
    files, bins = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[1.0] + [float(r[1] == b) for b in bins[1:]] for r in rows])
    z = np.array([[float(r[0] == f) for f in files] for r in rows])
    y, zz = np.array([r[2] for r in rows]), z @ z.T

    def at(between, within):
        vi = np.linalg.inv(within * np.eye(len(y)) + between * zz)
        c = np.linalg.inv(x.T @ vi @ x)
        p = vi - vi @ x @ c @ x.T @ vi
        dev = -np.linalg.slogdet(vi)[1] - np.linalg.slogdet(c)[1] + y @ p @ y
        grad = [np.trace(p @ k) - y @ p @ k @ p @ y for k in (zz, np.eye(len(y)))]
        slope = [np.diag(c @ x.T @ vi @ k @ vi @ x @ c) for k in (zz, np.eye(len(y)))]
        hess = [[-np.trace(p @ a @ p @ b) + 2 * y @ p @ a @ p @ b @ p @ y for b in (zz, np.eye(len(y)))]
                for a in (zz, np.eye(len(y)))]
        return dev + (len(y) - x.shape[1]) * math.log(2 * math.pi), grad, c @ x.T @ vi @ y, c, slope, hess

    return at


@pytest.mark.parametrize("missing", [set(), {(0, 3), (1, 3), (2, 8), (4, -1), (5, -1)}])
def test_against_dense_matrices(spark, missing):
    rows = simulated(6, [-1, *range(2, 9)], missing=missing)
    out = fit_random_intercept_wide(frame(spark, rows), "y", "bin", "file").collect()
    spread = {r.group: r.estimate**2 for r in out if r.effect == "ran_pars"}
    _, grad, beta, c, slope, hess = dense(rows)(spread["file"], spread["Residual"])
    assert grad == pytest.approx([0, 0], abs=1e-7)
    bins = sorted({r[1] for r in rows})
    fixed = {r.term: r for r in out if r.effect == "fixed"}
    ordered = [fixed[t] for t in ["(Intercept)", *[f"bin{b}" for b in bins[1:]]]]
    assert [r.estimate for r in ordered] == pytest.approx(list(beta), rel=1e-8, abs=1e-10)
    assert [r.std_error for r in ordered] == pytest.approx(list(np.sqrt(np.diag(c))), rel=1e-8)
    v, s = 2 * np.linalg.inv(np.array(hess)), np.stack(slope)
    dof = 2 * np.diag(c) ** 2 / np.einsum("ij,ik,kj->j", s, v, s)
    assert [r.df for r in ordered] == pytest.approx(list(dof), rel=1e-8)


def test_deviance_is_the_restricted_likelihood(spark, monkeypatch):
    rows = simulated(5, range(6), missing={(0, 1), (3, 2)})
    seen = []
    solve = wide_mixed_models._Equations.solve
    monkeypatch.setattr(wide_mixed_models._Equations, "solve", lambda e: seen.append(e) or solve(e))
    fit_random_intercept_wide(frame(spark, rows), "y", "bin", "file")
    at = dense(rows)
    for point in [(0.4, 0.15), (0.01, 2.0)]:
        assert seen[0].deviance(*point) == pytest.approx(at(*point)[0], rel=1e-8)
        gradient, hessian = seen[0].slopes(*point)
        assert list(gradient) == pytest.approx(list(at(*point)[1]), rel=1e-8)
        assert hessian.ravel() == pytest.approx(np.array(at(*point)[5]).ravel(), rel=1e-8)


def agree(spark, rows):
    df = frame(spark, rows)
    wide = {(r.effect, r.term): r for r in fit_random_intercept_wide(df, "y", "bin", "file").collect()}
    narrow = {(r.effect, r.term): r for r in fit_random_intercept(df, "y", "bin", "file").collect()}
    assert wide.keys() == narrow.keys()
    for key, r in narrow.items():
        for name in NUMBERS:
            if r[name] is None:
                assert wide[key][name] is None
            else:
                assert wide[key][name] == pytest.approx(r[name], rel=1e-4, abs=1e-5, nan_ok=True), (key, name)


@pytest.mark.parametrize("rows", [
    simulated(5, range(7), missing={(0, 1), (1, 1), (2, 1), (3, 1)}, seed=8),
    [(f"f{f}", b, float(b + (1 if (f + b) % 2 else -1))) for f in range(4) for b in range(4)],
    [(f"f{i % 4}", 1, float(i % 4 * 3 + i % 3)) for i in range(40)],
    simulated(3, range(4)) * 3,
], ids=["unbalanced", "no variation", "one level", "repeats"])
def test_same_table_as_the_narrow_fit(spark, rows):
    agree(spark, rows)


def test_fit_without_noise(spark):
    """Contrasts are then without error; the first level has that of the groups."""
    rows = [(f"f{f}", b, float(f * f + b)) for f in range(5) for b in range(4)]
    out = {r.term: r for r in fit_random_intercept_wide(frame(spark, rows), "y", "bin", "file").collect()}
    between = np.var([0, 1, 4, 9, 16], ddof=1)
    assert out["sd__Observation"].estimate == 0
    assert out["sd__(Intercept)"].estimate == pytest.approx(math.sqrt(between))
    assert out["(Intercept)"].std_error == pytest.approx(math.sqrt(between / 5))
    assert [out[t].estimate for t in ("(Intercept)", "bin1", "bin2", "bin3")] == pytest.approx([6, 1, 2, 3])
    for t in ("bin1", "bin2", "bin3"):
        assert out[t].std_error == pytest.approx(0, abs=1e-6) and math.isnan(out[t].df)
        assert math.isnan(out[t].p_value)


def test_missing_values_and_refusals(spark, monkeypatch):
    rows = simulated(4, range(5))
    clean = fit_random_intercept_wide(frame(spark, rows), "y", "bin", "file")
    dirty = fit_random_intercept_wide(
        frame(spark, [*rows, (None, 1, 9.0), ("f0", None, 9.0), ("f1", 2, None), ("f1", 2, math.nan)]),
        "y", "bin", "file")
    key = lambda r: (r.effect, r.term)
    for a, b in zip(sorted(clean.collect(), key=key), sorted(dirty.collect(), key=key)):
        assert a.estimate == pytest.approx(b.estimate, rel=1e-12)
    with pytest.raises(ValueError, match="no complete rows"):
        fit_random_intercept_wide(frame(spark, [("f", 1, None)]), "y", "bin", "file")
    monkeypatch.setattr(wide_mixed_models, "MOST_GROUPS", 3)
    with pytest.raises(ValueError, match="more than 3 groups"):
        fit_random_intercept_wide(frame(spark, rows), "y", "bin", "file")


def test_twenty_thousand_levels(spark, monkeypatch):
    """30 recordings, bins of unequal cover; the true variances are found."""
    monkeypatch.setattr(wide_mixed_models, "ENTRIES_AT_ONCE", 30 * 700)
    shift = F.element_at(F.array(*[F.lit(float(s)) for s in np.random.default_rng(4).normal(0, 2, 30)]),
                         (F.col("g") + 1).cast("int"))
    rows = spark.range(600_000).select(
        (F.col("id") % 30).alias("g"), F.floor(F.col("id") / 30).alias("bin"), F.randn(5).alias("e")
    ).where(F.pmod(F.xxhash64("g", "bin"), F.lit(10)) < 7)
    rows = rows.withColumn("y", shift + F.col("bin") * 0.001 + F.col("e"))
    out = fit_random_intercept_wide(rows, "y", "bin", "g").cache()
    assert out.count() == 20_002
    spread = {r.group: r.estimate for r in out.where("effect = 'ran_pars'").collect()}
    assert spread["Residual"] == pytest.approx(1, rel=0.01) and 1.2 < spread["g"] < 2.8
    found = {r.term: r for r in out.where("effect = 'fixed'").collect()}
    # 20,000 contrasts share the error of the first level, so each is within a few of its own.
    off = [(found[f"bin{b}"].estimate - b * 0.001) / found[f"bin{b}"].std_error for b in range(1, 20_000)]
    assert np.std(off) < 1 and abs(np.mean(off)) < 3
