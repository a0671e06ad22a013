import math

import numpy as np
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression

from tests.fixtures import BEHAVIOUR, MAIN_TIMES, ONE_SECOND_TIMES, TROUGHS, behaviour
from tidemark.operators import mixed_models
from tidemark.operators.linear_models import fit_linear
from tidemark.operators.mixed_models import fit_random_intercept
from tidemark.operators.t_distribution import two_sided_p


def durations(spark, cohorts):
    rows = [(c, 1.0 if c == "3V" else float(t - m)) for _, t, m, c in TROUGHS if c in cohorts]
    return spark.createDataFrame(rows, "stun string, total double")


def check(fit, terms, null, null_df, resid, resid_df, aic, dispersion):
    rows = {r.term: r for r in fit.coefficients.collect()}
    for term, (estimate, error, digits) in terms.items():
        assert round(rows[term].estimate, digits) == estimate
        assert round(rows[term].std_error, digits) == error
    assert set(rows) == set(terms)
    f = fit.fit.first()
    assert (f.df_null, f.df_residual, round(f.aic, 2)) == (null_df, resid_df, aic)
    assert (f.null_deviance, f.deviance) == pytest.approx((null, resid), rel=2e-5)
    assert f.dispersion == pytest.approx(dispersion, rel=1e-6)
    return rows


def test_duration_by_stun(spark):
    check(
        fit_linear(durations(spark, ["0", "2.5V", "3V"]), "total", ["stun"]),
        {"(Intercept)": (85.6, 7.601, 3), "stun2.5V": (-64.1, 10.292, 3), "stun3V": (-84.6, 11.402, 3)},
        21899.6, 14, 3466.7, 12, 132.21, 288.8917,
    )


def test_duration_by_temperature(spark):
    check(
        fit_linear(durations(spark, ["-2.5", "0", "2.5_5"]), "total", ["stun"]),
        {"(Intercept)": (47.4, 16.23, 2), "stun0": (38.2, 22.95, 2), "stun2.5_5": (100.8, 22.95, 2)},
        41693, 14, 15795, 12, 154.96, 1316.267,
    )


def test_time_by_stage_and_cohort(spark):
    df = spark.createDataFrame(behaviour(MAIN_TIMES), BEHAVIOUR)
    rows = check(
        fit_linear(df, "seconds", ["stage", "cohort"]),
        {"(Intercept)": (179.7, 143.3, 1), "stagestage_4": (1256.0, 202.6, 1), "cohort3_20": (1303.8, 286.6, 1)},
        6870588, 13, 1354979, 11, 208.45, 123179.9,
    )
    assert rows["stagestage_4"].p_value == pytest.approx(6.73e-5, rel=1e-3)


def test_one_second_stun(spark):
    df = spark.createDataFrame(behaviour(ONE_SECOND_TIMES), BEHAVIOUR)
    rows = check(
        fit_linear(df, "seconds", ["stage", "cohort"]),
        {"(Intercept)": (20.02, 10.02, 2), "stagestage_4": (35.45, 11.57, 2), "cohort2_1": (-24.45, 11.57, 2)},
        68112, 39, 49567, 37, 406.40, 1339.647,
    )
    assert rows["cohort2_1"].p_value == pytest.approx(0.04146, abs=1e-5)


def test_agrees_with_the_built_in_regression(spark):
    df = spark.createDataFrame(behaviour(ONE_SECOND_TIMES), BEHAVIOUR)
    formula = RFormula(formula="seconds ~ stage + cohort", stringIndexerOrderType="alphabetDesc")
    model = GeneralizedLinearRegression(family="gaussian").fit(formula.fit(df).transform(df))
    ours = {r.term: r.estimate for r in fit_linear(df, "seconds", ["stage", "cohort"]).coefficients.collect()}
    theirs = [model.intercept, *model.coefficients]
    assert sorted(ours.values()) == pytest.approx(sorted(theirs))


def test_aliased_term_has_no_coefficient(spark):
    rows = [(a, a, float(i % 3)) for i, a in enumerate("xyxyxyyx")]
    df = spark.createDataFrame(rows, "f string, g string, y double")
    found = {r.term: r.estimate for r in fit_linear(df, "y", ["f", "g"]).coefficients.collect()}
    assert found["gy"] is None and found["fy"] is not None


def test_t_tail():
    assert two_sided_p(1.998, 37) == pytest.approx(0.05311, abs=1e-4)
    assert two_sided_p(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert two_sided_p(0.0, 3) == 1.0


# --- mixed models ----------------------------------------------------------------


def simulated(files, bins, missing=(), between=0.41, within=0.15, seed=3):
    """Responses with exactly the given variance components when balanced."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(files):
        shift = rng.normal(0, math.sqrt(between))
        rows += [
            (f"f{f}", b, 3 + 0.1 * b + shift + rng.normal(0, math.sqrt(within)))
            for b in bins if (f, b) not in missing
        ]
    return rows


def dense_reml(rows):
    """Brute force: full covariance matrices and a fine search."""
    files = sorted({r[0] for r in rows})
    bins = sorted({r[1] for r in rows})
    x = np.array([[1.0] + [float(r[1] == b) for b in bins[1:]] for r in rows])
    z = np.array([[float(r[0] == f) for f in files] for r in rows])
    y = np.array([r[2] for r in rows])
    n, p = x.shape

    def fit(ratio):
        v = np.eye(n) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        a = x.T @ vi @ x
        beta = np.linalg.solve(a, x.T @ vi @ y)
        r = y - x @ beta
        s = r @ vi @ r / (n - p)
        dev = (n - p) * math.log(s) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
        return dev, s, beta, np.linalg.inv(a) * s

    lo, hi = -6.0, 6.0
    for _ in range(12):
        grid = np.linspace(lo, hi, 21)
        best = grid[int(np.argmin([fit(math.exp(g))[0] for g in grid]))]
        step = grid[1] - grid[0]
        lo, hi = best - step, best + step
    ratio = math.exp(best)
    _, s, beta, cov = fit(ratio)
    return beta, np.sqrt(np.diag(cov)), ratio * s, s


def fitted(spark, rows):
    df = spark.createDataFrame(rows, "file string, bin int, y double").repartition(4)
    out = fit_random_intercept(df, "y", "bin", "file").collect()
    fixed = [r for r in out if r.effect == "fixed"]
    spread = {r.group: r.estimate**2 for r in out if r.effect == "ran_pars"}
    return fixed, spread["file"], spread["Residual"]


def test_mixed_model_against_dense_matrices(spark):
    rows = simulated(6, [-1, *range(2, 9)], missing={(0, 3), (1, 3), (2, 8)})
    fixed, between, within = fitted(spark, rows)
    beta, errors, dense_between, dense_within = dense_reml(rows)
    assert [r.estimate for r in fixed] == pytest.approx(list(beta), abs=1e-6)
    assert [r.std_error for r in fixed] == pytest.approx(list(errors), rel=1e-5)
    assert (between, within) == pytest.approx((dense_between, dense_within), rel=1e-5)


def test_balanced_identities(spark):
    bins = [-1, *range(2, 31)]
    fixed, between, within = fitted(spark, simulated(5, bins))
    assert [r.term for r in fixed[:2]] == ["(Intercept)", "bin2"]
    assert fixed[0].std_error == pytest.approx(math.sqrt((between + within) / 5), rel=1e-6)
    for r in fixed[1:]:
        assert r.std_error == pytest.approx(math.sqrt(2 * within / 5), rel=1e-6)
        assert r.df == pytest.approx(4 * (len(bins) - 1), rel=1e-4)


def test_published_degrees_of_freedom(spark):
    """Same design and variance ratio as a published fit: 7.2263, 112.0622, 112.0."""
    bins = [-1, *range(2, 31)]
    missing = {(f, 2) for f in range(4)}
    rng = np.random.default_rng(1)
    rows = simulated(5, bins, missing, 0.0, 1.0)
    # Shape the data until the fit has the published variance components.
    shifts = rng.normal(0, 1, 5)
    scale_b, scale_w = math.sqrt(0.411), math.sqrt(0.1496)
    for _ in range(25):
        data = [
            (f, b, float(shifts[int(f[1])] * scale_b + (y - 3 - 0.1 * b) * scale_w)) for f, b, y in rows
        ]
        _, _, got_b, got_w = dense_reml(data)
        scale_b *= math.sqrt(0.411 / got_b)
        scale_w *= math.sqrt(0.1496 / got_w)
    fixed, between, within = fitted(spark, data)
    assert (between, within) == pytest.approx((0.411, 0.1496), rel=1e-3)
    assert [round(r.std_error, 3) for r in fixed[:3]] == [0.335, 0.428, 0.245]
    assert [r.df for r in fixed[:3]] == pytest.approx([7.2263, 112.0622, 112.0], rel=2e-3)


def test_no_variation_between_groups(spark):
    rows = [(f"f{f}", b, float(b + (1 if (f + b) % 2 else -1))) for f in range(4) for b in range(4)]
    fixed, between, within = fitted(spark, rows)
    assert between == 0
    assert {r.df for r in fixed} == {12.0}


def test_class_totals_in_spark_equal_local(spark, monkeypatch):
    rows = simulated(4, range(4), missing={(0, 1)})
    local = fitted(spark, rows)
    monkeypatch.setattr(mixed_models, "MAX_LOCAL_TOTALS", 0)
    monkeypatch.setattr(mixed_models, "_minimise", lambda f, highest: math.log(local[1] / local[2]))
    remote = fitted(spark, rows)
    assert [r.estimate for r in remote[0]] == pytest.approx([r.estimate for r in local[0]])
    assert [r.df for r in remote[0]] == pytest.approx([r.df for r in local[0]], rel=1e-6)


def test_steps_in_spark_are_few(spark, monkeypatch):
    """The whole fit with every sum taken in Spark."""
    rows = simulated(5, range(5), missing={(0, 1), (3, 2)})
    local = fitted(spark, rows)
    monkeypatch.setattr(mixed_models, "MAX_LOCAL_TOTALS", 0)
    spark.sparkContext.setJobGroup("reml", "reml")
    remote = fitted(spark, rows)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("reml"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.df for r in remote[0]] == pytest.approx([r.df for r in local[0]], rel=1e-6)
    assert jobs <= 45


def test_one_level_is_the_intercept_only(spark):
    fixed, between, within = fitted(spark, [(f"f{i % 4}", 1, float(i % 4 * 3 + i % 3)) for i in range(40)])
    assert [r.term for r in fixed] == ["(Intercept)"] and between > within > 0


def test_fit_without_noise_is_open_about_it(spark):
    fixed, between, within = fitted(spark, [(f"f{f}", b, float(f * f + b)) for f in range(5) for b in range(4)])
    assert within == 0 and between == pytest.approx(np.var([0, 1, 4, 9, 16], ddof=1), rel=1e-3)
    assert [r.estimate for r in fixed] == pytest.approx([6, 1, 2, 3])
    assert all(math.isnan(r.df) and math.isnan(r.p_value) for r in fixed)


def test_many_cells_and_levels(spark):
    cells = spark.range(200_000).selectExpr("id % 500 AS a", "id DIV 500 AS b", "cast(id % 7 AS double) AS y")
    fit = fit_linear(cells.selectExpr("a % 40 AS a", "b", "y"), "y", ["a", "b"]).fit.first()
    assert (fit.n, fit.df_residual) == (200_000, 200_000 - 40 - 399)
    many = spark.range(6_003).selectExpr("id % 2001 AS bin", "id DIV 9 AS file", "cast(id % 11 + id DIV 9 % 5 AS double) AS y")
    assert fit_random_intercept(many, "y", "bin", "file").count() == 2003


def test_constant_response_and_numeric_levels(spark):
    df = spark.createDataFrame([(i % 12, 1.0) for i in range(40)], "f int, y double")
    found = fit_linear(df, "y", ["f"])
    assert [r.term for r in found.coefficients.collect()] == ["(Intercept)", *[f"f{i}" for i in range(1, 12)]]
    row = found.fit.first()
    assert (row.deviance, row.null_deviance, row.aic) == (0.0, 0.0, -math.inf)
    assert all(math.isnan(r.statistic) for r in found.coefficients.collect())
