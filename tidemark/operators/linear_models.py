"""Gaussian linear models on categorical factors.

Everything the normal equations need are counts of levels and of pairs of levels and the
response's sums per level, which Spark aggregates from one table of factor cells. The driver
holds a terms x terms matrix, however many cells there are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import known
from tidemark.operators.t_distribution import two_sided_p
from tidemark.session import save_stage

ALIASED = 1e-9  # share of a term's own sum of squares that earlier terms must leave
LOCAL_CELLS = 1000  # so many cells are brought to the driver at once
NOISE_FREE = 1e-12  # deviance below this share of the null deviance is rounding

COEFFICIENTS = "term string, estimate double, std_error double, statistic double, p_value double"
FIT = (
    "n long, null_deviance double, df_null long, deviance double, df_residual long, "
    "dispersion double, aic double"
)


@dataclass(frozen=True)
class LinearFit:
    coefficients: DataFrame
    fit: DataFrame

    def summary(self) -> DataFrame:
        """Coefficients with the fit statistics repeated on each row."""
        row = self.fit.first().asDict()
        return self.coefficients.withColumns({name: F.lit(v) for name, v in row.items()})


def fit_linear(df: DataFrame, response: str, factors: Sequence[str]) -> LinearFit:
    """``response ~ factor1 + factor2 ...`` with treatment contrasts.

    The reference level of a factor is its smallest level, numbers in numeric and text in
    text order. Rows with a missing response or factor are left out. A fit without any
    residual has an AIC of minus infinity, and no test.
    """
    spark = df.sparkSession
    y = known(F.col(response).cast("double"))
    rows = df.select(*[F.col(f).alias(f) for f in factors], y.alias("__y")).na.drop()
    cells = save_stage(rows.groupBy(*factors).agg(
        F.count(F.lit(1)).alias("__n"), F.avg("__y").alias("__mean"), F.var_pop("__y").alias("__v")
    ))
    if cells.count() <= LOCAL_CELLS:
        total, centre, terms, xtx, xty, null_deviance = _from_cells(cells, factors)
    else:
        total, centre, terms, xtx, xty, null_deviance = _from_table(cells, factors)

    kept = _independent(xtx)
    p, df_residual = len(kept), total - len(kept)
    inverse = np.linalg.inv(xtx[np.ix_(kept, kept)])
    beta = inverse @ xty[kept]
    deviance = null_deviance - float(beta @ xty[kept])
    if deviance <= NOISE_FREE * null_deviance:
        deviance = 0.0
    dispersion = deviance / df_residual if df_residual else float("nan")
    spread = math.log(2 * math.pi * deviance / total) if deviance else -math.inf
    aic = total * (spread + 1) + 2 * (p + 1)
    errors = np.sqrt(dispersion * np.diag(inverse))
    beta[0] += centre
    out = [(t, None, None, None, None) for t in terms]
    for j, b, e in zip(kept, map(float, beta), map(float, errors)):
        t = b / e if e else float("nan")
        out[j] = (terms[j], b, e, t, two_sided_p(t, df_residual))
    fit = [(total, null_deviance, total - 1, deviance, df_residual, dispersion, aic)]
    return LinearFit(spark.createDataFrame(out, COEFFICIENTS), spark.createDataFrame(fit, FIT))


Equations = tuple[int, float, list[str], np.ndarray, np.ndarray, float]


def _from_cells(cells: DataFrame, factors: Sequence[str]) -> Equations:
    """Normal equations of a few cells, read in one job."""
    labels = [F.col(f).cast("string").alias(f"__label{i}") for i, f in enumerate(factors)]
    held = cells.select(*factors, *labels, "__n", "__mean", "__v").collect()
    if not held:
        raise ValueError("no complete rows to fit")
    n, mean, spread = (np.array([r[c] for r in held], float) for c in ("__n", "__mean", "__v"))
    centre = float(n @ mean / n.sum())
    off = mean - centre
    columns, terms = [np.ones(len(held))], ["(Intercept)"]
    for i, f in enumerate(factors):
        named = {r[f]: r[f"__label{i}"] for r in held}
        for level in sorted(named)[1:]:  # the reference level has no term of its own
            columns.append(np.array([r[f] == level for r in held], float))
            terms.append(f"{f}{named[level]}")
    x = np.column_stack(columns)
    return (int(n.sum()), centre, terms, x.T @ (x * n[:, None]), x.T @ (n * off),
            float((n * (spread + off * off)).sum()))


def _from_table(cells: DataFrame, factors: Sequence[str]) -> Equations:
    """Normal equations of many cells, which stay in Spark."""
    n = F.col("__n")
    total, centre = cells.agg(F.sum("__n"), F.sum(n * F.col("__mean")) / F.sum("__n")).first()
    # Centring the response keeps the sums of squares accurate.
    off = F.col("__mean") - F.lit(centre)
    cells = cells.withColumns({"__s": n * off, "__ss": n * (F.col("__v") + off * off)})
    terms, xtx, xty = _normal_equations(cells, factors)
    null_deviance = float(cells.agg(F.sum("__ss")).first()[0])
    return total, centre, terms, xtx, xty, null_deviance


def _normal_equations(
    cells: DataFrame, factors: Sequence[str]
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Term names, X'X and X'y from level and level-pair counts."""
    place: list[dict] = []
    terms, counts, sums = ["(Intercept)"], [], []
    for f in factors:
        label = F.col(f).cast("string").alias("__label")
        found = cells.groupBy(F.col(f).alias("__f"), label).agg(F.sum("__n"), F.sum("__s")).collect()
        found.sort(key=lambda r: r[0])
        # The reference level has no term of its own.
        place.append({r[0]: len(terms) + i - 1 for i, r in enumerate(found) if i})
        terms += [f"{f}{r[1]}" for r in found[1:]]
        counts += [float(r[2]) for r in found[1:]]
        sums += [float(r[3]) for r in found[1:]]
    total, whole = cells.agg(F.sum("__n"), F.sum("__s")).first()
    xtx = np.diag([float(total), *counts])
    xtx[0, 1:] = xtx[1:, 0] = counts
    for (i, f), (j, g) in itertools.combinations(enumerate(factors), 2):
        for a, b, both in cells.groupBy(f, g).agg(F.sum("__n")).collect():
            if a in place[i] and b in place[j]:
                xtx[place[i][a], place[j][b]] = xtx[place[j][b], place[i][a]] = float(both)
    return terms, xtx, np.array([float(whole), *sums])


def _independent(xtx: np.ndarray) -> list[int]:
    """Terms that earlier ones do not determine, by elimination in order."""
    rest, own, kept = xtx.copy(), np.diag(xtx).copy(), []
    for j in range(len(xtx)):
        if rest[j, j] > ALIASED * own[j]:
            kept.append(j)
            rest -= np.outer(rest[:, j], rest[j]) / rest[j, j]
    return kept
