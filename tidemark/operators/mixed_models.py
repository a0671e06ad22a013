"""Random-intercept model ``response ~ factor + (1 | group)`` fitted by REML.

Spark reduces the rows to counts and sums per group and level, then folds the
groups into classes of equal size: two groups with the same number of rows weigh
the same in every REML step, so only the class totals of their cross products
are needed. The optimiser works on those totals. When there are too many classes
for the driver, each step is a Spark aggregate over the saved class table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.t_distribution import two_sided_p
from tidemark.session import save_stage

PAIRS_AT_ONCE = 2_000_000  # level pairs of groups that a task folds in one step
LARGEST_LOG_RATIO = 60.0  # beyond this the residual variance is taken as zero
MAX_LOCAL_TOTALS = 2_000_000
NOISE_FREE = 1e-7  # residual share of the response's variation that is rounding
TIDY = (
    "effect string, group string, term string, estimate double, std_error double, "
    "statistic double, df double, p_value double"
)


def fit_random_intercept(df: DataFrame, response: str, factor: str, group: str) -> DataFrame:
    """Tidy coefficient table with Satterthwaite degrees of freedom.

    Fixed effects use treatment contrasts against the first level; a factor of one level
    has the intercept only. The last two rows are the standard deviations of the
    intercepts and of the residuals. A fit without residual noise has no degrees of
    freedom to estimate it by: ``df`` and ``p_value`` are NaN. The driver holds a levels x
    levels matrix.
    """
    totals = _Totals.of(df, response, factor, group)
    fit = _Reml(totals).solve()
    terms = ["(Intercept)"] + [f"{factor}{level}" for level in totals.levels[1:]]
    fixed = []
    for j, term in enumerate(terms):
        estimate, error = float(fit.beta[j]), math.sqrt(fit.covariance[j, j])
        estimate += totals.centre if j == 0 else 0.0
        t, dof = estimate / error if error else float("nan"), float(fit.dof[j])
        fixed.append(("fixed", None, term, estimate, error, t, dof, two_sided_p(t, dof)))
    spread = [
        ("ran_pars", group, "sd__(Intercept)", math.sqrt(fit.between)),
        ("ran_pars", "Residual", "sd__Observation", math.sqrt(fit.within)),
    ]
    rows = fixed + [(*s, None, None, None, None) for s in spread]
    return df.sparkSession.createDataFrame(rows, TIDY)


@dataclass
class _Totals:
    """Sums over all rows, and a way to sum group cross products with weights."""

    levels: list
    centre: float
    rows: int
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    weigh: Callable[[list], Iterable[np.ndarray]]

    @classmethod
    def of(cls, df: DataFrame, response: str, factor: str, group: str) -> _Totals:
        y = F.col(response).cast("double")
        rows = df.select(
            F.col(group).alias("g"), F.col(factor).alias("f"), F.when(~F.isnan(y), y).alias("y")
        ).na.drop()
        cells = save_stage(
            rows.groupBy("g", "f").agg(
                F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("v")
            )
        )
        # Centring the response keeps the sums of squares accurate.
        centre = cells.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).first()[0] or 0.0
        off = F.col("mean") - F.lit(centre)
        cells = cells.select(
            "g", "f", "n", (F.col("n") * off).alias("s"), (F.col("n") * (F.col("v") + off * off)).alias("ss")
        )
        per_level = cells.groupBy("f").agg(F.sum("n"), F.sum("s"), F.sum("ss"))
        found = sorted(map(tuple, per_level.collect()))
        if not found:
            raise ValueError("no complete rows to fit")
        levels = [r[0] for r in found]
        n, s, ss = (np.array([r[i] for r in found], dtype=float) for i in (1, 2, 3))
        classes = save_stage(_class_totals(cells, levels))
        return cls(
            levels, centre, int(n.sum()), _treatment(np.diag(n)), _treatment(s), float(ss.sum()),
            _weigher(classes, len(levels)),
        )


def _treatment(a: np.ndarray) -> np.ndarray:
    """From one-hot levels to an intercept plus contrasts with the first level."""
    a = a.copy()
    a[0] = a.sum(axis=0)
    if a.ndim == 2:
        a[:, 0] = a.sum(axis=1)
    return a


def _class_totals(cells: DataFrame, levels: list) -> DataFrame:
    """``size, pos, total``: per group size, the sums of the cross products.

    Positions hold x x' (p*p), x t (p), t*t and the number of groups, where x
    counts a group's rows per level and t sums its response.
    """
    p = len(levels)
    index = cells.sparkSession.createDataFrame(list(enumerate(levels)), ["i", "f"])
    index = index.select(F.col("i").cast("int"), F.col("f").cast(cells.schema["f"].dataType))
    # One entry per level, so at most p entries per group.
    vectors = cells.join(F.broadcast(index), "f").groupBy("g").agg(
        F.collect_list("i").alias("i"), F.collect_list("n").alias("n"), F.sum("s").alias("t")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["i"].map(len).to_numpy()
            # Groups in runs of bounded pair count; a group is p*p pairs at most.
            run = np.cumsum(lengths.astype(np.int64) ** 2) // PAIRS_AT_ONCE
            for _, part in batch.groupby(run):
                yield _fold(part, p)

    partial = vectors.select("i", "n", "t").mapInPandas(fold, "size long, pos long, total double")
    return partial.groupBy("size", "pos").agg(F.sum("total").alias("total"))


def _fold(groups: pd.DataFrame, p: int) -> pd.DataFrame:
    """Sums of the groups' cross products by group size and position; only level pairs
    that a group has are formed."""
    size, pos, value = [], [], []
    for i, n, t in zip(groups["i"], groups["n"], groups["t"]):
        i, n = np.asarray(i, np.int64), np.asarray(n, float)
        pairs = (i[:, None] * p + i).ravel()
        pos += [pairs, p * p + i, [p * p + p, p * p + p + 1]]
        value += [np.outer(n, n).ravel(), n * t, [t * t, 1.0]]
        size.append(np.full(len(pairs) + len(i) + 2, int(n.sum())))
    if not size:
        return pd.DataFrame({"size": [], "pos": [], "total": []}).astype({"size": int, "pos": int})
    frame = pd.DataFrame(
        {"size": np.concatenate(size), "pos": np.concatenate(pos), "total": np.concatenate(value)}
    )
    return frame.groupby(["size", "pos"], as_index=False)["total"].sum()


Weight = Callable[[object], object]


def _weigher(classes: DataFrame, p: int) -> Callable[[list[Weight]], Iterable[np.ndarray]]:
    """``weigh(ws)`` sums every cross product times ``w(group size)`` for each w in ws.

    All weights are taken in one pass, one aggregate in Spark.
    """
    width = p * p + p + 2
    if classes.count() <= MAX_LOCAL_TOTALS:
        local = classes.toPandas()
        size, pos = local["size"].to_numpy(dtype=float), local["pos"].to_numpy()
        value = local["total"].to_numpy()
        # One at a time: with many levels each is large.
        return lambda ws: (np.bincount(pos, weights=value * w(size), minlength=width) for w in ws)

    def distributed(ws: list[Weight]) -> list[np.ndarray]:
        sums = [F.sum(F.col("total") * w(F.col("size"))).alias(f"v{k}") for k, w in enumerate(ws)]
        out = np.zeros((len(ws), width))
        for pos, *values in classes.groupBy("pos").agg(*sums).collect():
            out[:, pos] = values
        return list(out)

    return distributed


@dataclass
class _Fit:
    beta: np.ndarray
    covariance: np.ndarray
    between: float
    within: float
    dof: np.ndarray


class _Reml:
    """Restricted likelihood in (between, within) = variance of groups, residuals."""

    def __init__(self, totals: _Totals):
        self.t = totals
        self.p = len(totals.levels)

    def _parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        p = self.p
        xx = _treatment(v[: p * p].reshape(p, p))
        return xx, _treatment(v[p * p : p * p + p]), v[-2], v[-1]

    def profiles(self, ratios: list[float]) -> list[tuple[float, float]]:
        """Deviance and residual variance at the best fit for each between / within."""
        weights: list[Weight] = []
        for ratio in ratios:
            weights += [lambda n, r=ratio: r / (1 + n * r), lambda n, r=ratio: _log1p(n * r)]
        sums = iter(self.t.weigh(weights))
        free = self.t.rows - self.p
        out = []
        for _ in ratios:
            xx, xt, tt, _ = self._parts(next(sums))
            a, r, q = self.t.xtx - xx, self.t.xty - xt, self.t.yty - tt
            rest, log_det = _rest(a, r, q)
            within = rest / free if free else 0.0
            spread = math.log(2 * math.pi * within) if within else -math.inf
            out.append((free * (spread + 1) + next(sums)[-1] + log_det, within))
        return out

    def gradients(self, points: list[tuple[float, float]]) -> list[tuple]:
        """Deviance gradient, covariance of beta, derivatives of its variances, and beta at
        each (between, within)."""
        weights: list[Weight] = []
        for b, w in points:
            weights += [
                lambda n, b=b, w=w: b / (w + n * b),
                lambda n, b=b, w=w: w / (w + n * b) ** 2,
                lambda n, b=b, w=w: -b / (w + n * b) ** 2,
                lambda n, b=b, w=w: n / (w + n * b),
                lambda n, b=b, w=w: 1 / (w + n * b),
                lambda n: n * 0 + 1,
            ]
        sums = iter(self.t.weigh(weights))
        return [
            self._gradient(between, within, [self._parts(next(sums)) for _ in range(6)])
            for between, within in points
        ]

    def _gradient(self, between: float, within: float, sums: list) -> tuple:
        t = self.t
        xx, xt, tt, _ = sums[0]
        a, r = (t.xtx - xx) / within, (t.xty - xt) / within
        q = (t.yty - tt) / within
        c = np.linalg.inv(a)
        beta = c @ r
        bxx, bxt, btt, _ = sums[1]
        wxx, wxt, wtt, _ = sums[2]
        slopes = [
            (-bxx / within, -bxt / within, -btt / within),
            (-a / within - wxx / within, -r / within - wxt / within, -q / within - wtt / within),
        ]
        logs = [sums[3][3], (t.rows - sums[5][3]) / within + sums[4][3]]
        grad = np.array(
            [
                dq - 2 * dr @ beta + beta @ da @ beta + dlog + np.sum(c * da)
                for (da, dr, dq), dlog in zip(slopes, logs)
            ]
        )
        # How the variances of beta change, on demand: a product of whole matrices each.
        changes = (-np.einsum("ij,ij->i", c @ da, c) for da, _, _ in slopes)
        return grad, c, changes, beta

    def solve(self) -> _Fit:
        (_, at_most), = self.profiles([math.exp(18.0)])
        if at_most * self.t.rows <= NOISE_FREE * self.t.yty:
            return self._without_noise()
        log_ratio = _minimise(
            lambda zs: [d for d, _ in self.profiles([math.exp(z) for z in zs])], LARGEST_LOG_RATIO
        )
        ratio = math.exp(log_ratio)
        (none, at_none), (best, at_best) = self.profiles([0.0, ratio])
        if none <= best and at_none > 0:
            ratio, at_best = 0.0, at_none  # no variation between groups: ordinary least squares
        if not at_best or log_ratio >= LARGEST_LOG_RATIO - 1:
            return self._without_noise()
        between, within = ratio * at_best, at_best
        if ratio:
            between, within, hessian = self._polished(between, within)
        _, c, changes, beta = self.gradients([(between, within)])[0]
        if not ratio:
            dof = np.full(self.p, float(self.t.rows - self.p))
            return _Fit(beta, c, between, within, dof)
        v = 2 * np.linalg.inv(hessian)
        g = np.stack(list(changes))
        dof = 2 * np.diag(c) ** 2 / np.einsum("ij,ik,kj->j", g, v, g)
        return _Fit(beta, c, between, within, dof)

    def _without_noise(self) -> _Fit:
        """Levels and groups explain every row: the intercepts' variance is all there is."""
        ratio = math.exp(18.0)
        (_, within), = self.profiles([ratio])
        groups = next(iter(self.t.weigh([lambda n: n * 0 + 1])))[-1]
        # All that is left of the sum of squares lies between the groups.
        between = within * ratio * (self.t.rows - self.p) / max(groups - 1, 1)
        _, c, _, beta = self.gradients([(1.0, 1 / ratio)])[0]
        return _Fit(beta, c * between, between, 0.0, np.full(self.p, np.nan))

    def _polished(self, between: float, within: float) -> tuple[float, float, np.ndarray]:
        """Newton steps on the exact gradient; the Hessian at the point reached."""
        at = np.array([between, within])
        for _ in range(2):
            hessian, gradient = self._hessian(*at)
            step = np.linalg.solve(hessian, gradient)
            if np.any(np.abs(step) > 0.01 * at) or np.all(np.abs(step) < 1e-9 * at):
                break
            at = at - step
        return float(at[0]), float(at[1]), hessian

    def _hessian(self, between: float, within: float) -> tuple[np.ndarray, np.ndarray]:
        """Central differences of the exact gradient, extrapolated once; and the gradient."""
        at = np.array([between, within])
        points, steps = [at], []
        for axis in range(2):
            for share in (1e-3, 5e-4):
                step = np.zeros(2)
                step[axis] = share * at[axis]
                steps.append(step[axis])
                points += [at + step, at - step]
        found = [g for g, *_ in self.gradients([tuple(x) for x in points])]
        slope = [(found[2 * k + 1] - found[2 * k + 2]) / (2 * h) for k, h in enumerate(steps)]
        matrix = np.stack([(4 * slope[2 * a + 1] - slope[2 * a]) / 3 for a in range(2)])
        return (matrix + matrix.T) / 2, found[0]


def _rest(a: np.ndarray, r: np.ndarray, q: float) -> tuple[float, float]:
    """q - r' a^-1 r, not below 0, and log det a, from one factorisation of both.

    Without noise, or at extreme ratios, the factor may not exist.
    """
    try:
        root = np.diag(np.linalg.cholesky(np.block([[a, r[:, None]], [r, np.array([q])]])))
        return float(root[-1] ** 2), 2 * float(np.log(root[:-1]).sum())
    except np.linalg.LinAlgError:
        sign, log_det = np.linalg.slogdet(a)
        rest = q - float(r @ np.linalg.lstsq(a, r)[0])
        return max(rest, 0.0), log_det if sign > 0 else math.inf


def _log1p(x):
    return F.log1p(x) if isinstance(x, Column) else np.log1p(x)


def _minimise(f: Callable[[list[float]], list[float]], highest: float) -> float:
    """Smallest point of a wide grid, refined by ever finer grids.

    ``f`` values many points in one pass. The grid is widened up to ``highest`` while its
    best point is the last one.
    """
    low, high = -18.0, 18.0
    while True:
        grid = np.linspace(low, high, 37)
        best = int(np.argmin(f(list(grid))))
        if best < len(grid) - 1 or high >= highest:
            break
        low, high = high - 1, min(high + 36, highest)
    while grid[1] - grid[0] > 1e-4:  # Newton steps finish the search
        a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        grid = np.linspace(a, b, 11)
        best = int(np.argmin(f(list(grid))))
    return float(grid[best])
