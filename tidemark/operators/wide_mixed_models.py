"""Random-intercept model ``response ~ factor + (1 | group)`` for factors of very many levels.

The levels are eliminated first: given the groups' intercepts a level's mean needs its own rows
only. What is left are equations between groups, summed over the levels' table by Spark. Their
eigenvalues turn the restricted likelihood, its gradient and its Hessian into sums of one term
per group, and estimates, errors and degrees of freedom are computed level by level in Spark.
The driver holds a groups x groups matrix; no levels x levels matrix exists anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import known
from tidemark.operators.mixed_models import LARGEST_LOG_RATIO, NOISE_FREE, TIDY, _minimise
from tidemark.operators.t_distribution import two_sided_p
from tidemark.session import save_stage

MOST_GROUPS = 1000  # a matrix of 8 MB on the driver and in each task
ENTRIES_AT_ONCE = 2_000_000  # of the dense block of levels that a task handles
UNRELATED = 1e-10  # eigenvalues below this share of the largest are zero


def fit_random_intercept_wide(df: DataFrame, response: str, factor: str, group: str) -> DataFrame:
    """The table of :func:`fit_random_intercept`, for few groups and any number of levels.

    Contrasts are against the smallest level, whose mean is the intercept; terms name a level
    by its text. Rows with a missing response, level or group are left out. More than
    ``MOST_GROUPS`` groups are refused. Without variation between groups the fit is that of
    ordinary least squares; without residual noise there are no degrees of freedom.
    """
    y = known(F.col(response).cast("double"))
    rows = df.select(F.col(group).alias("g"), F.col(factor).alias("f"), y.alias("y")).na.drop()
    cells = save_stage(rows.groupBy("g", "f").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("v")
    ))
    groups = _groups(cells)
    total, centre, first = cells.agg(
        F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n"), F.min("f")
    ).first()
    # Centring the response keeps the sums of squares accurate.
    off = F.col("mean") - F.lit(float(centre))
    index = df.sparkSession.createDataFrame([(i, r.g) for i, r in enumerate(groups)], ["i", "g"])
    index = index.select(F.col("i").cast("int"), F.col("g").cast(cells.schema["g"].dataType))
    placed = cells.join(F.broadcast(index), "g").withColumns(
        {"s": F.col("n") * off, "ss": F.col("n") * (F.col("v") + off * off)}
    )
    # A level has at most one entry per group.
    levels = save_stage(placed.groupBy("f").agg(
        F.collect_list(F.struct("i", "n")).alias("rows"), F.sum("n").alias("d"),
        F.sum("s").alias("s"), F.sum("ss").alias("ss"),
    ))
    sizes = np.array([r.n for r in groups], float)
    sums = np.array([r.t - r.n * centre for r in groups], float)
    equations = _equations(levels, total, sizes, sums)
    fit = equations.solve()
    base = _shares(pd.DataFrame([levels.where(F.col("f") == first).first().asDict()]), len(groups))[0]
    return _table(levels, factor, group, first, float(centre), equations, fit, base)


def _groups(cells: DataFrame) -> list:
    sums = cells.groupBy("g").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("t")
    ).orderBy("g")
    found = sums.limit(MOST_GROUPS + 1).collect()
    if not found:
        raise ValueError("no complete rows to fit")
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: use fit_random_intercept")
    return found


def _shares(levels: pd.DataFrame, groups: int) -> np.ndarray:
    """Per level (row) the share of its rows that each group has."""
    out = np.zeros((len(levels), groups))
    for k, (entries, d) in enumerate(zip(levels["rows"], levels["d"])):
        for entry in entries:
            out[k, entry["i"]] = entry["n"] / d
    return out


def _blocks(batches: Iterator[pd.DataFrame], groups: int) -> Iterator[pd.DataFrame]:
    step = max(ENTRIES_AT_ONCE // groups, 1)
    for batch in batches:
        for start in range(0, len(batch), step):
            yield batch.iloc[start : start + step]


def _equations(levels: DataFrame, total: int, sizes: np.ndarray, sums: np.ndarray) -> _Equations:
    """What the groups' equations lose to the levels, one partial matrix per task."""
    g = len(sizes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lost, mean = np.zeros((g, g)), np.zeros(g)
        count, logs, rest = 0, 0.0, 0.0
        for block in _blocks(batches, g):
            share, d = _shares(block, g), block["d"].to_numpy(float)
            s = block["s"].to_numpy(float)
            lost += share.T @ (share * d[:, None])
            mean += share.T @ s
            count += len(block)
            logs += float(np.log(d).sum())
            rest += float((block["ss"].to_numpy(float) - s * s / d).sum())
        scalars = np.zeros(g + 3)
        scalars[:3] = count, logs, rest
        if count:
            yield pd.DataFrame({"row": range(g + 2), "value": [*lost, mean, scalars]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "value": [np.sum(np.stack(part["value"]), axis=0)]})

    shape = "row int, value array<double>"
    # A row of the matrix meets itself once per task: tasks x groups numbers.
    summed = levels.mapInPandas(partial, shape).groupBy("row").applyInPandas(add, shape)
    found = {r.row: np.array(r.value) for r in summed.collect()}
    lost = np.stack([found[i] for i in range(g)])
    count, logs, rest = found[g + 1][:3]
    squares = float(levels.agg(F.sum("ss")).first()[0])
    return _Equations.of(total, int(count), np.diag(sizes) - lost, sums - found[g], logs, rest, squares)


@dataclass
class _Equations:
    """The groups' equations in the directions of their eigenvectors.

    ``size`` are the eigenvalues, ``pull`` the right side, ``share`` the sum of squares that
    each direction explains, ``noise`` what no direction does, ``free`` its degrees of freedom.
    """

    rows: int
    levels: int
    turn: np.ndarray
    size: np.ndarray
    pull: np.ndarray
    share: np.ndarray
    noise: float
    free: int
    logs: float
    squares: float

    @classmethod
    def of(cls, rows, levels, matrix, right, logs, rest, squares) -> _Equations:
        size, turn = np.linalg.eigh((matrix + matrix.T) / 2)
        there = size > UNRELATED * max(float(size.max()), 1.0)
        size = np.where(there, size, 0.0)
        pull = np.where(there, turn.T @ right, 0.0)
        share = np.divide(pull**2, size, out=np.zeros(len(size)), where=there)
        free = rows - levels - int(there.sum())
        return cls(rows, levels, turn, size, pull, share, max(rest - float(share.sum()), 0.0),
                   free, logs, squares)

    def deviance(self, between: float, within: float) -> float:
        """-2 log of the restricted likelihood."""
        there = self.size > 0
        v = within + between * self.size[there]
        all_free = self.rows - self.levels
        return float(
            all_free * math.log(2 * math.pi) + self.logs + self.free * math.log(within)
            + np.log(v).sum() + self.noise / within + (self.share[there] / v).sum()
        )

    def slopes(self, between: float, within: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the deviance in (between, within)."""
        there = self.size > 0
        a, e = self.size[there], self.share[there]
        v = within + between * a
        first, second = 1 / v - e / v**2, 2 * e / v**3 - 1 / v**2
        gradient = np.array([
            (a * first).sum(), first.sum() + self.free / within - self.noise / within**2
        ])
        cross = (a * second).sum()
        own = second.sum() - self.free / within**2 + 2 * self.noise / within**3
        return gradient, np.array([[(a * a * second).sum(), cross], [cross, own]])

    def _profile(self, ratio: float) -> tuple[float, float]:
        """Deviance (but for constants) and residual variance at the best fit for a ratio."""
        free = self.rows - self.levels
        within = (self.noise + (self.share / (1 + ratio * self.size)).sum()) / free
        spread = math.log(within) if within > 0 else -math.inf
        return free * spread + float(np.log1p(ratio * self.size).sum()), within

    def solve(self) -> _WideFit:
        rank = int((self.size > 0).sum())
        if self.free <= 0 or self.noise <= NOISE_FREE * self.squares:
            per_group = np.divide(self.share, self.size, out=np.zeros(len(self.size)), where=self.size > 0)
            return _WideFit(float(per_group.sum()) / max(rank, 1), 0.0, None)
        log_ratio = _minimise(
            lambda zs: [self._profile(math.exp(z))[0] for z in zs], LARGEST_LOG_RATIO
        )
        ratio = math.exp(log_ratio)
        (none, at_none), (best, within) = self._profile(0.0), self._profile(ratio)
        if none <= best:
            return _WideFit(0.0, at_none, None)
        at = np.array([ratio * within, within])
        for _ in range(5):
            gradient, hessian = self.slopes(*at)
            step = np.linalg.solve(hessian, gradient)
            if np.any(np.abs(step) > 0.01 * at) or np.all(np.abs(step) < 1e-14 * at):
                break
            at = at - step
        return _WideFit(float(at[0]), float(at[1]), np.linalg.inv(self.slopes(*at)[1]))


@dataclass
class _WideFit:
    between: float
    within: float
    inverse: np.ndarray | None  # of the Hessian, where both variances are estimated


def _table(levels, factor, group, first, centre, equations, fit, base) -> DataFrame:
    """Coefficients of all levels, computed where the levels are."""
    g, size, turn = len(base), equations.size, equations.turn
    between, within, inverse = fit.between, fit.within, fit.inverse
    v = within + between * size
    # Without noise only directions that no level separates keep the groups' variance.
    pulled = np.divide(between, v, out=np.zeros(g), where=v > 0)
    carried = np.where(size > 0, within * pulled, between)
    if not within:
        pulled = np.divide(1.0, size, out=np.zeros(g), where=size > 0)
    intercepts = turn @ (pulled * equations.pull)
    free = float(equations.rows - equations.levels)
    head = levels.where(F.col("f") == first).select("d", "s").first()
    base_mean, base_d = head.s / head.d - float(base @ intercepts), float(head.d)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, g):
            d = block["d"].to_numpy(float)
            share = _shares(block, g)
            is_first = block["first"].to_numpy(bool)
            mean = block["s"].to_numpy(float) / d - share @ intercepts
            estimate = np.where(is_first, mean + centre, mean - base_mean)
            alone = 1 / d + np.where(is_first, 0.0, 1 / base_d)
            apart = ((share - np.where(is_first[:, None], 0.0, base)) @ turn) ** 2
            variance = within * alone + apart @ carried
            if inverse is not None:
                by_between = apart @ (within / v) ** 2
                by_within = alone + apart @ (between**2 * size / v**2)
                slope = np.stack([by_between, by_within])
                dof = variance**2 / np.einsum("ik,ij,jk->k", slope, inverse, slope)
            else:
                dof = np.full(len(d), free if within else np.nan)
            error = np.sqrt(variance)
            t = np.divide(estimate, error, out=np.full(len(d), np.nan), where=error > 0)
            yield pd.DataFrame({
                "effect": "fixed", "group": None, "is_first": is_first, "label": block["label"],
                "estimate": estimate, "std_error": error, "statistic": t, "df": dof,
                "p_value": [two_sided_p(a, b) for a, b in zip(t, dof)],
            })

    known_levels = levels.select(
        F.col("f").cast("string").alias("label"), (F.col("f") == F.lit(first)).alias("first"),
        "rows", "d", "s",
    )
    schema = TIDY.replace("term string", "is_first boolean, label string")
    fixed = known_levels.mapInPandas(report, schema)
    name = F.when(F.col("is_first"), "(Intercept)").otherwise(F.concat(F.lit(factor), "label"))
    # A NaN leaves pandas as NULL.
    told = [F.coalesce(c, F.lit(math.nan)).alias(c) for c in ("statistic", "df", "p_value")]
    fixed = fixed.select("effect", "group", name.alias("term"), "estimate", "std_error", *told)
    spread = [
        ("ran_pars", group, "sd__(Intercept)", math.sqrt(between), None, None, None, None),
        ("ran_pars", "Residual", "sd__Observation", math.sqrt(within), None, None, None, None),
    ]
    return fixed.unionByName(levels.sparkSession.createDataFrame(spread, TIDY))
