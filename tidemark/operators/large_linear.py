"""Gaussian linear models whose factors have millions of levels.

The normal equations stay in Spark. The factor with most levels is absorbed: its part of the
solution is a mean per level, so the remaining equations are those of the other factors after
taking out these means. They are solved by conjugate gradients, scaled by their diagonal; the
vectors are tables of one row per level, and a step multiplies by passing once over the table of
factor cells. The driver holds scalars only, and no levels x levels matrix exists anywhere.

Where the other factors have few combinations of levels (``spark.tidemark.listedCells``), each
level of the absorbed factor is saved as one row with the list of its cells. One pass over these
rows sums the remaining equations, a table of at most the square of the combinations, and steps
read that table only: the number of steps, solutions and rounds moves no cells.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import known
from tidemark.groups import attach
from tidemark.operators.linear_models import FIT, NOISE_FREE
from tidemark.session import LISTED_CELLS, save_stage, setting


@dataclass(frozen=True)
class LargeFit:
    effects: DataFrame  # factor, level, estimate, std_error: contrasts with each first level
    fit: DataFrame  # one row, the columns of a LinearFit's
    steps: int  # of the longest solution


def fit_linear_large(
    df: DataFrame, response: str, factors: Sequence[str],
    errors: Sequence[tuple[str, object]] = (), tolerance: float = 1e-10, most_steps: int = 500,
) -> LargeFit:
    """``response ~ factor1 + factor2 ...`` with treatment contrasts, as :func:`fit_linear`.

    ``effects`` has the intercept (factor ``(Intercept)``, level NULL) and every level but the
    first of each factor. Standard errors are given for the levels of ``errors`` only, a
    solution each; those of the factor with most levels are not available. Rows with a
    missing response or factor are left out. Factors must be connected: levels that no chain
    of common rows relates to the others cannot be compared, and are refused. With three or
    more factors no other dependence between them is looked for.
    """
    cells = _Cells.of(df, response, list(factors))
    for factor, level in errors:
        if factor == cells.big:
            raise ValueError(f"{factor} is absorbed: its standard errors are not available")
    cells.require_connected()
    right = cells.right_side()
    solution, steps = _solve(cells, right, tolerance, most_steps)
    spread = {}
    for factor, level in errors:
        text = str(level)
        if text == cells.first[factor]:
            raise ValueError(f"{level} is the first level of {factor}")
        here = F.when(F.col("level") == text, 1.0).when(F.col("level") == cells.first[factor], -1.0)
        unit = F.when(F.col("factor") == factor, here)
        contrast = save_stage(cells.diagonal.select(
            "factor", "level", F.coalesce(unit, F.lit(0.0)).alias("value")))
        z, used = _solve(cells, contrast, tolerance, most_steps)
        steps = max(steps, used)
        both = z.select("factor", "level", F.col("value").alias("z")).join(contrast, ["factor", "level"])
        spread[factor, text] = float(both.agg(F.sum(F.col("z") * F.col("value"))).first()[0])
    return _report(df, cells, solution, spread, steps)


@dataclass
class _Cells:
    """Counts and mean responses (centred) of the cells of all factors, levels as text."""

    table: DataFrame
    factors: list[str]
    big: str
    first: dict[str, str]
    n_levels: dict[str, int]
    rows: int
    centre: float
    null_deviance: float
    diagonal: DataFrame = None

    @classmethod
    def of(cls, df: DataFrame, response: str, factors: list[str]) -> _Cells:
        y = known(F.col(response).cast("double"))
        rows = df.select(*factors, y.alias("__y")).na.drop()
        firsts = rows.agg(*[F.min(f).cast("string").alias(f) for f in factors]).first()
        named = [F.col(f).cast("string").alias(f) for f in factors]
        n = F.col("n")
        cells = save_stage(rows.groupBy(*named).agg(
            F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"), F.var_pop("__y").alias("v")))
        total, centre = cells.agg(F.sum("n"), F.sum(n * F.col("mean")) / F.sum("n")).first()
        if not total:
            raise ValueError("no complete rows to fit")
        table = cells.withColumn("mean", F.col("mean") - F.lit(float(centre)))
        null = table.agg(F.sum(n * (F.col("v") + F.col("mean") ** 2))).first()[0]
        sizes = {f: cells.select(f).distinct().count() for f in factors}
        big = max(factors, key=sizes.get)
        others = [f for f in factors if f != big]
        listed = others and math.prod(sizes[f] for f in others) <= setting(df.sparkSession, LISTED_CELLS)
        kind = _ListedCells if listed else cls
        made = kind(table, factors, big, firsts.asDict(), sizes, total, float(centre), float(null))
        made.diagonal = save_stage(made._diagonal())
        return made

    @property
    def rest(self) -> list[str]:
        return [f for f in self.factors if f != self.big]

    def _stacked(self, frame: DataFrame, value: Column, name: str) -> DataFrame:
        """``value`` summed per level of each factor but the absorbed one."""
        parts = [
            frame.groupBy(F.lit(f).alias("factor"), F.col(f).alias("level")).agg(F.sum(value).alias(name))
            for f in self.rest
        ]
        if not parts:
            return frame.select(F.lit("").alias("factor"), F.lit("").alias("level"), value.alias(name)).limit(0)
        return functools.reduce(DataFrame.unionByName, parts)

    def _diagonal(self) -> DataFrame:
        """A level's rows less what the absorbed means take out of them."""
        n = F.col("n")
        sizes = self.table.groupBy(self.big).agg(F.sum("n").alias("size"))
        parts = []
        for f in self.rest:
            pairs = self.table.groupBy(f, self.big).agg(F.sum("n").alias("n"))
            left = attach(pairs, sizes, [self.big])
            parts.append(left.groupBy(F.lit(f).alias("factor"), F.col(f).alias("level")).agg(
                F.sum(n - n * n / F.col("size")).alias("d")))
        empty = self._stacked(self.table, n.cast("double"), "d")
        return functools.reduce(DataFrame.unionByName, parts) if parts else empty

    def with_vectors(self, vector: DataFrame | None, name: str) -> DataFrame:
        """The cells with the sum of a vector's values at their levels."""
        cells, value = self.table, F.lit(0.0)
        for i, f in enumerate(self.rest if vector is not None else []):
            own = vector.where(F.col("factor") == f).select(F.col("level").alias(f), F.col("value").alias(f"__v{i}"))
            cells = attach(cells, own, [f])
            value = value + F.coalesce(F.col(f"__v{i}"), F.lit(0.0))
        return cells.withColumn(name, value).drop(*[f"__v{i}" for i in range(len(self.rest))])

    def absorbed(self, cells: DataFrame, value: Column) -> DataFrame:
        """Mean of ``value`` per level of the absorbed factor."""
        return cells.groupBy(self.big).agg((F.sum(F.col("n") * value) / F.sum("n")).alias("__m"))

    def multiply(self, value: Column, vectors: dict) -> DataFrame:
        """Sums per level of ``value`` less its absorbed means, saved."""
        cells = self.with_vectors(vectors.get("p"), "__q")
        inside = attach(cells, self.absorbed(cells, value), [self.big])
        return save_stage(self._stacked(inside, F.col("n") * (value - F.col("__m")), "value"))

    def right_side(self) -> DataFrame:
        return self.multiply(F.col("mean"), {})

    def product(self, vector: DataFrame) -> DataFrame:
        return self.multiply(F.col("__q"), {"p": vector})

    def remainder(self, x: DataFrame) -> tuple[DataFrame, float]:
        """The absorbed factor's means beside the solution, and the deviance of both."""
        fitted = self.with_vectors(x, "__q")
        own = save_stage(self.absorbed(fitted, F.col("mean") - F.col("__q")))
        off = F.col("mean") - F.col("__q") - F.col("__m")
        squares = attach(fitted, own, [self.big]).agg(F.sum(F.col("n") * (F.col("v") + off * off)))
        return own, float(squares.first()[0])

    def require_connected(self) -> None:
        """Labels spread over common cells until they stop; one label must be left."""
        if not self.rest:
            return
        label = save_stage(self.table.select(self.big).distinct().withColumn("label", F.col(self.big)))
        moved = True
        while moved:
            old = label.withColumnRenamed("label", "old")
            for f in self.rest:
                cells = attach(self.table.select(f, self.big), label, [self.big])
                lower = cells.groupBy(f).agg(F.min("label").alias("low"))
                spread = attach(self.table.select(f, self.big), lower, [f])
                label = save_stage(spread.groupBy(self.big).agg(F.min("low").alias("label")))
            moved = label.join(old, self.big).where(F.col("label") != F.col("old")).limit(1).count() > 0
        groups = label.select("label").distinct().count()
        if groups > 1:
            raise ValueError(f"{groups} unconnected groups of levels cannot be compared")


@dataclass
class _ListedCells(_Cells):
    """Cells as lists, one row per level of the absorbed factor; the other factors have few levels."""

    lists: DataFrame = None
    equations: DataFrame = None  # factor, level, factor2, level2, value
    rights: DataFrame = None

    def _diagonal(self) -> DataFrame:
        n, mean = F.col("n"), F.col("mean")
        self.lists = save_stage(self.table.groupBy(self.big).agg(
            F.sum(n).alias("__size"), (F.sum(n * mean) / F.sum(n)).alias("__m"),
            F.collect_list(F.struct(*self.rest, "n", "mean", "v")).alias("__cells")))
        pairs = self.lists.select("__size", "__m", "__cells", F.explode("__cells").alias("__a")).select(
            "__size", "__m", "__a", F.explode("__cells").alias("__b"))
        a, b = F.col("__a"), F.col("__b")
        same = functools.reduce(Column.__and__, [a[f] == b[f] for f in self.rest])
        value = F.when(same, a["n"]).otherwise(0) - a["n"] / F.col("__size") * b["n"]
        right = F.when(same, a["n"] * (a["mean"] - F.col("__m")))
        levels = [F.array(*[F.struct(F.lit(f).alias("factor"), side[f].alias("level")) for f in self.rest])
                  for side in (a, b)]
        joint = save_stage(pairs.groupBy(levels[0].alias("__a"), levels[1].alias("__b")).agg(
            F.sum(value).alias("value"), F.sum(right).alias("right")))
        own = joint.where(F.col("right").isNotNull()).select("right", F.inline("__a"))
        self.rights = own.groupBy("factor", "level").agg(F.sum("right").alias("value"))
        both = joint.select("value", "__b", F.inline("__a")).select(
            "value", "factor", "level", F.inline("__b").alias("factor2", "level2"))
        self.equations = save_stage(
            both.groupBy("factor", "level", "factor2", "level2").agg(F.sum("value").alias("value")))
        # A level that shares the rows of any absorbed level has 0.5 or more, others only rounding.
        d = F.when(F.col("value") >= 0.25, F.col("value")).otherwise(0.0)
        itself = (F.col("factor") == F.col("factor2")) & (F.col("level") == F.col("level2"))
        return self.equations.where(itself).select("factor", "level", d.alias("d"))

    def right_side(self) -> DataFrame:
        return save_stage(self.rights)

    def product(self, vector: DataFrame) -> DataFrame:
        p = vector.select(
            F.col("factor").alias("factor2"), F.col("level").alias("level2"), F.col("value").alias("p"))
        terms = self.equations.join(F.broadcast(p), ["factor2", "level2"])
        return save_stage(terms.groupBy("factor", "level").agg(F.sum(F.col("value") * F.col("p")).alias("value")))

    def remainder(self, x: DataFrame) -> tuple[DataFrame, float]:
        values = {f: [] for f in self.rest}
        for r in x.collect():  # a value per level of the few
            values[r["factor"]] += [F.lit(r["level"]), F.lit(r["value"])]

        def fitted(cell):
            found = [F.element_at(F.create_map(*values[f]), cell[f]) for f in self.rest]
            return functools.reduce(Column.__add__, found)

        left = F.aggregate("__cells", F.lit(0.0), lambda s, c: s + c["n"] * (c["mean"] - fitted(c)))
        own = self.lists.select(self.big, (left / F.col("__size")).alias("__m"), "__cells")
        cells = own.select("__m", F.explode("__cells").alias("c"))
        cell = F.col("c")
        off = cell["mean"] - fitted(cell) - F.col("__m")
        squares = cells.agg(F.sum(cell["n"] * (cell["v"] + off * off)))
        return own.select(self.big, "__m"), float(squares.first()[0])

    def require_connected(self) -> None:
        links = [((a, b), (c, d)) for a, b, c, d, _ in self.equations.collect()]
        label, moved = {one: one for one, _ in links}, True
        while moved:
            moved = False
            for one, other in links:
                if label[other] < label[one]:
                    label[one], moved = label[other], True
        groups = len(set(label.values()))
        if groups > 1:
            raise ValueError(f"{groups} unconnected groups of levels cannot be compared")


def _solve(cells: _Cells, right: DataFrame, tolerance: float, most_steps: int) -> tuple[DataFrame, int]:
    """Conjugate gradients on the equations without the absorbed factor."""
    scaled = F.when(F.col("d") > 0, F.col("r") / F.col("d")).otherwise(0.0)
    state = right.withColumnRenamed("value", "r").join(cells.diagonal, ["factor", "level"]).withColumns(
        {"x": F.lit(0.0), "p": scaled})
    size = state.agg(F.sum(F.col("r") * scaled)).first()[0] or 0.0
    goal, steps = tolerance**2 * size, 0
    while size > goal and steps < most_steps:
        steps += 1
        state = save_stage(state)
        held = state.select("factor", "level", F.col("p").alias("value"))
        product = cells.product(held).withColumnRenamed("value", "ap")
        met = save_stage(state.join(product, ["factor", "level"]))
        curve = met.agg(F.sum(F.col("p") * F.col("ap"))).first()[0] or 0.0
        if curve <= 0:  # nothing left but rounding
            break
        a = F.lit(size / curve)
        state = met.withColumns({"x": F.col("x") + a * F.col("p"), "r": F.col("r") - a * F.col("ap")}).drop("ap")
        before, size = size, state.agg(F.sum(F.col("r") * scaled)).first()[0]
        state = state.withColumn("p", scaled + F.lit(size / before) * F.col("p"))
    if size > goal and steps == most_steps:
        raise ArithmeticError(f"no solution within {most_steps} steps")
    return save_stage(state.select("factor", "level", F.col("x").alias("value"))), steps


def _report(df: DataFrame, cells: _Cells, x: DataFrame, spread: dict, steps: int) -> LargeFit:
    spark = df.sparkSession
    own, deviance = cells.remainder(x)
    if deviance <= NOISE_FREE * cells.null_deviance:
        deviance = 0.0
    p = 1 + sum(n - 1 for n in cells.n_levels.values())
    free, total = cells.rows - p, cells.rows
    dispersion = deviance / free if free else float("nan")
    log = math.log(2 * math.pi * deviance / total) if deviance else -math.inf
    fit = [(total, cells.null_deviance, total - 1, deviance, free, dispersion, total * (log + 1) + 2 * (p + 1))]

    every = x.unionByName(own.select(
        F.lit(cells.big).alias("factor"), F.col(cells.big).alias("level"), F.col("__m").alias("value")))
    at_first = F.lit(False)
    for f in cells.factors:
        at_first = at_first | ((F.col("factor") == f) & (F.col("level") == cells.first[f]))
    base = dict(every.where(at_first).select("factor", "value").collect())  # one row per factor
    shift = F.lit(None).cast("double")
    for f in cells.factors:
        shift = F.when(F.col("factor") == f, F.lit(base[f])).otherwise(shift)
    error = F.lit(None).cast("double")
    for (f, level), z in spread.items():
        here = (F.col("factor") == f) & (F.col("level") == level)
        error = F.when(here, F.lit(math.sqrt(z * dispersion))).otherwise(error)
    contrasts = every.where(~at_first).select(
        "factor", "level", (F.col("value") - shift).alias("estimate"), error.alias("std_error"))
    intercept = spark.createDataFrame(
        [("(Intercept)", None, cells.centre + sum(base.values()), None)], contrasts.schema)
    return LargeFit(contrasts.unionByName(intercept), spark.createDataFrame(fit, FIT), steps)
