"""Cohort summaries, box-plot statistics, profiles and histograms."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import known
from tidemark.groups import attach, match
from tidemark.quantiles import group_quantiles
from tidemark.session import save_stage


def cohort_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, range and row count per cohort; ``n`` counts missing values too.

    Here and below NaN is a missing value, like NULL.
    """
    df = df.withColumn(value, known(F.col(value)))
    medians = group_quantiles(df, keys, F.col(value), [0.5])
    medians = medians.select(*keys, F.col("quantiles")[0].alias("median_value"))
    plain = df.groupBy(*keys).agg(
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count(F.lit(1)).alias("n"),
    )
    return match(plain, medians, keys, "left")


def stage_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, standard deviation, range and row count per group."""
    df = df.withColumn(value, known(F.col(value)))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("sd_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count(F.lit(1)).alias("n"),
    )


def range_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The range as two rows per group, lower end first."""
    ends = F.posexplode(F.array("min_value", "max_value")).alias("end", "range_value")
    return df.select(*keys, ends)


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and outlier count per group.

    A whisker ends at the furthest value within ``reach`` quartile ranges.
    """
    table = group_quantiles(df, keys, F.col(value), [0.25, 0.5, 0.75])
    q = F.col("quantiles")
    table = save_stage(table.select(
        *keys, "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")
    ))
    spread = (F.col("q3") - F.col("q1")) * reach
    fences = table.select(
        *keys, (F.col("q1") - spread).alias("__lo"), (F.col("q3") + spread).alias("__hi")
    )
    x = known(F.col(value))
    inside = x.between(F.col("__lo"), F.col("__hi"))
    whiskers = attach(df.select(*keys, value), fences, keys, "inner").groupBy(*keys).agg(
        F.min(F.when(inside, x)).alias("lower_whisker"),
        F.max(F.when(inside, x)).alias("upper_whisker"),
        F.count(F.when(~inside, x)).alias("outliers"),
    )
    return match(table, whiskers, keys, "left")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Five-number summary, mean and missing count of numeric columns."""
    long = df.select(*[known(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    quartiles = group_quantiles(long, ["column"], F.col("value"), [0.25, 0.5, 0.75])
    q = F.col("quantiles")
    quartiles = quartiles.select(
        "column", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")
    )
    plain = long.groupBy("column").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
    )
    return match(plain, quartiles, ["column"], "left")


def pretty_bins(low: float, high: float, wanted: int) -> tuple[float, int, int]:
    """Step and first and last multiple of about ``wanted`` bins at round numbers.

    The step is 1, 2, 5 or 10 times a power of ten, with a bias to larger steps
    (fixed values 1.5 and 2.75); the multiples cover the range. At least a third of the
    bins wanted come out.
    """
    spread, size, least = high - low, max(abs(low), abs(high)), wanted // 3
    if spread == 0 and high == 0:
        cell, tiny = 1.0, True
    else:
        cell = size
        tiny = spread < cell * (1 + 1 / 2.5) * max(1, wanted) * sys.float_info.epsilon * 3
    if tiny:
        cell = (9 + cell / 10 if cell > 10 else cell) * 0.75
        cell = cell / least if least > 1 else cell
    else:
        cell = spread / wanted
    base = 10.0 ** math.floor(math.log10(cell))
    step = base
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - cell < bias * (cell - step):
            step = factor * base
    first, last = math.floor(low / step + 1e-10), math.ceil(high / step - 1e-10)
    short = int(0.5 + least - (last - first))
    if short > 0:
        if first >= 0:
            last, first = last + short // 2, first - short // 2 - short % 2
        else:
            first, last = first - short // 2, last + short // 2 + short % 2
    return step, first, last


def histogram(df: DataFrame, value: str, log: bool = False) -> DataFrame:
    """Counts in bins with round edges; ``log`` needs values > 0.

    About as many bins as Sturges' rule asks for. A bin is closed on the right, the
    first on both sides. Missing and infinite values are left out, and so are empty bins.
    """
    x = F.col(value).cast("double")
    values = df.where(x > 0).select(F.log(x).alias("x")) if log else df.select(x.alias("x"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    values = values.where(finite)
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    step, first, _ = pretty_bins(low, high, math.ceil(math.log2(n) + 1)) if n else (1.0, 0, 0)
    start = first * step
    # A value a rounding error above an edge still belongs below it.
    slot = F.ceil((F.col("x") - start) / step - 1e-7) - 1
    counts = values.groupBy(F.greatest(slot, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = F.col("bin") * F.lit(step) + start
    return counts.select("bin", edge.alias("bin_start"), (edge + step).alias("bin_end"), "n")
