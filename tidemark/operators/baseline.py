"""Each recording's own baseline and the signal as a percentage of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import Span, known, percent_of
from tidemark.groups import ColdStats, Median, Stats, attach, by_size, match
from tidemark.operators.markers import first_time
from tidemark.operators.roles import Roles
from tidemark.quantiles import group_quantiles

BASELINE_TIME = -300.0  # fixed values: the stamp of the baseline epoch
BASELINE_BIN = -1


def baseline_rows(
    df: DataFrame, roles: Roles, marker: Column, span: Span, stats: Stats | None = None
) -> DataFrame:
    """Rows of the baseline window, with no marker no rows."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        anchored = stats.attach(part, [roles.key], __anchor=first_time(roles, marker))
        return anchored.where(span(F.col(roles.time), F.col("__anchor"))).drop("__anchor")

    return by_size(df, [roles.key], plan, stats)


def baseline_medians(
    df: DataFrame, roles: Roles, marker: Column, span: Span, stats: Stats | None = None
) -> DataFrame:
    """Median of the signal in the baseline window, one row per recording that has rows there.

    NULL and NaN are skipped; a window without any other value has a NULL median.
    """

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        rows = baseline_rows(part, roles, marker, span, stats)
        if isinstance(stats, ColdStats):
            return rows.groupBy(roles.key).agg(F.median(known(F.col(roles.value))).alias("baseline"))
        medians = group_quantiles(rows, [roles.key], F.col(roles.value), [0.5])
        medians = medians.select(roles.key, F.col("quantiles")[0].alias("baseline"))
        return match(rows.select(roles.key).distinct(), medians, [roles.key], "left")

    return by_size(df, [roles.key], plan, stats)


def baseline_counts(
    df: DataFrame, roles: Roles, marker: Column, span: Span, stats: Stats | None = None
) -> DataFrame:
    rows = baseline_rows(df, roles, marker, span, stats)
    return rows.groupBy(roles.key).agg(F.count(F.lit(1)).alias("n"))


def percent_of_table(
    df: DataFrame, baselines: DataFrame, keys: Sequence[str], columns: dict[str, str]
) -> DataFrame:
    """Add ``pct_<column>`` for each ``column: baseline column`` of the mapping."""
    joined = attach(df, baselines, keys)
    return joined.withColumns(
        {f"pct_{c}": percent_of(F.col(c), F.col(b)) for c, b in columns.items()}
    )


def percent_of_window(
    df: DataFrame, key: str, inside: Column, columns: Sequence[str], stats: Stats
) -> DataFrame:
    """Add ``baseline_<column>``, the median where ``inside`` holds, and ``pct_<column>``."""
    medians = {f"baseline_{c}": Median(F.when(inside, F.col(c))) for c in columns}
    return stats.attach(df, [key], **medians).withColumns(
        {f"pct_{c}": percent_of(F.col(c), F.col(f"baseline_{c}")) for c in columns}
    )


def percent_of_baseline(
    df: DataFrame,
    roles: Roles,
    marker: Column,
    span: Span,
    columns: Sequence[str] | None = None,
    stats: Stats | None = None,
) -> DataFrame:
    """Signal columns as a percentage of their median in the baseline window."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        anchored = stats.attach(part, [roles.key], __anchor=first_time(roles, marker))
        inside = span(F.col(roles.time), F.col("__anchor"))
        based = percent_of_window(anchored, roles.key, inside, columns or [roles.value], stats)
        return based.drop("__anchor")

    return by_size(df, [roles.key], plan, stats)


def baseline_epoch(
    df: DataFrame, roles: Roles, marker: Column, span: Span, percent: str, stats: Stats | None = None
) -> DataFrame:
    """Mean percentage in the baseline window, stamped as its own epoch."""
    rows = baseline_rows(df, roles, marker, span, stats)
    return rows.groupBy(roles.key).agg(
        F.avg(percent).alias(percent),
        F.lit(BASELINE_TIME).alias("marker_time"),
        F.lit(BASELINE_BIN).cast("long").alias("bin"),
    )
