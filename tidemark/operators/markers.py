"""Marker times and the rows around or between markers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.groups import Stats, by_size
from tidemark.operators.roles import Roles


def first_time(roles: Roles, marker: Column) -> Column:
    """Aggregate: time of the first row where ``marker`` holds."""
    return F.min(F.when(marker, F.col(roles.time)))


def marker_times(df: DataFrame, roles: Roles, **markers: Column) -> DataFrame:
    """First time of every marker, one row per recording, NULL if absent."""
    return df.groupBy(roles.key).agg(*[first_time(roles, m).alias(n) for n, m in markers.items()])


def marker_times_of_clock(df: DataFrame, roles: Roles, clock: str, **markers: Column) -> DataFrame:
    """As :func:`marker_times`, in seconds since the recording's first sample.

    Start and markers are one aggregate over the clock, so no row is shuffled. The start
    itself is kept as ``start_clock``.
    """
    clocked = replace(roles, time=clock)
    found = df.groupBy(roles.key).agg(
        F.min(clock).alias("start_clock"),
        *[first_time(clocked, m).alias(n) for n, m in markers.items()],
    )
    return found.withColumns({n: F.col(n) - F.col("start_clock") for n in markers})


def marker_interval(
    df: DataFrame, roles: Roles, start: Column, end: Column, clock: str | None = None
) -> DataFrame:
    """Time from one marker to another; with ``clock`` from rows without relative time."""
    if clock:
        times = marker_times_of_clock(df, roles, clock, start_time=start, end_time=end)
        times = times.drop("start_clock")
    else:
        times = marker_times(df, roles, start_time=start, end_time=end)
    return times.withColumn("interval", F.col("end_time") - F.col("start_time"))


def between_markers(
    df: DataFrame,
    roles: Roles,
    start: Column,
    end: Column,
    pad: float = 5.0,
    stats: Stats | None = None,
) -> DataFrame:
    """Rows from ``start + pad`` to ``end - pad``, both ends included."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        bounded = stats.attach(
            part, [roles.key], __from=first_time(roles, start), __to=first_time(roles, end)
        )
        inside = F.col(roles.time).between(F.col("__from") + pad, F.col("__to") - pad)
        return bounded.where(inside).drop("__from", "__to")

    return by_size(df, [roles.key], plan, stats)


def crop_around_marker(
    df: DataFrame,
    roles: Roles,
    marker: Column,
    before: float,
    after: float,
    stats: Stats | None = None,
) -> DataFrame:
    """Rows within ``[marker - before, marker + after]``; no marker, no rows."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        anchored = stats.attach(part, [roles.key], __anchor=first_time(roles, marker))
        offset = F.col(roles.time) - F.col("__anchor")
        return anchored.where(offset.between(-before, after)).drop("__anchor")

    return by_size(df, [roles.key], plan, stats)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group in the given order, ties broken by that order."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    first = df.groupBy(*keys).agg(row)
    return first.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def smallest_with_ties(
    df: DataFrame, keys: Sequence[str], column: str, stats: Stats | None = None
) -> DataFrame:
    """All rows that hold the smallest value of their group."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        least = stats.attach(part, keys, __least=F.min(column))
        return least.where(F.col(column) == F.col("__least")).drop("__least")

    return by_size(df, keys, plan, stats)
