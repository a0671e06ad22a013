"""Clocks, recording time, marker time and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import clock_seconds
from tidemark.groups import ColdStats, Stats, attach, by_size, ordered_parts, running_before
from tidemark.operators.roles import Roles


def parse_clock(df: DataFrame, column: str, out: str = "time_seconds") -> DataFrame:
    return df.withColumn(out, clock_seconds(F.col(column)))


def relative_time(
    df: DataFrame, roles: Roles, clock: str = "time_seconds", stats: Stats | None = None
) -> DataFrame:
    """Seconds since the first sample of each recording, as ``roles.time``."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        started = stats.attach(part, [roles.key], __start=F.min(clock))
        return started.withColumn(roles.time, F.col(clock) - F.col("__start")).drop("__start")

    return by_size(df, [roles.key], plan, stats)


def shift_to_marker(
    df: DataFrame, anchors: DataFrame, roles: Roles, anchor: str, out: str = "marker_time"
) -> DataFrame:
    """Seconds relative to each recording's anchor; NULL without an anchor."""
    joined = attach(df, anchors.select(roles.key, anchor), [roles.key])
    return joined.withColumn(out, F.col(roles.time) - F.col(anchor))


def since_marker(
    df: DataFrame,
    roles: Roles,
    marker: Column,
    out: str = "marker_time",
    stats: Stats | None = None,
) -> DataFrame:
    """As :func:`shift_to_marker` with the first time ``marker`` holds as anchor."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        anchor = F.min(F.when(marker, F.col(roles.time)))
        anchored = stats.attach(part, [roles.key], __anchor=anchor)
        return anchored.withColumn(out, F.col(roles.time) - F.col("__anchor")).drop("__anchor")

    return by_size(df, [roles.key], plan, stats)


def sample_index(
    df: DataFrame, roles: Roles, out: str = "sample", stats: Stats | None = None
) -> DataFrame:
    """Zero-based row number of each recording in time order."""
    keys = [roles.key]

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        if isinstance(stats, ColdStats):
            window = Window.partitionBy(*keys).orderBy(*roles.sequence)
            return part.withColumn(out, F.row_number().over(window).cast("long") - 1)
        pieces = ordered_parts(part, keys, roles.sequence)
        before = running_before(pieces, keys, F.count(F.lit(1)), "__before", F.sum)
        window = Window.partitionBy("__part", *keys).orderBy(*roles.sequence, "__tie")
        numbered = attach(pieces, before, [*keys, "__part"]).withColumn(
            out,
            F.row_number().over(window).cast("long") - 1 + F.coalesce(F.col("__before"), F.lit(0)),
        )
        return numbered.drop("__before", "__part", "__tie")

    return by_size(df, keys, plan, stats)
