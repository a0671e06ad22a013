"""Median absolute deviation filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import MAD_SCALE, Span
from tidemark.groups import Median, Stats, by_size
from tidemark.operators.markers import first_time
from tidemark.operators.roles import Roles


def _drop_outliers(
    df: DataFrame, keys: Sequence[str], value: str, inside: Column, k: float, stats: Stats
) -> DataFrame:
    x = F.col(value)
    judged = df.withColumn("__inside", inside)
    inside = F.col("__inside")
    judged = stats.attach(judged, keys, __median=Median(F.when(inside, x)))
    deviation = F.abs(x - F.col("__median"))
    judged = stats.attach(judged, keys, __mad=Median(F.when(inside, deviation)))
    # An unknown window (no marker) drops the row: NULL must not reach otherwise().
    keep = F.when(inside, deviation <= k * (MAD_SCALE * F.col("__mad"))).when(~inside, True)
    return judged.where(keep).drop("__inside", "__median", "__mad")


def mad_filter_in_window(
    df: DataFrame,
    roles: Roles,
    marker: Column,
    span: Span,
    k: float,
    stats: Stats | None = None,
) -> DataFrame:
    """Keep rows within ``k`` MADs of the median of the window around the marker.

    Rows outside the window stay. A recording without the marker is dropped from
    the point where its window is unknown.
    """

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        anchored = stats.attach(part, [roles.key], __anchor=first_time(roles, marker))
        inside = span(F.col(roles.time), F.col("__anchor"))
        return _drop_outliers(anchored, [roles.key], roles.value, inside, k, stats).drop("__anchor")

    return by_size(df, [roles.key], plan, stats)


def mad_filter(
    df: DataFrame, keys: Sequence[str], value: str, k: float, stats: Stats | None = None
) -> DataFrame:
    """Keep rows within ``k`` MADs of their group's median."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        return _drop_outliers(part, keys, value, F.lit(True), k, stats)

    return by_size(df, keys, plan, stats)


def mad_filter_columns(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: float, stats: Stats | None = None
) -> DataFrame:
    """As :func:`mad_filter` for several columns at once; an outlying value becomes NULL.

    All columns share one shuffle of the wide rows.
    """

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        part = stats.attach(part, keys, **{f"__median_{c}": Median(F.col(c)) for c in columns})
        deviation = {c: F.abs(F.col(c) - F.col(f"__median_{c}")) for c in columns}
        part = stats.attach(part, keys, **{f"__mad_{c}": Median(d) for c, d in deviation.items()})
        kept = {
            c: F.when(d <= k * (MAD_SCALE * F.col(f"__mad_{c}")), F.col(c)) for c, d in deviation.items()
        }
        made = [f"__{kind}_{c}" for kind in ("median", "mad") for c in columns]
        return part.withColumns(kept).drop(*made)

    return by_size(df, keys, plan, stats)
