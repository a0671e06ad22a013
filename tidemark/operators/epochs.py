"""Anchored bins, epoch means and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import bin_of
from tidemark.groups import Stats, by_size


def anchored_bins(
    df: DataFrame,
    key: str,
    time: str = "marker_time",
    width: float = 60.0,
    horizon: float = 3600.0,
    stats: Stats | None = None,
) -> DataFrame:
    """Add ``bin``, ``anchor_time`` and ``start_time`` to rows in ``[0, horizon]``.

    ``start_time`` is the sample nearest to the bin's anchor. A bin starts at its
    anchor, so the nearest sample is the earliest one.
    """

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        binned = part.where(F.col(time).between(0.0, horizon)).withColumn(
            "bin", bin_of(F.col(time), width)
        )
        binned = binned.withColumn("anchor_time", F.col("bin") * F.lit(float(width)))
        return stats.attach(binned, [key, "bin"], start_time=F.min(time))

    # Bins refine the recordings, so a recording that fits a task has bins that fit.
    return by_size(df, [key], plan, stats)


def epoch_means(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    time: str = "marker_time",
    width: float = 60.0,
    horizon: float = 3600.0,
    window: float = 20.0,
    stats: Stats | None = None,
) -> DataFrame:
    """Mean of each column over the first ``window`` seconds of each bin."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        binned = anchored_bins(part, key, time, width, horizon, stats)
        used = binned.where(F.col(time) < F.col("start_time") + window)
        return used.groupBy(key, "bin").agg(
            *[F.avg(c).alias(c) for c in columns],
            F.min("start_time").alias("marker_time"),
            F.count(F.lit(1)).alias("n_points"),
        )

    return by_size(df, [key], plan, stats)


def with_reference_lines(df: DataFrame) -> DataFrame:
    """The constant 10 % and 100 % columns carried by every epoch."""
    return df.withColumns({"ten_percent": F.lit(10.0), "hundred_percent": F.lit(100.0)})


def to_long(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], name: str = "band", value: str = "power"
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "band", value: str = "power"
) -> DataFrame:
    """Inverse of :func:`to_long`; ``ids`` identify a row."""
    return df.groupBy(*ids).pivot(name, list(columns)).agg(F.first(value, ignorenulls=True))


def without_bins(df: DataFrame, bins: Sequence[int]) -> DataFrame:
    return df.where(~F.col("bin").isin(*bins)) if bins else df
