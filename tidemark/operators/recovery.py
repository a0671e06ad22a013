"""Recovery curves from staged time-to-event observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import bin_label, bin_of
from tidemark.groups import ColdStats, Stats, attach, by_size, match, ordered_parts, running_before


def bin_count(df: DataFrame, time: str, width: float) -> int:
    """Number of bins that cover the longest observed time."""
    longest = df.agg(F.max(time)).first()[0]
    return 0 if longest is None else int((longest + width) // width)


def with_bin(df: DataFrame, time: str, width: float) -> DataFrame:
    """Half-open bins from 0; a missing or negative time has no bin."""
    return df.withColumn("bin", F.when(F.col(time) >= 0, bin_of(F.col(time), width)))


def _bins(n_bins: int) -> Column:
    """Bins 0 to n - 1, one row each; no row for no bin."""
    return F.explode(_between(F.lit(0), F.lit(n_bins - 1))).alias("bin")


def _between(first: Column, last: Column) -> Column:
    """Whole numbers from first to last; none if last is smaller (sequence would count down)."""
    numbers = F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))
    return F.when(first <= last, numbers).otherwise(F.array().cast("array<bigint>"))


def recovery_grid(
    df: DataFrame, subject: str, cohort: str, cohorts: Sequence[object], n_bins: int
) -> DataFrame:
    """Every subject in every bin of every listed cohort."""
    levels = F.explode(F.array(*map(F.lit, cohorts))).alias(cohort)
    subjects = df.select(subject).distinct()
    return subjects.select(subject, levels).select(subject, cohort, _bins(n_bins))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    stats: Stats | None = None,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Last observation carried forward; leading NULLs stay."""

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        if isinstance(stats, ColdStats):
            so_far = Window.partitionBy(*keys).orderBy(*order)
            so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
            return part.withColumn(column, F.last(column, ignorenulls=True).over(so_far))
        pieces = ordered_parts(part, keys, order)
        position = F.when(F.col(column).isNotNull(), F.struct(*order, "__tie"))
        latest = F.max_by(F.col(column), position)
        before = running_before(
            pieces, keys, latest, "__carried", lambda c: F.last(c, ignorenulls=True)
        )
        local = Window.partitionBy("__part", *keys).orderBy(*order, "__tie")
        local = local.rowsBetween(Window.unboundedPreceding, 0)
        filled = F.coalesce(F.last(column, ignorenulls=True).over(local), F.col("__carried"))
        carried = attach(pieces, before, [*keys, "__part"]).withColumn(column, filled)
        return carried.drop("__carried", "__part", "__tie")

    return by_size(df, keys, plan, stats, measure)


def filled_grid(
    df: DataFrame, subject: str, cohort: str, stage: str, cohorts: Sequence[object], n_bins: int
) -> DataFrame:
    """The full grid with each subject's stage carried forward.

    An observation fills its own bin and those up to the next bin observed; bins
    before the first one, and foreign cohorts, are NULL. Spells are exploded, so the
    grid is neither joined nor sorted. Within a bin the last stage in order carries on.
    """
    inside = F.col(cohort).isin(*cohorts) & F.col("bin").between(0, n_bins - 1)
    seen = df.where(inside & F.col(stage).isNotNull()).select(subject, cohort, "bin", stage)
    pair = [subject, cohort]
    # At most a row per bin and pair is left to order.
    cells = seen.groupBy(*pair, "bin").agg(F.max(stage).alias(stage))
    following = F.lead("bin").over(Window.partitionBy(*pair).orderBy("bin"))
    later = cells.withColumn("__next", F.coalesce(following, F.lit(n_bins))).select(
        *pair, F.explode(_between(F.col("bin") + 1, F.col("__next") - 1)).alias("bin"), stage
    )
    pairs = df.select(subject).distinct().select(
        subject, F.explode(F.array(*map(F.lit, cohorts))).alias(cohort)
    )
    first = cells.groupBy(*pair).agg(F.min("bin").alias("__first"))
    nothing = F.lit(None).cast(seen.schema[stage].dataType).alias(stage)
    blank = match(pairs, first, pair, "left").select(
        *pair, F.explode(_between(F.lit(0), F.coalesce("__first", F.lit(n_bins)) - 1)).alias("bin"), nothing
    )
    return seen.unionByName(later).unionByName(blank)


def recovery_curve(
    df: DataFrame,
    subject: str,
    cohort: str,
    stage: str,
    time: str,
    stages: Sequence[str],
    width: float = 60.0,
    hold_full: bool = True,
) -> DataFrame:
    """Percentage of a cohort's subjects in each stage, per bin.

    A subject holds a stage from the bin it was seen in up to the bin of its next
    observation. The curve sums the arrivals and departures of these spells, so
    the subject x bin grid is never built. With ``hold_full`` a curve that
    reached 100 % stays there.
    """
    n_bins = bin_count(df, time, width)
    seen = with_bin(df, time, width).where(F.col("bin").isNotNull())
    seen = seen.select(cohort, subject, stage, "bin").distinct()
    # At most bins x stages rows per subject after distinct().
    following = F.lead("bin").over(Window.partitionBy(cohort, subject).orderBy("bin", stage))
    spells = seen.withColumn("next", F.coalesce(following, F.lit(n_bins)))
    until = F.when(F.col("next") == F.col("bin"), F.col("bin") + 1).otherwise(F.col("next"))
    changes = spells.select(
        cohort, stage,
        F.inline(F.array(
            F.struct(F.col("bin").alias("bin"), F.lit(1).alias("change")),
            F.struct(until.alias("bin"), F.lit(-1).alias("change")),
        )),
    ).groupBy(cohort, stage, "bin").agg(F.sum("change").alias("change"))

    sizes = df.groupBy(cohort).agg(F.count_distinct(subject).alias("subjects"))
    levels = F.explode(F.array(*map(F.lit, stages))).alias(stage)
    axis = sizes.select(cohort, "subjects", levels).select(cohort, "subjects", stage, _bins(n_bins))
    curve = match(axis, changes, [cohort, stage, "bin"], "left")
    so_far = Window.partitionBy(cohort, stage).orderBy("bin")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    present = F.coalesce(F.sum("change").over(so_far), F.lit(0))
    start = F.col("bin") * F.lit(float(width))
    curve = curve.select(
        cohort, stage, "bin",
        start.alias("bin_start"),
        (start + width).alias("bin_end"),
        (start + width / 2).alias("bin_mid"),
        (present / F.col("subjects") * 100).alias("proportion"),
    )
    if hold_full:
        full = F.min(F.when(F.col("proportion") == 100, F.col("bin")))
        full_from = full.over(Window.partitionBy(cohort, stage))
        curve = curve.withColumn(
            "proportion", F.when(F.col("bin") >= full_from, 100.0).otherwise(F.col("proportion"))
        )
    return curve


def with_bin_label(df: DataFrame, width: int) -> DataFrame:
    start = F.col("bin") * F.lit(width)
    return df.withColumn("bin_label", bin_label(start, start + width))
