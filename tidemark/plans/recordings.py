"""Recording analyses: from samples to epochs, as configuration rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import after_marker, before_marker, bin_of, is_exactly, mentions
from tidemark.groups import Stats, by_size
from tidemark.operators.baseline import BASELINE_BIN, BASELINE_TIME, percent_of_window
from tidemark.operators.markers import between_markers, first_time
from tidemark.operators.outliers import mad_filter, mad_filter_in_window
from tidemark.operators.roles import Roles
from tidemark.operators.timebase import relative_time


@dataclass(frozen=True)
class Protocol:
    """Markers, margins and windows of one experiment."""

    zero: str  # pattern of the zero-time marker
    before: str  # exact marker that ends the pre-event filter window
    after: str  # exact marker that starts the post-event filter window
    median_marker: str  # exact marker that ends the baseline-median window
    mean_marker: str  # exact marker that ends the baseline-mean window
    margin: float = 100.0
    after_offset: float = 120.0
    before_mads: float = 0.5
    after_mads: float = 1.0
    mean_start: float = 100.0
    width: float = 60.0
    window: float = 20.0
    horizon: float = 3600.0
    last_bin: int | None = 30
    dropped_bins: tuple[int, ...] = (0, 1)


# Markers and windows of the four experiments.
COLD_SHOCK = Protocol(
    zero="in slurry",
    before="in slurry",
    after="in slurry",
    median_marker="in slurry",
    mean_marker="in slurry",
)
STUN_THEN_COLD = Protocol(
    zero="in slurry",
    before="stun on",
    after="in slurry",
    median_marker="in slurry",
    mean_marker="stun on",
)
STUN_RECOVERY = Protocol(
    zero="stun off",
    before="Stun",
    after="stun off",
    median_marker="Stun",
    mean_marker="Stun",
    after_offset=60.0,
    last_bin=None,
    dropped_bins=(0, 4, 5, 6, 7, 8, 9, 10),
)
HALF_SECOND = STUN_THEN_COLD


def filtered_samples(df: DataFrame, protocol: Protocol, roles: Roles, stats: Stats) -> DataFrame:
    """Both outlier passes; the second sees only what the first kept."""
    comment = F.col(roles.comment)
    first = mad_filter_in_window(
        df, roles, is_exactly(comment, protocol.before),
        before_marker(0.0, protocol.margin), protocol.before_mads, stats,
    )
    return mad_filter_in_window(
        first, roles, is_exactly(comment, protocol.after),
        after_marker(protocol.after_offset), protocol.after_mads, stats,
    )


def percent_samples(df: DataFrame, protocol: Protocol, roles: Roles, stats: Stats) -> DataFrame:
    """Filtered samples with ``marker_time`` and the signal in % of baseline.

    ``mean_marker`` holds the end marker of the baseline-mean window.
    """
    comment, time = F.col(roles.comment), F.col(roles.time)
    rows = stats.attach(
        filtered_samples(df, protocol, roles, stats),
        [roles.key],
        __zero=first_time(roles, mentions(comment, protocol.zero)),
        __median_marker=first_time(roles, is_exactly(comment, protocol.median_marker)),
        mean_marker=first_time(roles, is_exactly(comment, protocol.mean_marker)),
    )
    inside = before_marker(0.0, protocol.margin)(time, F.col("__median_marker"))
    rows = percent_of_window(rows, roles.key, inside, [roles.value], stats)
    return rows.withColumn("marker_time", time - F.col("__zero")).drop("__zero", "__median_marker")


def recording_epochs(
    df: DataFrame, protocol: Protocol, roles: Roles = Roles(), clock: str = "time_seconds"
) -> DataFrame:
    """Epochs of all recordings: ``key, bin, marker_time, n_points, pct_<value>``.

    The baseline epoch and the binned epochs come out of one aggregate: a row
    that serves both is counted for both.
    """
    key, percent = roles.key, f"pct_{roles.value}"
    needed = [key, clock, roles.value, roles.comment, *roles.order]

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        timed = relative_time(part, roles, clock, stats)
        rows = percent_samples(timed, protocol, roles, stats)
        time, after_zero = F.col(roles.time), F.col("marker_time")
        in_baseline = before_marker(protocol.mean_start, protocol.margin)(time, F.col("mean_marker"))
        in_bins = after_zero.between(0.0, protocol.horizon)
        rows = rows.withColumn("__bin", F.when(in_bins, bin_of(after_zero, protocol.width)))
        rows = stats.attach(rows, [key, "__bin"], __start=F.min(F.when(in_bins, after_zero)))
        in_epoch = in_bins & (after_zero < F.col("__start") + protocol.window)
        if protocol.last_bin is not None:
            in_epoch = in_epoch & (F.col("__bin") <= protocol.last_bin)
        baseline = F.struct(
            F.lit(BASELINE_BIN).cast("long").alias("bin"), F.lit(BASELINE_TIME).alias("marker_time")
        )
        epoch = F.struct(F.col("__bin").alias("bin"), F.col("__start").alias("marker_time"))
        memberships = F.array_compact(
            F.array(F.when(in_baseline, baseline), F.when(in_epoch, epoch))
        )
        used = rows.select(key, percent, F.inline(memberships))
        return used.groupBy(key, "bin").agg(
            F.min("marker_time").alias("marker_time"),
            F.count(F.lit(1)).alias("n_points"),
            F.avg(percent).alias(percent),
        )

    return by_size(df.select(*needed), [key], plan)


def post_event_percent(
    df: DataFrame,
    protocol: Protocol,
    start: str,
    end: str,
    roles: Roles = Roles(),
    clock: str = "time_seconds",
    pad: float = 5.0,
    apply_mad: bool = False,
) -> DataFrame:
    """Mean % of baseline between two markers, with the number of samples.

    ``apply_mad`` adds the outlier filter between the markers; it is off because
    the published analysis computes but does not use it.
    """
    key, percent = roles.key, f"pct_{roles.value}"
    needed = [key, clock, roles.value, roles.comment, *roles.order]

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        timed = relative_time(part, roles, clock, stats)
        rows = percent_samples(timed, protocol, roles, stats)
        comment = F.col(roles.comment)
        rows = between_markers(
            rows, roles, is_exactly(comment, start), is_exactly(comment, end), pad, stats
        )
        if apply_mad:
            rows = mad_filter(rows, [key], roles.value, 1.0, stats)
        return rows.groupBy(key).agg(
            F.avg(percent).alias(percent), F.count(F.lit(1)).alias("all_count")
        )

    return by_size(df.select(*needed), [key], plan)


def event_versus_baseline(
    df: DataFrame,
    protocol: Protocol,
    start: str,
    end: str,
    roles: Roles = Roles(),
    clock: str = "time_seconds",
    pad: float = 5.0,
) -> DataFrame:
    """Mean % of baseline per recording in its baseline and between two markers.

    ``key, label, n, pct_<value>`` with label ``baseline`` or ``post_stun``; one
    aggregate serves both sections.
    """
    key, percent = roles.key, f"pct_{roles.value}"
    needed = [key, clock, roles.value, roles.comment, *roles.order]

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        timed = relative_time(part, roles, clock, stats)
        comment, time = F.col(roles.comment), F.col(roles.time)
        rows = stats.attach(
            percent_samples(timed, protocol, roles, stats),
            [key],
            __from=first_time(roles, is_exactly(comment, start)),
            __to=first_time(roles, is_exactly(comment, end)),
        )
        in_baseline = before_marker(protocol.mean_start, protocol.margin)(time, F.col("mean_marker"))
        in_event = time.between(F.col("__from") + pad, F.col("__to") - pad)
        sections = F.array_compact(
            F.array(F.when(in_baseline, F.lit("baseline")), F.when(in_event, F.lit("post_stun")))
        )
        return rows.select(key, percent, F.explode(sections).alias("label")).groupBy(key, "label").agg(
            F.count(F.lit(1)).alias("n"), F.avg(percent).alias(percent)
        )

    return by_size(df.select(*needed), [key], plan)
