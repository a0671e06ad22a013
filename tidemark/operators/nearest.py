"""The sample nearest to any anchor: a two-sided as-of join without a range join.

Anchors and samples are put into one sequence per recording. The sample before an anchor is
the last one met so far, the sample after it the first one to come, so one sort of the union
answers all anchors, however many there are. Recordings with too many rows for a task are
range-partitioned by time, solved part by part, and the candidates of earlier and later parts
are carried over the part ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.groups import ColdStats, Stats, attach, by_size, ordered_parts, running_after, running_before
from tidemark.operators.roles import Roles
from tidemark.session import save_stage


def _usable(time: Column) -> Column:
    return time.isNotNull() & ~F.isnan(time)


def nearest_samples(
    samples: DataFrame, anchors: DataFrame, roles: Roles, anchor: str,
    columns: Sequence[str] = (), prefix: str = "nearest_",
) -> DataFrame:
    """``anchors`` with the time and ``columns`` of the nearest sample of the same recording.

    Both frames have ``roles.key``; ``anchor`` is the column of the anchor's time. Of two
    samples equally far away the earlier one is taken, and of samples at one time the first
    in the order of ``roles.order``. Anchors without a time or a recording without samples
    give NULL; every anchor row gives one row. Samples without a time are not used.
    """
    key, kept = roles.key, [c for c in anchors.columns if c != roles.key]
    taken = list(dict.fromkeys([roles.time, *roles.order, *columns]))
    sample = F.struct(*[F.col(c).alias(c) for c in taken])
    sample_type = samples.select(sample.alias("s")).schema["s"].dataType
    own = F.struct(*[F.col(f"`{c}`") for c in kept])
    own_type = anchors.select(own.alias("a")).schema["a"].dataType
    rows = samples.where(_usable(F.col(roles.time).cast("double"))).select(
        F.col(key), F.col(roles.time).cast("double").alias("__at"), F.lit(0).alias("__kind"),
        *[F.col(c).alias(f"__order{i}") for i, c in enumerate(roles.order)],
        sample.alias("__sample"), F.lit(None).cast(own_type).alias("__anchor"),
    )
    asked = anchors.select(
        F.col(key), F.col(anchor).cast("double").alias("__at"), F.lit(1).alias("__kind"),
        *[F.lit(None).cast(samples.schema[c].dataType).alias(f"__order{i}") for i, c in enumerate(roles.order)],
        F.lit(None).cast(sample_type).alias("__sample"), own.alias("__anchor"),
    )
    timed = _usable(F.col("__at"))
    found = by_size(
        rows.unionByName(asked.where(timed)), [key],
        lambda part, stats: _solved(part, key, len(roles.order), stats),
    )
    lost = asked.where(~timed | F.col("__at").isNull()).select(
        key, "__anchor", F.lit(None).cast(sample_type).alias("__best"))
    return found.unionByName(lost).select(
        key, *[F.col("__anchor")[c].alias(c) for c in kept],
        F.col("__best")[roles.time].alias(f"{prefix}time"),
        *[F.col("__best")[c].alias(f"{prefix}{c}") for c in taken if c != roles.time],
    )


def _solved(rows: DataFrame, key: str, n_order: int, stats: Stats) -> DataFrame:
    """``key, __anchor, __best`` for the anchors of a union of samples and anchors."""
    order = ["__at", "__kind", *[f"__order{i}" for i in range(n_order)]]
    is_sample = F.col("__kind") == 0
    here = F.struct("__at", "__sample")
    if isinstance(stats, ColdStats):
        inside = Window.partitionBy(key).orderBy(*order)
        joined = _first_of_time(rows, inside).withColumns({
            "__carried": F.lit(None).cast(_type(rows, here)), "__coming": F.lit(None).cast(_type(rows, here)),
        })
    else:
        parts = ordered_parts(rows, [key], order)
        inside = Window.partitionBy("__part", key).orderBy(*order, "__tie")
        flagged = save_stage(_first_of_time(parts, inside))
        # The largest time, and of equal ones the earliest part, whose sample came first.
        last = F.max(F.when(F.col("__first"), F.struct("__at", (-F.col("__part")).alias("p"), "__sample")))
        next_ = F.min(F.when(is_sample, F.struct("__at", F.struct(*order[2:], "__tie").alias("o"), "__sample")))
        before = running_before(flagged, [key], last, "__carried", F.max)
        after = running_after(flagged, [key], next_, "__coming", F.min)
        both = [key, "__part"]
        joined = attach(attach(flagged, before, both), after, both).withColumns({
            c: F.struct(F.col(c)["__at"].alias("__at"), F.col(c)["__sample"].alias("__sample"))
            for c in ("__carried", "__coming")
        })
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = joined.withColumns({
        "__before": F.last(F.when(F.col("__first"), here), ignorenulls=True).over(so_far),
        "__after": F.first(F.when(is_sample, here), ignorenulls=True).over(to_come),
    })
    before, carried = F.col("__before"), F.col("__carried")
    # A part may begin within the samples of one time: the first of them is in an earlier part.
    earlier = F.when(
        before["__at"].isNull() | (before["__at"] == carried["__at"]), carried
    ).otherwise(before)
    later = F.coalesce(F.when(F.col("__after")["__at"].isNotNull(), F.col("__after")), F.col("__coming"))
    nearer = F.col("__at") - earlier["__at"] <= later["__at"] - F.col("__at")
    best = F.when(later["__at"].isNull() | nearer, earlier["__sample"]).otherwise(later["__sample"])
    return met.where(F.col("__kind") == 1).select(key, "__anchor", best.alias("__best"))


def _type(df: DataFrame, column: Column):
    return df.select(column.alias("c")).schema["c"].dataType


def _first_of_time(rows: DataFrame, window) -> DataFrame:
    """Marks the first sample of each time; at one time samples come before anchors."""
    earlier = F.lag("__at").over(window)
    return rows.withColumn(
        "__first", (F.col("__kind") == 0) & (earlier.isNull() | (earlier < F.col("__at"))))
