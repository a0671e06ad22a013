"""Signal troughs inside chosen windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.groups import attach
from tidemark.operators.roles import Roles
from tidemark.session import save_stage


def trough_in_windows(df: DataFrame, windows: DataFrame, roles: Roles) -> DataFrame:
    """Lowest sample of each window; ``windows`` holds ``key, lo, hi`` (inclusive).

    Equal lows resolve to the earliest sample. Time is cut into slots of the mean
    window length, so that the windows cover at most two slots each on average and
    a sample meets only the windows of its own slot.
    """
    windows = save_stage(windows.select(roles.key, "lo", "hi").where(F.col("lo") <= F.col("hi")))
    slot_width = F.lit(windows.agg(F.avg(F.col("hi") - F.col("lo"))).first()[0] or 1.0)
    slots = F.sequence(F.floor(F.col("lo") / slot_width), F.floor(F.col("hi") / slot_width))
    slotted = windows.withColumn("__slot", F.explode(slots))
    rows = df.withColumn("__slot", F.floor(F.col(roles.time) / slot_width))
    inside = attach(rows, slotted, [roles.key, "__slot"], "inner").where(
        F.col(roles.time).between(F.col("lo"), F.col("hi")) & F.col(roles.value).isNotNull()
    )
    row = F.struct(roles.time, roles.value, *[c for c in (roles.comment, *roles.order) if c])
    best = F.min_by(row, F.struct(roles.value, *roles.sequence)).alias("__row")
    found = inside.groupBy(roles.key, "lo", "hi").agg(best)
    return found.select(
        roles.key, "lo", "hi", F.col("__row")[roles.time].alias("noise_time"),
        *[F.col("__row")[c].alias(c) for c in (roles.value, roles.comment, *roles.order) if c],
    )


def trough_duration(
    troughs: DataFrame, anchors: DataFrame, key: str, anchor: str, override: str | None = None
) -> DataFrame:
    """``total`` = trough time minus anchor time, unless the row overrides it."""
    joined = attach(troughs, anchors.select(key, anchor), [key])
    total = F.col("noise_time") - F.col(anchor)
    return joined.withColumn("total", F.coalesce(F.col(override), total) if override else total)
