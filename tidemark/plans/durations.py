"""Duration analysis: from troughs in control windows to a cohort model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tidemark.groups import attach
from tidemark.operators.markers import marker_times
from tidemark.operators.roles import Roles
from tidemark.operators.troughs import trough_duration, trough_in_windows

CONTROL = "source_file string, lo double, hi double, stun_parameter string, override_total double"


def durations(
    df: DataFrame,
    control: DataFrame,
    marker: Column,
    roles: Roles = Roles(),
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Duration of each control window: trough time minus marker time.

    ``df`` holds unfiltered samples with relative time. ``control`` has one row
    per window: key, ``lo``, ``hi``, cohort columns and ``override_total``, which
    replaces the measured duration where it is not NULL. Marker times come from
    ``anchors``, samples such as the filtered ones, or else from ``df`` itself; the two
    differ where the filter drops the marker's row.
    """
    found = trough_in_windows(df, control, roles)
    cohorts = control.select(roles.key, "lo", "hi", *_extra(control, roles))
    labelled = attach(found, cohorts, [roles.key, "lo", "hi"])
    times = marker_times(df if anchors is None else anchors, roles, marker_at=marker)
    return trough_duration(labelled, times, roles.key, "marker_at", "override_total")


def _extra(control: DataFrame, roles: Roles) -> list[str]:
    return [c for c in control.columns if c not in (roles.key, "lo", "hi")]
