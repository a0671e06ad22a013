"""Behaviour analysis: recovery curve, summary and model of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.linear_models import LinearFit, fit_linear
from tidemark.operators.recovery import recovery_curve
from tidemark.operators.summaries import histogram, stage_summary


@dataclass(frozen=True)
class BehaviourReport:
    curve: DataFrame
    summary: DataFrame
    histogram: DataFrame
    model: LinearFit


def behaviour_report(
    df: DataFrame,
    subject: str = "animal_id",
    cohort: str = "stun_parameter",
    stage: str = "recovery_stage",
    time: str = "time_seconds_stage",
    stages: Sequence[str] = ("stage_3", "stage_4"),
    skip: str = "stage_2",
    width: float = 60.0,
    observed_only: bool = False,
    log: bool = False,
) -> BehaviourReport:
    """All results for the stages after ``skip``.

    ``observed_only`` leaves stages that were never reached out of the row counts;
    ``log`` takes the histogram over the logarithm of the times.
    """
    kept = df.where(~F.col(stage).rlike(skip))
    counted = kept.where(F.col(time).isNotNull()) if observed_only else kept
    return BehaviourReport(
        recovery_curve(kept, subject, cohort, stage, time, list(stages), width),
        stage_summary(counted, [stage, cohort], time),
        histogram(counted, time, log),
        fit_linear(counted, time, [stage, cohort]),
    )
