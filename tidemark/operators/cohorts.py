"""Cohorts: tags read from comments and lists of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import first_match, mentions
from tidemark.groups import attach

# Comment pattern -> slurry temperature, first hit wins.
TEMPERATURE_RULES = [
    (r"\+2", 2.5),
    (r"-2\.", -2.5),
    (r"-0deg", 0.0),
    (r"0deg", 0.0),
    (r"0 deg", 0.0),
    (r"5deg", 5.0),
    (r"5 deg", 5.0),
    (r"5 degrees", 5.0),
]


def group_tags(
    df: DataFrame, key: str, comment: Column, rules: Sequence[tuple[str, object]], out: str = "tag"
) -> DataFrame:
    """Tag of each group: the first rule that any of its comments satisfies."""
    hits = [F.max(mentions(comment, p)).alias(f"__hit{i}") for i, (p, _) in enumerate(rules)]
    tag = first_match(rules, lambda i, _: F.col(f"__hit{i}"))
    return df.groupBy(key).agg(*hits).select(key, tag.alias(out))


def tag_rows(df: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    return attach(df, tags, [key])


def merge_levels(df: DataFrame, column: str, levels: Sequence[object], into: object) -> DataFrame:
    return df.withColumn(
        column, F.when(F.col(column).isin(*levels), F.lit(into)).otherwise(F.col(column))
    )


def members(df: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    return attach(df, cohort.select(key).distinct(), [key], "left_semi")


def non_members(df: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    return attach(df, cohort.select(key).distinct(), [key], "left_anti")


def split_cohort(
    df: DataFrame, cohort: DataFrame, key: str, inside: str, outside: str, out: str = "cohort"
) -> DataFrame:
    """Label each row by whether its key belongs to the cohort table."""
    flagged = attach(df, cohort.select(key).distinct().withColumn("__member", F.lit(True)), [key])
    label = F.when(F.col("__member"), F.lit(inside)).otherwise(F.lit(outside))
    return flagged.withColumn(out, label).drop("__member")
