"""Per-group statistics that survive groups of any size.

A group is *hot* when it holds more rows than one task should see. Cold groups
use window functions: one shuffle on the group key serves every statistic of an
operator chain. Hot groups never meet in one task: their statistics are partial
aggregates written as a small table and joined back without moving the rows.
There are at most ``rows / threshold`` hot groups.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import known
from tidemark.session import BROADCAST_ROWS, HOT_ROWS, save_stage, setting

SALTS = 64
MOST_SALTS = 10_000


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe equi join that keeps the left key columns only."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = functools.reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Saved table of the hot groups and their row counts, or None."""
    limit = setting(df.sparkSession, HOT_ROWS)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    largest = counts.agg(F.max("__rows")).first()[0]
    if largest is None or largest <= limit:
        return None
    return save_stage(counts.where(F.col("__rows") > limit))


def attach(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", weight: int = 1
) -> DataFrame:
    """Join ``rows`` to a per-group table without gathering a hot group.

    The table is written first, so its size is known: small tables are broadcast,
    others are shuffled by key. There, groups with more than their share of the
    rows are spread over salts; fewer than ``BROADCAST_ROWS`` groups can be. A table
    whose rows hold arrays gives their length as ``weight``.
    """
    table = save_stage(table)
    spark = rows.sparkSession
    bound = setting(spark, BROADCAST_ROWS)
    if table.count() * weight <= bound:
        return match(rows, F.broadcast(table), keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total, largest = counts.agg(F.sum("__rows"), F.max("__rows")).first()
    share = max(setting(spark, HOT_ROWS), (total or 0) // bound)
    if (largest or 0) <= share:
        return match(rows, table, keys, how)
    heavy = save_stage(counts.where(F.col("__rows") > share))
    # As many salts as keep each at the share, whatever the size of the largest group.
    salts = min(max(SALTS, largest // share + 1), MOST_SALTS)
    rows_salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    table_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_rows = match(rows, F.broadcast(heavy), keys, "left").withColumn(
        "__salt", F.when(F.col("__rows").isNotNull(), rows_salt).otherwise(0)
    )
    salted_table = match(table, F.broadcast(heavy), keys, "left").withColumn(
        "__salt",
        F.explode(F.when(F.col("__rows").isNotNull(), table_salts).otherwise(F.array(F.lit(0)))),
    )
    joined = match(salted_rows.drop("__rows"), salted_table.drop("__rows"), [*keys, "__salt"], how)
    return joined.drop("__salt")


@dataclass(frozen=True)
class Median:
    """Marks a statistic that is the median of ``column``, NULL and NaN skipped."""

    column: Column


Statistic = Column | Median


class ColdStats:
    """Statistics of groups that fit a task, as window functions."""

    def attach(self, df: DataFrame, keys: Sequence[str], **stats: Statistic) -> DataFrame:
        group = Window.partitionBy(*keys)
        columns = {
            name: (F.median(known(s.column)) if isinstance(s, Median) else s).over(group)
            for name, s in stats.items()
        }
        return df.withColumns(columns)


class HotStats:
    """Statistics of oversized groups, as partial aggregates joined back."""

    def attach(self, df: DataFrame, keys: Sequence[str], **stats: Statistic) -> DataFrame:
        from tidemark.quantiles import hot_group_quantiles

        result = df
        plain = [s.alias(n) for n, s in stats.items() if not isinstance(s, Median)]
        if plain:
            result = attach(result, df.groupBy(*keys).agg(*plain), keys)
        for name, stat in stats.items():
            if isinstance(stat, Median):
                middle = hot_group_quantiles(df, keys, stat.column, [0.5])
                table = middle.select(*keys, F.col("quantiles")[0].alias(name))
                result = attach(result, table, keys)
        return result


Stats = ColdStats | HotStats


def by_size(
    df: DataFrame,
    keys: Sequence[str],
    plan: Callable[[DataFrame, Stats], DataFrame],
    stats: Stats | None = None,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Run ``plan`` on the cold groups and, if there are any, on the hot ones.

    With ``stats`` the caller has split the groups already. Chains of operators
    split once and pass ``stats`` on, so that each sample is read once. Groups are
    counted in ``measure`` where that is cheaper than in ``df``.
    """
    if stats is not None:
        return plan(df, stats)
    hot = hot_groups(df if measure is None else measure, keys)
    if hot is None:
        return plan(df, ColdStats())
    cold_part = plan(match(df, hot, keys, "left_anti"), ColdStats())
    # Hot statistics take several passes; they read the hot rows only.
    hot_part = plan(save_stage(match(df, hot, keys, "left_semi")), HotStats())
    return cold_part.unionByName(hot_part)


def ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by group and order, tag rows with the partition, save.

    A hot group spans several parts and part numbers follow the order. ``__tie``
    ranks copies of a row, so that copies can be split as well. Saving pins the
    part of every row.
    """
    pieces = df.count() // setting(df.sparkSession, HOT_ROWS) + 1
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [F.col(c) for c in (*keys, *order, "__tie")]
    return save_stage(
        tied.repartitionByRange(int(pieces), *by).withColumn("__part", F.spark_partition_id())
    )


def running_before(parts: DataFrame, keys: Sequence[str], carry: Column, name: str,
                   total: Callable[[Column], Column]) -> DataFrame:
    """Combine ``carry`` over all earlier parts of the group: ``keys, __part, name``.

    ``carry`` is an aggregate of one part, so the window sees one row per part.
    """
    return _running(parts, keys, carry, name, total, F.col("__part").asc())


def running_after(parts: DataFrame, keys: Sequence[str], carry: Column, name: str,
                  total: Callable[[Column], Column]) -> DataFrame:
    """As :func:`running_before` over all later parts of the group."""
    return _running(parts, keys, carry, name, total, F.col("__part").desc())


def _running(parts, keys, carry, name, total, order) -> DataFrame:
    per_part = parts.groupBy(*keys, "__part").agg(carry.alias(name))
    others = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.withColumn(name, total(F.col(name)).over(others))
