"""Exact group quantiles (linear interpolation between order statistics)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.groups import attach, hot_groups, match, ordered_parts, running_before
from tidemark.session import HOT_ROWS, save_stage, setting

SKETCH_ACCURACY = 1000


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probabilities: Sequence[float]
) -> DataFrame:
    """``keys, n, quantiles`` with NULL and NaN values skipped.

    Groups that fit a task use the built-in exact ``percentile``. For hot groups
    a sketch brackets each quantile, and only rows inside the bracket are ranked.
    """
    rows = _values(df, keys, value)
    keyed = list(keys) or ["__all"]
    if not keys:
        rows = rows.withColumn("__all", F.lit(0))
    hot = hot_groups(rows, keyed)
    cold = rows if hot is None else match(rows, hot, keyed, "left_anti")
    result = cold.groupBy(*keyed).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("__v", F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles"),
    )
    if hot is not None:
        hot_rows = match(rows, hot, keyed, "left_semi")
        result = result.unionByName(_hot_quantiles(hot_rows, keyed, list(probabilities)))
    return result.select(*keys, "n", "quantiles")


def hot_group_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probabilities: Sequence[float]
) -> DataFrame:
    """As :func:`group_quantiles` for groups known to be hot: two passes, no count."""
    return _hot_quantiles(_values(df, keys, value), list(keys), list(probabilities))


def _values(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    rows = df.select(*keys, value.cast("double").alias("__v"))
    return rows.where(F.col("__v").isNotNull() & ~F.isnan("__v"))


def _hot_quantiles(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    targets = save_stage(_brackets(rows, keys, probabilities))
    located, inside = _locate(rows, keys, targets)
    below, reach = F.col("below"), F.col("below") + F.col("inside")
    missed = (below > F.col("low_rank")) | (reach <= F.col("high_rank"))
    any_missed, most = located.agg(F.max(missed), F.max("inside")).first()
    if any_missed:
        # The sketch promises its error bound; where it fails, rank every row of the group.
        infinity = F.lit(float("inf"))
        names = [*keys, "target"]
        wide = located.where(missed).select(*targets.columns).withColumns(
            {"low": -infinity, "high": infinity}
        )
        again, more = _locate(rows, keys, save_stage(wide))
        located, inside = located.where(~missed), match(
            inside, located.where(~missed).select(*names), names, "left_semi"
        )
        located = save_stage(located.unionByName(again))
        inside = inside.unionByName(more)
        most = located.agg(F.max("inside")).first()[0]
    one_task = (most or 0) <= setting(rows.sparkSession, HOT_ROWS)
    return _select_ranks(located, inside, keys, one_task)


def _brackets(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    slack = 2.0 / SKETCH_ACCURACY
    ends = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-slack, slack)]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("__v", F.array(*map(F.lit, ends)), SKETCH_ACCURACY).alias("ends"),
    )
    infinity = F.lit(float("inf"))
    brackets = []
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        low = F.col("ends")[2 * i] if p - slack > 0 else -infinity
        high = F.col("ends")[2 * i + 1] if p + slack < 1 else infinity
        brackets.append(
            F.struct(
                F.lit(i).alias("target"),
                low.alias("low"),
                high.alias("high"),
                F.floor(position).alias("low_rank"),
                F.ceil(position).alias("high_rank"),
                (position - F.floor(position)).alias("weight"),
            )
        )
    return sketch.select(*keys, "n", F.inline(F.array(*brackets)))


def _locate(rows: DataFrame, keys: list[str], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows below each bracket, counted; values inside it, with multiplicity."""
    marked = attach(rows, targets.select(*keys, "target", "low", "high"), keys, "inner")
    # One pass: everything below a bracket collapses into one NULL value.
    tally = save_stage(
        marked.where(F.col("__v") <= F.col("high"))
        .withColumn("value", F.when(F.col("__v") >= F.col("low"), F.col("__v")))
        .groupBy(*keys, "target", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    copies = F.col("copies")
    sums = tally.groupBy(*keys, "target").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), copies)), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), copies)), F.lit(0)).alias("inside"),
    )
    located = save_stage(match(targets, sums, [*keys, "target"], "left"))
    return located, tally.where(F.col("value").isNotNull())


def _select_ranks(
    located: DataFrame, inside: DataFrame, keys: list[str], one_task: bool
) -> DataFrame:
    group = [*keys, "target"]
    ranks = located.select(*group, "below", "low_rank", "high_rank")
    if one_task:
        up_to = F.sum("copies").over(Window.partitionBy(*group).orderBy("value"))
        reach = F.col("below") + up_to
        ranked = attach(inside, ranks, group).withColumn("reach", reach)
    else:
        parts = ordered_parts(inside, group, ["value"])
        before = running_before(parts, group, F.sum("copies"), "earlier", F.sum)
        before = match(before.fillna(0, ["earlier"]), ranks, group, "left")
        up_to = F.sum("copies").over(Window.partitionBy("__part", *group).orderBy("value"))
        reach = F.col("below") + F.col("earlier") + up_to
        ranked = attach(parts, before, [*group, "__part"]).withColumn("reach", reach)
    value = F.col("value")
    picked = ranked.groupBy(*group).agg(
        F.min(F.when(F.col("reach") > F.col("low_rank"), value)).alias("low_value"),
        F.min(F.when(F.col("reach") > F.col("high_rank"), value)).alias("high_value"),
    )
    low, high = F.col("low_value"), F.col("high_value")
    answer = F.when(low == high, low).otherwise((1 - F.col("weight")) * low + F.col("weight") * high)
    joined = match(located.select(*group, "n", "weight"), picked, group, "left")
    found = joined.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("target", answer.alias("q")))).alias("found"),
    )
    return found.select(*keys, "n", F.transform("found", lambda f: f["q"]).alias("quantiles"))
