"""Lowest samples of many overlapping windows from a range-minimum index.

The samples of a recording are ranked by time and cut into blocks of ``BLOCK``. A block keeps
its samples and the minima of the 1, 2, 4, ... blocks that begin with it. A window is a range of
ranks: two of those minima cover its whole blocks, and the two blocks at its edges give the
rest. Each sample is read once, and a window costs at most four lookups whatever its length and
however many windows overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.groups import ColdStats, Stats, attach, by_size, ordered_parts, running_before
from tidemark.operators.roles import Roles
from tidemark.session import save_stage

BLOCK = 64

# Order of rows at one time: a window's begin, samples, a window's end.
BEGIN, SAMPLE, END = 0, 1, 2


def lowest_in_windows(df: DataFrame, windows: DataFrame, roles: Roles) -> DataFrame:
    """Lowest sample of each window; ``windows`` holds ``key, lo, hi`` (inclusive).

    The result is that of :func:`tidemark.operators.troughs.trough_in_windows`: equal lows
    resolve to the earliest sample, samples without a value or time are not used, a window
    without samples gives no row, and equal windows give one row.
    """
    key = roles.key
    asked = windows.select(key, "lo", "hi").where(F.col("lo") <= F.col("hi")).distinct()
    ranked = _ranked(df, asked, roles)
    samples = ranked.where(F.col("kind") == SAMPLE)
    index = _index(samples, key)
    bounds = ranked.where(F.col("kind") != SAMPLE).groupBy(key, "lo", "hi").agg(
        F.max(F.when(F.col("kind") == BEGIN, F.col("seen"))).alias("first"),
        (F.max(F.when(F.col("kind") == END, F.col("seen"))) - 1).alias("last"),
    ).where(F.col("first") <= F.col("last"))
    # Every probe meets one block: a stretch of its samples, or one of its minima.
    probes = bounds.select(key, "lo", "hi", F.inline(_probes()))
    met = attach(probes, index, [key, "block"], "inner", weight=BLOCK)
    stretch = F.slice("samples", F.col("from") + 1, F.col("to") - F.col("from") + 1)
    lowest = F.when(F.col("level") >= 0, F.get("minima", F.col("level"))).otherwise(F.array_min(stretch))
    found = met.select(key, "lo", "hi", lowest.alias("low")).groupBy(key, "lo", "hi").agg(F.min("low").alias("low"))
    low = F.col("low")
    return found.select(
        key, "lo", "hi", low["time"].alias("noise_time"), low["value"].alias(roles.value),
        *[low[f"extra{i}"].alias(c) for i, c in enumerate(_extras(roles))],
    )


def _extras(roles: Roles) -> list[str]:
    """Columns of the result after time and value, ties ordered by all but the comment."""
    return [c for c in (roles.comment, *roles.order) if c]


def _ranked(df: DataFrame, asked: DataFrame, roles: Roles) -> DataFrame:
    """Samples and window bounds with the number of samples ``seen`` before them."""
    key = roles.key
    extras = _extras(roles)
    ties = [f"extra{extras.index(c)}" for c in roles.order]
    parts = {
        "value": F.col(roles.value), "time": F.col(roles.time),
        **{f"extra{extras.index(c)}": F.col(c) for c in roles.order},
        **{f"extra{i}": F.col(c) for i, c in enumerate(extras) if c not in roles.order},
    }
    sample = F.struct(*[c.alias(n) for n, c in parts.items()])
    rows = df.where(F.col(roles.value).isNotNull() & F.col(roles.time).isNotNull()).select(
        key, F.col(roles.time).alias("at"), F.lit(SAMPLE).alias("kind"), sample.alias("sample"))
    none = F.lit(None).cast(rows.schema["sample"].dataType)
    bound = lambda name, kind: asked.select(
        key, F.col(name).alias("at"), F.lit(kind).alias("kind"), none.alias("sample"), "lo", "hi")
    union = rows.unionByName(bound("lo", BEGIN), allowMissingColumns=True).unionByName(bound("hi", END))
    order = ["at", "kind", *[f"tie{i}" for i in range(len(ties))]]
    union = union.withColumns({f"tie{i}": F.col("sample")[c] for i, c in enumerate(ties)})
    one = F.when(F.col("kind") == SAMPLE, 1).otherwise(0).cast("long")

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        if isinstance(stats, ColdStats):
            window = Window.partitionBy(key).orderBy(*order)
            earlier = F.lit(0)
        else:
            part = ordered_parts(part, [key], order)
            carried = running_before(part, [key], F.sum(one), "earlier", F.sum)
            part = attach(part, carried, [key, "__part"])
            window = Window.partitionBy("__part", key).orderBy(*order, "__tie")
            earlier = F.coalesce(F.col("earlier"), F.lit(0))
        before = F.sum(one).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - one
        counted = part.withColumn("seen", before + earlier)
        return counted.select(key, "kind", "sample", "lo", "hi", "seen")

    return save_stage(by_size(union, [key], plan))


def _index(samples: DataFrame, key: str) -> DataFrame:
    """``key, block, samples, minima``: a block's samples in order and its sparse table row."""
    placed = F.struct(F.col("seen"), F.col("sample"))
    blocks = save_stage(
        samples.groupBy(key, F.floor(F.col("seen") / BLOCK).cast("long").alias("block"))
        .agg(F.array_sort(F.collect_list(placed)).alias("placed"))
        .select(key, "block", F.col("placed.sample").alias("samples"))
    )
    most = blocks.agg(F.max("block")).first()[0] or 0
    levels = most.bit_length()
    lean = blocks.select(key, "block", F.array_min("samples").alias("m0"))

    def plan(part: DataFrame, stats: Stats) -> DataFrame:
        if isinstance(stats, ColdStats):
            order = Window.partitionBy(key).orderBy("block")
            for j in range(1, levels):
                other = F.lead(f"m{j - 1}", 2 ** (j - 1)).over(order)
                part = part.withColumn(f"m{j}", F.least(F.col(f"m{j - 1}"), other))
            return part
        for j in range(1, levels):  # blocks of a huge recording meet by number, not by recording
            part = save_stage(part)
            other = part.select(
                F.col(key).alias("__k"), (F.col("block") - 2 ** (j - 1)).alias("__b"),
                F.col(f"m{j - 1}").alias("__m"))
            met = F.col(key).eqNullSafe(F.col("__k")) & (F.col("block") == F.col("__b"))
            part = part.join(other, met, "left").withColumn(
                f"m{j}", F.least(F.col(f"m{j - 1}"), F.col("__m"))).drop("__k", "__b", "__m")
        return part

    minima = by_size(lean, [key], plan).select(
        key, "block", F.array(*[f"m{j}" for j in range(max(levels, 1))]).alias("minima"))
    return attach(blocks, minima, [key, "block"], "inner", weight=BLOCK)


def _blocks(level: Column) -> Column:
    """Blocks that a minimum of this level covers."""
    return F.pow(F.lit(2.0), level).cast("long")


def _probes() -> Column:
    """At most four lookups for the ranks ``first`` to ``last``."""
    b1, b2 = (F.floor(F.col(c) / BLOCK).cast("long") for c in ("first", "last"))
    begin, end = ((F.col(c) % BLOCK).cast("int") for c in ("first", "last"))
    inner = b2 - b1 - 1
    level = F.floor(F.log2(F.greatest(inner, F.lit(1)).cast("double"))).cast("int")
    # The logarithm of a large number may be rounded up.
    level = F.when(_blocks(level) > inner, level - 1).otherwise(level)

    def probe(block, low, high, at):
        return F.struct(
            block.alias("block"), low.cast("int").alias("from"), high.cast("int").alias("to"),
            at.cast("int").alias("level"))

    edge, none = F.lit(-1), F.lit(0)
    return F.array_compact(F.array(
        probe(b1, begin, F.when(b1 == b2, end).otherwise(BLOCK - 1), edge),
        F.when(b2 > b1, probe(b2, none, end, edge)),
        F.when(inner > 0, probe(b1 + 1, none, none, level)),
        F.when(inner > 0, probe(b2 - _blocks(level), none, none, level)),
    ))
