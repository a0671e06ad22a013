"""Column expressions and joins that several operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.groups import match
from tidemark.session import save_stage

# A word is a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

# A key with more than 1/HEAVY_SHARE of all rows is heavy, so there are fewer than
# HEAVY_SHARE heavy keys however large the input is.
HEAVY_SHARE = 1000


def text_of(name: str) -> Column:
    """The text, NULL counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts without other letters take the fast built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators name their working columns ``__...``. Columns of the first frame with such
    names are the caller's: they have other names during the operator, and theirs again after.
    """
    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        theirs = [c for c in df.columns if c.startswith("__")]
        aside = {c: free_name(df, f"theirs{i}") for i, c in enumerate(theirs)}
        named = lambda x: aside.get(x, x) if isinstance(x, str) else x
        out = operator(
            df.withColumnsRenamed(aside), *map(named, args), **{k: named(v) for k, v in options.items()}
        )
        return out.withColumnsRenamed({new: old for old, new in aside.items()})

    return run


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names clash in any case)."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int,
    how: str = "inner",
) -> DataFrame:
    """Join rows to a saved table of one row per key without gathering a heavy key.

    ``size`` counts the rows of each key. Heavy keys number fewer than
    ``HEAVY_SHARE``; they are broadcast and their rows stay where they are. The rest
    is shuffled by key, where no key has more than 1/HEAVY_SHARE of the rows.
    ``groups`` must be small per row (digests and numbers, not texts).
    """
    limit = total // HEAVY_SHARE
    heavy = F.broadcast(groups.where(F.col(size) > limit))
    light = groups.where(F.col(size) <= limit)
    near = match(rows, heavy, keys, "inner")
    far = match(match(rows, heavy.select(*keys), keys, "left_anti"), light, keys, how)
    return near.unionByName(far)


def saved(df: DataFrame) -> tuple[DataFrame, int]:
    """The frame written to the shared folder, and its number of rows."""
    table = save_stage(df)
    return table, table.count()
