"""Scalar expressions with the null rules of the analysis.

Everything here stays inside whole-stage codegen. Text that is not a number
becomes NULL, a division by zero becomes NULL and the root of a negative number
becomes NULL, so that aggregates skip the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826  # consistency factor of the median absolute deviation

Span = Callable[[Column, Column], Column]


def number(text: Column) -> Column:
    """Text to double; non-numeric text and NaN become NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def known(value: Column) -> Column:
    """The value, with NaN as NULL: NaN is a missing value in every statistic."""
    return F.when(~F.isnan(value.cast("double")), value)


def clock_seconds(text: Column) -> Column:
    """``hh:mm:ss`` or ``hh:mm:ss.0`` to seconds; hours may exceed 24."""
    part = F.split(F.trim(text), ":")
    return (
        F.try_element_at(part, F.lit(1)).try_cast("double") * 3600
        + F.try_element_at(part, F.lit(2)).try_cast("double") * 60
        + F.try_element_at(part, F.lit(3)).try_cast("double")
    )


def epoch_seconds(timestamp: Column) -> Column:
    """TIMESTAMP_NTZ to seconds since 1970, to the microsecond, in any session zone."""
    seconds = (
        F.unix_date(timestamp.cast("date")).cast("long") * 86400
        + F.hour(timestamp) * 3600
        + F.minute(timestamp) * 60
    )
    fraction = (F.extract(F.lit("SECOND"), timestamp) * 1000000).cast("long")
    return (seconds * 1000000 + fraction) / F.lit(1e6)


def percent_of(value: Column, baseline: Column) -> Column:
    return F.try_divide(value, baseline) * 100


def root(value: Column) -> Column:
    return F.when(value >= 0, F.sqrt(value))


def bin_of(time: Column, width: float) -> Column:
    return F.floor(time / F.lit(float(width)))


def is_exactly(comment: Column, text: str) -> Column:
    """Case-sensitive marker."""
    return comment == F.lit(text)


def mentions(comment: Column, pattern: str) -> Column:
    """Case-insensitive marker: the pattern occurs anywhere in the comment."""
    return comment.rlike("(?i)" + pattern)


def first_match(rules: Sequence[tuple[str, object]], column: Callable[[int, str], Column]) -> Column:
    """Value of the first rule whose condition holds, else NULL."""
    return F.coalesce(
        *[F.when(column(i, pattern), F.lit(tag)) for i, (pattern, tag) in enumerate(rules)]
    )


def before_marker(start: float, margin: float) -> Span:
    """``[start, marker - margin)``."""
    return lambda time, marker: (time >= start) & (time < marker - margin)


def after_marker(offset: float) -> Span:
    """``[marker + offset, end)``."""
    return lambda time, marker: time >= marker + offset


def bin_label(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), start.cast("string"), F.lit(","), end.cast("string"), F.lit(")"))


def label_bounds(label: Column) -> tuple[Column, Column, Column]:
    """Start, end and midpoint of a ``[a,b)`` label."""
    part = F.split(F.regexp_replace(label, r"[\[\]()]", ""), ",")
    start = F.try_element_at(part, F.lit(1)).try_cast("double")
    end = F.try_element_at(part, F.lit(2)).try_cast("double")
    return start, end, (start + end) / 2
