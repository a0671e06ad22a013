"""Small tables with the awkward cases, and plain-Python helpers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))

AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, "x" * 200_000, "de", None, 200_000),
    (7, "Ärger über ÄÖ und 日本語 🎉", "de", "b", 1),
    (8, "ärger über ÄÖ und 日本語 🎉", "de", "b", 1),
    (None, "no id here but some words to read on the way home", None, None, None),
    (9, "The Same Text", "en", "a", 13),
    (10, "the same text", "en", "a", 13),
    (10, "the same text", "en", "a", 13),
    (11, "one two three four", "fr", "c", 18),
    (12, "one two three", "fr", "c", 13),
]


def documents(spark: SparkSession, rows=AWKWARD, schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """The frame with extra columns that have the operator's own names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("theirs") for n in names})


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
