"""Columns of the caller that have an operator's working names come back unchanged."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import clashing
from tidemark import groups, llm
from tidemark.llm import exact_dedup, html_text, near_dedup, quality, url_filters

SOURCES = [*Path(llm.__file__).parent.glob("*.py"), Path(groups.__file__)]
WORKING = sorted({n.lower() for p in SOURCES for n in re.findall(r'\b(__[a-z]\w*?)\b(?!__)', p.read_text()) if not n.endswith("__")})
LONG = " ".join(f"w{i}" for i in range(40))
DOCS = [(1, LONG, "en"), (2, LONG.upper(), "en"), (3, LONG + " more", "de"), (4, "short", None), (None, None, "en")]
PAGES = [(i, f"http://h.org/a/{i}", f"<p>Menu</p><article>Text {i} of the page</article>") for i in range(4)]


def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string")


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def assess(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    return quality.assess(docs, labels)


def judge(spark, given):
    outcomes = spark.createDataFrame([("http://h.org/x", True)], "url string, bad boolean")
    return url_filters.judge_urls(given, outcomes, [])


OPERATORS = {
    "drop_copies": (documents, lambda spark, d: exact_dedup.drop_copies(d)),
    "drop_near": (documents, lambda spark, d: near_dedup.drop_near(d)),
    "assess": (documents, assess),
    "judge_urls": (pages, judge),
    "extract_text": (pages, lambda spark, d: html_text.extract_text(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_working_names_may_be_taken(spark, name):
    assert {"__block", "__bits", "__host", "__row", "__text", "__words", "__pages"} <= set(WORKING)
    make, run = OPERATORS[name]
    frame = make(spark)
    plain = run(spark, frame)
    taken = run(spark, clashing(frame, *WORKING))
    assert set(taken.columns) == {*plain.columns, *WORKING}
    rows = taken.collect()
    assert all(r[n] == "theirs" for r in rows for n in WORKING)
    cut = sorted(repr([r[c] for c in plain.columns]) for r in rows)
    assert cut == sorted(repr(list(r)) for r in plain.collect())


def test_a_column_that_the_operator_reads_may_have_such_a_name(spark):
    docs = documents(spark).withColumnsRenamed({"doc_id": "__id", "text": "__row"})
    out = exact_dedup.drop_copies(docs, "__id", text_col="__row")
    assert sorted(r["__id"] or 0 for r in out.collect()) == [0, 2, 3, 4]
    assert out.columns == docs.columns
