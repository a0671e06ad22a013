from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, clashing, documents
from tidemark.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(rows):
    found = defaultdict(list)
    for doc_id, text, *_ in rows:
        found[(text or "").translate(LOWER)].append(doc_id)
    return found


@pytest.mark.parametrize("blocks", [1, exact_dedup.MAX_BLOCKS])
def test_marks_match_brute_force(spark, blocks):
    rows = [*AWKWARD, *[(100 + i, f"Copy {i % 40}", "en", "a", 1) for i in range(300)]]
    out = exact_dedup.mark_copies(documents(spark, rows), max_blocks=blocks).collect()
    want = groups(rows)
    assert len(out) == len(rows)
    by_keep = defaultdict(list)
    for r in out:
        by_keep[r.text_sha256].append(r)
    assert len(by_keep) == len(want)
    for ids in want.values():
        best = max((i for i in ids if i is not None), default=None)
        mine = [r for rs in by_keep.values() for r in rs if r.keep_id == best and r.doc_id in ids]
        assert {r.group_size for r in mine} == {len(ids)}
        assert sum(r.kept for r in mine) == 1  # also of the repeated row 10


def test_dropping_keeps_every_column(spark):
    docs = clashing(documents(spark), "kept", "keep_id", "text_sha256")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 2, 3, 5, 6, 7, 8, 10, 11, 12]


def test_filter_has_no_false_negative(spark):
    values = spark.range(2000).select(F.xxhash64("id").alias("h"))
    twice = values.unionByName(values.limit(700))
    bloom = exact_dedup.repeat_filter(twice, "h", 1)
    probed = exact_dedup.probe(twice, F.col("h"), bloom, "may")
    repeated = twice.groupBy("h").count().where("count > 1").select("h")
    assert probed.join(repeated, "h").where("not may").count() == 0
    assert probed.where("not may").count() > 600


def test_empty_table(spark):
    assert exact_dedup.exact_dedup_report(documents(spark, [])).count() == 0
    assert exact_dedup.drop_copies(documents(spark, [])).count() == 0
