from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.frames import AWKWARD, clashing, documents, words
from tidemark.llm import quality
from tidemark.session import BROADCAST_ROWS

LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    w = words(text)
    seen, twice = set(), set()
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    for g in grams:
        (twice if g in seen else seen).add(g)
    covered = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts_match_brute_force(spark):
    random.seed(2)
    made = [(50 + i, "".join(random.choice(["ab ", "c ", "# ", "\n", "Z\t", "é "]) for _ in range(random.randrange(90))),
             "en", "a", 0) for i in range(200)]
    rows = [*AWKWARD, *made, (900, "a b\x1fc\x85d\xa0e " * 12, "en", "a", 0)]
    docs = clashing(documents(spark, rows), "n_words", "kept", "symbol_share")
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 0)], LABELS)
    out = quality.quality_report(docs, labels).collect()
    found = sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.base_failed) for r in out)
    want = []
    for doc_id, text, *_ in rows:
        c = counts(text)
        want.append((doc_id or -1, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert found == sorted(want)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.3), (2, 50, 0.1), (5, 4000, 0.002), (9, 10, 0.5), (3000, 1_000_000, 0.004)])
def test_binomial_bound(spark, k, n, p):
    row = spark.range(1).select(
        quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("p")
    ).first()
    if k >= n * p:
        assert row.p == 1.0
    else:
        log = lambda j: (math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                         + j * math.log(p) + (n - j) * math.log(1 - p))
        assert row.p == pytest.approx(sum(math.exp(log(j)) for j in range(k + 1)), rel=1e-6)


def test_false_rejection_is_controlled_per_stratum(spark):
    """Junk goes, good text stays within the risk, and a stratum without labels has no rule."""
    random.seed(4)
    clean = lambda: " ".join("".join(random.choice("abcdefg") for _ in range(5)) for _ in range(30))
    junk = lambda: " ".join(x + "***" for x in clean().split())
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, junk() if bad else clean(), ("en", "de")[i % 2], "a", 1))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(5000 + i, junk(), "fr", "a", 1) for i in range(10)]
    control = quality.Control(risk=0.02)
    out = quality.assess(documents(spark, rows), spark.createDataFrame(labels, LABELS), control)
    kept = {r.doc_id: r.kept for r in out.select("doc_id", "kept").collect()}
    assert all(kept[i] for i in range(1500) if i % 5)
    assert not any(kept[i] for i in range(0, 1500, 5))
    assert all(kept[5000 + i] for i in range(10))


def test_small_strata_get_rules_from_their_pool(spark, tmp_path):
    """At the production risk no language can pass a test alone, but together they can."""
    random.seed(5)
    clean = lambda: " ".join("".join(random.choice("abcdefg") for _ in range(5)) for _ in range(22))
    junk = lambda: " ".join(x + "***" for x in clean().split())
    rows = [(i, junk() if i % 10 == 0 else clean(), ("en", "de", "fr", "es")[i % 4], "a", 1) for i in range(3600)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(3600)], LABELS)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, rows)
    left = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i in range(3600) if i % 10}
    # A stratum that can pass alone keeps its own cutoffs; the query follows its SQL, without a pool.
    both = quality.Control(pool_small=True, risk=0.01)
    features = quality.with_features(docs).withColumn(
        "__stratum", F.when(F.col("lang") == "es", F.concat("lang", F.col("doc_id") % 5)).otherwise(F.col("lang")))
    named = {r["__named"] for r in quality.thresholds(features, labels, both, "doc_id").collect()}
    assert named == {"en", "de", "fr", None}
    assert quality.quality_report(docs, labels).where("not kept").count() == 0


def test_strata_beyond_the_bound_are_pooled(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(25)), f"l{i % 6}", "a", 1) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], LABELS)
    control = quality.Control(max_strata=2)
    features = quality.with_features(documents(spark, rows)).withColumn("__stratum", F.col("lang"))
    table = quality.thresholds(features, labels, control, "doc_id")
    assert table.count() == 3 and table.where("__named is null").count() == 1


@pytest.mark.parametrize("rows_broadcast", [None, "3"])
def test_every_stratum_has_its_own_cutoffs(spark, rows_broadcast):
    """Also beyond 64: the junk of y goes, although the good texts of z look the same."""
    plain, junk = " ".join(f"word{j}" for j in range(25)), " ".join(f"word{j}***" for j in range(25))
    langs = [*[f"l{i}" for i in range(64)], "y", "z"]
    rows = [(15 * n + i, junk if lang == "z" else plain, lang, "a", 1) for n, lang in enumerate(langs) for i in range(15)]
    rows.append((5000, junk, "y", "a", 1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15 * len(langs))], LABELS)
    if rows_broadcast:
        spark.conf.set(BROADCAST_ROWS[0], rows_broadcast)
    try:
        out = quality.assess(documents(spark, rows), labels, quality.Control(risk=0.5))
        assert [r.doc_id for r in out.where("not kept").collect()] == [5000] and out.count() == len(rows)
    finally:
        spark.conf.unset(BROADCAST_ROWS[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.quality_report(documents(spark, []), none).count() == 0
    docs = clashing(documents(spark), "kept")
    left = quality.drop_rejected(docs, none)
    assert left.columns == docs.columns and left.count() == 0  # all too short or repetitive
