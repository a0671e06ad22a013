"""Hot groups give what window functions give, and what plain Python gives."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.groups import ColdStats, HotStats, Median, attach, by_size, hot_groups
from tidemark.operators.recovery import carry_forward
from tidemark.operators.roles import Roles
from tidemark.operators.timebase import sample_index
from tidemark.quantiles import group_quantiles

SKEWED = "k string, t double, v double"


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key, n in (("hot", 400), ("warm", 60), ("small", 9), (None, 50)):
        values = rng.choice([1.0, 2.0, 2.5, 9.0, 10.0], n) + (rng.random(n) > 0.5) * rng.random(n)
        rows += [(key, float(t), float(v)) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, SKEWED).repartition(5).cache()


def grouped(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    return groups


@pytest.mark.usefixtures("tiny_limits")
class TestHot:
    def test_detection(self, skewed):
        assert {r.k for r in hot_groups(skewed, ["k"]).collect()} == {"hot", "warm", None}

    @pytest.mark.parametrize("strategy", [ColdStats, HotStats])
    def test_statistics(self, skewed, strategy):
        out = strategy().attach(
            skewed, ["k"], low=F.min("v"), middle=Median(F.when(F.col("t") < 40, F.col("v")))
        )
        for rows in grouped(out).values():
            early = [r.v for r in rows if r.t < 40]
            assert {r.low for r in rows} == {min(r.v for r in rows)}
            assert [r.middle for r in rows] == pytest.approx([statistics.median(early)] * len(rows))

    def test_quantiles(self, skewed):
        probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
        out = group_quantiles(skewed, ["k"], F.col("v"), probabilities)
        groups = grouped(skewed)
        for r in out.collect():
            values = [x.v for x in groups[r.k]]
            assert r.n == len(values)
            assert r.quantiles == pytest.approx(list(np.quantile(values, probabilities)))

    def test_quantile_without_keys(self, skewed):
        values = [r.v for r in skewed.collect()]
        r = group_quantiles(skewed, [], F.col("v"), [0.5]).first()
        assert (r.n, r.quantiles[0]) == (len(values), pytest.approx(np.median(values)))

    def test_rank_over_many_parts(self, spark):
        """More distinct values inside the bracket than one task may rank."""
        values = [float(i * 7919 % 20011) for i in range(20011)]
        df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(4)
        r = group_quantiles(df, ["k"], F.col("v"), [0.5, 0.123]).first()
        assert r.quantiles == pytest.approx(list(np.quantile(values, [0.5, 0.123])))

    def test_sample_index(self, skewed):
        out = sample_index(skewed, Roles("k", "t", "v", ""))
        for rows in grouped(out).values():
            assert all(r.sample == int(r.t) for r in rows)

    def test_sample_index_with_copies(self, spark):
        df = spark.createDataFrame([("a", 1.0)] * 150, "k string, t double")
        found = sorted(r.sample for r in sample_index(df, Roles("k", "t")).collect())
        assert found == list(range(150))

    def test_carry_forward(self, skewed):
        gaps = skewed.withColumn("seen", F.when((F.col("t") % 37) == 5, F.col("t")))
        out = carry_forward(gaps, ["k"], ["t"], "seen")
        for rows in grouped(out).values():
            for r in rows:
                last = (r.t - 5) // 37 * 37 + 5
                assert r.seen == (last if r.t >= 5 else None)

    def test_union_of_parts_is_whole(self, skewed):
        out = by_size(skewed, ["k"], lambda df, s: s.attach(df, ["k"], n=F.count(F.lit(1))))
        assert {(r.k, r.n) for r in out.collect()} == {("hot", 400), ("warm", 60), ("small", 9), (None, 50)}
        assert out.count() == skewed.count()


@pytest.mark.usefixtures("tiny_limits", "no_broadcast")
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join(spark, skewed, how):
    table = spark.createDataFrame(
        [("hot", 1), ("small", 2), ("x", 3), ("y", 4), (None, 5)], "k string, w int"
    )
    found = attach(skewed, table, ["k"], how)
    counts = {r.k: r["count"] for r in found.groupBy("k").count().collect()}
    sizes = {"hot": 400, "warm": 60, "small": 9, None: 50}
    matched = {"hot", "small", None}
    expected = {
        "left": sizes,
        "left_anti": {k: n for k, n in sizes.items() if k not in matched},
    }.get(how, {k: n for k, n in sizes.items() if k in matched})
    assert counts == expected
    if how in ("left", "inner"):
        assert {r.w for r in found.where(F.col("k").isNull()).collect()} == {5}
