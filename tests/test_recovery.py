import pytest
from pyspark.sql import functions as F

from tests.fixtures import BEHAVIOUR, MAIN_TIMES, ONE_SECOND_TIMES, behaviour
from tidemark.operators import recovery, summaries


@pytest.fixture
def main(spark):
    return spark.createDataFrame(behaviour(MAIN_TIMES), BEHAVIOUR)


def curve(main, **kwargs):
    out = recovery.recovery_curve(
        main, "animal", "cohort", "stage", "seconds", ["stage_3", "stage_4"], 60.0, **kwargs
    )
    rows = out.collect()
    assert len(rows) == len({(r.cohort, r.stage, r.bin) for r in rows}) == 32 * 2 * 2
    return {(r.cohort, r.stage, r.bin): round(r.proportion, 2) for r in rows}


def spans(*parts):
    return {b: p for lo, hi, p in parts for b in range(lo, hi + 1)}


EXPECTED = {
    ("2.5_5", "stage_3"): spans(
        (0, 0, 16.67), (1, 2, 33.33), (3, 3, 66.67), (4, 9, 100), (10, 19, 83.33),
        (20, 23, 66.67), (24, 24, 50), (25, 30, 33.33), (31, 31, 0),
    ),
    ("2.5_5", "stage_4"): spans(
        (0, 9, 0), (10, 19, 16.67), (20, 23, 33.33), (24, 24, 50), (25, 30, 66.67), (31, 31, 100)
    ),
    ("3_20", "stage_3"): spans((0, 19, 0), (20, 28, 16.67), (29, 31, 33.33)),
    ("3_20", "stage_4"): spans((0, 31, 0)),
}


def test_curve(main):
    found = curve(main, hold_full=False)
    for (cohort, stage), bins in EXPECTED.items():
        assert {b: found[cohort, stage, b] for b in bins} == bins


def test_curve_stays_full(main):
    found = curve(main)
    assert [found["2.5_5", "stage_3", b] for b in range(4, 32)] == [100] * 28
    assert found["2.5_5", "stage_4", 30] == 66.67
    assert found["3_20", "stage_3", 31] == 33.33


def test_curve_equals_the_carried_grid(main):
    binned = recovery.with_bin(main, "seconds", 60.0)
    grid = recovery.filled_grid(binned, "animal", "cohort", "stage", ["2.5_5", "3_20"], 32)
    present = grid.where(F.col("stage").isNotNull()).groupBy("cohort", "stage", "bin")
    counts = present.agg(F.count_distinct("animal").alias("n")).collect()
    found = curve(main, hold_full=False)
    assert {(r.cohort, r.stage, r.bin): round(r.n / 6 * 100, 2) for r in counts} == {
        key: p for key, p in found.items() if p
    }


def test_two_stages_in_one_bin(spark):
    rows = [(1, "c", "stage_3", 5.0), (1, "c", "stage_4", 8.0), (2, "c", "stage_3", 130.0)]
    df = spark.createDataFrame(rows, BEHAVIOUR)
    out = recovery.recovery_curve(
        df, "animal", "cohort", "stage", "seconds", ["stage_3", "stage_4"], 60.0, False
    )
    found = {(r.stage, r.bin): r.proportion for r in out.collect()}
    assert [found["stage_3", b] for b in range(3)] == [50, 0, 50]
    assert [found["stage_4", b] for b in range(3)] == [50, 50, 50]


@pytest.mark.parametrize(
    "times, cohort, stage, mean, sd, low, high, n",
    [
        (MAIN_TIMES, "2.5_5", "stage_3", 179.6667, 91.0048, 42, 252, 6),
        (MAIN_TIMES, "2.5_5", "stage_4", 1435.6667, 486.2068, 602, 1910, 6),
        (MAIN_TIMES, "3_20", "stage_3", 1483.5, 362.7458, 1227, 1740, 6),
        (MAIN_TIMES, "3_20", "stage_4", None, None, None, None, 6),
        (ONE_SECOND_TIMES, "2.5_1", "stage_3", 9.7, 4.6440, 4, 18, 10),
        (ONE_SECOND_TIMES, "2.5_1", "stage_4", 65.8, 65.4265, 12, 167, 10),
        (ONE_SECOND_TIMES, "2_1", "stage_3", 5.9, 7.1717, 0, 24, 10),
        (ONE_SECOND_TIMES, "2_1", "stage_4", 20.7, 26.0770, 5, 92, 10),
    ],
)
def test_stage_summary(spark, times, cohort, stage, mean, sd, low, high, n):
    df = spark.createDataFrame(behaviour(times), BEHAVIOUR)
    out = summaries.stage_summary(df, ["cohort", "stage"], "seconds")
    r = out.where((F.col("cohort") == cohort) & (F.col("stage") == stage)).first()
    assert r.n == n
    assert (r.min_value, r.max_value) == (low, high)
    assert [r.mean_value, r.sd_value] == ([None, None] if mean is None else pytest.approx([mean, sd], abs=1e-4))
