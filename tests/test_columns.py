from pyspark.sql import functions as F

from tidemark.functions import columns as c


def one(spark, expression, **values):
    schema = ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()
    )
    row = spark.createDataFrame([tuple(values.values())], schema)
    return row.select(expression).first()[0]


def test_text_that_is_no_number_becomes_null(spark):
    assert one(spark, c.number(F.col("x")), x="abc") is None
    assert one(spark, c.number(F.col("x")), x="NaN") is None
    assert one(spark, c.number(F.col("x")), x=" 2.5e-3") == 0.0025


def test_clock(spark):
    assert one(spark, c.clock_seconds(F.col("x")), x="00:29:13") == 1753
    assert one(spark, c.clock_seconds(F.col("x")), x="00:00:01.5") == 1.5
    assert one(spark, c.clock_seconds(F.col("x")), x="30:00:00") == 108000
    assert one(spark, c.clock_seconds(F.col("x")), x="noon") is None


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    stamp = F.lit("2024-03-10 02:30:07.179575").cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, c.epoch_seconds(stamp), x=0.0) == 1710037807.179575
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_division_and_root(spark):
    assert one(spark, c.percent_of(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, c.percent_of(F.col("a"), F.col("b")), a=1.0, b=4.0) == 25.0
    assert one(spark, c.root(F.col("a")), a=-1.0) is None
    assert one(spark, c.root(F.col("a")), a=9.0) == 3.0


def test_exact_and_contained_markers_differ(spark):
    text = "In slurry -2.5degC"
    assert one(spark, c.is_exactly(F.col("x"), "in slurry"), x=text) is False
    assert one(spark, c.mentions(F.col("x"), "in slurry"), x=text) is True
    assert one(spark, c.mentions(F.col("x"), "in slurry"), x="into slurry") is False


def test_bin_labels(spark):
    label = c.bin_label(F.lit(60), F.lit(120))
    assert one(spark, label, x=0.0) == "[60,120)"
    start, end, mid = c.label_bounds(label)
    assert one(spark, F.array(start, end, mid), x=0.0) == [60.0, 120.0, 90.0]
