"""Every operator as a query over the star-schema tables.

``events`` plays a set of recordings: the user is the recording, seconds since
the user's first event are its time, ``value`` is the signal and the event type
is the comment (with " high" added from 80 up). ``lineitem`` plays the same part
for larger data, with the supplier as the recording and days as time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.functions.columns import (
    after_marker,
    before_marker,
    epoch_seconds,
    is_exactly,
    label_bounds,
    mentions,
    root,
)
from tidemark.groups import attach, by_size, match
from tidemark.operators import baseline, cohorts, epochs, markers, nearest, outliers, recovery
from tidemark.operators import summaries, timebase, troughs
from tidemark.operators.large_linear import fit_linear_large
from tidemark.operators.linear_models import fit_linear
from tidemark.operators.mixed_models import fit_random_intercept
from tidemark.operators.wide_mixed_models import fit_random_intercept_wide
from tidemark.operators.range_minimum import lowest_in_windows
from tidemark.operators.roles import Roles
from tidemark.plans import recordings as plans
from tidemark.session import save_stage, stage_folder
from tidemark.sources.file_order import read_in_file_order
from tidemark.sources.recordings import RECORDING_COLUMNS, clean_recordings, read_recordings
from tidemark.sources.tables import load_table, save_table

DAY = 86400.0
ROLES = Roles("user_id", "t", "value", "comment", ("event_id",))
ITEMS = Roles("l_suppkey", "t", "l_extendedprice", "comment", ("l_orderkey", "l_linenumber"))

# The experiments' protocols stretched to days.
DAILY = dict(
    margin=DAY, after_offset=DAY, mean_start=DAY, width=DAY, window=DAY / 3, horizon=30 * DAY
)
ONE_MARKER = replace(
    plans.COLD_SHOCK, zero="error high", before="error high", after="error high",
    median_marker="error high", mean_marker="error high", **DAILY,
)
TWO_MARKERS = replace(
    plans.STUN_THEN_COLD, zero="error high", before="signup high", after="error high",
    median_marker="error high", mean_marker="signup high", **DAILY,
)
RECOVERY = replace(
    plans.STUN_RECOVERY, zero="purchase high", before="error high", after="purchase high",
    median_marker="error high", mean_marker="error high", **DAILY,
)
ITEM_PROTOCOL = replace(
    plans.COLD_SHOCK, zero="r full", before="R full", after="R full", median_marker="R full",
    mean_marker="R full", margin=30 * DAY, after_offset=30 * DAY, mean_start=30 * DAY,
    width=30 * DAY, window=10 * DAY, horizon=2400 * DAY, last_bin=60,
)


def _exact(text: str):
    return is_exactly(F.col("comment"), text)


def _r(column, name: str):
    return F.round(column, 6).alias(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    comment = F.concat("event_type", F.when(F.col("value") >= 80, " high").otherwise(""))
    return table(spark, sf, "events").select(
        "user_id", "event_id", "value", comment.alias("comment"), epoch_seconds(F.col("ts")).alias("clock")
    )


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.relative_time(samples(spark, sf), ROLES, "clock")


def per_recording(df: DataFrame, plan: Callable, roles: Roles = ROLES) -> DataFrame:
    """``plan(rows with relative time, stats)``; recordings are split by size once."""
    return by_size(
        df, [roles.key], lambda part, s: plan(timebase.relative_time(part, roles, "clock", s), s)
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    comment = F.concat("l_returnflag", F.when(F.col("l_quantity") >= 50, " full").otherwise(""))
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", comment.alias("comment"),
        epoch_seconds(F.col("l_shipdate")).alias("clock"),
    )


def timed_items(spark: SparkSession, sf: str) -> DataFrame:
    return timebase.relative_time(items(spark, sf), ITEMS, "clock")


# --- sources ---------------------------------------------------------------------


def _write_recordings(events: DataFrame) -> str:
    """CSV files as the recorder exports them: a header, two unit rows, samples.

    Every task writes the files of its own rows; nothing is shuffled. High
    sign-ups carry text where a number belongs, and views have no comment.
    """
    value = F.col("value").cast("string")
    broken = (F.col("event_type") == "signup") & (F.col("value") >= 80)
    signals = [F.col("event_id").cast("string"), F.col("user_id").cast("string"),
               F.when(broken, "n/a").otherwise(value), *[value] * 6]
    comment = F.when(F.col("event_type") != "view", F.col("event_type"))
    columns = [F.date_format("ts", "HH:mm:ss"), *signals, comment]
    rows = events.select(*[c.alias(n) for c, n in zip(columns, RECORDING_COLUMNS)])

    def with_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if number == 0:
                units = {name: ["unit", "unit"] for name in batch.schema.names}
                yield pa.RecordBatch.from_pydict(units, schema=batch.schema)
            yield batch

    path = f"{stage_folder(events.sparkSession)}/recordings-{uuid.uuid4().hex}"
    rows.mapInArrow(with_units, rows.schema).write.csv(path, header=True)
    return path


def scan_recordings(spark, sf):
    raw = read_recordings(spark, _write_recordings(table(spark, sf, "events")))
    return raw.select(
        "time", F.col("raw_eeg").alias("event_text"), F.col("alpha").alias("alpha_text"), "comments",
        F.col("source_file").rlike(r"^part-[^/]*[.]csv$").alias("named"),
    )


def _write_one_file_each(events: DataFrame) -> str:
    """A CSV file per user: header, two unit rows, samples from the lowest value up.

    The clock shows whole hours, so many samples of a file have the same time.
    """
    text = lambda c: F.col(c).cast("string")
    cells = [F.date_format("ts", "HH:00:00"), text("event_id"), text("user_id"), *[text("value")] * 7,
             F.col("event_type")]
    named = lambda columns: [c.alias(n) for c, n in zip(columns, RECORDING_COLUMNS)]
    place = F.struct(F.lit(1).alias("kind"), "value", "event_id")
    units = F.struct(F.lit(0).alias("kind"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("event_id"))
    rows = events.select(F.col("user_id").alias("recording"), place.alias("place"), *named(cells)).unionByName(
        events.select(F.col("user_id").alias("recording")).distinct().select(
            "recording", F.explode(F.array(units, units)).alias("place"),
            *named([F.lit("unit")] * len(RECORDING_COLUMNS))))
    path = f"{stage_folder(events.sparkSession)}/recordings-{uuid.uuid4().hex}"
    ordered = rows.repartition("recording").sortWithinPartitions("recording", "place").drop("place")
    ordered.write.partitionBy("recording").csv(path, header=True)
    return path


def _in_file_order(spark, sf):
    folder = _write_one_file_each(table(spark, sf, "events"))
    return read_in_file_order(spark, folder, recursive=True).select(
        F.col("beta").cast("long").alias("user_id"), F.col("raw_eeg").cast("long").alias("event_id"),
        "time", "row")


def file_order(spark, sf):
    return _in_file_order(spark, sf).drop("time")


def first_in_file(spark, sf):
    """Of samples with the same clock the one that the file has first."""
    return markers.first_per_group(_in_file_order(spark, sf), ["user_id", "time"], ["row"])


def clean(spark, sf):
    raw = read_recordings(spark, _write_recordings(table(spark, sf, "events")))
    cleaned = timebase.parse_clock(clean_recordings(raw), "time")
    return cleaned.select(
        F.col("raw_eeg").cast("long").alias("event_id"), F.col("beta").cast("long").alias("user_id"),
        _r(F.col("alpha"), "value"), "comments", "time_seconds",
    )


# --- time and markers ------------------------------------------------------------


def relative_time(spark, sf):
    return timed(spark, sf).select("user_id", "event_id", _r(F.col("t"), "t"))


def marker_first(spark, sf):
    times = markers.marker_times_of_clock(
        samples(spark, sf), ROLES, "clock", first_exact=_exact("error high"),
        first_mention=mentions(F.col("comment"), "ERROR"), first_second=_exact("purchase high"),
    ).drop("start_clock")
    return times.select("user_id", *[_r(F.col(c), c) for c in times.columns[1:]])


def marker_relative_time(spark, sf):
    shifted = per_recording(samples(spark, sf), lambda df, s: timebase.since_marker(
        df, ROLES, _exact("error high"), stats=s
    ))
    return shifted.select("user_id", "event_id", _r(F.col("marker_time"), "marker_time"))


def marker_interval(spark, sf):
    found = markers.marker_interval(
        samples(spark, sf), ROLES, _exact("error high"), _exact("purchase high"), "clock"
    )
    return found.select("user_id", _r(F.col("interval"), "interval"))


def between_markers(spark, sf):
    rows = per_recording(samples(spark, sf), lambda df, s: markers.between_markers(
        df, ROLES, _exact("error high"), _exact("purchase high"), 3600.0, s
    ))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("all_count"), _r(F.avg("value"), "mean_value")
    )


def crop_around_marker(spark, sf):
    rows = per_recording(samples(spark, sf), lambda df, s: markers.crop_around_marker(
        df, ROLES, _exact("error high"), DAY, 6 * DAY, s
    ))
    return rows.select("user_id", "event_id", _r(F.col("t"), "t"), "value")


def first_per_group(spark, sf):
    """First row of each user and comment; a user's start is the earliest of these rows."""
    df = samples(spark, sf).select("user_id", "comment", "clock", "event_id", "value")
    first = markers.first_per_group(df, ["user_id", "comment"], ["clock", "event_id"])
    start = F.min("clock").over(Window.partitionBy("user_id"))  # a row per comment
    return first.withColumn("t", F.col("clock") - start).select(
        "user_id", "comment", "event_id", "value", _r(F.col("t"), "t")
    )


def slice_min_ties(spark, sf):
    """Smallest order quantity of each part, all rows that share it."""
    rows = markers.smallest_with_ties(
        table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"),
        ["l_partkey"], "l_quantity",
    )
    return rows


def sample_index(spark, sf):
    numbered = per_recording(
        samples(spark, sf), lambda df, s: timebase.sample_index(df, ROLES, "sample", s)
    )
    return numbered.select("user_id", "event_id", F.col("sample").cast("long").alias("sample"))


# --- outliers and baselines ------------------------------------------------------


def _filter_pre(df, stats):
    return outliers.mad_filter_in_window(
        df, ROLES, _exact("error high"), before_marker(0.0, DAY), 0.5, stats
    )


def _filter_both(df, stats):
    return outliers.mad_filter_in_window(
        _filter_pre(df, stats), ROLES, _exact("error high"), after_marker(DAY), 1.0, stats
    )


def mad_filter_pre(spark, sf):
    kept = per_recording(samples(spark, sf), _filter_pre)
    return kept.select("user_id", "event_id", "value")


def mad_filter_post(spark, sf):
    kept = per_recording(samples(spark, sf), _filter_both)
    return kept.select("user_id", "event_id", "value")


BANDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _bands(spark, sf):
    return epochs.to_long(table(spark, sf, "lineitem").select(*LINE, *BANDS), BANDS, LINE)


def mad_filter_long(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_suppkey", *BANDS)
    kept = outliers.mad_filter_columns(wide, ["l_suppkey"], BANDS, 1.0)
    kept = epochs.to_long(kept, BANDS, ["l_suppkey"]).where(F.col("power").isNotNull())
    return kept.groupBy("l_suppkey", "band").agg(
        F.count(F.lit(1)).alias("kept"), _r(F.sum("power"), "total")
    )


def _in_baseline(operator, *args):
    """The operator over each recording's baseline, up to a day before the marker."""
    return lambda df, stats: operator(
        df, ROLES, _exact("error high"), before_marker(0.0, DAY), *args, stats=stats
    )


_percent = _in_baseline(baseline.percent_of_baseline)


def baseline_window(spark, sf):
    rows = per_recording(samples(spark, sf), _in_baseline(baseline.baseline_rows))
    return rows.select("user_id", "event_id", _r(F.col("t"), "t"), "value")


def baseline_median(spark, sf):
    medians = per_recording(samples(spark, sf), _in_baseline(baseline.baseline_medians))
    return medians.select("user_id", _r(F.col("baseline"), "baseline"))


def baseline_counts(spark, sf):
    return per_recording(samples(spark, sf), _in_baseline(baseline.baseline_counts))


def percent_of_baseline(spark, sf):
    rows = per_recording(samples(spark, sf), _percent)
    return rows.select("user_id", "event_id", _r(F.col("pct_value"), "pct_value"))


def baseline_epoch(spark, sf):
    def plan(df, stats):
        return baseline.baseline_epoch(
            _percent(df, stats), ROLES, _exact("error high"), before_marker(DAY, DAY), "pct_value", stats
        )

    epoch = per_recording(samples(spark, sf), plan)
    return epoch.select("user_id", "bin", "marker_time", _r(F.col("pct_value"), "pct_value"))


# --- epochs ----------------------------------------------------------------------


def _from_marker(df, stats):
    rows = _percent(df, stats)
    return timebase.since_marker(rows, ROLES, _exact("error high"), stats=stats)


def anchored_bins(spark, sf):
    def plan(df, stats):
        return epochs.anchored_bins(
            _from_marker(df, stats), "user_id", width=DAY, horizon=30 * DAY, stats=stats
        )

    return per_recording(samples(spark, sf), plan).select(
        "user_id", "event_id", "bin", "anchor_time", _r(F.col("start_time"), "start_time")
    )


def _epoch_means(df, stats):
    means = epochs.epoch_means(
        _from_marker(df, stats), "user_id", ["pct_value"], width=DAY, horizon=30 * DAY,
        window=DAY / 3, stats=stats,
    )
    return epochs.with_reference_lines(means)


def nearest_sample(spark, sf):
    """For moments spread over a month, one per order, the customer's nearest event."""
    anchor = (F.col("o_orderkey") * 7919 % 2_592_000).cast("double").alias("anchor")
    moments = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", anchor)
    found = nearest.nearest_samples(timed(spark, sf), moments, ROLES, "anchor", ["value"])
    return found.select(
        "user_id", "o_orderkey", "anchor", _r(F.col("nearest_time"), "nearest_time"),
        "nearest_event_id", "nearest_value")


def epoch_means(spark, sf):
    return per_recording(samples(spark, sf), _epoch_means).select(
        "user_id", "bin", "n_points", "ten_percent", "hundred_percent",
        _r(F.col("marker_time"), "marker_time"), _r(F.col("pct_value"), "pct_value"),
    )


def _protocol_epochs(protocol):
    def query(spark, sf):
        found = plans.recording_epochs(samples(spark, sf), protocol, ROLES, "clock")
        return found.select(
            "user_id", "bin", "n_points", _r(F.col("marker_time"), "marker_time"),
            _r(F.col("pct_value"), "pct_value"),
        )

    return query


def post_event_percent(spark, sf):
    return _post_event(spark, sf, False)


def post_event_percent_mad(spark, sf):
    return _post_event(spark, sf, True)


def _post_event(spark, sf, apply_mad):
    found = plans.post_event_percent(
        samples(spark, sf), TWO_MARKERS, "signup high", "error high", ROLES, "clock", 3600.0, apply_mad
    )
    return found.select("user_id", "all_count", _r(F.col("pct_value"), "pct_value"))


def _event_versus_baseline(spark, sf):
    return plans.event_versus_baseline(
        samples(spark, sf), TWO_MARKERS, "signup high", "error high", ROLES, "clock", 3600.0
    )


def event_versus_baseline(spark, sf):
    found = _event_versus_baseline(spark, sf)
    return found.select("user_id", "label", "n", _r(F.col("pct_value"), "pct_value"))


def event_glm(spark, sf):
    """sqrt(%) by section and cohort, the cohort being the user's parity."""
    found = _event_versus_baseline(spark, sf).withColumn("cohort", F.pmod("user_id", F.lit(2)))
    rooted = found.withColumn("sqrt_pct", root(F.col("pct_value")))
    return _model(fit_linear(rooted, "sqrt_pct", ["cohort", "label"]))


def band_long(spark, sf):
    renamed = _bands(spark, sf).replace({"l_extendedprice": "price"}, subset=["band"])
    return renamed.where(F.col("power") > 0)


def band_wide(spark, sf):
    measures = ["p_size", "p_retailprice"]
    parts = table(spark, sf, "part").select("p_partkey", *[F.col(m).cast("double") for m in measures])
    long = epochs.to_long(parts, measures, ["p_partkey"])
    return epochs.to_wide(long, ["p_partkey"], measures)


def sqrt_transform(spark, sf):
    accounts = table(spark, sf, "customer")
    return accounts.select("c_custkey", _r(root(F.col("c_acctbal")), "root"))


def epoch_model_input(spark, sf):
    found = plans.recording_epochs(samples(spark, sf), ONE_MARKER, ROLES, "clock")
    kept = epochs.without_bins(found, ONE_MARKER.dropped_bins)
    return kept.select("user_id", "bin", _r(root(F.col("pct_value")), "sqrt_pct"))


def epoch_lmm(spark, sf):
    found = plans.recording_epochs(samples(spark, sf), ONE_MARKER, ROLES, "clock")
    kept = epochs.without_bins(found, ONE_MARKER.dropped_bins)
    rooted = kept.withColumn("sqrt_pct", root(F.col("pct_value")))
    return fit_random_intercept(rooted, "sqrt_pct", "bin", "user_id")


# --- troughs ---------------------------------------------------------------------


CLOCKED = replace(ROLES, time="clock")


def _marked(spark, sf):
    """Start of each recording on the clock and its first error, one aggregate."""
    return save_stage(markers.marker_times_of_clock(
        samples(spark, sf), ROLES, "clock", slurry_time=mentions(F.col("comment"), "error")
    ))


def _troughs(spark, sf, marked, spans):
    """Troughs in windows of (start, end) days after the start, found on the raw clock."""
    windows = marked.select("user_id", F.explode(F.array(*[
        F.struct((F.col("start_clock") + lo).alias("lo"), (F.col("start_clock") + hi).alias("hi"))
        for lo, hi in spans
    ])).alias("w")).select("user_id", "w.lo", "w.hi")
    found = attach(troughs.trough_in_windows(samples(spark, sf), windows, CLOCKED), marked, ["user_id"])
    start = F.col("start_clock")
    return found.withColumns({
        **{c: F.round(F.col(c) - start, 3) for c in ("lo", "hi")}, "noise_time": F.col("noise_time") - start,
    })


def _week(shift=0.0):
    lo = (F.pmod(F.col("user_id"), F.lit(7)) + shift) * DAY
    return lo, lo + 10 * DAY


def trough_in_window(spark, sf):
    return _troughs(spark, sf, _marked(spark, sf), [_week()]).select(
        "user_id", "lo", "hi", "event_id", "value", _r(F.col("noise_time"), "noise_time")
    )


def trough_windows(spark, sf):
    """Three overlapping windows per user, the last a long one."""
    long = (F.lit(0.0), F.lit(25 * DAY))
    return _troughs(spark, sf, _marked(spark, sf), [_week(), _week(4.0), long]).select(
        "user_id", "lo", "hi", "event_id", "value", _r(F.col("noise_time"), "noise_time")
    )


def _nested(df: DataFrame, key: str, n: int, days: float, step: float) -> DataFrame:
    """``n`` windows per recording, each inside the one before."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = df.select(key).distinct().select(key, i.alias("i"))
    lo, hi = F.col("i") * (step * DAY), F.lit(days * DAY) - F.col("i") * (step * DAY)
    return at.select(key, lo.alias("lo"), hi.alias("hi"))


def nested_troughs(spark, sf):
    """Fifty nested windows per user."""
    df = timed(spark, sf)
    found = lowest_in_windows(df, _nested(df, "user_id", 50, 30.0, 0.25), ROLES)
    return found.select("user_id", "lo", "hi", "event_id", "value", _r(F.col("noise_time"), "noise_time"))


def lineitem_nested_troughs(spark, sf):
    """A hundred nested windows per supplier."""
    df = timed_items(spark, sf)
    found = lowest_in_windows(df, _nested(df, "l_suppkey", 100, 2400.0, 10.0), ITEMS)
    return found.select("l_suppkey", "lo", "noise_time", "l_extendedprice", "l_orderkey", "l_linenumber")


def _durations(spark, sf):
    marked = _marked(spark, sf)
    found = _troughs(spark, sf, marked, [_week()]).drop("slurry_time")
    found = found.withColumn("fixed", F.when(F.pmod("user_id", F.lit(5)) == 0, F.lit(1.0)))
    return troughs.trough_duration(found, marked, "user_id", "slurry_time", "fixed")


def trough_duration(spark, sf):
    """Trough minus first error; one cohort's durations are fixed at 1."""
    return _durations(spark, sf).select("user_id", _r(F.col("total"), "total"))


def saved_duration_glm(spark, sf):
    """Durations written as CSV, read again and fitted by cohort."""
    path = f"{stage_folder(spark)}/durations-{uuid.uuid4().hex}"
    cohort = F.pmod("user_id", F.lit(3)).cast("string")
    save_table(_durations(spark, sf).select("user_id", cohort.alias("cohort"), "total"), path, "csv")
    schema = StructType([StructField("user_id", LongType()), StructField("cohort", StringType()),
                         StructField("total", DoubleType())])
    return _model(fit_linear(load_table(spark, path, schema, "csv"), "total", ["cohort"]))


# --- recovery --------------------------------------------------------------------

STAGES = ["error", "purchase"]


def _stages(spark, sf):
    """First high error and purchase of each user; users form two cohorts."""
    high = timed(spark, sf).where(F.col("comment").isin("error high", "purchase high"))
    stage = F.substring_index("comment", " ", 1)
    first = high.groupBy("user_id", stage.alias("stage")).agg(F.min("t").alias("t"))
    return first.withColumn("cohort", F.pmod("user_id", F.lit(2)))


def recovery_grid(spark, sf):
    seen = save_stage(_stages(spark, sf))
    n_bins = recovery.bin_count(seen, "t", DAY)
    return recovery.recovery_grid(seen, "user_id", "cohort", [0, 1], n_bins).select(
        "user_id", F.col("cohort").cast("long").alias("cohort"), "bin"
    )


def locf(spark, sf):
    seen = recovery.with_bin(save_stage(_stages(spark, sf)), "t", DAY)
    n_bins = recovery.bin_count(seen, "t", DAY)
    filled = recovery.filled_grid(seen, "user_id", "cohort", "stage", [0, 1], n_bins)
    return filled.select("user_id", F.col("cohort").cast("long").alias("cohort"), "bin", "stage")


def carry_forward(spark, sf):
    """Each user's last error value so far."""
    df = samples(spark, sf).withColumn(
        "last_error", F.when(F.col("comment").startswith("error"), F.col("value")))
    filled = recovery.carry_forward(df, ["user_id"], ["clock", "event_id"], "last_error")
    return filled.select("user_id", "event_id", "last_error")


def recovery_curve(spark, sf):
    """All users are subjects; a stage that a user never reached has no time."""
    users = table(spark, sf, "events").select("user_id").distinct().select(
        "user_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"),
        F.pmod("user_id", F.lit(2)).alias("cohort"),
    )
    reached = _stages(spark, sf).drop("cohort")
    seen = save_stage(match(users, reached, ["user_id", "stage"], "left"))
    curve = recovery.recovery_curve(seen, "user_id", "cohort", "stage", "t", STAGES, DAY)
    return curve.select("cohort", "stage", "bin", "bin_mid", _r(F.col("proportion"), "proportion"))


def bin_label_parse(spark, sf):
    seen = recovery.with_bin(timed(spark, sf), "t", 3600.0)
    labelled = recovery.with_bin_label(seen, 3600)
    start, end, mid = label_bounds(F.col("bin_label"))
    return labelled.select(
        "event_id", "bin_label", start.alias("bin_start"), end.alias("bin_end"), mid.alias("bin_mid")
    )


# --- cohorts, tags, summaries ----------------------------------------------------

PROPS_RULES = [(r'"k": 9\d', 90.0), (r'"k": 1\d\}', 10.0), (r'"K": 5', 50.0)]


def condition_tag(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "props")
    tags = cohorts.group_tags(events, "user_id", F.col("props"), PROPS_RULES)
    tagged = cohorts.tag_rows(events, tags, "user_id")
    return cohorts.merge_levels(tagged, "tag", [10.0, 50.0], 30.0).select("event_id", "user_id", "tag")


def regex_filter(spark, sf):
    documents = table(spark, sf, "documents")
    text = F.col("text")
    kept = documents.where(mentions(text, "licen[sc]e") | ~mentions(text, r"\bthe\b"))
    return kept.where(~F.lower("source").contains("src3")).select("doc_id", "lang", "n_chars")


def cohort_split(spark, sf):
    """Orders split by whether the customer is in the building segment."""
    cohort = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    cohort = cohort.select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return cohorts.split_cohort(orders, cohort, "o_custkey", "building", "other")


def cohort_members(spark, sf):
    """Orders of one segment's customers that are not in debt."""
    customers = table(spark, sf, "customer")
    key = F.col("c_custkey").alias("o_custkey")
    building = customers.where(F.col("c_mktsegment") == "BUILDING").select(key)
    debt = customers.where(F.col("c_acctbal") < 0).select(key)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return cohorts.non_members(cohorts.members(orders, building, "o_custkey"), debt, "o_custkey")


def cohort_label(spark, sf):
    cohort = table(spark, sf, "customer").where(F.col("c_acctbal") < 0)
    cohort = cohort.select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    labelled = cohorts.split_cohort(orders, cohort, "o_custkey", "debt", "credit")
    return labelled.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("o_totalprice"), "mean_price")
    )


def cohort_summary(spark, sf):
    found = summaries.cohort_summary(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return found.select("c_mktsegment", "n", *[_r(F.col(c), c) for c in ("median_value", "min_value", "max_value")])


def cohort_range(spark, sf):
    found = summaries.cohort_summary(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return summaries.range_long(found, ["c_mktsegment"]).select(
        "c_mktsegment", F.col("end").cast("long").alias("end"), _r(F.col("range_value"), "range_value")
    )


def stage_summary(spark, sf):
    found = summaries.stage_summary(
        table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"
    )
    numbers = ["mean_value", "sd_value", "min_value", "max_value"]
    return found.select("o_orderpriority", "o_orderstatus", "n", *[_r(F.col(c), c) for c in numbers])


def boxplot_stats(spark, sf):
    found = summaries.boxplot_stats(table(spark, sf, "events"), ["event_type"], "value")
    numbers = ["q1", "median", "q3", "lower_whisker", "upper_whisker"]
    return found.select("event_type", "n", "outliers", *[_r(F.col(c), c) for c in numbers])


def profile(spark, sf):
    found = summaries.profile(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    numbers = ["min", "q1", "median", "mean", "q3", "max"]
    return found.select("column", "missing", *[_r(F.col(c), c) for c in numbers])


def histogram(spark, sf):
    found = summaries.histogram(table(spark, sf, "events"), "value")
    return found.select("bin", "n", _r(F.col("bin_start"), "bin_start"))


def log_histogram(spark, sf):
    found = summaries.histogram(table(spark, sf, "customer"), "c_acctbal", log=True)
    return found.select("bin", "n", _r(F.col("bin_start"), "bin_start"))


# --- models ----------------------------------------------------------------------


def _model(fit):
    numbers = ["estimate", "std_error", "statistic", "p_value", "null_deviance", "deviance", "dispersion", "aic"]
    return fit.summary().select("term", "n", "df_null", "df_residual", *[_r(F.col(c), c) for c in numbers])


def noise_glm(spark, sf):
    return _model(fit_linear(table(spark, sf, "events"), "value", ["event_type"]))


def stage_glm(spark, sf):
    events = table(spark, sf, "events").withColumn("cohort", F.pmod("user_id", F.lit(2)))
    return _model(fit_linear(events, "value", ["event_type", "cohort"]))


def cell_lmm(spark, sf):
    """Mean log price by priority (groups) and status (levels), a complete grid."""
    cells = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.avg(F.log("o_totalprice")).alias("y")
    )
    fit = fit_random_intercept(cells, "y", "o_orderstatus", "o_orderpriority")
    numbers = ["estimate", "std_error", "statistic", "df", "p_value"]
    return fit.select("effect", "group", "term", *[F.round(F.col(n), 4).alias(n) for n in numbers])


def order_glm(spark, sf):
    """Price by return flag with an effect of every order."""
    lines = table(spark, sf, "lineitem")
    fit = fit_linear_large(lines, "l_extendedprice", ["l_orderkey", "l_returnflag"],
                           [("l_returnflag", "N"), ("l_returnflag", "R")])
    row = fit.fit.first().asDict()
    return fit.effects.select(
        "factor", "level", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"),
        F.lit(row["df_residual"]).alias("df_residual"), F.lit(round(row["dispersion"], 2)).alias("dispersion"))


def lineitem_lmm(spark, sf):
    """Discount by line status with an intercept per order; orders have 1 to 13 lines or so."""
    fit = fit_random_intercept(table(spark, sf, "lineitem"), "l_discount", "l_linestatus", "l_orderkey")
    numbers = ["estimate", "std_error"]
    return fit.select("effect", "group", "term", *[_r(F.col(n), n) for n in numbers])


def part_lmm(spark, sf):
    """Log price by part, with an intercept per kind of price: list, and after a discount
    of 5 % or more. There are as many levels as parts."""
    lines = table(spark, sf, "lineitem")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    prices = F.array(
        F.struct(F.lit("list").alias("kind"), price.alias("price")),
        F.struct(F.lit("net").alias("kind"), F.when(discount >= 0.05, price * (1 - discount)).alias("price")),
    )
    rows = lines.select("l_partkey", F.inline(prices)).withColumn("y", F.log("price"))
    fit = fit_random_intercept_wide(rows, "y", "l_partkey", "kind")
    numbers = ["estimate", "std_error", "df"]
    return fit.select("effect", "group", "term", *[F.round(F.col(n), 4).alias(n) for n in numbers])


# --- the larger table ------------------------------------------------------------


def lineitem_epochs(spark, sf):
    found = plans.recording_epochs(items(spark, sf), ITEM_PROTOCOL, ITEMS, "clock")
    return found.select(
        "l_suppkey", "bin", "n_points", "marker_time", _r(F.col("pct_l_extendedprice"), "pct_price")
    )


def lineitem_mad_filter(spark, sf):
    kept = per_recording(items(spark, sf), lambda df, s: outliers.mad_filter_in_window(
        df, ITEMS, _exact("R full"), after_marker(30 * DAY), 1.0, s
    ), ITEMS)
    return kept.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("kept"), _r(F.sum("l_extendedprice"), "total")
    )


def lineitem_trough(spark, sf):
    """Cheapest line of each supplier in the 200 days after its first marker."""
    df = timed_items(spark, sf)
    windows = markers.marker_times(df, ITEMS, lo=_exact("R full")).withColumn("hi", F.col("lo") + 200 * DAY)
    found = troughs.trough_in_windows(df, windows, ITEMS)
    return found.select("l_suppkey", "lo", "noise_time", "l_extendedprice", "l_orderkey", "l_linenumber")


def lineitem_boxplot(spark, sf):
    found = summaries.boxplot_stats(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"
    )
    numbers = ["q1", "median", "q3", "lower_whisker", "upper_whisker"]
    return found.select("l_returnflag", "l_linestatus", "n", "outliers", *[_r(F.col(c), c) for c in numbers])


def lineitem_glm(spark, sf):
    return _model(fit_linear(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "scan_recordings": scan_recordings,
    "clean_recordings": clean,
    "file_order": file_order,
    "first_in_file": first_in_file,
    "relative_time": relative_time,
    "marker_first": marker_first,
    "marker_relative_time": marker_relative_time,
    "marker_interval": marker_interval,
    "between_markers": between_markers,
    "crop_around_marker": crop_around_marker,
    "first_per_group": first_per_group,
    "slice_min_ties": slice_min_ties,
    "sample_index": sample_index,
    "mad_filter_pre": mad_filter_pre,
    "mad_filter_post": mad_filter_post,
    "mad_filter_long": mad_filter_long,
    "baseline_window": baseline_window,
    "baseline_median": baseline_median,
    "baseline_counts": baseline_counts,
    "percent_of_baseline": percent_of_baseline,
    "baseline_epoch": baseline_epoch,
    "anchored_bins": anchored_bins,
    "nearest_sample": nearest_sample,
    "epoch_means": epoch_means,
    "epochs_with_baseline": _protocol_epochs(ONE_MARKER),
    "epochs_two_markers": _protocol_epochs(TWO_MARKERS),
    "epochs_recovery": _protocol_epochs(RECOVERY),
    "post_event_percent": post_event_percent,
    "post_event_percent_mad": post_event_percent_mad,
    "event_versus_baseline": event_versus_baseline,
    "event_glm": event_glm,
    "band_long": band_long,
    "band_wide": band_wide,
    "sqrt_transform": sqrt_transform,
    "epoch_model_input": epoch_model_input,
    "epoch_lmm": epoch_lmm,
    "cell_lmm": cell_lmm,
    "lineitem_lmm": lineitem_lmm,
    "part_lmm": part_lmm,
    "order_glm": order_glm,
    "trough_in_window": trough_in_window,
    "trough_windows": trough_windows,
    "nested_troughs": nested_troughs,
    "trough_duration": trough_duration,
    "saved_duration_glm": saved_duration_glm,
    "recovery_grid": recovery_grid,
    "locf": locf,
    "carry_forward": carry_forward,
    "recovery_curve": recovery_curve,
    "bin_label_parse": bin_label_parse,
    "condition_tag": condition_tag,
    "regex_filter": regex_filter,
    "cohort_split": cohort_split,
    "cohort_members": cohort_members,
    "cohort_label": cohort_label,
    "cohort_summary": cohort_summary,
    "cohort_range": cohort_range,
    "stage_summary": stage_summary,
    "boxplot_stats": boxplot_stats,
    "profile": profile,
    "histogram": histogram,
    "log_histogram": log_histogram,
    "noise_glm": noise_glm,
    "stage_glm": stage_glm,
    "lineitem_epochs": lineitem_epochs,
    "lineitem_mad_filter": lineitem_mad_filter,
    "lineitem_trough": lineitem_trough,
    "lineitem_nested_troughs": lineitem_nested_troughs,
    "lineitem_boxplot": lineitem_boxplot,
    "lineitem_glm": lineitem_glm,
}
