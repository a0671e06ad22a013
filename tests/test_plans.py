"""The recording plan against a plain-Python evaluation of its steps."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import BEHAVIOUR, MAIN_TIMES, ONE_SECOND_TIMES, TROUGHS, behaviour
from tidemark.functions.columns import mentions
from tidemark.operators.linear_models import fit_linear
from tidemark.operators.roles import Roles
from tidemark.plans.behaviour import behaviour_report
from tidemark.plans.durations import CONTROL, durations
from tidemark.plans.recordings import (
    COLD_SHOCK,
    STUN_RECOVERY,
    STUN_THEN_COLD,
    event_versus_baseline,
    post_event_percent,
    recording_epochs,
)

ROLES = Roles("source_file", "t", "power", "comments")
SCHEMA = "source_file string, time_seconds double, power double, comments string"


def recording(name, marks, n=1500, seed=0, step=1.0):
    rng = np.random.default_rng(seed)
    level = rng.lognormal(0, 0.4, n)
    gaps = rng.random(n) < 0.05
    marks = dict(marks)
    return [
        (name, 50 + i * step, float(level[i]), marks.get(i, ""))
        for i in range(n) if i in marks or i == 0 or not gaps[i]
    ]


def first(rows, test):
    return min((t for _, t, _, c in rows if test(c)), default=None)


def mad_pass(rows, inside, k):
    values = [v for _, t, v, _ in rows if inside(t)]
    if not values:
        return rows
    middle = statistics.median(values)
    dev = 1.4826 * statistics.median([abs(v - middle) for v in values])
    return [r for r in rows if not inside(r[1]) or abs(r[2] - middle) <= k * dev]


def expected(rows, p):
    start = min(r[1] for r in rows)
    rows = [(f, t - start, v, c) for f, t, v, c in rows]
    m = first(rows, lambda c: c == p.before)
    if m is None:
        return {}
    rows = mad_pass(rows, lambda t: 0 <= t < m - p.margin, p.before_mads)
    m = first(rows, lambda c: c == p.after)
    if m is None:
        return {}
    rows = mad_pass(rows, lambda t: t >= m + p.after_offset, p.after_mads)
    zero = first(rows, lambda c: p.zero in c.lower())
    end = first(rows, lambda c: c == p.median_marker)
    base = [v for _, t, v, _ in rows if 0 <= t < end - p.margin] if end is not None else []
    base = statistics.median(base) if base else None
    out = {}
    end = first(rows, lambda c: c == p.mean_marker)
    if end is not None:
        out[-1] = (-300.0, [v for _, t, v, _ in rows if p.mean_start <= t < end - p.margin])
    bins = {}
    for _, t, v, _ in rows:
        if 0 <= t - zero <= p.horizon:
            bins.setdefault(int((t - zero) // p.width), []).append((t - zero, v))
    for b, points in bins.items():
        if p.last_bin is None or b <= p.last_bin:
            s = min(points)[0]
            out[b] = (s, [v for t, v in points if t < s + p.window])
    return {
        b: (s, len(vs), statistics.fmean(vs) / base * 100 if base else None)
        for b, (s, vs) in out.items() if vs
    }


CASES = {
    "cold": (COLD_SHOCK, {"a.csv": {400: "in slurry"}, "b c.csv": {600: "in slurry", 900: "in slurry"},
                          "regex.csv": {300: "In slurry -2.5degC"}, "early.csv": {60: "in slurry"}, "none.csv": {}}),
    "stun": (STUN_THEN_COLD, {"a.csv": {400: "stun on", 430: "stun off", 460: "in slurry"}, "b.csv": {300: "in slurry"}}),
    "recovery": (STUN_RECOVERY, {"a.csv": {400: "Stun", 420: "stun off"}, "b.csv": {250: "Stun", 300: "Stun off"}}),
}


@pytest.mark.parametrize("case, hot", [*[(c, False) for c in CASES], ("cold", True)])
def test_epochs(spark, case, hot, request):
    if hot:
        request.getfixturevalue("tiny_limits")
    protocol, files = CASES[case]
    rows, want = [], {}
    for seed, (name, marks) in enumerate(files.items()):
        one = recording(name, marks, seed=seed, step=0.5 if name == "b.csv" else 1.0)
        rows += one
        want.update({(name, b): x for b, x in expected(one, protocol).items()})
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = recording_epochs(df, protocol, ROLES).collect()
    got = {(r.source_file, r.bin): (r.marker_time, r.n_points, r.pct_power) for r in out}
    assert set(got) == set(want) and want
    for key, (start, n, mean) in want.items():
        assert got[key][:2] == (start, n), key
        assert got[key][2] == (None if mean is None else pytest.approx(mean)), key


def test_sections_around_the_stun(spark):
    marks = {400: "stun on", 430: "stun off", 520: "in slurry"}
    rows = recording("a.csv", marks, seed=5, step=0.5) + recording("b.csv", {300: "in slurry"}, seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    # The recording starts at 50 s; markers are then at 200, 215 and 260 s.
    out = event_versus_baseline(df, STUN_THEN_COLD, "stun off", "in slurry", ROLES)
    found = {(r.source_file, r.label): r for r in out.collect()}
    assert set(found) == {("a.csv", "post_stun")}
    kept = [r for r in rows if r[0] == "a.csv" and 220 <= r[1] - 50 <= 255]
    assert found["a.csv", "post_stun"].n == len(kept)
    alone = post_event_percent(df, STUN_THEN_COLD, "stun off", "in slurry", ROLES).first()
    assert alone.pct_power == pytest.approx(found["a.csv", "post_stun"].pct_power)
    fewer = post_event_percent(
        df, STUN_THEN_COLD, "stun off", "in slurry", ROLES, apply_mad=True
    ).first()
    assert 0 < fewer.all_count < alone.all_count


def test_durations_to_model(spark):
    samples = [
        (n, float(t), 0.1 if t == trough else 1.0, "In slurry" if t == marker else "")
        for n, trough, marker, _ in TROUGHS for t in range(marker - 5, trough + 20)
    ]
    df = spark.createDataFrame(samples, "source_file string, t double, power double, comments string")
    windows = [(n, float(t - 7), float(t + 7), c, 1.0 if c == "3V" else None) for n, t, _, c in TROUGHS]
    control = spark.createDataFrame(windows, CONTROL)
    out = durations(df, control, mentions(F.col("comments"), "in slurry"), ROLES)
    fit = fit_linear(out.where("stun_parameter in ('0', '2.5V', '3V')"), "total", ["stun_parameter"])
    assert round(fit.fit.first().aic, 2) == 132.21


def test_behaviour_report(spark):
    names = ["animal_id", "stun_parameter", "recovery_stage", "time_seconds_stage"]
    extra = [(100, "2.5_5", "stage_2", 3.0)]
    main = spark.createDataFrame(behaviour(MAIN_TIMES) + extra, BEHAVIOUR).toDF(*names)
    report = behaviour_report(main)
    assert report.curve.count() == 128
    assert report.curve.where("proportion < 0 or proportion > 100").count() == 0
    assert sum(r.n for r in report.summary.collect()) == 24
    assert round(report.model.fit.first().aic, 2) == 208.45
    one_second = spark.createDataFrame(behaviour(ONE_SECOND_TIMES), BEHAVIOUR).toDF(*names)
    report = behaviour_report(one_second, observed_only=True, log=True)
    assert round(report.model.fit.first().aic, 1) == 406.4
    assert sum(r.n for r in report.histogram.collect()) == 37
