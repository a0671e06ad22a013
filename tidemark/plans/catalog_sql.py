"""The SQL every query of the catalog must agree with (DuckDB dialect)."""

from __future__ import annotations

EVENTS = """
ev AS (
  SELECT user_id, event_id, value, epoch(ts) AS clock,
         event_type || CASE WHEN value >= 80 THEN ' high' ELSE '' END AS comment
  FROM events),
rel AS (SELECT *, clock - min(clock) OVER (PARTITION BY user_id) AS t FROM ev)"""

ITEMS = """
ev AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, epoch(l_shipdate) AS clock,
         l_returnflag || CASE WHEN l_quantity >= 50 THEN ' full' ELSE '' END AS comment
  FROM lineitem),
rel AS (SELECT *, clock - min(clock) OVER (PARTITION BY l_suppkey) AS t FROM ev)"""


def mad_steps(source: str, out: str, marker: str, window: str, k: float, key="user_id", value="value"):
    """CTEs that keep rows within k MADs; ``window`` is a predicate over t and m."""
    return f"""
{out}_a AS (SELECT *, min(t) FILTER (WHERE comment = '{marker}') OVER (PARTITION BY {key}) AS m
            FROM {source}),
{out}_b AS (SELECT *, ({window}) AS inside FROM {out}_a),
{out}_c AS (SELECT *, median({value}) FILTER (WHERE inside) OVER (PARTITION BY {key}) AS med
            FROM {out}_b),
{out}_d AS (SELECT *, median(abs({value} - med)) FILTER (WHERE inside) OVER (PARTITION BY {key}) AS dev
            FROM {out}_c),
{out} AS (SELECT * EXCLUDE (m, inside, med, dev) FROM {out}_d
          WHERE CASE WHEN inside THEN abs({value} - med) <= {k} * (1.4826 * dev)
                     WHEN NOT inside THEN TRUE END)"""


def nested(source: str, key: str, value: str, order: str, n: int, days: float, step: float, shown: str):
    """Lowest sample of n nested windows per recording, joined window by window."""
    return f"""WITH {source},
windows AS (SELECT {key}, i * {step} * 86400 AS lo, {days} * 86400 - i * {step} * 86400 AS hi
            FROM (SELECT DISTINCT {key} FROM rel), range({n}) AS r(i))
SELECT r.{key}, {shown} AS noise_time
FROM rel r JOIN windows w ON r.{key} = w.{key} AND t BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY r.{key}, lo, hi ORDER BY {value}, t, {order}) = 1"""


def random_intercept(table: str, y: str, level: str, factor: str, group: str, steps: int = 6) -> str:
    """REML fit of ``y ~ two-level factor + (1 | group)``, whatever the sizes of the groups.

    Groups of equal size and equal share of the second level share their weight, so sums per
    class are enough. The variance ratio is where the derivative of the criterion changes its
    sign: a logarithmic grid brackets it, and each further grid divides the bracket by 100.
    """
    sums = f"""
groups AS (SELECT {group}, count(*) AS n, count(*) FILTER ({factor} = '{level}') AS m, sum({y}) AS t
           FROM {table} GROUP BY {group}),
classes AS (SELECT n, m, count(*) AS k, sum(t) AS t1, sum(t * t) AS t2 FROM groups GROUP BY n, m),
whole AS (SELECT count(*) AS nn, count(*) FILTER ({factor} = '{level}') AS mm, sum({y}) AS s,
                 coalesce(sum({y}) FILTER ({factor} = '{level}'), 0) AS sm, sum({y} * {y}) AS q FROM {table})"""
    found = [sums, "grid0 AS (SELECT power(10, i / 100.0 - 7) AS r FROM range(1001) AS g(i))"]

    def solved(name: str, grid: str) -> str:
        return f"""
{name}_a AS (
  SELECT r, any_value(nn) AS nn, any_value(nn) - sum(r / (1 + n * r) * k * n * n) AS a11,
         any_value(mm) - sum(r / (1 + n * r) * k * n * m) AS a12,
         any_value(mm) - sum(r / (1 + n * r) * k * m * m) AS a22,
         any_value(s) - sum(r / (1 + n * r) * n * t1) AS r1, any_value(sm) - sum(r / (1 + n * r) * m * t1) AS r2,
         any_value(q) - sum(r / (1 + n * r) * t2) AS qq
  FROM {grid}, classes, whole GROUP BY r),
{name}_b AS (SELECT *, a11 * a22 - a12 * a12 AS det, (r1 * a22 - r2 * a12) / (a11 * a22 - a12 * a12) AS b1,
                    (r2 * a11 - r1 * a12) / (a11 * a22 - a12 * a12) AS b2 FROM {name}_a),
{name} AS (SELECT *, qq - b1 * r1 - b2 * r2 AS rss FROM {name}_b)"""

    for i in range(steps):
        found.append(solved(f"fit{i}", f"grid{i}"))
        found.append(f"""
slope{i} AS (
  SELECT r, -any_value(nn - 2) / any_value(rss)
            * sum((t2 - 2 * (n * b1 + m * b2) * t1 + k * power(n * b1 + m * b2, 2)) / power(1 + n * r, 2))
          + sum(k * n / (1 + n * r))
          - sum(k * (a22 * n * n - 2 * a12 * n * m + a11 * m * m) / power(1 + n * r, 2)) / any_value(det) AS g
  FROM fit{i}, classes GROUP BY r),
bracket{i} AS (SELECT max(r) FILTER (g < 0) AS lo, min(r) FILTER (g >= 0) AS hi FROM slope{i}),
grid{i + 1} AS (SELECT coalesce(lo, 0) + (hi - coalesce(lo, 0)) * j / 100.0 AS r
                FROM bracket{i}, range(101) AS g(j))""")
    found.append(f"best AS (SELECT (min(r) + max(r)) / 2 AS r FROM grid{steps})")
    found.append(solved("final", "best"))
    steps_sql = ",".join(found)
    return f"""WITH {steps_sql}
SELECT 'fixed' AS effect, CAST(NULL AS VARCHAR) AS "group", '(Intercept)' AS term,
       round(b1, 6) AS estimate, round(sqrt(rss / (nn - 2) * a22 / det), 6) AS std_error FROM final
UNION ALL SELECT 'fixed', NULL, '{factor}{level}', round(b2, 6), round(sqrt(rss / (nn - 2) * a11 / det), 6) FROM final
UNION ALL SELECT 'ran_pars', '{group}', 'sd__(Intercept)', round(sqrt(r * rss / (nn - 2)), 6), NULL FROM final
UNION ALL SELECT 'ran_pars', 'Residual', 'sd__Observation', round(sqrt(rss / (nn - 2)), 6), NULL FROM final"""


PRE = mad_steps("rel", "pre", "error high", "t >= 0 AND t < m - 86400", 0.5)
POST = mad_steps("pre", "post", "error high", "t >= m + 86400", 1.0)

# Rows of the baseline window; percentages of the window's median.
ANCHORED = """
anchored AS (SELECT *, min(t) FILTER (WHERE comment = 'error high') OVER (PARTITION BY user_id) AS m
             FROM rel)"""
PERCENT = ANCHORED + """,
based AS (SELECT *, median(value) FILTER (WHERE t >= 0 AND t < m - 86400)
                      OVER (PARTITION BY user_id) AS baseline FROM anchored),
pct AS (SELECT *, value / nullif(baseline, 0) * 100 AS pct_value, t - m AS marker_time FROM based)"""
BINNED = PERCENT + """,
binned AS (SELECT *, CAST(floor(marker_time / 86400) AS BIGINT) AS bin FROM pct
           WHERE marker_time BETWEEN 0 AND 30 * 86400),
started AS (SELECT *, min(marker_time) OVER (PARTITION BY user_id, bin) AS start_time FROM binned)"""


def protocol_steps(
    before: str, after: str, zero: str, median: str, mean: str, after_offset: int = 86400,
    last_bin: int | None = 30, key="user_id", value="value", day=86400, width=86400, window=28800,
    horizon=30 * 86400,
) -> str:
    """CTEs from samples to ``epochs`` (key, bin, marker_time, n_points, pct_value)."""
    keep_bin = f"AND bin <= {last_bin}" if last_bin is not None else ""
    group = f"OVER (PARTITION BY {key})"
    return (
        mad_steps("rel", "pre", before, f"t >= 0 AND t < m - {day}", 0.5, key, value)
        + ","
        + mad_steps("pre", "post", after, f"t >= m + {after_offset}", 1.0, key, value)
        + f""",
zeroed AS (SELECT *,
    t - min(t) FILTER (WHERE regexp_matches(comment, '{zero}', 'i')) {group} AS marker_time,
    min(t) FILTER (WHERE comment = '{median}') {group} AS m_median,
    min(t) FILTER (WHERE comment = '{mean}') {group} AS m_mean
  FROM post),
based AS (SELECT *, median({value}) FILTER (WHERE t >= 0 AND t < m_median - {day}) {group} AS baseline
  FROM zeroed),
pct AS (SELECT *, {value} / nullif(baseline, 0) * 100 AS pct_value FROM based),
baseline_rows AS (SELECT {key}, -1 AS bin, -300.0 AS start_time, pct_value FROM pct
  WHERE t >= {day} AND t < m_mean - {day}),
binned AS (SELECT *, CAST(floor(marker_time / {width}) AS BIGINT) AS bin FROM pct
  WHERE marker_time BETWEEN 0 AND {horizon}),
started AS (SELECT *, min(marker_time) OVER (PARTITION BY {key}, bin) AS start_time FROM binned),
epoch_rows AS (SELECT {key}, bin, start_time, pct_value FROM started
  WHERE marker_time < start_time + {window} {keep_bin}),
epochs AS (SELECT {key}, CAST(bin AS BIGINT) AS bin, count(*) AS n_points,
    min(CAST(start_time AS DOUBLE)) AS marker_time, avg(pct_value) AS pct_value
  FROM (SELECT * FROM baseline_rows UNION ALL SELECT * FROM epoch_rows) GROUP BY ALL)"""
    )


EPOCHS = """
SELECT user_id, bin, n_points, round(marker_time, 6) AS marker_time,
       round(pct_value, 6) AS pct_value FROM epochs"""
ONE_MARKER = protocol_steps("error high", "error high", "error high", "error high", "error high")
TWO_MARKERS = protocol_steps("signup high", "error high", "error high", "error high", "signup high")
RECOVERY = protocol_steps(
    "error high", "purchase high", "purchase high", "error high", "error high", last_bin=None
)
ITEM_EPOCHS = protocol_steps(
    "R full", "R full", "r full", "R full", "R full", 30 * 86400, 60, "l_suppkey", "l_extendedprice",
    30 * 86400, 30 * 86400, 10 * 86400, 2400 * 86400,
)

BANDS = "l_quantity, l_extendedprice, l_discount, l_tax"
LONG = f"""
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, band, power
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {BANDS} FROM lineitem)
  UNPIVOT (power FOR band IN ({BANDS}))"""

TROUGHS = """
windows AS (SELECT DISTINCT user_id, user_id % 7 * 86400.0 AS lo, user_id % 7 * 86400.0 + 864000 AS hi
            FROM rel),
troughs AS (SELECT user_id, lo, hi, event_id, value, t AS noise_time
  FROM rel JOIN windows USING (user_id) WHERE t BETWEEN lo AND hi
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, t, event_id) = 1)"""

TOTALS = """
a AS (SELECT user_id, min(t) FILTER (WHERE regexp_matches(comment, 'error', 'i')) AS slurry_time
      FROM rel GROUP BY user_id),
totals AS (SELECT * FROM (SELECT user_id, CAST(user_id % 3 AS VARCHAR) AS cohort,
    CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE noise_time - slurry_time END AS total
  FROM troughs JOIN a USING (user_id)))"""

STAGES = """
stages AS (SELECT user_id, split_part(comment, ' ', 1) AS stage, min(t) AS t, user_id % 2 AS cohort
  FROM rel WHERE comment IN ('error high', 'purchase high') GROUP BY ALL)"""
GRID = """
grid AS (SELECT user_id, cohort, bin FROM (SELECT DISTINCT user_id FROM stages),
  (SELECT unnest([0, 1]) AS cohort), (SELECT unnest(range({bins})) AS bin))"""
FILLED = """
joined AS (SELECT g.user_id, g.cohort, g.bin, s.stage FROM grid g LEFT JOIN stages s
  ON g.user_id = s.user_id AND g.cohort = s.cohort AND g.bin = floor(s.t / 86400)),
filled AS (SELECT user_id, cohort, bin, last_value(stage IGNORE NULLS) OVER (
  PARTITION BY cohort, user_id ORDER BY bin, stage NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stage FROM joined)"""
N_BINS = "(SELECT CAST(floor((max(t) + 86400) / 86400) AS BIGINT) FROM stages)"


def boxplot(table: str, keys: str, value: str) -> str:
    return f"""
WITH q AS (SELECT {keys}, count({value}) AS n, quantile_cont({value}, 0.25) AS q1,
    quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
  FROM {table} GROUP BY {keys})
SELECT {keys}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min({value}) FILTER (WHERE inside), 6) AS lower_whisker,
  round(max({value}) FILTER (WHERE inside), 6) AS upper_whisker,
  count({value}) FILTER (WHERE NOT inside) AS outliers
FROM (SELECT *, {value} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
      FROM {table} JOIN q USING ({keys}))
GROUP BY {keys}, n, q1, median, q3"""


def histogram(values: str) -> str:
    """Counts between multiples of 1, 2, 5 or 10 powers of ten, closed on the right."""
    return f"""
WITH v AS ({values}),
s AS (SELECT min(x) AS lo, max(x) AS hi, ceil(log2(count(*)) + 1) AS wanted FROM v),
c AS (SELECT *, (hi - lo) / wanted AS cell, power(10.0, floor(log10((hi - lo) / wanted))) AS base FROM s),
one AS (SELECT *, base AS u1 FROM c),
two AS (SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - u1) THEN 2 * base ELSE u1 END AS u2 FROM one),
five AS (SELECT *, CASE WHEN 5 * base - cell < 2.75 * (cell - u2) THEN 5 * base ELSE u2 END AS u5 FROM two),
ten AS (SELECT *, CASE WHEN 10 * base - cell < 1.5 * (cell - u5) THEN 10 * base ELSE u5 END AS step FROM five),
b AS (SELECT greatest(CAST(ceil((x - floor(lo / step + 1e-10) * step) / step - 1e-7) AS BIGINT) - 1, 0) AS bin,
        floor(lo / step + 1e-10) * step AS start, step FROM v, ten)
SELECT bin, count(*) AS n, round(bin * step + start, 6) AS bin_start FROM b GROUP BY bin, start, step"""


def t_tail(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided p: the t density over the angle atan(u / sqrt(df)), by Simpson's rule.

    The range ends where the density has vanished.
    """
    return f"""(SELECT least(1.0, 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * h / 3 * sum(
        (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(({df} - 1) * ln(greatest(cos(low + i * h), 1e-300)))))
      FROM (SELECT low, (least(pi() / 2, low + 14 / sqrt({df} * 1.0)) - low) / {steps} AS h
            FROM (SELECT atan(abs({t}) / sqrt({df} * 1.0)) AS low)), (SELECT unnest(range({steps} + 1)) AS i)
      GROUP BY low, h)"""


def one_way(table: str, factor: str, y: str, before: str = "") -> str:
    """Group means and pooled errors of ``y ~ factor``."""
    return f"""
WITH {before}g AS (SELECT {factor} AS f, count(*) AS n, avg({y}) AS mean, var_pop({y}) * count(*) AS ss
           FROM {table} GROUP BY 1),
fit AS (SELECT sum(n) AS n, count(*) AS p, sum(ss) AS deviance FROM g),
null_fit AS (SELECT var_pop({y}) * count(*) AS null_deviance FROM {table}),
r AS (SELECT n AS n_ref, mean AS mean_ref FROM g ORDER BY f LIMIT 1),
c AS (SELECT CASE WHEN rank() OVER (ORDER BY f) = 1 THEN '(Intercept)' ELSE '{factor}' || f END AS term,
        CASE WHEN rank() OVER (ORDER BY f) = 1 THEN mean ELSE mean - mean_ref END AS estimate,
        sqrt(deviance / (fit.n - p)
          * (1.0 / g.n + CASE WHEN rank() OVER (ORDER BY f) = 1 THEN 0 ELSE 1.0 / n_ref END)) AS std_error
      FROM g, r, fit)
SELECT term, CAST(fit.n AS BIGINT) AS n, CAST(fit.n - 1 AS BIGINT) AS df_null,
  CAST(fit.n - p AS BIGINT) AS df_residual, round(estimate, 6) AS estimate,
  round(std_error, 6) AS std_error, round(estimate / std_error, 6) AS statistic,
  round({t_tail("estimate / std_error", "(fit.n - p)")}, 6) AS p_value,
  round(null_deviance, 6) AS null_deviance, round(deviance, 6) AS deviance,
  round(deviance / (fit.n - p), 6) AS dispersion,
  round(fit.n * (ln(2 * pi() * deviance / fit.n) + 1) + 2 * (p + 1), 6) AS aic
FROM c, fit, null_fit"""


def two_way(source: str, factor: str, binary: str) -> str:
    """``y ~ factor + binary`` by demeaning within the factor's levels.

    ``source`` selects f (a factor), z (0 or 1) and y; ``binary`` names z's term.
    """
    return f"""
e AS ({source}),
g AS (SELECT f, count(*) AS n, avg(z) AS zm, avg(y) AS ym, var_pop(z) * count(*) AS szz,
        covar_pop(z, y) * count(*) AS szy, var_pop(y) * count(*) AS syy FROM e GROUP BY f),
s AS (SELECT sum(n) AS n, count(*) + 1 AS p, sum(szz) AS szz, sum(szy) / sum(szz) AS b,
        sum(syy) - sum(szy) * sum(szy) / sum(szz) AS deviance FROM g),
null_fit AS (SELECT var_pop(y) * count(*) AS null_deviance FROM e),
r AS (SELECT g.n AS n_ref, zm AS z_ref, ym - b * zm AS a_ref FROM g, s ORDER BY f LIMIT 1),
c AS (
  SELECT CASE WHEN f = (SELECT min(f) FROM g) THEN '(Intercept)' ELSE '{factor}' || f END AS term,
    CASE WHEN f = (SELECT min(f) FROM g) THEN a_ref ELSE ym - b * zm - a_ref END AS estimate,
    CASE WHEN f = (SELECT min(f) FROM g) THEN 1.0 / g.n + zm * zm / s.szz
         ELSE 1.0 / g.n + 1.0 / n_ref + (zm - z_ref) * (zm - z_ref) / s.szz END AS v
  FROM g, s, r
  UNION ALL SELECT '{binary}', b, 1.0 / szz FROM s)
SELECT term, CAST(n AS BIGINT) AS n, CAST(n - 1 AS BIGINT) AS df_null,
  CAST(n - p AS BIGINT) AS df_residual, round(estimate, 6) AS estimate,
  round(sqrt(deviance / (n - p) * v), 6) AS std_error,
  round(estimate / sqrt(deviance / (n - p) * v), 6) AS statistic,
  round({t_tail("estimate / sqrt(deviance / (n - p) * v)", "(n - p)")}, 6) AS p_value,
  round(null_deviance, 6) AS null_deviance, round(deviance, 6) AS deviance,
  round(deviance / (n - p), 6) AS dispersion,
  round(n * (ln(2 * pi() * deviance / n) + 1) + 2 * (p + 1), 6) AS aic
FROM c, s, null_fit"""


EVENT_SECTIONS = """
marked AS (SELECT *, min(t) FILTER (WHERE comment = 'signup high') OVER (PARTITION BY user_id) + 3600 AS lo,
             min(t) FILTER (WHERE comment = 'error high') OVER (PARTITION BY user_id) - 3600 AS hi FROM pct),
sections AS (SELECT user_id, label, count(*) AS n, avg(pct_value) AS pct_value FROM (
    SELECT user_id, 'baseline' AS label, pct_value FROM baseline_rows
    UNION ALL SELECT user_id, 'post_stun', pct_value FROM marked WHERE t BETWEEN lo AND hi)
  GROUP BY user_id, label)"""

ORACLES: dict[str, str] = {
    "scan_recordings": """
SELECT strftime(ts, '%H:%M:%S') AS time, CAST(event_id AS VARCHAR) AS event_text,
  CASE WHEN event_type = 'signup' AND value >= 80 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS alpha_text,
  CASE WHEN event_type <> 'view' THEN event_type END AS comments, TRUE AS named
FROM events""",
    "clean_recordings": """
SELECT event_id, user_id, round(value, 6) AS value,
  CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS comments,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS time_seconds
FROM events WHERE NOT (event_type = 'signup' AND value >= 80)""",
    "file_order": """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS row
FROM events""",
    "first_in_file": """
WITH numbered AS (SELECT user_id, event_id, strftime(ts, '%H:00:00') AS time,
  row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS row FROM events)
SELECT user_id, time, arg_min(event_id, row) AS event_id, min(row) AS row FROM numbered GROUP BY user_id, time""",
    "relative_time": f"WITH {EVENTS} SELECT user_id, event_id, round(t, 6) AS t FROM rel",
    "marker_first": f"""WITH {EVENTS}
SELECT user_id, round(min(t) FILTER (WHERE comment = 'error high'), 6) AS first_exact,
  round(min(t) FILTER (WHERE regexp_matches(comment, 'ERROR', 'i')), 6) AS first_mention,
  round(min(t) FILTER (WHERE comment = 'purchase high'), 6) AS first_second
FROM rel GROUP BY user_id""",
    "marker_relative_time": f"""WITH {EVENTS}, {ANCHORED}
SELECT user_id, event_id, round(t - m, 6) AS marker_time FROM anchored""",
    "marker_interval": f"""WITH {EVENTS}
SELECT user_id, round(min(t) FILTER (WHERE comment = 'purchase high')
  - min(t) FILTER (WHERE comment = 'error high'), 6) AS interval FROM rel GROUP BY user_id""",
    "between_markers": f"""WITH {EVENTS},
a AS (SELECT user_id, min(t) FILTER (WHERE comment = 'error high') + 3600 AS lo,
        min(t) FILTER (WHERE comment = 'purchase high') - 3600 AS hi FROM rel GROUP BY user_id)
SELECT user_id, count(*) AS all_count, round(avg(value), 6) AS mean_value
FROM rel JOIN a USING (user_id) WHERE t BETWEEN lo AND hi GROUP BY user_id""",
    "crop_around_marker": f"""WITH {EVENTS}, {ANCHORED}
SELECT user_id, event_id, round(t, 6) AS t, value FROM anchored WHERE t - m BETWEEN -86400 AND 518400""",
    "first_per_group": f"""WITH {EVENTS}
SELECT user_id, comment, event_id, value, round(t, 6) AS t FROM rel
QUALIFY row_number() OVER (PARTITION BY user_id, comment ORDER BY t, event_id) = 1""",
    "slice_min_ties": """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity) = 1""",
    "sample_index": f"""WITH {EVENTS}
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS sample
FROM rel""",
    "mad_filter_pre": f"WITH {EVENTS}, {PRE} SELECT user_id, event_id, value FROM pre",
    "mad_filter_post": f"WITH {EVENTS}, {PRE}, {POST} SELECT user_id, event_id, value FROM post",
    "mad_filter_long": f"""
WITH long AS ({LONG}),
m AS (SELECT *, median(power) OVER (PARTITION BY l_suppkey, band) AS med FROM long),
d AS (SELECT *, median(abs(power - med)) OVER (PARTITION BY l_suppkey, band) AS dev FROM m)
SELECT l_suppkey, band, count(*) AS kept, round(sum(power), 6) AS total FROM d
WHERE abs(power - med) <= 1.4826 * dev GROUP BY l_suppkey, band""",
    "baseline_window": f"""WITH {EVENTS}, {ANCHORED}
SELECT user_id, event_id, round(t, 6) AS t, value FROM anchored WHERE t >= 0 AND t < m - 86400""",
    "baseline_median": f"""WITH {EVENTS}, {ANCHORED}
SELECT user_id, round(median(value), 6) AS baseline FROM anchored
WHERE t >= 0 AND t < m - 86400 GROUP BY user_id""",
    "baseline_counts": f"""WITH {EVENTS}, {ANCHORED}
SELECT user_id, count(*) AS n FROM anchored WHERE t >= 0 AND t < m - 86400 GROUP BY user_id""",
    "percent_of_baseline": f"""WITH {EVENTS}, {PERCENT}
SELECT user_id, event_id, round(pct_value, 6) AS pct_value FROM pct""",
    "baseline_epoch": f"""WITH {EVENTS}, {PERCENT}
SELECT user_id, CAST(-1 AS BIGINT) AS bin, CAST(-300 AS DOUBLE) AS marker_time,
  round(avg(pct_value), 6) AS pct_value
FROM pct WHERE t >= 86400 AND t < m - 86400 GROUP BY user_id""",
    "anchored_bins": f"""WITH {EVENTS}, {BINNED}
SELECT user_id, event_id, bin, CAST(bin * 86400 AS DOUBLE) AS anchor_time,
  round(start_time, 6) AS start_time FROM started""",
    "nearest_sample": f"""WITH {EVENTS},
moments AS (SELECT o_custkey AS user_id, o_orderkey, CAST(o_orderkey * 7919 % 2592000 AS DOUBLE) AS anchor
            FROM orders)
SELECT m.user_id, o_orderkey, anchor, round(t, 6) AS nearest_time, event_id AS nearest_event_id,
  value AS nearest_value
FROM moments m LEFT JOIN rel r ON m.user_id = r.user_id
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(t - anchor), t, event_id) = 1""",
    "epoch_means": f"""WITH {EVENTS}, {BINNED}
SELECT user_id, bin, count(*) AS n_points, CAST(10 AS DOUBLE) AS ten_percent,
  CAST(100 AS DOUBLE) AS hundred_percent, round(min(start_time), 6) AS marker_time,
  round(avg(pct_value), 6) AS pct_value
FROM started WHERE marker_time < start_time + 28800 GROUP BY user_id, bin""",
    "epochs_with_baseline": f"WITH {EVENTS}, {ONE_MARKER} {EPOCHS}",
    "epochs_two_markers": f"WITH {EVENTS}, {TWO_MARKERS} {EPOCHS}",
    "epochs_recovery": f"WITH {EVENTS}, {RECOVERY} {EPOCHS}",
    "post_event_percent": f"""WITH {EVENTS}, {TWO_MARKERS},
b AS (SELECT *, min(t) FILTER (WHERE comment = 'signup high') OVER (PARTITION BY user_id) + 3600 AS lo,
        min(t) FILTER (WHERE comment = 'error high') OVER (PARTITION BY user_id) - 3600 AS hi FROM pct)
SELECT user_id, count(*) AS all_count, round(avg(pct_value), 6) AS pct_value
FROM b WHERE t BETWEEN lo AND hi GROUP BY user_id""",
    "post_event_percent_mad": f"""WITH {EVENTS}, {TWO_MARKERS},
b AS (SELECT *, min(t) FILTER (WHERE comment = 'signup high') OVER (PARTITION BY user_id) + 3600 AS lo,
        min(t) FILTER (WHERE comment = 'error high') OVER (PARTITION BY user_id) - 3600 AS hi FROM pct),
i AS (SELECT * FROM b WHERE t BETWEEN lo AND hi),
m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS med FROM i),
d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY user_id) AS dev FROM m)
SELECT user_id, count(*) AS all_count, round(avg(pct_value), 6) AS pct_value
FROM d WHERE abs(value - med) <= 1.4826 * dev GROUP BY user_id""",
    "band_long": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN band = 'l_extendedprice' THEN 'price' ELSE band END AS band, power
FROM ({LONG}) WHERE power > 0""",
    "band_wide": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    "sqrt_transform": """
SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS root FROM customer""",
    "epoch_model_input": f"""WITH {EVENTS}, {ONE_MARKER}
SELECT user_id, bin, round(sqrt(pct_value), 6) AS sqrt_pct FROM epochs WHERE bin NOT IN (0, 1)""",
    "trough_in_window": f"""WITH {EVENTS}, {TROUGHS}
SELECT user_id, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, event_id, value,
  round(noise_time, 6) AS noise_time FROM troughs""",
    "trough_windows": f"""WITH {EVENTS},
users AS (SELECT DISTINCT user_id FROM rel),
windows AS (SELECT user_id, user_id % 7 * 86400.0 AS lo, user_id % 7 * 86400.0 + 864000 AS hi FROM users
  UNION ALL SELECT user_id, (user_id % 7 + 4) * 86400.0, (user_id % 7 + 4) * 86400.0 + 864000 FROM users
  UNION ALL SELECT user_id, 0.0, 2160000.0 FROM users)
SELECT user_id, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, event_id, value, round(t, 6) AS noise_time
FROM rel JOIN windows USING (user_id) WHERE t BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY user_id, lo, hi ORDER BY value, t, event_id) = 1""",
    "nested_troughs": nested(EVENTS, "user_id", "value", "event_id", 50, 30, 0.25,
                              "CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, event_id, value, round(t, 6)"),
    "lineitem_nested_troughs": nested(
        ITEMS, "l_suppkey", "l_extendedprice", "l_orderkey, l_linenumber", 100, 2400, 10,
        "CAST(lo AS DOUBLE) AS lo, l_extendedprice, l_orderkey, l_linenumber, t"),
    "trough_duration": f"""WITH {EVENTS}, {TROUGHS}, {TOTALS}
SELECT user_id, round(total, 6) AS total FROM totals""",
    "saved_duration_glm": one_way("totals", "cohort", "total", f"{EVENTS}, {TROUGHS}, {TOTALS}, "),
    "recovery_grid": f"""WITH {EVENTS}, {STAGES}, {GRID.format(bins=N_BINS)}
SELECT user_id, CAST(cohort AS BIGINT) AS cohort, bin FROM grid""",
    "locf": f"""WITH {EVENTS}, {STAGES}, {GRID.format(bins=N_BINS)}, {FILLED}
SELECT user_id, CAST(cohort AS BIGINT) AS cohort, bin, stage FROM filled""",
    "recovery_curve": f"""WITH {EVENTS}, {STAGES}, {GRID.format(bins=N_BINS)}, {FILLED},
sizes AS (SELECT user_id % 2 AS cohort, count(DISTINCT user_id) AS subjects FROM rel GROUP BY 1),
present AS (SELECT cohort, bin, stage, count(DISTINCT user_id) AS present FROM filled GROUP BY ALL),
axis AS (SELECT s.cohort, subjects, bin, stage FROM sizes s,
  (SELECT unnest(range({N_BINS})) AS bin), (SELECT unnest(['error', 'purchase']) AS stage)),
curve AS (SELECT a.cohort, a.bin, a.stage, coalesce(present, 0) / subjects * 100 AS p
  FROM axis a LEFT JOIN present p ON a.cohort = p.cohort AND a.bin = p.bin AND a.stage = p.stage),
held AS (SELECT *, min(bin) FILTER (WHERE p = 100) OVER (PARTITION BY cohort, stage) AS full_from
  FROM curve)
SELECT cohort, stage, bin, bin * 86400.0 + 43200 AS bin_mid,
  round(CASE WHEN bin >= full_from THEN 100 ELSE p END, 6) AS proportion FROM held""",
    "bin_label_parse": f"""WITH {EVENTS}, b AS (SELECT event_id, CAST(floor(t / 3600) AS BIGINT) AS bin FROM rel)
SELECT event_id, '[' || bin * 3600 || ',' || (bin + 1) * 3600 || ')' AS bin_label,
  CAST(bin * 3600 AS DOUBLE) AS bin_start, CAST((bin + 1) * 3600 AS DOUBLE) AS bin_end,
  CAST(bin * 3600 + 1800 AS DOUBLE) AS bin_mid FROM b""",
    "condition_tag": r"""
WITH h AS (SELECT user_id, bool_or(regexp_matches(props, '"k": 9\d', 'i')) AS a,
             bool_or(regexp_matches(props, '"k": 1\d\}', 'i')) AS b,
             bool_or(regexp_matches(props, '"K": 5', 'i')) AS c FROM events GROUP BY user_id)
SELECT event_id, user_id, CASE WHEN a THEN 90.0::DOUBLE WHEN b OR c THEN 30.0::DOUBLE END AS tag
FROM events JOIN h USING (user_id)""",
    "regex_filter": r"""
SELECT doc_id, lang, n_chars FROM documents
WHERE (regexp_matches(text, 'licen[sc]e', 'i') OR NOT regexp_matches(text, '\bthe\b', 'i'))
  AND NOT contains(lower(source), 'src3')""",
    "cohort_split": """
SELECT o_orderkey, o_custkey, o_totalprice,
  CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
       THEN 'building' ELSE 'other' END AS cohort
FROM orders""",
    "cohort_members": """
SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND NOT c_acctbal < 0""",
    "cohort_label": """
SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
            THEN 'debt' ELSE 'credit' END AS cohort,
  count(*) AS n, round(avg(o_totalprice), 6) AS mean_price
FROM orders GROUP BY 1""",
    "cohort_summary": """
SELECT c_mktsegment, count(*) AS n, round(median(c_acctbal), 6) AS median_value,
  round(min(c_acctbal), 6) AS min_value, round(max(c_acctbal), 6) AS max_value
FROM customer GROUP BY c_mktsegment""",
    "cohort_range": """
WITH r AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
SELECT c_mktsegment, CAST(0 AS BIGINT) AS "end", round(lo, 6) AS range_value FROM r
UNION ALL SELECT c_mktsegment, CAST(1 AS BIGINT), round(hi, 6) FROM r""",
    "stage_summary": """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean_value,
  round(stddev_samp(o_totalprice), 6) AS sd_value, round(min(o_totalprice), 6) AS min_value,
  round(max(o_totalprice), 6) AS max_value
FROM orders GROUP BY o_orderpriority, o_orderstatus""",
    "boxplot_stats": boxplot("events", "event_type", "value"),
    "profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing,
  round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
  round(median(CAST({c} AS DOUBLE)), 6) AS median, round(avg({c}), 6) AS mean,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, round(CAST(max({c}) AS DOUBLE), 6) AS max
FROM part"""
        for c in ("p_size", "p_retailprice")
    ),
    "histogram": histogram("SELECT value AS x FROM events WHERE value IS NOT NULL"),
    "log_histogram": histogram("SELECT ln(c_acctbal) AS x FROM customer WHERE c_acctbal > 0"),
    "noise_glm": one_way("events", "event_type", "value"),
    "stage_glm": "WITH " + two_way(
        "SELECT event_type AS f, CAST(user_id % 2 AS DOUBLE) AS z, value AS y FROM events",
        "event_type", "cohort1",
    ),
    "event_versus_baseline": f"""WITH {EVENTS}, {TWO_MARKERS}, {EVENT_SECTIONS}
SELECT user_id, label, n, round(pct_value, 6) AS pct_value FROM sections""",
    "event_glm": f"WITH {EVENTS}, {TWO_MARKERS}, {EVENT_SECTIONS}, " + two_way(
        """SELECT CAST(user_id % 2 AS VARCHAR) AS f, CAST(label = 'post_stun' AS INT) * 1.0 AS z,
             sqrt(pct_value) AS y FROM sections WHERE pct_value IS NOT NULL""",
        "cohort", "labelpost_stun",
    ),
    # Balanced: both variances, errors and degrees of freedom have closed forms.
    "cell_lmm": f"""
WITH cells AS (SELECT o_orderpriority AS g, o_orderstatus AS f, avg(ln(o_totalprice)) AS y
               FROM orders GROUP BY 1, 2),
m AS (SELECT *, avg(y) OVER (PARTITION BY g) AS yg, avg(y) OVER (PARTITION BY f) AS yf, avg(y) OVER () AS ya,
        first_value(y) OVER (PARTITION BY g ORDER BY f) AS y1 FROM cells),
n AS (SELECT count(DISTINCT g) * 1.0 AS gs, count(DISTINCT f) * 1.0 AS fs FROM cells),
v AS (SELECT gs, fs, sum((y - yg - yf + ya) ** 2) / ((gs - 1) * (fs - 1)) AS mse,
        sum((yg - ya) ** 2) / (gs - 1) AS msg, sum((y - yf) ** 2) / (gs * fs - fs) AS ols FROM m, n GROUP BY gs, fs),
w AS (SELECT *, msg > mse AS varies, CASE WHEN msg > mse THEN (msg - mse) / fs ELSE 0 END AS b,
        CASE WHEN msg > mse THEN mse ELSE ols END AS e, gs * fs - fs AS rest FROM v),
lv AS (SELECT f, avg(y) AS mean, avg(y - y1) AS contrast FROM m GROUP BY f),
fixed AS (
  SELECT f = (SELECT min(f) FROM lv) AS is_first, f,
    CASE WHEN f = (SELECT min(f) FROM lv) THEN mean ELSE contrast END AS estimate,
    CASE WHEN f = (SELECT min(f) FROM lv) THEN sqrt((b + e) / gs) ELSE sqrt(2 * e / gs) END AS std_error,
    CASE WHEN NOT varies THEN rest
         WHEN f = (SELECT min(f) FROM lv) THEN (msg / fs + mse * (fs - 1) / fs) ** 2
           / ((msg / fs) ** 2 / (gs - 1) + (mse * (fs - 1) / fs) ** 2 / ((gs - 1) * (fs - 1)))
         ELSE (gs - 1) * (fs - 1) END AS df
  FROM lv, w)
SELECT 'fixed' AS effect, NULL AS "group",
  CASE WHEN is_first THEN '(Intercept)' ELSE 'o_orderstatus' || f END AS term, round(estimate, 4) AS estimate,
  round(std_error, 4) AS std_error, round(estimate / std_error, 4) AS statistic, round(df, 4) AS df,
  round({t_tail("estimate / std_error", "df")}, 4) AS p_value FROM fixed
UNION ALL SELECT 'ran_pars', 'o_orderpriority', 'sd__(Intercept)', round(sqrt(b), 4), NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT 'ran_pars', 'Residual', 'sd__Observation', round(sqrt(e), 4), NULL, NULL, NULL, NULL FROM w""",
    "lineitem_epochs": f"""WITH {ITEMS}, {ITEM_EPOCHS}
SELECT l_suppkey, bin, n_points, marker_time, round(pct_value, 6) AS pct_price FROM epochs""",
    "lineitem_mad_filter": f"""WITH {ITEMS},
{mad_steps("rel", "kept", "R full", "t >= m + 2592000", 1.0, "l_suppkey", "l_extendedprice")}
SELECT l_suppkey, count(*) AS kept, round(sum(l_extendedprice), 6) AS total FROM kept GROUP BY 1""",
    "lineitem_trough": f"""WITH {ITEMS},
a AS (SELECT l_suppkey, min(t) FILTER (WHERE comment = 'R full') AS lo FROM rel GROUP BY l_suppkey)
SELECT l_suppkey, lo, t AS noise_time, l_extendedprice, l_orderkey, l_linenumber
FROM rel JOIN a USING (l_suppkey) WHERE t BETWEEN lo AND lo + 17280000
QUALIFY row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_extendedprice, t, l_orderkey, l_linenumber) = 1""",
    "lineitem_boxplot": boxplot("lineitem", "l_returnflag, l_linestatus", "l_extendedprice"),
    "carry_forward": f"""WITH {EVENTS}
SELECT user_id, event_id, last_value(CASE WHEN comment LIKE 'error%' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY clock, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM ev""",
    "lineitem_lmm": random_intercept("lineitem", "l_discount", "O", "l_linestatus", "l_orderkey"),
    # Two groups leave one equation between them: variances, errors and degrees of freedom
    # have closed forms, whatever the rows of each level.
    "part_lmm": """WITH
x AS (SELECT l_partkey AS f, 1 AS g, ln(l_extendedprice) AS y FROM lineitem
      UNION ALL SELECT l_partkey, 0, ln(l_extendedprice * (1 - l_discount)) FROM lineitem WHERE l_discount >= 0.05),
c AS (SELECT f, y - (SELECT avg(y) FROM x) AS y, g FROM x),
lv AS (SELECT f, count(*) AS d, sum(g) AS m, sum(y) AS s, sum(y * g) AS sg, sum(y * y) AS q,
              f = (SELECT min(f) FROM x) AS is_first FROM c GROUP BY f),
t AS (SELECT count(*) AS p, sum(d) AS n, sum(m - m * m * 1.0 / d) AS a, sum(sg - m * s / d) AS r,
             sum(q - s * s / d) AS rest FROM lv),
k AS (SELECT *, 2 * a AS lam, r * r / a AS e, (rest - r * r / a) / (n - p - 1) AS w1 FROM t),
z AS (SELECT *, e > w1 AS varies, CASE WHEN e > w1 THEN w1 ELSE rest / (n - p) END AS w,
             CASE WHEN e > w1 THEN (e - w1) / lam ELSE 0 END AS b FROM k),
h AS (SELECT *, w + b * lam AS v, lam * lam / (e * e) AS hbb, lam / (e * e) AS hbw,
             (n - p - 1) / (w * w) + 1 / (e * e) AS hww, b / (w + b * lam) * r AS u FROM z),
co AS (SELECT f, is_first, d, 2.0 * m / d - 1 AS lean, s / d - u * (2.0 * m / d - 1) AS mean FROM lv, h),
o AS (SELECT lean AS lean0, mean AS mean0, d AS d0 FROM co WHERE is_first),
va AS (SELECT f, is_first, CASE WHEN is_first THEN mean + (SELECT avg(y) FROM x) ELSE mean - mean0 END AS estimate,
       1.0 / d + CASE WHEN is_first THEN 0 ELSE 1.0 / d0 END AS alone,
       CASE WHEN is_first THEN lean * lean ELSE (lean - lean0) ** 2 END / 2 AS apart,
       CASE WHEN is_first THEN 0.5 ELSE 0 END AS whole FROM co, o),
er AS (SELECT va.*, h.*, w * alone + apart * w * b / v + whole * b AS variance,
       apart * w * w / (v * v) + whole AS gb, alone + apart * b * b * lam / (v * v) AS gw FROM va, h)
SELECT 'fixed' AS effect, CAST(NULL AS VARCHAR) AS "group",
  CASE WHEN is_first THEN '(Intercept)' ELSE 'l_partkey' || f END AS term, round(estimate, 4) AS estimate,
  round(sqrt(variance), 4) AS std_error,
  round(CASE WHEN varies THEN variance * variance * (hbb * hww - hbw * hbw)
             / (gb * gb * hww - 2 * gb * gw * hbw + gw * gw * hbb) ELSE n - p END, 4) AS df FROM er
UNION ALL SELECT 'ran_pars', 'kind', 'sd__(Intercept)', round(sqrt(b), 4), NULL, NULL FROM z
UNION ALL SELECT 'ran_pars', 'Residual', 'sd__Observation', round(sqrt(w), 4), NULL, NULL FROM z""",
    # Two dummies with the orders' means taken out, solved in closed form.
    "order_glm": """WITH
x AS (SELECT l_orderkey AS o, l_extendedprice AS y, (l_returnflag = 'N')::INT AS n, (l_returnflag = 'R')::INT AS r
      FROM lineitem),
w AS (SELECT y - avg(y) OVER g AS y, n - avg(n) OVER g AS n, r - avg(r) OVER g AS r
      FROM x WINDOW g AS (PARTITION BY o)),
s AS (SELECT sum(n * n) AS nn, sum(n * r) AS nr, sum(r * r) AS rr, sum(n * y) AS ny, sum(r * y) AS ry,
             sum(y * y) AS yy, count(*) AS c FROM w),
b AS (SELECT *, (ny * rr - ry * nr) / (nn * rr - nr * nr) AS bn, (ry * nn - ny * nr) / (nn * rr - nr * nr) AS br FROM s),
d AS (SELECT *, c - (SELECT count(DISTINCT o) FROM x) - 2 AS free FROM b),
e AS (SELECT *, (yy - bn * ny - br * ry) / free AS v FROM d),
means AS (SELECT o, avg(y) - any_value(bn) * avg(n) - any_value(br) * avg(r) AS m FROM x, e GROUP BY o),
base AS (SELECT arg_min(m, o) AS m, min(o) AS o FROM means),
effects AS (
  SELECT '(Intercept)' AS factor, NULL AS level, m AS estimate, NULL AS std_error FROM base
  UNION ALL SELECT 'l_returnflag', 'N', bn, sqrt(v * rr / (nn * rr - nr * nr)) FROM e
  UNION ALL SELECT 'l_returnflag', 'R', br, sqrt(v * nn / (nn * rr - nr * nr)) FROM e
  UNION ALL SELECT 'l_orderkey', CAST(means.o AS VARCHAR), means.m - base.m, NULL FROM means, base WHERE means.o <> base.o)
SELECT factor, level, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, free AS df_residual,
  round(v, 2) AS dispersion FROM effects, e""",
    "lineitem_glm": one_way("lineitem", "l_returnflag", "l_extendedprice"),
}
