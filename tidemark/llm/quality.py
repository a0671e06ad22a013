"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule rejects a document whose measure exceeds a cutoff. Labelled documents of good
quality are the holdout: per stratum (language) and rule, cutoffs are tested from the
most lenient to the strictest with the exact binomial test of "more than ``risk`` of the
good documents are rejected", and the last one before the first failure is used. Testing
in a fixed order needs no correction along the cutoffs; over rules and strata the level
is divided by their number (Bonferroni). With probability 1 - ``level`` all chosen rules
together reject at most ``rules * risk`` of the good documents of every stratum. A stratum
with too few labels gets no rule.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.groups import attach
from tidemark.llm.columns import SPACE, WORD, bind, own_names, text_of, without, words
from tidemark.session import save_stage

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

RATIOS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
# Measures and their cutoffs, most lenient first.
CUTOFFS: Mapping[str, tuple[float, ...]] = {
    "symbol_share": RATIOS,
    "dup_line_share": RATIOS,
    "repeat_share": RATIOS,
    "upper_share": RATIOS,
    "mean_word": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}


@dataclass(frozen=True)
class Control:
    risk: float = 0.002  # share of good documents that one rule may reject
    level: float = 0.05
    max_strata: int | None = None  # strata with most labels; all others are pooled as one
    pool_small: bool = False  # pool the strata that could pass no test
    cutoffs: Mapping[str, tuple[float, ...]] = field(default_factory=lambda: CUTOFFS)


def _pairs(hashes: Column, n: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` after it."""
    left = F.slice(hashes, F.lit(1), n - step)
    right = F.slice(hashes, F.lit(1 + step), n - step)
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    at = F.sequence(F.lit(0), F.size(hashes) - 1)
    tagged = F.sort_array(F.zip_with(hashes, at, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twin = lambda p, i: (F.get(s, i - 1)["h"] == p["h"]) | (F.get(s, i + 1)["h"] == p["h"])
        return F.filter(s, lambda p, i: F.coalesce(twin(p, i), F.lit(False)))

    starts = F.sort_array(F.transform(bind(tagged, repeated), lambda p: p["i"]))
    gains = bind(starts, lambda s: F.transform(
        s, lambda p, i: F.least(F.lit(WINDOW), p - F.coalesce(F.get(s, i - 1), p - WINDOW))
    ))
    return F.aggregate(gains, F.lit(0), lambda total, g: total + g)


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts and the measures of the rules."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    step = docs.withColumns({"__words": words(text), "__lines": lines})
    step = step.withColumns({
        "n_words": F.size("__words").cast("long"),
        "__n": F.size("__words"),
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
        "__n_lines": F.size("__lines"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "__upper": F.regexp_count(text, F.lit("[A-Z]")),
    }).drop("__words", "__lines")
    # Pairs, fours, then eights: each window's hash from two halves.
    many = F.col("__n") >= WINDOW
    empty = F.array().cast("array<bigint>")
    step = step.withColumn("__hash", F.when(many, _pairs(F.col("__hash"), F.col("__n"), 1)).otherwise(empty))
    step = step.withColumn("__hash", F.when(many, _pairs(F.col("__hash"), F.col("__n") - 1, 2)).otherwise(empty))
    step = step.withColumn("__hash", F.when(many, _pairs(F.col("__hash"), F.col("__n") - 3, 4)).otherwise(empty))
    some = F.size(F.array_distinct("__hash")) < F.size("__hash")
    step = step.withColumn(
        "n_repeat_words", F.when(some, _covered(F.col("__hash"))).otherwise(0).cast("long")
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return step.withColumns({
        "base_failed": failed,
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "__n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("__upper", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
    }).drop("__n", "__hash", "__n_lines", "__upper")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), or 1 where k is not below the mean.

    Summed in logarithms, so large n do not underflow before the end.
    """
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (state["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(steps, start, add)["sum"])


def thresholds(features: DataFrame, labels: DataFrame, control: Control, id_col: str) -> DataFrame:
    """One row per stratum with the cutoff of every rule, NULL where a rule is off.

    ``features`` has the id, ``__stratum``, ``base_failed`` and the measures. A pool is the
    row with a NULL stratum.
    """
    good = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("__label")).distinct()
    holdout = features.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("__label"))
    counts = holdout.groupBy("__stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}:{i}")
          for rule, grid in control.cutoffs.items() for i, c in enumerate(grid)],
    )
    names = [c for c in counts.columns if c != "__stratum"]
    named = F.col("__stratum")
    if control.max_strata is not None:
        turn = F.row_number().over(Window.orderBy(F.col("n").desc(), "__stratum"))
        named = F.when(turn <= control.max_strata, named)
    if control.pool_small:
        counts = save_stage(counts)
        level = control.level / (max(counts.count(), 1) * len(control.cutoffs))
        # Even with no good document above a cutoff the test needs so many of them.
        named = F.when(F.col("n") >= math.log(level) / math.log1p(-control.risk), named)
    counts = counts.withColumn("__stratum", named).groupBy("__stratum").agg(
        *[F.sum(f"`{c}`").alias(c) for c in names]
    )
    counts = save_stage(counts)
    tests = max(counts.count(), 1) * len(control.cutoffs)
    chosen = []
    for rule, grid in control.cutoffs.items():
        passed = [
            binomial_cdf(F.col(f"`{rule}:{i}`"), F.col("n"), control.risk) <= control.level / tests
            for i in range(len(grid))
        ]
        # Fixed order: the cutoff before the first test that fails.
        failed_at = F.array_position(F.array(*passed), False)
        last = F.when(failed_at == 0, len(grid)).otherwise(failed_at - 1).cast("int")
        value = F.array(*[F.lit(float(c)) for c in grid])
        chosen.append(F.when(last > 0, F.get(value, last - 1)).alias(f"max_{rule}"))
    return save_stage(counts.select(F.col("__stratum").alias("__named"), *chosen))


@own_names
def assess(
    docs: DataFrame, labels: DataFrame, control: Control = Control(), id_col: str = "doc_id",
    text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """Documents with counts, measures, ``base_failed`` and ``kept``.

    The text is read once: features are written to the shared folder first, without the
    text. NULL texts have no words; NULL strata and NULL ids are
    judged with the pooled stratum and without labels. Repeated rows are kept.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "kept", *control.cutoffs]
    rows = with_features(without(docs, made), text_col)
    rows = rows.withColumn("__stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    rows = save_stage(rows.drop(text_col))
    limits = thresholds(rows, labels, control, id_col)
    named = limits.where(F.col("__named").isNotNull()).withColumn("__stratum", F.col("__named"))
    pooled = limits.where(F.col("__named").isNull()).first()
    found = attach(rows, named, ["__stratum"])
    rejected = F.lit(False)
    for rule in control.cutoffs:
        rest = F.lit(pooled[f"max_{rule}"] if pooled else None).cast("double")
        limit = F.when(F.col("__named").isNull(), rest).otherwise(F.col(f"max_{rule}"))
        rejected = rejected | F.coalesce(F.col(rule) > limit, F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(
        "__stratum", "__named", *[f"max_{rule}" for rule in control.cutoffs]
    )


REPORT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "base_failed", "kept"]


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs.select("doc_id", "text", "lang"), labels).select(*REPORT)


def drop_rejected(docs: DataFrame, labels: DataFrame, control: Control = Control()) -> DataFrame:
    """The documents that stay, with their own columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    packed = docs.select(whole, "doc_id", "text", "lang")
    return assess(packed, labels, control).where("kept").select("__doc.*")


def _oracle(control: Control = Control()) -> str:
    """The same rules in DuckDB SQL, written from the definition."""
    space = r"[\x20\x09-\x0D]"
    tests = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {i} AS i, {c} AS cutoff"
        for rule, grid in control.cutoffs.items() for i, c in enumerate(grid)
    )
    measure = " ".join(f"WHEN '{rule}' THEN {rule}" for rule in control.cutoffs)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id
), f AS (
  SELECT d.doc_id, lang, len(ws) AS n_words,
         length(t) - len(regexp_extract_all(t, '{space}')) AS word_chars,
         len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
         len(regexp_extract_all(t, '[A-Z]')) AS upper,
         coalesce(dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
         coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
         CASE WHEN word_chars > 0 THEN upper / word_chars ELSE 0 END AS upper_share,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word
  FROM f
), tests AS ({tests}
), good AS (
  SELECT * FROM m WHERE NOT base_failed
    AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), counts AS (
  SELECT lang, rule, i, cutoff, count(*) AS n,
         count(*) FILTER (CASE rule {measure} END > cutoff) AS k
  FROM good, tests GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN k >= n * {control.risk} THEN 1 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                   + j * ln({control.risk}) + (n - j) * ln(1 - {control.risk})))
    FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS p
  FROM counts
), level AS (
  SELECT {control.level} / (greatest(count(DISTINCT lang), 1) * {len(control.cutoffs)}) AS a FROM p
), chosen AS (
  SELECT lang, rule, min(cutoff) AS cutoff
  FROM (SELECT *, min(CASE WHEN p > a THEN i ELSE 1000 END) OVER (PARTITION BY lang, rule) AS bad
        FROM p, level) WHERE i < bad GROUP BY lang, rule
), rejected AS (
  SELECT DISTINCT doc_id FROM m JOIN chosen USING (lang)
  WHERE CASE rule {measure} END > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM m
"""


ORACLE = _oracle()
