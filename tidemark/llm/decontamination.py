"""Benchmark passages in training documents by winnowing, in DataFrame functions only.

A window is ``span`` consecutive words. Its fingerprint is the smallest hash of its
``gram``-word runs, so every shared passage of ``span`` words or more has a fingerprint on
both sides, wherever it starts. Neighbouring windows mostly share their fingerprint: a
document sends one row per change of fingerprint (and at least one per ``span - gram + 1``
windows), with the keys of the windows that may have it.

The rows meet the fingerprints of the benchmark first. That set is broadcast while it has at
most ``MAX_PRINTS`` numbers and becomes a Bloom filter of bounded size beyond. What passes is
saved and extended: each of its windows is looked up by a 128-bit key of its words' hashes
among the windows of the benchmark, so a hit is a whole window and touching hits grow into
longer spans. A document row carries no text, and a window matches one row of the benchmark
however many items share it.

Windows with the same items form one class. Documents hold classes, and the list of items is
made once for each different set of classes, so a passage that is in a third of the documents
and a third of the items costs no pair of both.

Items of fewer than ``span`` words are one window each. Their fingerprint is the hash of the
whole window (a sliding window of one), for every length that occurs among the items.

Defined results: NULL and word-free texts have no windows, as document and as item. Repeated
rows are judged each for itself. A NULL item id marks words but is not listed. A NULL document
id is kept. An empty benchmark leaves every document clean; an empty document table gives an
empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.groups import attach, match
from tidemark.llm.columns import ascii_lower, bind, saved, text_of
from tidemark.llm.exact_dedup import bloom_filter, probe
from tidemark.session import save_stage

# Letters and digits of ASCII, and everything beyond it; applied after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_PRINTS = 2_000_000  # numbers of 8 bytes: what is broadcast stays below 100 MB


@dataclass(frozen=True)
class Winnow:
    span: int = 10  # words of a window
    gram: int = 5  # words of a hashed run
    max_prints: int = MAX_PRINTS

    @property
    def width(self) -> int:
        """Runs in a window."""
        return self.span - self.gram + 1


@dataclass(frozen=True)
class Overlaps:
    documents: DataFrame  # doc id, n_words, n_hit, spans, item_set (NULL: clean)
    item_sets: DataFrame  # item_set, items


def words_of(name: str) -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(name)), F.lit(WORD), F.lit(0))


def _next(values: Column, place: Column, n: int) -> list[Column]:
    """The ``n`` values from ``place`` on, NULL beyond the end; ``slice`` would copy the array."""
    return [F.get(values, place + k) for k in range(n)]


def _places(n: Column) -> Column:
    """0 to ``n - 1``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _found(words: Column, rule: Winnow, short: list[int]) -> Column:
    """Per fingerprint of a text its place, the length of its windows and their words' hashes.

    Arrays are bound, so that each is made once; stacked columns would be inlined.
    """
    width = rule.width

    def row(hashes: Column, place: Column, length: int, mark: Column, reach: int) -> Column:
        return F.struct(
            (place + 1).alias("start"), F.lit(length).alias("length"), mark.alias("print"),
            F.array(*_next(hashes, place, reach)).alias("context"),
        )

    def whole(hashes: Column, length: int) -> Column:
        """Every window of ``length`` words, its own hash as fingerprint."""
        return F.transform(_places(F.size(hashes) - (length - 1)), lambda i: row(
            hashes, i, length, F.xxhash64(*_next(hashes, i, length)), length))

    def spans(hashes: Column, least: Column) -> Column:
        changes = lambda i: (i % width == 0) | (F.get(least, i) != F.get(least, i - 1))
        chosen = F.filter(_places(F.size(hashes) - (rule.span - 1)), changes)
        return F.transform(chosen, lambda i: row(
            hashes, i, rule.span, F.get(least, i), rule.span + width - 1))

    def lists(hashes: Column) -> Column:
        # Values near the end cover fewer words; no window starts there.
        grams = F.transform(hashes, lambda x, i: F.xxhash64(*_next(hashes, i, rule.gram)))
        smallest = lambda g: g if width == 1 else F.transform(
            g, lambda x, i: F.least(*_next(g, i, width)))
        long = bind(grams, lambda g: bind(smallest(g), lambda least: spans(hashes, least)))
        return F.concat(*[whole(hashes, n) for n in short], long)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lists)


def _each_window(rows: DataFrame) -> DataFrame:
    """One row per window of the rows' fingerprints: ``start, length`` and the key ``a, b``.

    Rows that stand for a document give one row without a key.
    """
    kept = [c for c in rows.columns if c not in ("start", "length", "print", "context")]
    known = F.array_compact("context")
    at = F.explode(_places(F.greatest(F.size("known") - F.col("length") + 1, F.lit(1))))
    placed = rows.select(*kept, "start", "length", known.alias("known")).select("*", at.alias("at"))
    window = F.when(F.col("start") > 0, F.slice("known", F.col("at") + 1, F.col("length")))
    return placed.select(
        *kept, (F.col("start") + F.col("at")).alias("start"), "length",
        F.when(window.isNotNull(), F.xxhash64(window)).alias("a"),
        F.when(window.isNotNull(), F.xxhash64(F.lit(1), window)).alias("b"),
    )


def _benchmark(items: DataFrame, item_col: str, text_col: str, rule: Winnow):
    """Lengths of short items, distinct fingerprints, windows with class, items of each class."""
    words = save_stage(
        items.select(F.col(item_col).cast("string").alias("item"), words_of(text_col).alias("words"))
        .where(F.size("words") > 0).distinct()
    )
    sizes = words.where(F.size("words") < rule.span).select(F.size("words").alias("n")).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # fewer than ``span`` numbers
    found = _found(F.col("words"), rule, short)
    # A short window counts only where it is a whole item.
    rows = save_stage(words.select("item", F.size("words").alias("n"), F.inline(found)).where(
        (F.col("length") == rule.span) | (F.col("length") == F.col("n"))
    ))
    windows = save_stage(
        _each_window(rows).select("item", "length", "a", "b").distinct()
    )
    # Windows of the same items have equal sums; their items are listed for one of them only.
    mark = F.coalesce("item", F.lit(""))
    by_window = save_stage(windows.groupBy("length", "a", "b").agg(
        F.count("item").alias("n_items"),
        F.bit_xor(F.xxhash64("item", mark)).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "item", mark)).alias("y"),
    ))
    sums = ["n_items", "x", "y"]
    classes = save_stage(
        by_window.groupBy(*sums).agg(F.min(F.struct("length", "a", "b")).alias("model"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    classed = attach(by_window, classes.select(*sums, "class"), sums, "inner")
    members = windows.where(F.col("item").isNotNull()).join(
        classes.select("model.*", "class"), ["length", "a", "b"]
    ).select("class", "item")
    prints = rows.select("print").distinct()
    return short, prints, classed.select("length", "a", "b", "class"), members


def _possible(rows: DataFrame, prints: DataFrame, rule: Winnow) -> DataFrame:
    """The rows whose fingerprint the benchmark (perhaps) has, and each document's first row."""
    table, n = saved(prints)
    if n <= rule.max_prints:
        known = F.broadcast(table.select(F.col("print").alias("known")))
        joined = rows.join(known, F.col("print") == F.col("known"), "left")
        return joined.where(F.col("known").isNotNull() | (F.col("start") == 0)).drop("known")
    marked = probe(rows, F.col("print"), bloom_filter(table, "print"), "known")
    return marked.where(F.col("known") | (F.col("start") == 0)).drop("known")


def _covered(spans: Column) -> Column:
    """Touching and overlapping ``(start, end)`` spans joined, in order."""
    span = "struct<start:int,end:int>"
    empty = F.struct(
        F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("open")
    )

    def step(state: Column, s: Column) -> Column:
        grown = F.struct(
            state["open"]["start"].alias("start"),
            F.greatest(state["open"]["end"], s["end"]).alias("end"),
        )
        begun = F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), s.alias("open"))
        return (
            F.when(state["open"].isNull(), F.struct(state["done"].alias("done"), s.alias("open")))
            .when(s["start"] <= state["open"]["end"],
                  F.struct(state["done"].alias("done"), grown.alias("open")))
            .otherwise(begun)
        )

    return F.aggregate(F.array_sort(spans), empty, step, lambda state: F.when(
        state["open"].isNull(), state["done"]
    ).otherwise(F.concat(state["done"], F.array(state["open"]))))


def find_overlaps(
    docs: DataFrame, items: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> Overlaps:
    """Words of each document that lie in a window of some item.

    ``spans`` are word positions from 0, end exclusive, touching ones joined; ``n_hit`` is
    their length. ``item_set`` names a row of ``item_sets`` with the sorted ids of the items
    that have a window in the document.
    """
    short, prints, windows, members = _benchmark(items, item_col, item_text_col, rule)
    text = text_of(text_col)
    own = ["id", "t1", "t2"]
    # The first row stands for the document itself and always passes.
    first = lambda words: F.struct(
        F.lit(0).alias("start"), F.size(words).alias("length"), F.lit(None).cast("bigint").alias("print"),
        F.array().cast("array<bigint>").alias("context"),
    )
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        F.inline(bind(words_of(text_col), lambda w: F.concat(
            F.array(first(w)), _found(w, rule, short)))),
    )
    passed = save_stage(_possible(rows, prints, rule).drop("print"))
    hits = attach(_each_window(passed), windows, ["length", "a", "b"]).where(
        F.col("class").isNotNull() | (F.col("start") == 0)
    )
    span = F.struct(
        (F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("length")).alias("end")
    )
    judged = hits.groupBy(*own).agg(
        F.collect_set(F.when(F.col("start") > 0, span)).alias("hits"),
        F.array_sort(F.collect_set("class")).alias("classes"),
        F.max(F.when(F.col("start") == 0, F.col("length"))).cast("long").alias("n_words"),
        F.count_if(F.col("start") == 0).cast("int").alias("copies"),
    )
    in_set = F.when(F.size("classes") > 0, F.sha2(F.array_join(F.col("classes").cast("array<string>"), ","), 256))
    judged = save_stage(judged.withColumn("spans", _covered(F.col("hits"))).select(
        "id", "n_words", "spans", "classes", in_set.alias("item_set"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))),
    ))
    length = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long")
    )
    sets = judged.where(F.col("item_set").isNotNull()).select("item_set", "classes").distinct()
    listed = (
        sets.select("item_set", F.explode("classes").alias("class")).join(members, "class", "left")
        .groupBy("item_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    documents = judged.select(
        F.col("id").alias(id_col), "n_words", length.alias("n_hit"), "spans", "item_set"
    )
    return Overlaps(documents, listed)


def overlap_report(docs: DataFrame, items: DataFrame, rule: Winnow = Winnow()) -> DataFrame:
    """The contract's columns for ``documents`` and ``benchmark``."""
    found = find_overlaps(docs.select("doc_id", "text"), items.select("item_id", "text"), rule)
    digests = found.item_sets.select(
        "item_set", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    return attach(found.documents, digests, ["item_set"]).select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.0,
                      id_col: str = "doc_id", text_col: str = "text", rule: Winnow = Winnow()) -> DataFrame:
    """The documents of which at most ``share`` of the words are hit, by document id."""
    found = find_overlaps(docs, items, rule, id_col, text_col)
    bad = found.documents.where(F.col("n_hit") > F.col("n_words") * share).select(id_col).distinct()
    return match(docs, bad, [id_col], "left_anti")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)
), hits AS (
  SELECT r, i, d.n, item_id FROM doc_windows d JOIN item_windows USING (n, k)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), listed AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
