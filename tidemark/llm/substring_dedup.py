"""Repeated passages removed by suffix automata over reference shards.

A window is ``length`` consecutive words. Equal windows hold the same smallest
``anchor``-word hash, so a document is cut into segments, the runs of windows with one
such hash, and the hash routes a segment to its shard. Equal windows always meet in one
shard, and a shard needs no other one: each automaton sees only the text that can match it
(broadcasting every automaton to every document would cost documents times shards).

1. Hashes of all segments are counted. A bounded Bloom filter of those met twice rules
   out the segments that repeat nothing; they are not shuffled.
2. Equal segments are combined into one, with the first place it stands at. All windows
   of its other places are repeats.
3. The different segments of a shard are streamed in document order through a suffix
   automaton that grows with them. Its suffix link tells the matching statistic: the
   longest run of words ending here that also ends earlier. Windows whose statistic
   reaches ``length`` are repeats.
4. The words of repeated windows, the maximal spans, are removed.

A crowded shard (a passage that thousands of documents lead into differently) would be an
automaton of unbounded size. Its segments are cut again at a longer anchor and go through
the same steps in finer shards. Should one of these be crowded too, its equal windows are
combined, as equal segments are in step 2, and all but their first place are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.groups import match
from tidemark.llm.columns import WORD, join_groups, saved, text_of
from tidemark.llm.exact_dedup import Bloom, bloom_filter, probe, repeat_filter
from tidemark.llm.text_words import U, Words, mix, slices, words_of
from tidemark.session import save_stage


@dataclass(frozen=True)
class Passages:
    length: int = 20
    anchor: int = 5
    most_segments: int = 500  # different segments in one automaton

    @property
    def anchors(self) -> int:
        """Anchor runs in a window."""
        return self.length - self.anchor + 1


SEGMENT = T.StructType([
    T.StructField("route", T.LongType(), False),
    T.StructField("start", T.IntegerType(), False),  # first word of the first window
    T.StructField("windows", T.IntegerType(), False),
    T.StructField("loops", T.BooleanType(), False),  # its anchor stands in it twice
    T.StructField("digest", T.LongType(), False),  # of its words
])
WORDS = T.StructField("words", T.BinaryType(), False)  # 64-bit hashes
SEGMENT_ARROW = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]


@dataclass
class _Segments:
    route: np.ndarray
    start: np.ndarray  # in the batch
    windows: np.ndarray
    loops: np.ndarray
    owner: np.ndarray


def _sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n neighbours."""
    width, out = 1, h
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:len(out) - step], out[step:])
        width += step
    return out


def _segments(words: Words, options: Passages) -> _Segments:
    """Runs of windows with the same smallest anchor hash."""
    n, span = options.length, options.anchors
    total = len(words.hashes)
    if total < n:
        none = np.empty(0, np.int64)
        return _Segments(none, none, none, none.astype(bool), none)
    h = words.hashes
    anchors = h[:total - options.anchor + 1].copy()
    for i in range(1, options.anchor):
        anchors = mix(anchors * U(3) + h[i:total - options.anchor + 1 + i])
    least = _sliding_min(anchors, span)
    twice = np.zeros(len(least), np.int8)
    for i in range(span):
        twice += anchors[i:i + len(least)] == least
    last = np.repeat(words.first[1:], np.diff(words.first))
    valid = np.arange(len(least)) + n <= last[:len(least)]
    at = np.flatnonzero(valid)
    owner = np.searchsorted(words.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (owner[1:] != owner[:-1])
    cut = np.flatnonzero(new)
    if not len(cut):
        none = np.empty(0, np.int64)
        return _Segments(none, none, none, none.astype(bool), none)
    windows = np.diff(np.append(cut, len(at)))
    loops = (np.maximum.reduceat(twice[at], cut) > 1) | (windows > span)
    return _Segments(least[at[cut]].view(np.int64), at[cut], windows, loops, owner[cut])


def _lists(owner: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())


def _routes(docs: DataFrame, options: Passages) -> DataFrame:
    """One row per segment with its route; twice if it may repeat itself."""
    schema = T.StructType([T.StructField("routes", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = _segments(words_of(batch.column("text")), options)
                times = 1 + found.loops.astype(np.int64)
                lists = pa.ListArray.from_arrays(
                    _lists(np.repeat(found.owner, times), len(batch)), pa.array(np.repeat(found.route, times))
                )
                yield pa.RecordBatch.from_arrays([lists], names=["routes"])

    texts = docs.select(text_of("text").alias("text"))
    return texts.mapInArrow(run, schema).select(F.explode("routes").alias("route"))


def _text_digests(texts: pa.Array) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(t.as_py().encode(), digest_size=8).digest() for t in texts)
    return np.frombuffer(raw, np.int64)


def _segment_lists(words: Words, options: Passages, n: int, with_words: bool) -> pa.Array:
    """The segments of each text as a list of structs."""
    s = _segments(words, options)
    size = s.windows + options.length - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = words.hashes[np.arange(ends[-1]) + np.repeat(s.start - ends[:-1], size)]
    # Position-dependent sum, mixed: the digest of a segment's words.
    place = mix((np.arange(ends[-1]) - np.repeat(ends[:-1], size)).astype(U) + U(99))
    sums = np.concatenate([[U(0)], np.cumsum(mix(flat ^ place), dtype=U)])
    digest = mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(U)).view(np.int64)
    columns = [
        pa.array(s.route), pa.array((s.start - words.first[s.owner]).astype(np.int32)),
        pa.array(s.windows.astype(np.int32)), pa.array(s.loops), pa.array(digest),
    ]
    fields = list(SEGMENT)
    if with_words:
        fields.append(WORDS)
        columns.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(ends * 8), pa.py_buffer(flat)]
        ).cast(pa.binary()))
    structs = pa.StructArray.from_arrays(
        columns, fields=[pa.field(f.name, t, False) for f, t in zip(fields, SEGMENT_ARROW)]
    )
    return pa.ListArray.from_arrays(_lists(s.owner, n), structs)


def _all_segments(docs: DataFrame, options: Passages, with_words: bool = False) -> DataFrame:
    """``id, text_digest`` and the segment columns, one row per segment."""
    segment = T.StructType([*SEGMENT.fields, *([WORDS] if with_words else [])])
    schema = T.StructType([
        docs.schema["id"], T.StructField("text_digest", T.LongType(), False),
        T.StructField("segments", T.ArrayType(segment, False), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text")
                lists = _segment_lists(words_of(texts), options, len(batch), with_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(_text_digests(texts)), lists],
                    names=["id", "text_digest", "segments"],
                )

    rows = docs.select("id", text_of("text").alias("text")).mapInArrow(run, schema)
    return rows.select("id", "text_digest", F.inline("segments"))


def _finer_segments(segments: DataFrame, options: Passages) -> DataFrame:
    """Segments cut again at the smallest hash of a longer anchor; with their words."""
    segment = T.StructType([*SEGMENT.fields, WORDS])
    schema = T.StructType([
        *[segments.schema[c] for c in ("id", "text_digest", "start")],
        T.StructField("segments", T.ArrayType(segment, False), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "words"):
                held = [np.frombuffer(w.as_py(), np.uint64) for w in batch.column("words")]
                first = np.concatenate([[0], np.cumsum([len(w) for w in held])]).astype(np.int64)
                words = Words(np.concatenate(held), first)
                lists = _segment_lists(words, options, len(batch), True)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["id", "text_digest", "start"]).columns, lists],
                    names=["id", "text_digest", "start", "segments"],
                )

    cut = segments.select("id", "text_digest", "start", "words").mapInArrow(run, schema)
    rows = cut.select("id", "text_digest", F.col("start").alias("__from"), F.inline("segments"))
    return rows.withColumn("start", F.col("start") + F.col("__from")).drop("__from")


class SuffixAutomaton:
    """Online suffix automaton over word hashes."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def add(self, word: int) -> int:
        """Append a word; the longest run ending with it that also ended earlier."""
        nexts, link, length = self.next, self.link, self.length
        state, p = len(nexts), self.last
        nexts.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        self.last = state
        return length[link[state]]


RANGE = T.StructType([
    T.StructField("first", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False),
])


def _spans(found: list[int], start: int, length: int) -> list[tuple[int, int]]:
    """Word ranges of the windows whose statistic reaches the length, put together."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(found):
        if n >= length:
            a, b = start + i + 1 - length, start + i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def _stream(shards: DataFrame, options: Passages) -> DataFrame:
    """Repeated ranges of the segments' first places: ``id, text_digest, first, end``.

    Rows arrive sorted by shard and place; one shard at a time is in memory.
    """
    schema = T.StructType([shards.schema["id"], shards.schema["text_digest"], *RANGE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, number = None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(n).to_pylist() for n in ("shard", "id", "text_digest", "start", "words")]
            for key, doc, digest, start, words in zip(*columns):
                if key != shard:
                    shard, automaton, number = key, SuffixAutomaton(), 0
                found = [automaton.add(w) for w in np.frombuffer(words, np.uint64).tolist()]
                number += 1
                automaton.add(-number)
                rows += [(doc, digest, a, b) for a, b in _spans(found, start, options.length)]
            arrays = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(arrays[0], batch.schema.field("id").type), pa.array(arrays[1], pa.int64()),
                 pa.array(arrays[2], pa.int32()), pa.array(arrays[3], pa.int32())],
                names=["id", "text_digest", "first", "end"],
            )

    return shards.mapInArrow(run, schema)


def _place() -> Column:
    """Order of places in the corpus."""
    return F.struct(F.col("id").isNotNull().alias("known"), "id", "text_digest", "start")


def _at_place() -> Column:
    return (
        F.col("id").eqNullSafe(F.col("place.id")) & (F.col("text_digest") == F.col("place.text_digest"))
        & (F.col("start") == F.col("place.start"))
    )


def _combined(segments: DataFrame, total: int, options: Passages) -> tuple[DataFrame, DataFrame]:
    """Equal segments combined: the repeated ranges of all but the first places, and the
    different segments of shared shards at their first places."""
    different = save_stage(segments.groupBy("route", "digest").agg(
        F.min(_place()).alias("place"), F.count(F.lit(1)).alias("copies"),
        F.first("windows").alias("windows"), F.first("loops").alias("loops"),
    ))
    joined = join_groups(
        segments.select("id", "text_digest", "start", "route", "digest"),
        different.select("route", "digest", "place", "copies", "windows").where(F.col("copies") > 1),
        ["route", "digest"], "copies", total,
    )
    copies = joined.where(~_at_place()).select(
        "id", "text_digest", F.col("start").alias("first"),
        (F.col("start") + F.col("windows") + options.length - 1).alias("end"),
    )
    # Shards of several segments, or of one that may repeat itself.
    routes = save_stage(different.groupBy("route").agg(
        F.count(F.lit(1)).alias("segments"), F.max("loops").alias("any_loops")
    ).where((F.col("segments") > 1) | F.col("any_loops")))
    shared = join_groups(
        different.select("route", "windows", "place"), routes, ["route"], "segments", different.count()
    )
    return copies, shared.select(
        "route", "segments", "windows", "place.id", "place.text_digest", "place.start"
    )


def _automata(shards: DataFrame, options: Passages) -> DataFrame:
    """Repeated ranges of the first places in shards of bounded size."""
    partitions = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards.select("shard", "id", "text_digest", "start", "words").repartition(partitions, "shard")
    return _stream(dealt.sortWithinPartitions(
        "shard", F.col("id").asc_nulls_first(), "text_digest", "start"
    ), options)


def _single_windows(rows: DataFrame, options: Passages) -> DataFrame:
    """Repeated ranges where even finer shards are crowded: equal windows are combined."""
    at = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
    window = F.substring(F.col("words"), F.col("__at") * 8 + 1, F.lit(options.length * 8))
    windows, total = saved(
        rows.withColumn("__at", at)
        .withColumns({"window": F.xxhash64(window), "start": F.col("start") + F.col("__at")})
        .select("route", "window", "id", "text_digest", "start")
    )
    firsts = save_stage(
        windows.groupBy("route", "window").agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
    joined = join_groups(windows, firsts, ["route", "window"], "copies", total)
    return joined.where(~_at_place()).select(
        "id", "text_digest", F.col("start").alias("first"), (F.col("start") + options.length).alias("end")
    )


def _with_words(docs: DataFrame, places: DataFrame, options: Passages) -> DataFrame:
    """``places`` with the words of their segments, read from the documents again.

    Only segments that a Bloom filter of the places lets through leave their task.
    """
    key = ["id", "text_digest", "start"]
    mark = F.xxhash64(*key)
    bloom = bloom_filter(places.select(mark.alias("h")), "h")
    again = probe(_all_segments(docs, options, with_words=True), mark, bloom, "__may").where("__may")
    return save_stage(match(places, again.select(*key, "words"), key, "inner").dropDuplicates(key))


def repeated_ranges(docs: DataFrame, options: Passages = Passages()) -> DataFrame:
    """``id, text_digest, ranges``: word ranges to remove, for documents that have any.

    ``docs`` has ``id`` and ``text``.
    """
    bloom = repeat_filter(_routes(docs, options), "route")
    may = probe(_all_segments(docs, options), F.col("route"), bloom, "__may").where("__may")
    copies, shared = _combined(*saved(may.drop("__may")), options)
    shared = _with_words(docs, save_stage(shared), options)
    crowd = F.col("segments") > options.most_segments
    ranges = copies.unionByName(_automata(shared.where(~crowd).withColumn("shard", F.col("route")), options))
    if not shared.where(crowd).isEmpty():
        finer = replace(options, anchor=max(options.anchor, options.length * 2 // 3))
        pieces, total = saved(_finer_segments(shared.where(crowd), finer))
        # A finer shard belongs to its coarse one, whose windows it holds.
        copies, parts = _combined(pieces.drop("words"), total, finer)
        key = ["id", "text_digest", "start"]
        parts = save_stage(match(save_stage(parts), pieces.select(*key, "words"), key, "inner").dropDuplicates(key))
        ranges = ranges.unionByName(copies).unionByName(
            _automata(parts.where(~crowd).withColumn("shard", F.col("route")), finer)
        ).unionByName(_single_windows(parts.where(crowd), finer))
    return save_stage(ranges.groupBy("id", "text_digest").agg(
        F.sort_array(F.collect_list(F.struct("first", "end"))).alias("ranges")
    ))


def remove_repeats(
    docs: DataFrame, options: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_words, n_removed, text`` (kept words, one space between).

    A window is removed if its words also start earlier: in a document with a smaller id
    (NULL is smallest), or earlier in the same one. Rows equal in id and text are one
    document and get the same result; rows that share an id only are ordered by a digest of
    the text. NULL and empty texts have no words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_ranges(rows, options)
    known = F.coalesce(F.xxhash64("id"), F.lit(0))
    touched = bloom_filter(ranges.select(known.alias("h")).distinct(), "h")
    return _cut(rows, ranges, touched).withColumnRenamed("id", id_col)


def _cut(rows: DataFrame, ranges: DataFrame, touched: Bloom) -> DataFrame:
    known = F.coalesce(F.xxhash64("id"), F.lit(0))
    probed = probe(rows.withColumn("text", text_of("text")), known, touched, "__may")
    none = F.lit(None).cast(ranges.schema["ranges"].dataType)
    plain = probed.where(~F.col("__may")).select("id", "text", none.alias("ranges"))
    # Only documents that may lose words are shuffled.
    digested = _with_digest(probed.where("__may").select("id", "text"))
    same = digested["id"].eqNullSafe(ranges["id"]) & (digested["text_digest"] == ranges["text_digest"])
    found = digested.join(ranges, same, "left").select(digested["id"], "text", "ranges")
    return _keep_words(plain.unionByName(found))


def _with_digest(rows: DataFrame) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("text_digest", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array(_text_digests(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, "text_digest"])

    return rows.mapInArrow(run, schema)


def _keep_words(rows: DataFrame) -> DataFrame:
    schema = T.StructType([
        rows.schema["id"], T.StructField("n_words", T.LongType(), False),
        T.StructField("n_removed", T.LongType(), False), T.StructField("text", T.StringType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                words = text.as_py().encode().split()
                kept, at = [], 0
                for r in ranges or ():
                    kept += words[at:r["first"]]
                    at = max(at, r["end"])
                kept += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "text"],
            )

    return rows.mapInArrow(run, schema)


ORACLE = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)
), later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
