"""Alignment of two tokenizers over the bytes of each document.

A is a byte-level BPE that reads a space and the text, B a sentencepiece model that adds the
space itself, so both cut the same bytes. The tasks work on Arrow columns of whole batches:
token lists are flattened with their parent indices, byte ends are cumulative sums per
document, and an Acero hash join on (document, end) puts the two sets of ends together. Ends
that both have close a group; every end closes one *link*, a pair of tokens that overlap.

Per document the distinct pairs and how often they are linked are saved once. Their document
counts are ``Table.group_by`` counts of the tasks, merged by Spark. A pair's count is looked up
in a broadcast of at most ``max_pairs`` pairs; where there are more, the broadcast has the
pairs of the largest counts and only links of the rarer ones shuffle. The largest count of each
A id is a table of at most one row per vocabulary entry.

Texts are cut at single spaces between other characters: no token of either kind spans such a
place. The different pieces of some megabytes of text are encoded once, joined by spaces, and
the texts' ids put together from theirs; they are the ids of the whole text.

Defined results: a text that is NULL or empty, or that one tokenizer cannot give back byte for
byte (a U+2581, which B reads as a space), has no tokens and all its numbers are zero. Repeated
rows are documents of their own, NULL ids are kept, extra columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.groups import attach
from tidemark.llm.columns import text_of
from tidemark.llm.text_words import runs, slices
from tidemark.session import save_stage

PAIR = 1 << 16  # a pair of ids is the number a * PAIR + b; both vocabularies are smaller
FLUSH = 1_000_000  # different pairs that a task holds before it hands on its counts
TEXT_BYTES = 4_000_000  # text whose different pieces are encoded once
PIECE_BYTES = 500_000  # different pieces encoded as one text
ALIGNED = 1_000_000  # characters aligned at once
PAIRS = 200_000  # pairs counted or weighed at once
CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Tokenizers:
    byte_path: str  # tokenizers' JSON of a byte-level BPE
    piece_path: str  # sentencepiece model
    max_pairs: int = 2_000_000  # pairs of the broadcast, 16 bytes each


@functools.cache
def _byte_level():
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Loaded:
    """Both tokenizers and the bytes of their entries, once per worker."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        pa.set_cpu_count(1)
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = _byte_level()
        entries = {i: piece for piece, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = pa.array(
            [bytes(letters.get(c, 0x3F) for c in entries.get(i, "")) for i in range(max(entries) + 1)],
            pa.large_binary())
        self.b_bytes = pa.array(map(self._piece, range(self.b.get_piece_size())), pa.large_binary())

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def lists(self, pieces: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """Token ids of each piece."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        return _lists(a), _lists(self.b.encode(pieces, num_threads=1))

    def joined(self, pieces: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray] | None:
        """As :meth:`lists` for pieces without space at their ends, encoded as one text."""
        text = " ".join(pieces)
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        sides = []
        for ids, entries in zip(self.lists([text]), (self.a_bytes, self.b_bytes)):
            if not _joined_equal(ids, entries, [(" " + text).encode()])[0]:
                return None
            length = np.asarray(pc.binary_length(entries)).astype(np.int64)
            places = np.searchsorted(np.cumsum(length[np.asarray(ids.values)]), ends) + 1
            offsets = pa.array(np.concatenate([[0], places]), pa.int64())
            sides.append(pa.LargeListArray.from_arrays(offsets, ids.values))
        return tuple(sides)

    def ids(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """Token ids of each text, every different piece of the texts encoded once."""
        cut = [CUT.split(t) if t else [] for t in texts]
        flat = pa.array([p for pieces in cut for p in pieces], pa.large_string()).dictionary_encode()
        pieces = flat.dictionary.to_pylist()
        plain = np.array([p.strip() == p and "▁" not in p for p in pieces], bool)
        first = [p for p, ok in zip(pieces, plain) if ok]
        other = [p for p, ok in zip(pieces, plain) if not ok]
        bounds = runs(np.array([len(p) + 1 for p in first], np.int64), PIECE_BYTES)
        known = [self.joined(first[x:y]) or self.lists(first[x:y]) for x, y in bounds]
        rank = np.empty(len(pieces), np.int64)
        rank[plain], rank[~plain] = np.arange(len(first)), len(first) + np.arange(len(other))
        taken = pa.array(rank[np.asarray(flat.indices)])
        edges = np.concatenate([[0], np.cumsum([len(pieces) for pieces in cut])]).astype(np.int64)
        return tuple(
            _by_text(pa.concat_arrays(side).take(taken), edges) for side in zip(*known, self.lists(other)))


@functools.cache
def loaded(byte_path: str, piece_path: str) -> Loaded:
    return Loaded(byte_path, piece_path)


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(offsets[-1]))
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _by_text(lists: pa.LargeListArray, edges: np.ndarray) -> pa.LargeListArray:
    """Lists of pieces joined to lists of texts; ``edges`` are the texts' first pieces."""
    offsets = pa.array(np.asarray(lists.offsets)[edges], pa.int64())
    return pa.LargeListArray.from_arrays(offsets, lists.values)


def _part(ids: pa.LargeListArray, x: int, y: int) -> pa.LargeListArray:
    """The lists from x to y, as an array of their own."""
    offsets = np.asarray(ids.offsets)[x:y + 1]
    values = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
    return pa.LargeListArray.from_arrays(pa.array(offsets - offsets[0]), values)


def _joined_equal(ids: pa.LargeListArray, entries: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """For each document whether the entries of its ids make up its bytes."""
    taken = entries.take(ids.values)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1]
    data = taken.buffers()[2].to_pybytes() if len(taken) else b""
    edges = ends[np.asarray(ids.offsets)]
    return np.array([data[x:y] == w for x, y, w in zip(edges, edges[1:], wanted)], bool)


def _ends(ids: pa.LargeListArray, entries: pa.Array, index: str) -> pa.Table:
    """Document, byte end and place of every token."""
    doc = pc.list_parent_indices(ids)
    total = np.cumsum(np.asarray(pc.binary_length(entries)).astype(np.int64)[np.asarray(ids.values)])
    begin = np.asarray(ids.offsets)
    before = np.concatenate([[0], total])[begin[:-1]]
    end = total - before[np.asarray(doc)]
    return pa.table({"doc": doc, "end": pa.array(end, pa.int64()), index: pa.array(np.arange(len(end)))})


@dataclass
class Aligned:
    a: pa.LargeListArray
    b: pa.LargeListArray
    doc: np.ndarray  # of each link
    end: np.ndarray
    link_a: np.ndarray  # place of the link's tokens among all of the batch
    link_b: np.ndarray
    closes: np.ndarray  # links at whose end both tokens end
    empty: np.ndarray  # documents without tokens


def align_texts(texts: list[str | None], tools: Loaded) -> Aligned:
    texts = [t or "" for t in texts]
    return _aligned(texts, *tools.ids(texts), tools)


def align_runs(texts: list[str | None], tools: Loaded) -> Iterator[tuple[slice, Aligned]]:
    """Runs of the texts, each aligned by itself; the pieces of all are encoded together."""
    texts = [t or "" for t in texts]
    a, b = tools.ids(texts)
    for x, y in runs(np.array([len(t) for t in texts], np.int64), ALIGNED):
        yield slice(x, y), _aligned(texts[x:y], _part(a, x, y), _part(b, x, y), tools)


def _aligned(texts: list[str], a: pa.LargeListArray, b: pa.LargeListArray, tools: Loaded) -> Aligned:
    wanted = [(" " + t).encode() for t in texts]
    good = _joined_equal(a, tools.a_bytes, wanted) & _joined_equal(b, tools.b_bytes, wanted)
    good &= np.array([bool(t) for t in texts], bool)
    if not good.all():
        a, b = _blanked(a, good), _blanked(b, good)
    ends = _ends(a, tools.a_bytes, "at_a").join(
        _ends(b, tools.b_bytes, "at_b"), ["doc", "end"], join_type="full outer", use_threads=False
    ).sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    both = pc.and_(pc.is_valid(ends["at_a"]), pc.is_valid(ends["at_b"]))
    # A token covers all ends up to its own; each document ends with an end of both.
    link_a, link_b = (pc.fill_null_backward(ends[c]).combine_chunks() for c in ("at_a", "at_b"))
    as_numbers = lambda x: np.asarray(x).astype(np.int64)
    return Aligned(a, b, as_numbers(ends["doc"]), as_numbers(ends["end"]), as_numbers(link_a),
                   as_numbers(link_b), np.asarray(both).astype(bool), ~good)


def _blanked(ids: pa.LargeListArray, good: np.ndarray) -> pa.LargeListArray:
    size = np.diff(np.asarray(ids.offsets))
    kept = np.asarray(ids.values)[np.repeat(good, size)]
    offsets = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(kept, pa.int64()))


def _edges(sorted_docs: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_docs, np.arange(n + 1))


def _group_texts(found: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    sides = []
    for ids, link in ((found.a, found.link_a), (found.b, found.link_b)):
        offsets = np.concatenate([[0], link[found.closes] + 1])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), ids.values.cast(pa.string()))
        sides.append(pc.binary_join(lists, ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    edges = _edges(found.doc[found.closes], len(found.a))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), groups), ";").to_pylist()


def _summary(ids: pa.Array, found: Aligned) -> pa.RecordBatch:
    n = len(ids)
    count = lambda docs: np.bincount(docs, minlength=n).astype(np.int64)
    pair = np.asarray(found.a.values)[found.link_a] * PAIR + np.asarray(found.b.values)[found.link_b]
    keyed, times = np.unique(found.doc * PAIR**2 + pair, return_counts=True)  # pairs are below 2^32
    edges = pa.array(_edges(keyed // PAIR**2, n), pa.int32())
    texts_of = _group_texts(found)
    digest = ["" if e else hashlib.sha256(t.encode()).hexdigest() for e, t in zip(found.empty, texts_of)]
    return pa.RecordBatch.from_pydict({
        "id": ids,
        "n_a": np.diff(np.asarray(found.a.offsets)), "n_b": np.diff(np.asarray(found.b.offsets)),
        "n_groups": count(found.doc[found.closes]), "n_links": count(found.doc),
        "groups_sha256": pa.array(digest, pa.string()),
        "pairs": pa.ListArray.from_arrays(edges, pa.array(keyed % PAIR**2, pa.int64())),
        "times": pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
    })


def align_documents(docs: DataFrame, tools: Tokenizers, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Saved table with one row per document: ``row``, the id, ``n_a, n_b, n_groups, n_links,
    groups_sha256``, the distinct linked ``pairs`` and how often (``times``) each is linked."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), *StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = loaded(tools.byte_path, tools.piece_path)
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                for rows, found in align_runs(part.column("text").to_pylist(), held):
                    yield _summary(part.column("id")[rows], found)

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return save_stage(
        texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
        .withColumnRenamed("id", id_col)
    )


def token_groups(docs: DataFrame, tools: Tokenizers, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per group: id, ``start, end`` in the bytes of a space and the text, ``a_ids, b_ids``."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField(id_col, kind), *StructType.fromDDL(
        "start long, end long, a_ids array<long>, b_ids array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = loaded(tools.byte_path, tools.piece_path)
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                for rows, found in align_runs(part.column("text").to_pylist(), held):
                    doc, end = found.doc[found.closes], found.end[found.closes]
                    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                    start = np.where(first, 0, np.concatenate([[0], end[:-1]])) if len(doc) else end
                    lists = [
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], link[found.closes] + 1]), pa.int32()), ids.values)
                        for ids, link in ((found.a, found.link_a), (found.b, found.link_b))
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id")[rows].take(pa.array(doc)), pa.array(start), pa.array(end), *lists],
                        names=[id_col, "start", "end", "a_ids", "b_ids"])

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, schema)


def _by_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``PAIRS`` pairs."""
    for batch in batches:
        for x, y in runs(np.asarray(batch.column("pairs").value_lengths()), PAIRS):
            yield batch.slice(x, y - x)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's pairs; handed on early when there are many different ones."""
    pa.set_cpu_count(1)
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    held = schema.empty_table()

    def merged(table: pa.Table) -> pa.Table:
        total = table.group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return total.rename_columns({"n_sum": "n"}).select(["pair", "n"])

    for batch in _by_pairs(batches):
        pairs = batch.column("pairs").flatten()
        counted = pa.table({"pair": pairs, "n": np.ones(len(pairs), np.int64)})
        held = merged(pa.concat_tables([held, merged(counted)]))
        if held.num_rows > FLUSH:
            yield from held.combine_chunks().to_batches()
            held = schema.empty_table()
    yield from held.combine_chunks().to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Saved table of pairs: ``pair, a_id, b_id, n_docs`` and whether that is its A id's ``best``."""
    counts = save_stage(
        aligned.select("pairs").mapInArrow(_partial_counts, "pair long, n long")
        .groupBy("pair").agg(F.sum("n").alias("n_docs"))
        .select("pair", F.expr(f"pair div {PAIR}").alias("a_id"), (F.col("pair") % PAIR).alias("b_id"), "n_docs")
    )
    best = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))  # one row per A id
    return save_stage(attach(counts, best, ["a_id"]).select(
        "pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` pairs reach."""
    if counts.count() <= most:
        return 0
    level = F.floor(F.log2("n_docs")).cast("int")
    levels = dict(counts.groupBy(level.alias("level")).count().collect())  # at most 63 rows
    total, floor = 0, max(levels) + 1
    while total + levels.get(floor - 1, 0) <= most:
        floor -= 1
        total += levels.get(floor, 0)
    return 2**floor


def weigh_links(aligned: DataFrame, counts: DataFrame, max_pairs: int) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` over the links of each document."""
    floor = _frequent(counts, max_pairs)
    table = counts.where(F.col("n_docs") >= floor).select("pair", "n_docs", "best").toPandas()  # bounded above
    table = table.sort_values("pair")
    held = aligned.sparkSession.sparkContext.broadcast((
        table["pair"].to_numpy(np.int64), table["n_docs"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    schema = StructType([f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
                        + StructType.fromDDL("n_best long, count_sum long, pairs array<long>, times array<long>").fields)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_docs, best = held.value
        for batch in _by_pairs(batches):
            lists = batch.column("pairs")
            asked, times = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("pairs", "times"))
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(size)])
            at = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
            known = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
            weight = np.where(known, n_docs[at] * times, 0) if len(pairs) else np.zeros(len(asked), np.int64)
            hit = np.where(known & best[at], times, 0) if len(pairs) else weight
            rest = pa.array(np.concatenate([[0], np.cumsum(add(~known))]), pa.int32())
            done = {f.name: batch.column(f.name) for f in schema if f.name in batch.schema.names}
            done |= {"n_best": pa.array(add(hit)), "count_sum": pa.array(add(weight)),
                     "pairs": pa.ListArray.from_arrays(rest, pa.array(asked[~known])),
                     "times": pa.ListArray.from_arrays(rest, pa.array(times[~known]))}
            yield pa.RecordBatch.from_pydict({f.name: done[f.name] for f in schema})

    weighed = aligned.mapInArrow(weigh, schema)
    if not floor:
        return weighed.drop("pairs", "times")
    weighed = save_stage(weighed)
    rare = weighed.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(
        counts.where(F.col("n_docs") < floor).withColumnRenamed("pair", "pairs"), "pairs")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"),
        F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"))
    zero = F.lit(0).cast("long")
    return weighed.drop("pairs", "times").join(more, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", zero),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero),
    }).drop("more_best", "more_sum")


def alignment_report(docs: DataFrame, tools: Tokenizers) -> DataFrame:
    """The contract's columns for ``documents``."""
    aligned = align_documents(docs.select("doc_id", "text"), tools)
    return weigh_links(aligned, pair_counts(aligned), tools.max_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
