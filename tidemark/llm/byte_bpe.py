"""Byte-level BPE through a sentencepiece model built from the vocabulary.

The model is serialised, not trained: every token's bytes are written as one letter per
byte, scored by negative rank, with identity normalisation. Merging the best-scored
neighbours is then the same as merging the lowest rank. The pattern cuts a text into
pre-tokens, which are encoded one by one; a pre-token that is itself a token needs no
merging. Ids are ranks. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tidemark.llm.columns import text_of, without

CACHED = 300_000  # pre-tokens a Python worker remembers
CACHED_LENGTH = 40
BATCH_TOKENS = 400_000  # most tokens in an output batch, unless one text has more


def byte_letters() -> str:
    """A letter for each byte: itself where printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in set(printable) else next(others)) for b in range(256))


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks."""
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must count from 0 without gaps")
    model = model_pb2.ModelProto()
    for token in tokens:
        piece = "".join(letters[b] for b in token)
        model.pieces.add(piece=piece, score=-float(ranks[token]), type=model.SentencePiece.NORMAL)
    model.pieces.add(piece="⁇", score=0.0, type=model.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = spec.BPE
    spec.vocab_size, spec.unk_id = len(model.pieces), len(tokens)
    spec.unk_piece = "⁇"
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    normal = model.normalizer_spec
    normal.name, normal.precompiled_charsmap = "identity", b""
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


class _PreTokens(dict):
    """Pre-token to its ids, encoded when first met."""

    def __init__(self, vocabulary: bytes) -> None:
        super().__init__()
        self.ranks = read_ranks(vocabulary)
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        rank = self.ranks.get(data)
        if rank is not None:
            ids = (rank,)
        else:
            ids = tuple(self.model.encode(data.decode("latin-1").translate(self.letters)))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _pre_tokens(vocabulary: bytes) -> _PreTokens:
    return _PreTokens(vocabulary)


@functools.lru_cache(maxsize=2)
def _token_bytes(vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = [t for t, _ in sorted(read_ranks(vocabulary).items(), key=lambda x: x[1])]
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file (under 1 MB) read here, once, and sent to every executor."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold at most ``most`` together, one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def encode(
    docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text",
    ids_col: str = "ids", bytes_col: str | None = None,
) -> DataFrame:
    """Adds ``ids array<int>``; the text column is replaced by its ids.

    NULL and empty texts give an empty array. Other columns pass through; one named like
    ``ids_col`` is replaced. Special tokens are ordinary text. With ``bytes_col`` the same
    Python worker decodes the ids again, as :func:`decode` would in a second one.
    """
    vocabulary = _vocabulary(docs, vocabulary_path)
    made = [c for c in (ids_col, bytes_col) if c and c.lower() != text_col.lower()]
    rows = without(docs, made)
    rows = rows.withColumn(text_col, text_of(text_col))
    kept = [c for c in rows.columns if c != text_col]
    schema = T.StructType([rows.schema[c] for c in kept] + [
        T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)
    ] + ([T.StructField(bytes_col, T.BinaryType(), False)] if bytes_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = regex.compile(pattern), _pre_tokens(vocabulary.value)
        entries = _token_bytes(vocabulary.value) if bytes_col else None
        for batch in batches:
            texts, others = batch.column(text_col), batch.select(kept)
            flat, ends, start = array("i"), [0], 0
            for i in range(len(texts)):
                for ids in map(pieces.__getitem__, cut.findall(texts[i].as_py())):
                    flat.extend(ids)
                ends.append(len(flat))
                if len(flat) >= BATCH_TOKENS or i + 1 == len(texts):
                    columns = [*others.slice(start, i + 1 - start).columns, _lists(ends, flat)]
                    if entries:
                        columns.append(_bytes(columns[-1].values.to_numpy(), np.array(ends), entries))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    flat, ends, start = array("i"), [0], i + 1

    return rows.mapInArrow(run, schema)


def _lists(ends: list[int], flat: array) -> pa.ListArray:
    values = pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _bytes(ids: np.ndarray, ends: np.ndarray, entries: tuple[np.ndarray, ...]) -> pa.BinaryArray:
    """The bytes of each list of ids; ``ends`` are 0 and the lists' ends."""
    data, starts, lengths = entries
    size = lengths[ids]
    places = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(places[-1]) + np.repeat(starts[ids] - places[:-1], size)
    of_rows = places[ends].astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(of_rows), pa.py_buffer(data[at])]
    )


def decode(
    tokens: DataFrame, vocabulary_path: str, ids_col: str = "ids", bytes_col: str = "decoded"
) -> DataFrame:
    """Adds ``decoded binary``: the bytes of the ids. NULL ids give empty bytes."""
    vocabulary = _vocabulary(tokens, vocabulary_path)
    rows = without(tokens, [bytes_col])
    schema = T.StructType([*rows.schema.fields, T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _token_bytes(vocabulary.value)
        for batch in batches:
            column = batch.column(ids_col)
            counts = np.array(column.value_lengths().fill_null(0))
            for a, b in _slices(counts, BATCH_TOKENS):
                ids = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                decoded = _bytes(ids, np.concatenate([[0], np.cumsum(counts[a:b])]), entries)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, decoded], [*part.schema.names, bytes_col]
                )

    return rows.mapInArrow(run, schema)
