"""Alignment against plain loops over tokens and bytes."""

from __future__ import annotations

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.frames import AWKWARD, clashing
from tidemark.llm import token_alignment
from tidemark.llm.token_alignment import Tokenizers, alignment_report, loaded, token_groups

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"

TEXTS = [(r[0], r[1]) for r in AWKWARD if len(r[1] or "") < 5000] + [
    (20, "a ▁ b"), (21, "tabs\tand\r\nlines \x00 <s> <|endoftext|> <unk> <0x41>"), (22, "  two  spaces   three "),
    (23, "don't we'll I'M 12345 3.14"), (24, "  ﻿ é ﬁ \U0001f469‍\U0001f469"),
    (25, "the same words here and the same words there"), (25, "the same words here and the same words there"),
    (26, " "), (27, "\n"), (28, "naïve façade über die Straße " * 20),
]


def letters() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 400))
    return {(chr(b) if b in shown else chr(next(rest))): b for b in range(256)}


def brute(rows):
    a_tool = Tokenizer.from_file(PATHS[0])
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    table = letters()
    per_doc = []
    for doc, text in rows:
        text = text or ""
        a = a_tool.encode(" " + text, add_special_tokens=False).ids
        b = b_tool.encode(text)
        a_bytes = [bytes(table[c] for c in a_tool.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i)
                   else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            per_doc.append((doc, [], [], [], []))
            continue
        spans = []
        for pieces in (a_bytes, b_bytes):
            at, out = 0, []
            for p in pieces:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links, j0 = [], 0
        for i, (x, y) in enumerate(spans[0]):
            links += [(a[i], b[j]) for j, (u, v) in enumerate(spans[1]) if u < y and v > x]
        common = {y for _, y in spans[0]} & {y for _, y in spans[1]}
        groups, start = [], 0
        for end in sorted(common):
            side = [",".join(str(i) for i, (x, y) in zip(ids, s) if start <= x and y <= end)
                    for ids, s in zip((a, b), spans)]
            groups.append("|".join(side))
            start = end
        per_doc.append((doc, a, b, links, groups))
    count = Counter(p for *_, links, _ in per_doc for p in set(links))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((
        doc, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
        sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
    ) for doc, a, b, links, groups in per_doc), key=str)


def report(spark, rows, **options):
    found = alignment_report(spark.createDataFrame(rows, SCHEMA), Tokenizers(*PATHS, **options))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def expected():
    return brute(TEXTS)


def test_equals_brute_force(spark, expected):
    assert report(spark, TEXTS) == expected


@pytest.mark.parametrize("most", [0, 10, 60])
def test_rare_pairs_are_joined_by_shuffle(spark, expected, most):
    assert report(spark, TEXTS, max_pairs=most) == expected


def test_tables_of_any_kind(spark):
    assert report(spark, []) == []
    assert report(spark, [(1, None), (None, "")]) == brute([(1, None), (None, "")])
    frame = clashing(spark.createDataFrame(TEXTS, SCHEMA), "row", "pairs", "n_a", "id", "best")
    assert alignment_report(frame, Tokenizers(*PATHS)).count() == len(TEXTS)


def test_pieces_have_the_ids_of_the_whole_text(monkeypatch):
    tools = loaded(*PATHS)
    text = ("we'll see,  12 times: naïve \n\n code_x  = 'y' don 't 日本語 のテ キスト \x1c a\u00a0 b " * 50).strip()
    texts = [text, "", "x y", " lead", "trail \n", "▁ y", "▁"]
    pieces = [x.to_pylist() for x in tools.ids(texts)]
    whole = [x.to_pylist() for x in tools.lists(texts)]
    assert [x[:5] for x in pieces] == [[*side[:1], [], *side[2:5]] for side in whole]
    monkeypatch.setattr(token_alignment.Loaded, "joined", lambda self, pieces: None)
    assert [x.to_pylist() for x in tools.ids(texts)] == pieces
    monkeypatch.undo()
    huge = "x" * 300_000 + " " + "word " * 250_000
    found = token_alignment.align_texts([huge], tools)
    assert not found.empty[0] and found.end[-1] == len(huge) + 1


def test_texts_are_aligned_in_runs(monkeypatch):
    tools = loaded(*PATHS)
    texts = [t for _, t in TEXTS]
    whole = token_alignment.align_texts(texts, tools)
    monkeypatch.setattr(token_alignment, "ALIGNED", 40)
    monkeypatch.setattr(token_alignment, "PIECE_BYTES", 20)
    parts = list(token_alignment.align_runs(texts, tools))
    assert len(parts) > 5 and [i for rows, _ in parts for i in range(len(texts))[rows]] == [*range(len(texts))]
    for side in ("a", "b"):
        assert [x for _, p in parts for x in getattr(p, side).to_pylist()] == getattr(whole, side).to_pylist()
    ends = [(rows.start + d, e, c) for rows, p in parts for d, e, c in zip(p.doc, p.end, p.closes)]
    assert ends == [*zip(whole.doc, whole.end, whole.closes)]


def test_memory_of_counts_does_not_follow_the_batch():
    pairs = pa.ListArray.from_arrays(
        pa.array(np.arange(0, 4_000_001, 500), pa.int32()), pa.array(np.arange(4_000_000) % 5000))
    batch = pa.RecordBatch.from_arrays([pairs], names=["pairs"])
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(token_alignment._partial_counts(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 5000 and set(found["n"].to_pylist()) == {800}
    assert peak < 10_000_000  # a number for each pair of the batch takes 32 MB


def test_groups_cover_the_bytes(spark):
    text = "naïve façade, don't über 12345"
    rows = token_groups(spark.createDataFrame([(1, text), (2, None)], SCHEMA), Tokenizers(*PATHS)).collect()
    whole = (" " + text).encode()
    assert {r["doc_id"] for r in rows} == {1}
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len(whole)
    assert all(x["end"] == y["start"] for x, y in zip(rows, rows[1:]))
    tools = loaded(*PATHS)
    for r in rows:
        joined = b"".join(tools.a_bytes[i].as_py() for i in r["a_ids"])
        assert joined == whole[r["start"]:r["end"]] == b"".join(tools.b_bytes[i].as_py() for i in r["b_ids"])
