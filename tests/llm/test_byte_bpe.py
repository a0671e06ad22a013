from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.frames import AWKWARD, clashing, documents
from tidemark.llm import byte_bpe
from tidemark.llm.queries import bpe_report

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_awkward_texts_match_the_library(spark, reference):
    extra = [(20, "don't  we'll <|endoftext|>\x00\x7f\n\n\t x ", None, None, None)]
    rows = [*AWKWARD, *extra]
    out = bpe_report(documents(spark, rows).select("doc_id", "text")).collect()
    found = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out)
    want = []
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id or -1, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert found == sorted(want)


def test_columns_pass_and_clashes_are_replaced(spark):
    docs = clashing(documents(spark), "ids", "decoded")
    coded = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    by_id = {r.doc_id: r for r in coded.collect()}
    assert bytes(by_id[7].decoded).decode() == AWKWARD[6][1] and by_id[7].source == "b"
    assert by_id[1].ids == [] and bytes(by_id[1].decoded) == b""


def test_one_python_worker_encodes_and_decodes(spark):
    docs = clashing(documents(spark), "ids", "decoded")
    both = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, bytes_col="decoded")
    apart = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert both.schema == apart.schema
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    report = bpe_report(documents(spark).select("doc_id", "text"))
    for made in (report, corpus_pipeline.tokenise(spark, documents(spark), "")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_empty_table(spark):
    coded = byte_bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert byte_bpe.decode(coded, PATH).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0, b"b": 2})
