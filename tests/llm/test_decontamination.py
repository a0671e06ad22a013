"""Winnowing against a plain search of every window."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tests.llm.frames import AWKWARD, clashing, documents
from tidemark.llm.decontamination import Winnow, drop_contaminated, find_overlaps, overlap_report
from tidemark.session import BROADCAST_ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, span=10):
    """Per document: its id, words, hit words, sorted item ids."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i:i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(listed), digest, bool(hit)))
    return sorted(out, key=str)


def report(spark, docs, items, **rule):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    listed = spark.createDataFrame(items, ITEMS)
    rows = overlap_report(frame, listed, Winnow(**rule)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def planted(seed: int):
    """Documents of few different words, with passages of the items, whole and cut."""
    rng = random.Random(seed)
    letters = "abcdefgh"
    prose = lambda n: [rng.choice(letters) for _ in range(n)]
    items = [(i, " ".join(prose(rng.choice([0, 3, 6, 9, 10, 11, 25, 60])))) for i in range(12)]
    items += [(12, items[3][1]), (3, "Another text, of ITEM three: it has more than ten words, really."), (None, " ".join(prose(14)))]
    docs = []
    for d in range(60):
        w = prose(rng.choice([0, 4, 30, 120]))
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1].split()
            a = rng.randrange(len(passage) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[a:a + rng.choice([9, 10, 30])]
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(w)))
    return docs + docs[:5] + [(None, docs[7][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = planted(seed)
    assert report(spark, docs, items) == brute(docs, items)


def test_other_paths(spark):
    docs, items = planted(3)
    spark.conf.set(BROADCAST_ROWS[0], "3")
    try:
        assert report(spark, docs, items, max_prints=4) == brute(docs, items)
    finally:
        spark.conf.unset(BROADCAST_ROWS[0])
    assert report(spark, docs, items, span=12, gram=4) == brute(docs, items, 12)
    assert report(spark, docs, items, span=5, gram=5) == brute(docs, items, 5)


def test_one_word_and_ties(spark):
    items = [(1, "same"), (2, "same " * 40), (3, "same"), (4, "")]
    docs = [(1, "same " * 500), (2, "Same, other!"), (3, "other " * 30), (4, None)]
    assert report(spark, docs, items) == brute(docs, items)


def test_awkward_rows(spark):
    docs = [(r[0], r[1]) for r in AWKWARD]
    items = [(1, " ".join(f"w{i}" for i in range(300, 340))), (2, "ärger über ÄÖ und"), (None, None),
             (3, "read on the way home")]
    assert report(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = planted(4)
    assert report(spark, docs, []) == brute(docs, [])
    assert report(spark, docs, [(1, None), (2, "...")]) == brute(docs, [])
    assert report(spark, [], items) == []


def test_spans_items_and_dropping(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    frame = documents(spark, [(1, f"Well: {text}. And more", "en", "a", 1), (2, "clean", "en", "a", 1)])
    items = spark.createDataFrame([(7, text), (70, text[4:])], ITEMS)
    found = find_overlaps(clashing(frame, "start", "a", "class", "t1"), items)
    rows = {r["doc_id"]: r for r in found.documents.collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(1, 13)] and rows[1]["n_hit"] == 12
    assert rows[2]["spans"] == [] and rows[2]["item_set"] is None
    sets = {r["item_set"]: r["items"] for r in found.item_sets.collect()}
    assert sets[rows[1]["item_set"]] == ["7", "70"]
    assert [r["doc_id"] for r in drop_contaminated(frame, items).collect()] == [2]
    assert drop_contaminated(frame, items, share=0.9).count() == 2
