from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from tests.llm.frames import AWKWARD, clashing, documents, words
from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import Passages, SuffixAutomaton
from tidemark.llm.text_words import slices, words_of


def brute(rows, n=20):
    """Kept words by id; rows equal in id and text are one document."""
    distinct = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for known, doc_id, text in distinct:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            key = tuple(w[p:p + n])
            if key in seen:
                gone[p:p + n] = [True] * n
            seen.add(key)
        out[doc_id if known else None] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def made():
    random.seed(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(400):
        kind = i % 6
        if kind == 0:
            t = " ".join(random.choice("ab") for _ in range(random.randrange(80)))
        elif kind == 1:
            t = " ".join(random.choice("xyzw") for _ in range(30)) + f" {passage} {random.random()} tail"
        elif kind == 2:
            t = "a " * random.randrange(60)
        elif kind == 3:
            t = " ".join(f"r{random.randrange(3)}" for _ in range(45))
        elif kind == 4:
            t = random.choice(rows)[1]
        else:
            t = None
        rows.append((i, t, "en", "a", 1))
    return rows


@pytest.mark.parametrize("options", [Passages(), Passages(most_segments=3), Passages(anchor=20), Passages(anchor=1)])
def test_matches_brute_force(spark, options):
    rows = made()
    out = substring_dedup.remove_repeats(documents(spark, rows).repartition(7), options)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()} == brute(rows)


def test_awkward_documents(spark):
    docs = clashing(documents(spark), "id", "ranges", "n_words")
    out = substring_dedup.remove_repeats(docs).collect()
    assert len(out) == len(AWKWARD)
    want = brute(AWKWARD)
    assert all((r.n_words, r.n_removed, r.text) == want[r.doc_id] for r in out)
    assert want[5][1] == 30_000 and want[4][1] > 28_000  # a copy goes, a text repeats itself


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_automaton_gives_matching_statistics():
    random.seed(1)
    for _ in range(50):
        text = [random.randrange(3) for _ in range(40)]
        automaton = SuffixAutomaton()
        for end, got in enumerate(map(automaton.add, text), 1):
            fits = lambda n: any(text[i:i + n] == text[end - n:end] for i in range(end - n))
            assert got == max(n for n in range(end) if n == 0 or fits(n))


def test_memory_does_not_follow_the_batch():
    random.seed(2)
    texts = [" ".join(f"w{random.randrange(50_000)}" for _ in range(500)) for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    rows, options = 0, Passages()
    tracemalloc.start()
    try:
        for part in slices(batch, "text"):
            rows += len(substring_dedup._segment_lists(words_of(part["text"]), options, len(part), True))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts)
    assert peak < 40_000_000  # 4 MB of text at once take 84 MB


def test_word_hashes_tell_words_apart():
    texts = ["", " a b ", "aa\tb\nc", "é ü x y", " ", "x" * 3_000_000 + " y", "x" * 2_999_999 + "z y", "a\x1fb \x85"]
    found = words_of(pa.array(texts))
    flat = [w for t in texts for w in words(t)]
    assert [int(b - a) for a, b in zip(found.first, found.first[1:])] == [len(words(t)) for t in texts]
    by_word = dict(zip(flat, found.hashes))
    assert all(by_word[w] == h for w, h in zip(flat, found.hashes))
    assert len(set(by_word.values())) == len(by_word)

