"""The prefix trie against a plain walk over every prefix."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.frames import clashing
from tidemark.llm.prefix_trie import Trie, prefix_trie, rebuilt_turns, sketch
from tidemark.session import BROADCAST_ROWS, HOT_ROWS

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [n for n in members if n[:d] == node]
        childless = lambda n: not any(len(c) == len(n) + 1 and c[:len(n)] == n for c in members)
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == d)))
        out.append((
            min(convs), d, min(members[node[:-1]]) if d else None, len(convs),
            sum(len(n) == d + 1 for n in below), sum(map(childless, below)),
            sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def talks(seed: int, convs=range(0, 90)):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", None])
            text = rng.choice(["hello there", "one two three", "", None, f"only {c} {turn}"])
            rows.append((c, turn if rng.random() < 0.97 else None, role, text))
    rng.shuffle(rows)
    return rows


def trie(spark, rows, **rule):
    found = prefix_trie(spark.createDataFrame(rows, SCHEMA), Trie(**rule)).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = talks(seed)
    assert trie(spark, rows) == brute(rows)


def test_hot_bundles_full_sketch_and_shuffled_joins(spark):
    """Bundles over several parts, every cell of the sketch met twice, nothing broadcast."""
    rows = talks(3) + [(41, t, "user", f"long {t}") for t in range(100, 180)]
    spark.conf.set(HOT_ROWS[0], "30")
    spark.conf.set(BROADCAST_ROWS[0], "3")
    try:
        assert trie(spark, rows, max_cells=8, id_chunk=4) == brute(rows)
    finally:
        spark.conf.unset(HOT_ROWS[0])
        spark.conf.unset(BROADCAST_ROWS[0])


def test_awkward_rows(spark):
    rows = [
        (20, None, None, None), (20, 1, "user", "x " * 50_000), (20, 1, "user", "x " * 50_000),
        (21, 1, "user", ""), (21, 1, "user", ""), (22, 5, "a", "one"), (22, 5, "a", "one"),
        (39, 0, "user", "hi"), (63, 0, "user", "alone"), (None, 0, "user", "nobody's"),
        (9_000_000_000_000, 0, None, "far"), (9_000_000_000_007, 0, "user", "far too"),
    ]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows + rows) == brute(rows + rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    frame = clashing(spark.createDataFrame(rows, SCHEMA), "depth", "p1", "base", "kind", "owner")
    assert sorted((tuple(r) for r in prefix_trie(frame).collect()), key=str) == brute(rows)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 2) for t in range(3)]
    assert trie(spark, rows, id_chunk=100) == trie(spark, rows)
    root = next(r for r in trie(spark, rows) if r[1] == 0)
    assert root[3] == 3000


def test_screen_proves_singletons(spark):
    """An estimate of one is never wrong, and most singletons are found."""
    rows = rebuilt_turns(spark.createDataFrame(talks(5, range(0, 400)), SCHEMA)).where("depth > 0")
    held = rows.toPandas()
    shared = sketch(rows, len(held)).shared(held["p1"].to_numpy(), held["p2"].to_numpy())
    counts = held.groupby(["p1", "p2"])["conv_id"].transform("count").to_numpy()
    assert not np.any(~shared & (counts > 1))
    assert np.mean(shared[counts == 1]) < 0.05
