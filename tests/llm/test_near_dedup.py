from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from tests.llm.frames import AWKWARD, clashing, documents, words
from tidemark.llm import near_dedup
from tidemark.llm.components import components
from tidemark.llm.near_dedup import NearDedup


def brute_classes(rows, size=5, share=0.8):
    """Smallest id of each document's class, from all pairs with a common shingle."""
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)]))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = {}
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in places.get(g, ()))
        for j, n in both.items():
            if n >= share * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            places.setdefault(g, []).append(i)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(i)
    return list(classes.values())


def check(out, rows):
    want = Counter()
    for members in brute_classes(rows):
        ids = [rows[i][0] for i in members]
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, min(known) if known else None, len(ids))] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in out) == want
    kept = Counter((r.class_id, r.class_size) for r in out if r.kept)
    sizes = Counter((r.class_id, r.class_size) for r in out)
    assert all(kept[k] * k[1] == n for k, n in sizes.items())


def corpus(seed=1):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        base = [word() for _ in range(random.randrange(20, 120))]
        rows.append(base)
        for _ in range(random.randrange(4)):
            copy = list(random.choice(rows[-3:]))
            for _ in range(random.randrange(1, 6)):
                copy[random.randrange(len(copy))] = word()
            rows.append(copy)
    # Documents that share a passage but are not alike.
    rows += [passage + [word() for _ in range(50)] for _ in range(120)]
    return [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(rows)]


@pytest.mark.parametrize("options", [NearDedup(), NearDedup(few=0, tries=1), NearDedup(few=0, tries=1, stray_block=2, member_block=3)])
def test_classes_match_all_pairs(spark, options):
    rows = corpus()
    check(near_dedup.near_classes(documents(spark, rows), options).collect(), rows)


def test_chains_across_a_bucket_are_found(spark):
    """Each text is like the next one only: the first of a bucket is not like most of it."""
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w[i * 5:i * 5 + 60]), "en", "a", 1) for i in range(40)]
    out = near_dedup.near_classes(documents(spark, rows), replace(NearDedup(), few=1, tries=1)).collect()
    check(out, rows)
    assert {r.class_id for r in out} == {0}


def test_awkward_documents(spark):
    docs = clashing(documents(spark), "class_id", "kept", "node")
    check(near_dedup.near_classes(docs).collect(), AWKWARD)
    left = near_dedup.drop_near(docs)
    assert left.columns == docs.columns
    # Of the classes {1,2,3}, {4,5} and {9}, {10,10} the smallest ids stay.
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 4, 6, 7, 8, 9, 10, 10, 11, 12]


def test_empty_table(spark):
    assert near_dedup.near_classes(documents(spark, [])).count() == 0
    assert near_dedup.drop_near(documents(spark, [])).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_the_weighted_similarity(weighted):
    rng = np.random.default_rng(3)
    items = rng.integers(1, 2**62, 300).astype(np.uint64)
    a = rng.integers(1, 20, 300).astype(float) if weighted else np.ones(300)
    b = np.where(np.arange(300) < 200, np.maximum(a - 3, 1), 0) if weighted else (np.arange(300) < 240) * 1.0
    has = b > 0
    table = near_dedup.dart_signatures(
        np.concatenate([items, items[has]]), np.concatenate([a, b[has]]),
        np.concatenate([np.zeros(300, int), np.ones(has.sum(), int)]), 3, 4000,
    )
    similarity = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((table[0] == table[1]).mean() - similarity) < 0.035
    assert len(set(table[0])) > 200 and (table[2] == near_dedup.mix(np.zeros(1, np.uint64))).all()


def test_signature_does_not_depend_on_the_batch():
    items = np.arange(1, 50, dtype=np.uint64)
    alone = near_dedup.dart_signatures(items, np.ones(49), np.zeros(49, int), 1, 160)
    big = np.arange(1000, 9000, dtype=np.uint64)
    both = near_dedup.dart_signatures(
        np.concatenate([big, items]), np.ones(8049), np.repeat([0, 1], [8000, 49]), 2, 160
    )
    assert (alone[0] == both[1]).all()


def test_components(spark):
    random.seed(7)
    edges = [(f"n{random.randrange(300):03}", f"n{random.randrange(300):03}") for _ in range(220)]
    edges += [(f"z{i:03}", f"z{i + 1:03}") for i in range(60)] + [("n000", f"y{i}") for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 60])
def test_components_of_many_chunks(spark, chunk, no_broadcast):
    """Paths, in order and not, a hub and cycles, joined a few edges at a time."""
    random.seed(11)
    path = random.sample(range(80), 80)
    edges = [(f"p{a:03}", f"p{b:03}") for a, b in zip(path, path[1:])]
    edges += [(f"z{i:03}", f"z{i + 1:03}") for i in range(40)]
    edges += [("n000", f"n{i:03}") for i in range(1, 60)] + [("n030", "z020")]
    edges += [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] * 2 + [("c0", "c0")]
    rows = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.root for r in components(rows, chunk).collect()}
    assert got == {x: {"p": "p000", "z": "n000", "n": "n000", "c": "c0"}[x[0]] for e in edges for x in e}


def test_components_of_few_edges_take_no_rounds(spark):
    """A dozen stages at most however long the path, not several shuffles for every halving of it."""
    edges = spark.createDataFrame([(f"z{i:03}", f"z{i + 1:03}") for i in range(500)], "a string, b string")
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    assert {r.root for r in components(edges).collect()} == {"z000"}
    stages = [s for j in context.statusTracker().getJobIdsForGroup("few edges")
              for s in context.statusTracker().getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(stages)) <= 12
