from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, clashing, documents, words
from tidemark.llm import mixing

WEIGHTS = (5, 2, 1)


def rows(n=900):
    text = lambda i: " ".join(f"w{j}" for j in range(i * 7 % 90))
    return [(i, text(i), "en", None if i % 9 == 8 else f"s{0 if i % 3 else i % 7}", 1) for i in range(n)]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * weight[s] / w for s in left}}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_taken_words(spark):
    data = rows()
    sizes = defaultdict(int)
    for _, text, _, source, _ in data:
        sizes[source] += len(words(text))
    out = mixing.mix_report(documents(spark, data)).collect()
    assert len(out) == len(data)
    want, taken = brute_targets(sizes), defaultdict(int)
    of = {d[0]: d[3] for d in data}
    for r in out:
        assert r.size == len(words(data[r.doc_id][1])) and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 and r.source_size == sizes[of[r.doc_id]]
        taken[of[r.doc_id]] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.01 * target + 32
    again = {r.doc_id: r.taken for r in mixing.mix_report(documents(spark, data).repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_documents_carry_the_words_taken(spark):
    docs = documents(spark, rows())
    report = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    original = {r[0]: words(r[1]) for r in rows()}
    for r in mixed.collect():
        w = words(r.text)
        got[r.doc_id] += len(w)
        assert r.n_chars == len(r.text)
        whole = original[r.doc_id]
        assert any(whole[i:i + len(w)] == w for i in range(len(whole) - len(w) + 1))
    assert {k: v for k, v in report.items() if v} == dict(got)


def test_pieces_keep_their_white_space(spark):
    text = "\t a  b\nc \x0b d\r\n e "
    docs = documents(spark, [(i, text, "en", "s", 1) for i in range(40)])
    mix = mixing.Mix(budget=0.55, block=3)
    for r in mixing.mix_documents(docs, mix).collect():
        assert r.text == text or r.text in text and r.text.strip() == r.text


def test_apportionment_is_sainte_lague(spark):
    sizes = [97.6, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 3.0, 0.0]
    units = spark.createDataFrame([("g", i, x, 100) for i, x in enumerate(sizes)], "g string, u int, w double, seats int")
    got = {r.u: r.quota for r in mixing.apportion(units, ["g"], "u", "w", "seats").collect()}
    want = defaultdict(int)
    for _ in range(100):
        want[max(range(len(sizes)), key=lambda i: (sizes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == {i: want[i] for i in range(len(sizes))}


def test_awkward_and_empty(spark):
    docs = clashing(documents(spark, AWKWARD), "size", "taken", "target")
    assert mixing.mix_report(docs).count() == len(AWKWARD)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    silent = documents(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])
    assert {r.taken for r in mixing.mix_report(silent).collect()} == {0}
    assert mixing.mix_documents(silent).where(F.col("text").isNotNull()).count() == 0
