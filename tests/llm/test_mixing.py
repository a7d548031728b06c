"""Mixing: targets, sums, bounds and reruns."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing as x
from tests.llm.cases import TEXTS, documents, rows_of, table


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(sizes, share=1.5, most=2):
    """Targets of {source: words} by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    out, budget, open_names = {}, share * sum(sizes.values()), set(names)
    while open_names:
        total = sum(weight[s] for s in open_names)
        above = [s for s in open_names if weight[s] / total * budget > most * sizes[s]]
        if not above:
            return out | {s: weight[s] / total * budget for s in open_names}
        for s in above:
            out[s] = most * sizes[s]
            budget -= out[s]
            open_names.remove(s)
    return out


def checked(df, docs, near=None):
    """The report fits the rows and the brute-force targets, and each source comes near its own."""
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
    goal = targets(dict(sizes))
    found = df.collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r.doc_id, words(r.text)) for r in rows)
    source_of = {(r.doc_id, words(r.text)): r.source for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= (largest[s] if near is None else near * max(1, goal[s])), s


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    checked(x.mix_report(docs), docs)


def test_reruns_agree(spark, sf):
    docs = table(spark, sf, "documents")
    assert rows_of(x.mix_report(docs)) == rows_of(x.mix_report(docs.repartition(7).orderBy(F.rand(3))))


def test_rows_of_one_id_with_equal_words(spark):
    """Two rows of size 10 and one of size 20 share id, source and words, and are drawn apart: reruns agree."""
    texts = [t for k in range(40) for t in ("w " * 10, "w " * 10, "w " * 20)]
    docs = documents(spark, texts, ids=[k // 3 for k in range(120)], sources=("s",))
    first = rows_of(x.mix_report(docs))
    assert len(first) == 120 and len({r[:2] for r in first}) == 80
    assert all(rows_of(x.mix_report(docs.repartition(n).orderBy(F.rand(n)))) == first for n in (3, 5))


def test_hot_source_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(x.round_fractions, "__defaults__", (x.SEED, 20, 3, x.LARGE))
    rng = random.Random(2)
    texts = ["w " * rng.choice([1, 2, 5, 9, 30, 400]) for _ in range(900)]
    sources = [rng.choice(["hot"] * 8 + ["é", "Z", "a", None]) for _ in texts]
    rows = [(i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    checked(x.mix_report(docs), docs, near=0.05)


def test_edges(spark):
    docs = documents(spark, extra=True)
    checked(x.mix_report(docs), docs)
    assert x.mix_report(documents(spark, [])).collect() == []
    blank = documents(spark, [None, "", " "])
    assert [(r.size, r.taken) for r in x.mix_report(blank).collect()] == [(0, 0)] * 3
    repeated = documents(spark, ["a b"] * 4 + ["c"], ids=[None, None, 3, 3, 3], sources=("s",))
    assert [r[0] for r in rows_of(x.mix_report(repeated))] == [None, None, 3, 3, 3]


def test_mix_takes_what_the_report_says(spark):
    docs = documents(spark, [f"{'w ' * (i % 9)}x{i}" for i in range(60)] + TEXTS, extra=True)
    out = x.mix(docs)
    assert out.schema == docs.schema
    taken = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert {r.doc_id: taken[r.doc_id] for r in out.select("doc_id").distinct().collect()} == dict(taken)
    for r in x.mix_report(docs).collect():
        assert r.size == 0 or r.taken == r.size * taken[r.doc_id]
    assert x.mix(documents(spark, [])).collect() == []


def test_rounding_keeps_expectations():
    ups = Counter()
    for seed in range(400):
        done, held = x.pair_off([(i, 10, 0.3) for i in range(10)], seed)
        total = sum(w * u for _, w, u in done) + (held[1] * held[2] if held else 0)
        assert total == pytest.approx(30)
        for i, _, u in [*done, *([held] if held else [])]:
            ups[i] += u
    assert all(85 < ups[i] < 155 for i in range(10))


def test_word_count(spark):
    texts = TEXTS + ["a\x1fb\x85c d", "\x0b\x0c x"]
    found = documents(spark, texts).select("doc_id", x.word_count(F.col("text")).alias("n"))
    assert rows_of(found) == [(i, words(t)) for i, t in enumerate(texts, 1)]
