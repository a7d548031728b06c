"""The n-gram join against all pairs, and its index against random sets that link."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import ngram_join as j
from folioscope.llm.components import components
from tests.llm.cases import TEXTS, documents, rows_of, table


def shingles(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=3, num=90, den=100):
    """(id, set size, smallest id reachable by links) of rows (id, text)."""
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed, n=160, vocabulary=400, phrase=()):
    """Texts of 1 to 250 words with chains of copies that differ by some words."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 250]))]
        words[len(words) // 2 : len(words) // 2] = phrase
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(vocabulary)}"
    return texts[:n]


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100)])
def test_against_all_pairs(spark, words, num, den):
    texts = near_copies(words) + near_copies(words + 50, 60, 12) + near_copies(9, 60, 400, ["common"] * 3 + ["passage", "of", "many", "documents"] * 3)
    found = rows_of(j.near_duplicates(documents(spark, texts).repartition(5), words, num, den))
    assert found == brute(list(enumerate(texts, 1)), words, num, den)


def test_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(j.near_duplicates(docs)) == brute(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_SETS", 10)
    texts = near_copies(4, 120, 8) + near_copies(5, 80, 300)
    assert rows_of(j.near_duplicates(documents(spark, texts))) == brute(list(enumerate(texts, 1)))


@pytest.mark.parametrize("num,den", [(1, 3), (1, 10)])
def test_large_groups_of_far_sizes(spark, monkeypatch, num, den):
    """Sets of sizes at the very end of what may link, above the block size."""
    monkeypatch.setattr(j, "BLOCK_SETS", 4)
    words = [f"w{i}" for i in range(500)]
    sizes = sorted({min(500, max(1, n * den // num)) for n in (1, 3, 9, 27, 33, 50, 81, 100)} | {1, 3, 9, 27, 33, 50, 81, 100, 243, 300})
    texts = [" ".join(words[:n]) for n in sizes] + near_copies(5, 40, 60)
    assert rows_of(j.near_duplicates(documents(spark, texts), 1, num, den)) == brute(list(enumerate(texts, 1)), 1, num, den)


@pytest.mark.parametrize("num,den", [(1, 3), (1, 10), (4, 5), (90, 100), (99, 100), (1, 1)])
def test_classes_part_no_link(num, den):
    bounds = j.class_bounds(num, den, 300_000)
    if num == den:
        assert bounds == []
        return
    at = np.searchsorted(bounds, np.arange(1, 200_001), "right")
    largest = np.minimum(np.arange(1, 200_001) * den // num, 200_000)
    assert (at[largest - 1] - at <= 1).all() and (np.diff(bounds) > 0).all()


def test_edges(spark):
    found = rows_of(j.near_duplicates(documents(spark, extra=True)))
    assert found == brute(list(enumerate(TEXTS, 1)))
    assert j.near_duplicates(documents(spark, [])).collect() == []
    repeated = documents(spark, ["a b c d", "a b c d", "a b c d", None, None], ids=[3, 3, None, None, 4])
    assert rows_of(j.near_duplicates(repeated)) == [(None, 0, None), (None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)]


def test_keep_one(spark):
    docs = documents(spark, ["a b c d", "A b c d", "other", None, "", "a b c d", "b", "c"], ids=[5, 2, 9, 7, 7, None, 2, None], extra=True)
    kept = j.keep_one(docs, 3, 90, 100)
    assert kept.schema == docs.schema
    assert rows_of(kept, "doc_id", "text") == [(None, "c"), (2, "A b c d"), (2, "b"), (7, None), (7, ""), (9, "other")]
    shared = documents(spark, ["a", "a", "b", "c", "d", "a", "a"], ids=[1, 2, 2, 3, 3, None, None])
    assert rows_of(j.keep_one(shared, 3, 90, 100), "doc_id", "text") == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]
    assert rows_of(j.keep_one(documents(spark, ["a"] * 3 + ["b"] * 2, ids=[None, None, None, 4, 4]), 3, 90, 100), "doc_id", "text") == [(None, "a"), (4, "b")]
    assert j.keep_one(documents(spark, []), 5, 80, 100).collect() == []


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (95, 100)])
def test_linked_sets_share_a_key(num, den):
    rng = np.random.default_rng(num)
    checked = 0
    for n in [1, 2, 3, 4, 6, 9, 10, 11, 15, 20, 25, 33, 40, 60, 100, 150, 300, 900]:
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            frequent = np.sort(rng.choice(base, rng.integers(0, len(base) + 1), replace=False))
            most = len(base) * (den - num) // num + 1
            removed, added = rng.integers(0, most + 1), rng.integers(0, most + 1)
            other = np.unique(np.concatenate([rng.permutation(base)[removed:], rng.integers(0, 1 << 64, added, np.uint64)]))
            common = len(np.intersect1d(base, other))
            if not np.array_equal(base, other) and common and j.linked(len(base), len(other), common, num, den):
                checked += 1
                assert len(np.intersect1d(j.index_keys(base, num, den, frequent), j.index_keys(other, num, den, frequent)))
    assert checked > 150


def test_bands_cover_all_sizes():
    found = j.bands(90, 100)
    assert all(a.high == b.low for a, b in zip(found, found[1:])) and found[0].low <= 10
    for b in found:
        assert b.segments + b.deleting - b.spare > (b.high - 1) * 10 // 90


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    links = path + [(100, 200 + i) for i in range(30)] + [(500, 501), (501, 500)]
    rng.shuffle(links)
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[n] for n in [100, *range(200, 230)]}) == 1
    assert len(set(found.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


class Caught:
    """Stands in for a table and keeps the function that would run in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        self.task = task
        return self


def test_index_task_keeps_nothing():
    texts = [" ".join(f"w{i}x{k}" for k in range(1000)) for i in range(150)]
    batches = [pa.record_batch([pa.array([i]), pa.array([t])], names=["id", "text"]) for i, t in enumerate(texts)]
    task = j.index_rows(Caught(), 5, 80, 100, np.zeros(0, np.uint64)).task
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in task(iter(batches))]
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert sum(sizes) > 10_000 and max(sizes) <= 1 << 16
    assert kept < 4 << 20  # the words alone take more than 20 MB in a table


def test_index_is_spread(spark):
    index = spark.createDataFrame([(1, 5, None), (1, 6, None), (6, 6, 5), (2, 7, None)], "key long, node long, hub long")
    links = j.candidate_links(index)
    assert rows_of(links) == [(5, 6)]
    parts = j.INDEX_SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.search(rf"hashpartitioning\(key#\d+L, {parts}\)", links._jdf.queryExecution().executedPlan().toString())


def test_chance_keys_do_not_chain(spark, monkeypatch):
    """Texts that share half of their words with the next one share keys by chance, but none links."""
    blocks = [" ".join(f"b{i}w{k}" for k in range(60)) for i in range(61)]
    texts = [f"{a} {b}" for a, b in zip(blocks, blocks[1:])]
    texts += [texts[3] + " more", texts[40] + " more"]
    compared = []
    links = j.exact_links
    monkeypatch.setattr(j, "exact_links", lambda groups, *a: compared.append(groups.select("node").distinct().count()) or links(groups, *a))
    assert rows_of(j.near_duplicates(documents(spark, texts), 5, 80, 100)) == brute(list(enumerate(texts, 1)), 5, 80, 100)
    assert compared == [4]


@pytest.mark.parametrize("crowd,star", [(1, 5_000), (32, 2)])
def test_crowds_and_large_stars(spark, monkeypatch, crowd, star):
    monkeypatch.setattr(j, "CROWD_SETS", crowd)
    monkeypatch.setattr(j, "STAR_SETS", star)
    texts = near_copies(11, 90, 8) + near_copies(12, 90, 300)
    assert rows_of(j.near_duplicates(documents(spark, texts).repartition(3), 5, 80, 100)) == brute(list(enumerate(texts, 1)), 5, 80, 100)


@pytest.mark.parametrize("num,den", [(1, 10), (1, 3), (80, 100), (90, 100), (1, 1)])
def test_sketches_part_no_link(num, den):
    rng = np.random.default_rng(den - num)
    linked = unlike = 0
    for n in [1, 2, 5, 9, 40, 63, 64, 65, 127, 128, 129, 300, 1100]:
        for _ in range(40):
            base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            removed, added = rng.integers(0, n + 1), rng.integers(0, n + 1) * int(rng.integers(0, 2))
            other = np.unique(np.concatenate([rng.permutation(base)[removed:], rng.integers(0, 1 << 64, added, np.uint64)]))
            common = len(np.intersect1d(base, other))
            a, b = (j.Sketched.of(i, len(x), j.sketch(x)) for i, x in enumerate((base, other)))
            if j.linked(len(base), len(other), common, num, den):
                linked += 1
                assert a.may_link(b, num, den) and b.may_link(a, num, den)
                assert j.parted([b, a], num, den) == [(0, 1)]
            unlike += not a.may_link(b, num, den)
    assert linked > 10 and unlike > 10
