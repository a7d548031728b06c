"""Vector codes and hard negatives against brute force in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np

from folioscope.llm import hard_negatives as h
from folioscope.llm import pivot_index as index
from folioscope.llm import vector_codes as c
from tests.llm.cases import rows_of, table

SCHEMA = "vec_id long, embedding array<float>, label int, v string, pivot string, uid string, query string, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def whole(rows, scale):
    return [(i, [math.floor(scale * float(np.float32(y))) for y in x], l) for i, x, l in rows if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x)]


def held(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def brute_negatives(rows, positives=5, negatives=10, every=100):
    good = [(i, x, (l + 1) % 10 if i % 7 == 0 else l) for i, x, l in whole(rows, 256) if l is not None]
    out = []
    for at, (anchor, q, label) in enumerate(good):
        if anchor % every:
            continue
        scored = sorted((-held(sum(a * b for a, b in zip(q, x))), i, l) for other, (i, x, l) in enumerate(good) if other != at and len(x) == len(q))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(j, -n) for n, j, l in scored if l != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(anchor, i, rank, j, -p, n) for rank, (j, n) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = sorted(whole(rows, 256), key=lambda r: (r[0], r[1]))
    width = -(-max((len(x) for _, x, _ in good), default=0) // parts)
    cut = [[tuple((x + [0] * (parts * width - len(x)))[p * width : (p + 1) * width]) for p in range(parts)] for _, x, _ in good]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[nearest(p, x[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, codes in zip(cut, chosen) if codes[p] == k]
                if own:
                    books[p][k] = tuple(sum(y) // len(own) for y in zip(*own))
    final = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    errors = [held(sum(e for e, _ in f)) for f in final]
    by_label = {}
    for (_, _, label), e in zip(good, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(y) for p in books for e in p for y in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, held(by_label[label]), digest) for (i, _, label), f, e in zip(good, final, errors))


ODD = [
    (None, [1.0] * 4, 1), (-100, None, 1), (-101, [None] * 4, 1), (-102, [float("nan"), 0.0, 0.0, 0.0], 2), (-103, [float("inf"), 0.0, 0.0, 0.0], 2),
    (-104, [0.0] * 4, None), (-105, [0.0] * 4, 3), (-200, [0.0] * 4, 3), (-300, [0.5] * 4, 4), (-300, [0.5] * 4, 4), (-301, [0.5] * 4, 4), (-307, [0.5] * 4, 4),
]


def clusters(n, width=4, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(10)]
    return [(i, [x + rng.gauss(0, 0.3) for x in centres[k]], k if i % 50 else None) for i in range(1, n) for k in [rng.randrange(10)]]


def test_negatives_of_the_table(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = rows_of(h.hard_negatives(vectors))
    assert found and found == brute_negatives([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])


def test_negatives_of_clusters_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)
    monkeypatch.setattr(index, "QUERIES", 2)
    monkeypatch.setattr(index, "SAMPLE", 40)
    monkeypatch.setattr(index, "LISTED", 1)  # several salts for each pivot
    monkeypatch.setattr(index, "PIVOTS", 5)
    rows = clusters(700) + [(1000 + i, [0.25, 0.5, -0.25, 0.125], i % 3) for i in range(120)]  # ties
    rows += ODD + [rows[4], rows[4], (1100, [0.25, 0.5, -0.25, 0.125], 0), (2300, [1.0, 2.0], 1), (2301, [1.0, 3.0], 1), (2302, [0.5, 1.0], 2), (2400, [], 1), (2401, [], 2), (2403, [], 1)]
    rows += [(2500, [3e30] * 3, 1), (2501, [1e30] * 3, 1), (2503, [1e-12] * 3, 2), (2504, [2e30] * 3, 2)]
    found = rows_of(h.hard_negatives(vectors(spark, rows).repartition(5)))
    assert found == brute_negatives(rows)
    assert {len([r for r in found if r[:2] == k]) for k in {r[:2] for r in found}} > {10}


def test_inner_and_far_annuli_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 32)
    monkeypatch.setattr(index, "SAMPLE", 200)
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    centres = rng.normal(size=(40, 16))
    at = rng.integers(0, 40, 3000)
    rows = [(i, x, int(k) % 10) for i, (x, k) in enumerate(zip(unit(centres[at] + 0.05 * rng.normal(size=(3000, 16))), at))]
    shares = []
    assert rows_of(h.hard_negatives(vectors(spark, rows), shares=shares)) == brute_negatives(rows)
    assert shares[0] < 0.25 and shares[1] < 0.95


def test_negatives_of_few_and_none(spark):
    assert h.hard_negatives(vectors(spark, [])).collect() == []
    assert h.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []
    assert h.hard_negatives(vectors(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 2)])).collect() == []
    assert rows_of(h.hard_negatives(vectors(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]))) == [(100, 1, 1, 2, 65536, 32768)]


def test_codes_of_the_table(spark, sf):
    vectors = table(spark, sf, "embeddings")
    assert rows_of(c.code_report(vectors)) == brute_codes([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])


def test_codes_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "ROWS", 7)
    rows = clusters(150, width=32) + ODD + [(2400, [], 1), (2300, [1.0] * 33, 1), (5, [0.5] * 32, 7), (5, [0.25] * 32, 7)]
    assert rows_of(c.code_report(vectors(spark, rows).repartition(5))) == brute_codes(rows)


def test_codes_of_huge_components(spark):
    rows = clusters(90, width=16) + [(-5, [3e38] * 16, 1), (-6, [-3e38] * 16, 1), (1000, [1e20] * 16, 2), (1001, [1e9] * 16, 2)]
    assert rows_of(c.code_report(vectors(spark, rows).repartition(3))) == brute_codes(rows)


def test_codes_of_few_and_none(spark):
    assert c.code_report(vectors(spark, [])).collect() == []
    for rows in ([(1, [], 1)], [(3, [0.1, -0.1], None)], ODD):
        assert rows_of(c.code_report(vectors(spark, rows))) == brute_codes(rows)
