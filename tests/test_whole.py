"""Queries on whole tables against brute force on a small fixture."""

import datetime
import random
from collections import Counter, defaultdict

import pytest

from folioscope.functions import text
from folioscope.plans import catalog
from folioscope.streaming import state

LINES = [(1, 10, 1), (1, 20, 2), (2, 20, 1), (2, 30, 2), (2, 10, 3), (3, 10, 1), (3, 20, 2), (3, 20, 3), (10, 40, 1), (10, 50, 2), (11, 30, 1), (13, 60, 1), (21, 50, 1), (21, 40, 2), (33, 40, 1), (33, 70, 2)]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(paper, author, author + paper % 2, place) for paper, author, place in LINES]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def pairs():
    links = set((p, a) for p, a, _ in LINES)
    return Counter((a, b) for p, a in links for q, b in links if p == q and a < b)


def degrees():
    return Counter(x for pair in pairs() for x in pair)


def test_network_of_all_papers(spark, lines):
    rows = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, lines).collect())
    found, degree = pairs(), degrees()
    assert rows("coauthor_pairs") == sorted((a, b, n) for (a, b), n in found.items())
    authors = {a for _, a, _ in LINES}
    assert rows("degree_centrality") == sorted((a, round(degree[a] / max(degree.values()), 4)) for a in authors)
    median = sorted(degree.values())[len(degree) // 2]
    assert rows("core_researchers") == sorted((a, n) for a, n in degree.items() if n >= max(median, 2))
    both = sorted([(a, b, n) for (a, b), n in found.items()] + [(b, a, n) for (a, b), n in found.items()])
    assert rows("collaboration_matrix") == both
    assert rows("research_groups") == [(10, 10), (20, 10), (30, 10), (40, 40), (50, 40), (70, 40)]
    end = lambda iri: int(iri.rsplit("/", 1)[1])
    assert sorted((end(s), end(o)) for s, _, o in rows("coauthor_edges")) == [(a, b) for a, b, _ in both]


def test_merged_authors_of_all_papers(spark, lines):
    seen, known = defaultdict(lambda: 99), {}
    for paper, author, place in LINES:
        who = (paper, author + paper % 2)
        seen[who] = min(seen[who], place)
    for paper in {p for p, _ in seen}:
        people = sorted((-(1 + (s % 2 == 0)), at, f"supplier {s}", s) for (p, s), at in seen.items() if p == paper)
        for i, (n, _, _, s) in enumerate(people, 1):
            known[paper, i] = (f"Supplier {s}", str(s) if s % 2 == 0 else None, f"Org {s}", -n)
    found = catalog.QUERIES["merge_authors"](spark, lines).collect()
    assert {(r.paper, r.place): (r.name, r.orcid, r.affiliation, r.n_sources) for r in found} == known and len(found) == len(known)


def test_fuzzy_scores_of_all_papers(spark):
    rows = [(1, "Big Data", "data big"), (2, "abc", "abd"), (3, "abc", "abd"), (50, "Heart of stone", "a heart"), (51, "x", ""), (52, None, "x"), (53, "x", None), (53, "x", None), (None, "x y", "y z")]
    normal = lambda t: (t or "").lower()
    found = catalog.fuzzy_scores(spark.createDataFrame(rows, "id long, title string, abstractText string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, round(text.token_set_score(normal(a), normal(b)), 4)) for i, a, b in rows), key=str)


def test_exact_cache_hits(spark):
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=rng.randrange(2000)), rng.choice([None, 1, 1, 1, 1, 2, 3])) for i in range(600)]
    rows += [(600, None, 1), (601, start + datetime.timedelta(seconds=5000), 4), (602, start + datetime.timedelta(seconds=5010), 4), (603, start + datetime.timedelta(seconds=5011), 4)]
    written, known = {}, {}
    for i, ts, key in sorted(rows, key=lambda r: (r[1] or start, r[0])):
        known[i] = ts is not None and key in written and (ts - written[key]).total_seconds() <= 10
        if ts is not None and not known[i]:
            written[key] = ts
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = state.exact_cache_hits(log, "user_id", 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.event_id: r.hit for r in found} == known and len(found) == len(rows)
    gaps = {r.event_id: r.hit for r in state.cache_hits(log, "user_id", 10).collect()}
    assert gaps != known and not known[603] and gaps[603]
