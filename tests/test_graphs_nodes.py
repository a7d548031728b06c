"""Node rows, deep merge, quarantine and stored graphs against the standard library and plain Python."""

import glob
import json
import os
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from folioscope.operators import deep_merge, graph, nodes, quarantine, stats
from folioscope.sources import graph_store
from folioscope.sources.tables import shared_path


def tree(rng, depth=0):
    tag = rng.choice(["sec", "p", "title", "x:b"])
    given = "".join(f' {k}="{rng.choice("xy")}"' for k in ("id", "kind") if rng.random() < 0.4)
    inside = "".join(rng.choice([f"w{rng.randrange(9)} ", " ", "z&amp;", "é"]) if rng.random() < 0.4 or depth > 4 else tree(rng, depth + 1) for _ in range(rng.randrange(4)))
    return f"<{tag}{given}>{inside}</{tag}>"


def text_of(e):
    return " ".join(" ".join(x.split()) for x in e.itertext() if x.strip())


PATTERNS = [".//sec", ".//sec/title", "body/sec", ".//sec[@id]//p", './/sec[@id="x"]/p', ".//p[b]", './/*[@kind="y"]/b', "body//title", './/sec[title]/p[@id="y"]', "back/*", "./body/sec//sec/p", ".//body//b"]


def test_patterns_against_the_standard_library(spark):
    rng = random.Random(5)
    docs = [(i, f"<!DOCTYPE article><article><body>{tree(rng)}{tree(rng)}</body><back>{tree(rng)}</back></article>".replace("<x:b", "<b").replace("</x:b", "</b"), "clash") for i in range(40)]
    docs += [(100, None, "x"), (101, " ", "x"), (102, "<a><b></a>", "x"), (103, "<a/>", "x"), (None, "<article><body><sec><title>null id</title></sec></body></article>", "x"), (1, None, "x")]
    rows = nodes.shred(spark.createDataFrame(docs, "id int, xml string, path string"), "id", "xml")
    rows.write.parquet(path := shared_path(spark, "nodes"))
    rows = spark.read.parquet(path)
    found = {}
    for r in nodes.by_patterns(rows, {p: p for p in PATTERNS} | {"kinds": ".//sec"}, {"kinds": "kind"}).orderBy("doc", "field", "pos").collect():
        found.setdefault((r.doc, r.field), []).append(r.value)
    for i, xml, _ in docs[:40]:
        root = ET.fromstring(xml.replace("<!DOCTYPE article>", ""))
        place = {e: n for n, e in enumerate(root.iter())}
        for p in PATTERNS:
            assert found.get((i, p), []) == [text_of(e) for e in sorted(set(root.findall(p)), key=place.get)], p
        assert found.get((i, "kinds"), []) == [e.get("kind") for e in root.findall(".//sec")]
    assert found[None, ".//sec/title"] == ["null id"]
    assert sorted(r.doc for r in rows.where("error is not null").collect()) == [1, 100, 101, 102]
    assert nodes.by_patterns(rows, {"a": ".//sec"}, first_only=True).groupBy("doc").count().where("count > 1").isEmpty()
    assert nodes.by_patterns(rows.where("false"), {"a": ".//sec[b]/p"}).collect() == []
    for bad in ("sec[", "sec[1]", "a/b[c='d']", "/a//"):
        with pytest.raises(ValueError):
            nodes.steps(bad)


def test_sections_leave_inner_ones_out(spark):
    xml = "<article><front><sec><title>no</title></sec></front><body><p>loose</p><sec><title>A</title><p>one <b>two</b></p><sec><p>in</p><sec><title>C</title></sec></sec><p>three</p></sec></body></article>"
    rows = nodes.shred(spark.createDataFrame([("d", xml)], "id string, xml string"), "id", "xml")
    assert [(r.pos, r.title, r.content) for r in nodes.sections(rows).orderBy("pos").collect()] == [(0, "A", "one two three"), (1, None, "in"), (2, "C", "")]


def merge(a, b):
    return {k: merge(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b[k] if k in b else a[k] for k in {**a, **b}}


def value(rng, depth=0):
    kinds = [None, 1, "t\"e,x:t", [1, {"a": 2}], True, {}, 2.5, "é\\"]
    return {rng.choice("abc.\""): value(rng, depth + 1) for _ in range(rng.randint(0, 3))} if depth < 4 and rng.random() < 0.6 else rng.choice(kinds)


def test_deep_merge_against_recursion(spark):
    rng = random.Random(6)
    rows = [(i, n, json.dumps(v if isinstance(v := value(rng), dict) else {"a": v})) for i in range(150) for n in range(rng.randint(1, 4))]
    odd = [(1000, 0, "broken"), (1001, 0, "[1]"), (1002, 0, None), (1003, 0, ""), (None, 0, '{"a":1}'), (1004, 0, "{}"), (1005, 1, "broken"), (1005, 0, '{"a":{}}')]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "id int, seq int, json string, path string")
    found = {r.id: json.loads(r.json) for r in deep_merge.merged(df).collect()}
    expected = {1004: {}, 1005: {"a": {}}}
    for i, _, text in sorted(rows):
        expected[i] = merge(expected.get(i, {}), json.loads(text))
    assert found == expected
    assert deep_merge.merged(df.where("false")).collect() == []


def test_quarantine_of_tables_and_streams(spark):
    texts = [None, " ", "{", "1", "{}", '{"id":null}', '{"id":" "}', '{"id":5}', '{"id":"a","x":[1]}', '{"id":5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, json string")
    path = shared_path(spark, "quarantine")
    assert quarantine.set_apart(df, path) == {"records": 10, "null": 1, "empty": 1, "no json": 1, "no object": 1, "no fields": 1, "no id": 2}
    assert sorted(r.n for r in spark.read.parquet(path).where("quarantined = 'false'").collect()) == [7, 8, 9]
    assert quarantine.set_apart(df.where("false"), shared_path(spark, "quarantine"))["records"] == 0
    landed, out, marks = (shared_path(spark, n) for n in ("landed", "out", "marks"))
    for part in (df.where("n < 5"), df.where("n >= 5")):
        part.write.mode("append").parquet(landed)
        quarantine.stream_apart(spark.readStream.schema(df.schema).parquet(landed), out, marks).awaitTermination()
    found = spark.read.parquet(out)
    assert sorted((r.n, r.fault) for r in found.collect()) == sorted((r.n, r.fault) for r in quarantine.with_faults(df).collect()) and found.select("batch").distinct().count() == 2


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*graph.COLUMNS).collect()), key=str)


def files(path):
    return {f: (os.path.getmtime(f), os.path.getsize(f)) for f in glob.glob(path.removeprefix("file://") + "/bucket=*/*.parquet")}


def test_increments_equal_a_full_build_and_leave_files(spark):
    facts = [(f"s{i % 30}", f"p{i % 3}", f"o{i}", "literal", None if i % 2 else "t", "g") for i in range(200)]
    df = lambda part: spark.createDataFrame(part, graph_store.SCHEMA)
    path = shared_path(spark, "graph")
    graph_store.store(df(facts[:100]), path, 8)
    before = files(path)
    graph_store.add(df(facts[50:150]), path, 8)
    grown = graph_store.add(df(facts[150:] + facts[:20] + facts[150:]), path, 8)
    assert rows_of(graph_store.stored(spark, path)) == rows_of(df(facts)) and grown
    assert before.items() <= files(path).items()
    settled = files(path)
    assert graph_store.add(df(facts), path, 8) == [] and files(path) == settled  # again: nothing
    assert graph_store.add(df([("s1", "p", "new", "iri", None, "g")]), path, 8) == [r.bucket for r in graph_store.stored(spark, path).where("o = 'new'").collect()]
    assert graph_store.add(df([]), path, 8) == []


def test_turtle_reads_back(spark):
    odd = ['quote " and \\ and\nlines\r\ttab', "", "ends \\", "é 北京 👩", "a ; b . c", '"^^<x>', "@prefix x: <y> ."]
    rows = [(f"{graph.BASE}paper/{i}", graph.iri("dcterms:title"), t, "literal", graph.iri("xsd:string") if i % 2 else None, "g1") for i, t in enumerate(odd)]
    rows += [("http://x/odd <>\"{}|^`\\ name", "http://x/p#q", "http://x/ space", "iri", None, "g2"), (graph.iri("foaf:Person"), graph.iri("rdf:type"), graph.iri("kg:9no"), "iri", None, "g2")]
    rows += [("http://hot", f"http://p/{i % 7}", f"v{i}", "literal", graph.iri("xsd:string"), "g1") for i in range(500)]  # one subject with many rows
    df = spark.createDataFrame(rows, graph_store.SCHEMA)
    for parts in (1, 3, 7):
        path = shared_path(spark, "turtle")
        graph_store.write_turtle(df, path, parts)
        assert rows_of(graph_store.read_turtle(spark, path)) == rows_of(df)
    path = shared_path(spark, "turtle")
    graph_store.write_turtle(df.where("false"), path)
    assert graph_store.read_turtle(spark, path).collect() == []


def test_kinds_of_graphs(spark):
    made = lambda s, p, o, kind="iri": (s, p, o, kind, None, "g")
    rows = [made("a", graph.iri("rdf:type"), graph.iri("foaf:Person")), made("a", "n", "x", "literal"), made("t", graph.iri("rdf:type"), graph.iri("bibo:Table")), made("t", "n", "y", "literal"), made("u", "n", "z", "literal")]
    df = spark.createDataFrame(rows, graph_store.SCHEMA)
    assert {r.s for r in graph_store.by_kind(df, "content").collect()} == {"t"} and {r.s for r in graph_store.by_kind(df, "metadata").collect()} == {"a", "u"}
    assert rows_of(graph_store.by_kind(df, "complete")) == rows_of(df)


def test_emitted_is_one_scan_and_one_exchange(spark, sf):
    from folioscope.plans.services import QUERIES

    for name in ("reference_triples", "heading_triples", "annotation_triples", "organisation_triples"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, name


def test_licences(spark):
    expected = {
        "cc-by": "CC-BY", " CC-BY 4.0 ": "CC-BY", "CC-BY-SA": "CC-BY", "cc-by-nc": "CC-BY-NC", "cc-by-nc-sa 4.0": "CC-BY-NC", "cc-by-nc-nd": "CC-BY-NC-ND", "cc-by-nd": "CC-BY-ND", "cc0 1.0": "CC0", "pd": "Public Domain",
        "In the public domain": "Public Domain", "Publisher terms": "Publisher", "copyright X": "Publisher", "open access and free": "Open Access", "creative commons": "Creative Commons (other)", "odd": "odd", " ": "Unknown", "cc-by and more": "CC-BY",
    }
    df = spark.createDataFrame([(k,) for k in expected], "l string")
    assert {r.l: r.c for r in df.select("l", stats.normalized_license(F.col("l")).alias("c")).collect()} == expected
