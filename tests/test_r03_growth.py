"""Findings of round 3 on growth: what is parsed, joined or written once."""

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from folioscope.operators import deep_merge, graph, search_entities
from folioscope.plans import mined
from folioscope.sources import graph_store
from folioscope.sources.tables import cut, shared_path


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_and_affiliations_are_parsed_once(spark):
    told = '{"authorAffiliationDetailsList":{"authorAffiliation":[%s]}}'
    one, two, none = '{"affiliation":"Uni A, Rome, Italy"}', '{"affiliation":"94103"}', '{"affiliation":""},{}'
    rows = [(1, '{"authorList":{"author":[' + ",".join([told % f"{one},{two}", told % none, "{}", told % one]) + "]}}"), (2, '{"authorList":{"author":[' + told % f"{none},{one}" + "]}}"), (3, "{}"), (4, None), (5, '{"authorList":{"author":[]}}')]
    found = search_entities.records(spark.createDataFrame(rows, "id int, json string").repartition(2))
    people = search_entities.authors(found)
    made = search_entities.institutions(people)
    assert sorted(tuple(r) for r in made.collect()) == [(i, p, n, "Uni A, Rome, Italy", "Uni A", "Rome", None, None, "Italy") for i, p, n in ((1, 0, 0), (1, 3, 0), (2, 0, 0))]
    for df in (people.select("id", "affiliations"), search_entities.headings(found).select("id", "major"), search_entities.grants(found).select("id", "agency"), search_entities.keywords(found)):
        assert optimized(df).count("from_json(") <= 2  # two where a record is parsed for two of its fields
    assert optimized(made).count("split(coalesce(") == 1
    assert [r.pos for r in people.where("id = 1").orderBy("pos").collect()] == [0, 1, 2, 3]


def test_merging_writes_once_for_some_levels(spark, monkeypatch):
    written = []
    monkeypatch.setattr(deep_merge, "cut", lambda df, name="loop": written.append(name) or cut(df, name))
    rows = [(1, 0, '{"b":{"c":{"x y":1}},"a":2}'), (1, 2, '{"b":{"c":{"z":[{}]}}}'), (1, 1, '{"b":{"c":7}}'), (2, 0, '{"a":{"b":1}}'), (2, 1, '{"a":{}}'), (3, 0, '{"a":{"b":1}}'), (3, 1, '{"a":null}'), (3, 2, '{"a":{}}'), (4, None, '{"a":1}'), (5, 0, "{}"), (6, 0, "x")]
    df = spark.createDataFrame(rows, "id int, seq int, json string")
    expected = {1: '{"a":2,"b":{"c":{"z":[{}]}}}', 2: '{"a":{"b":1}}', 3: '{"a":{}}', 4: '{"a":1}', 5: "{}"}
    made = deep_merge.merged(df)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.id: r.json for r in made.collect()} == expected and len(written) == 1
    deep = '{"k\\"":' * 11 + "1" + "}" * 11
    assert [r.json for r in deep_merge.merged(spark.createDataFrame([(1, 0, deep)], df.schema)).collect()] == [deep] and len(written) == 4


def test_a_growing_graph_makes_papers_once_and_meets_by_one_exchange(spark, sf, monkeypatch):
    plans = []
    written = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or written(self, *a, **b))
    found = mined.grown_graph(spark, sf)
    assert sum("lineitem.parquet" in p for p in plans) == 1
    assert [p.count("Exchange hashpartitioning") for p in plans if "lineitem.parquet" not in p] == [1, 1, 1]
    papers = mined.view(spark, sf, "papers").where("id % 3 <> 0 or id % 6 <> 1 or id % 2 = 1")
    expected = graph.paper_triples(papers)
    assert sorted(map(str, found.select(*graph.COLUMNS).collect())) == sorted(map(str, expected.collect()))


def test_rows_of_facts_grow_a_graph_of_other_kinds(spark):
    kinds = (("p", "literal", "t", "g"), ("q", "literal", None, "g"))
    other = [("a", "p", "1", "iri", "t", "g"), ("a", "p", "1", "literal", "t", "h"), ("a", "r", None, "literal", None, "g"), ("b", "q", "2", "literal", None, "g"), (None, "q", "2", "literal", None, "g")]
    path = shared_path(spark, "graph")
    graph_store.store(spark.createDataFrame(other + other, graph_store.SCHEMA), path, 4)

    def facts(row):
        none = F.lit(None).cast("struct<p:string,o_kind:string,o_datatype:string,g:string>")
        return F.array(*(F.when(row[c].isNotNull(), F.struct(F.lit(i).alias("k"), row[c].alias("o"), none.alias("kind"))) for i, c in enumerate("xy")))

    told = [("a", "1", None), ("a", "1", "2"), ("b", None, "2"), ("c", None, None), *(("hot", str(i % 50), str(i % 3)) for i in range(500))]
    rows = cut(spark.createDataFrame(told, "s string, x string, y string")).select("s", F.struct("x", "y").alias("row"))
    made = {(s, "p", x, "literal", "t", "g") for s, x, _ in told if x} | {(s, "q", y, "literal", None, "g") for s, _, y in told if y}
    assert graph_store.add(rows, path, 4, kinds, facts)
    assert sorted(map(str, (tuple(r) for r in graph_store.stored(spark, path).select(*graph.COLUMNS).collect()))) == sorted(map(str, made | set(other)))
    assert graph_store.add(rows, path, 4, kinds, facts) == []
