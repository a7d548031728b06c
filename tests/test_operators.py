"""Operators on small tables with results worked out by hand."""

import datetime
import json

import pytest

from folioscope.functions import affiliation, entities, identifiers, text
from folioscope.operators import dedupe, filters, flatten, fulltext, graph, merge, network, query_language as q, stats
from folioscope.sources import readers
from folioscope.streaming import state
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_identifiers(spark):
    assert column(spark, ["https://doi.org/10.1/AB", " 10.2/x ", "", None], identifiers.normalized_doi) == ["10.1/ab", "10.2/x", None, None]
    assert column(spark, ["https://orcid.org/0000-0001-2345-678x", "1234"], identifiers.orcid) == ["0000-0001-2345-678X", None]
    assert column(spark, ["pmc12", "77", "PMCx"], identifiers.pmcid) == ["PMC12", "PMC77", None]
    assert column(spark, ["289K", "2.8M", "2024-01-01", "12"], identifiers.file_size) == [289 * 1024, int(2.8 * (1 << 20)), None, None]
    assert column(spark, ["2001", "999", "x"], identifiers.year) == [2001, None, None]
    assert column(spark, ["2020-03-01", "3 Mar 2020", "soon"], identifiers.iso_date) == [datetime.date(2020, 3, 1), datetime.date(2020, 3, 3), None]
    assert column(spark, ["yes", "0", "maybe"], identifiers.boolean) == [True, False, None]
    assert column(spark, ["5", "5000", "x"], lambda c: identifiers.clamped_int(c, 25)) == [5, 1000, 25]


def test_affiliations(spark):
    assert column(spark, ["u.s.a.", "guinea-bissau", "england"], affiliation.normalized_country) == ["United States", "Guinea-Bissau", "United Kingdom"]
    assert column(spark, ["MIT me@x.org, Boston, USA", "Department of X, Y", "ab"], affiliation.institution_of) == ["MIT Boston", "X", ""]
    assert column(spark, ["12345", "K1A 0B1", "SW1A 1AA", "abc"], affiliation.is_postal_code) == [True, True, True, False]


def test_text(spark):
    assert column(spark, ["Été—2!", None, "plain  A"], text.normalized) == ["ete 2", None, "plain a"]
    assert column(spark, ["One. Two! Three"], lambda c: text.sentences(c)) == [["One.", "Two!", "Three"]]
    assert text.token_set_score("a b c", "b a") == 100.0
    assert text.token_set_score("", "a") == 0.0
    assert text.token_set_score("abc", "abd") == pytest.approx(200 * 2 / 6)


PAPERS = [(1, "A", "2001", "Y", 5, None, 0), (2, "a ", "", "N", 9, "", 1), (3, "B", "x", "Y", 1, "10.1/a", 2), (4, "B", "1990", "Y", 7, "10.1/a", 3), (5, None, None, "N", 0, None, 4)]


@pytest.fixture
def papers(spark):
    return spark.createDataFrame(PAPERS, "id int, title string, pubYear string, isOpenAccess string, citedByCount long, doi string, pos long").withColumns({"abstractText": F.lit("Heart study"), "pubType": F.lit("Review")})


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_dedupe(papers):
    assert ids(dedupe.remove_duplicates(papers, "title")) == [1, 3, 5]
    assert ids(dedupe.remove_duplicates(papers, "doi", "last")) == [2, 4, 5]
    assert ids(dedupe.remove_duplicates(papers, "title", "most_cited")) == [2, 4, 5]
    assert [r.positions for r in dedupe.duplicate_groups(papers, "doi").collect()] == [[2, 3]]
    with pytest.raises(ValueError):
        dedupe.remove_duplicates(papers, "colour")


def test_filters(papers):
    assert ids(filters.filter_papers(papers, 1, 2000, open_access=None)) == [1, 2]
    assert ids(filters.filter_papers(papers, 0, 1900, open_access="Y", abstract={"HEART"})) == [1, 4]
    assert ids(filters.filter_papers_or(papers, 0, 1900, open_access=None, abstract=set())) == []
    assert ids(filters.filter_papers_or(papers, 0, 1900, open_access=None)) == [1, 2, 4, 5]
    assert ids(filters.filter_papers(papers, 0, 1900, allowed=("letter",), open_access=None)) == []


def test_query_language(papers):
    assert q.parse("a AND b OR NOT c") == q.Or((q.And((q.Term(None, "a"), q.Term(None, "b"))), q.Not(q.Term(None, "c"))))
    assert ids(q.search(papers, "TITLE:a OR CITED:[7 TO *]")) == [1, 2, 4]
    assert ids(q.search(papers, "heart NOT OPEN_ACCESS:y")) == [2, 5]
    assert ids(q.search(papers, '"heart study" PUB_YEAR:[1980 TO 2001]')) == [1, 4]
    for bad in ("(a", "AND b", 'x "y', "a AND", "a)", "NOPE:1"):
        with pytest.raises(ValueError):
            q.compiled(q.parse(bad))
    built = q.Query().field("title", "gene therapy").and_().group(q.Query().years(1999, 2001).or_().citations(3)).build()
    assert built == 'TITLE:"gene therapy" AND ((PUB_YEAR:[1999 TO 2001]) OR (CITED:[3 TO *]))'
    assert q.as_pubmed(q.parse(built)) == '("gene therapy"[ti] AND (1999:2001[dp] OR 3:3000[cited]))'
    with pytest.raises(ValueError):
        q.Query().keyword("a").and_().build()


def test_empty_tables(papers, spark):
    none = papers.limit(0)
    assert stats.citation_statistics(none).first().total_papers == 0
    assert stats.publication_year_distribution(none).count() == 0
    assert stats.access_citation_effect(none).first().is_significant is False
    assert dedupe.remove_duplicates(none).count() == 0


def test_network_of_two_groups(spark):
    rows = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "x"), (3, "y"), (4, "lone")]
    n = spark.createDataFrame(rows, "paper int, author string")
    groups = {r.author: r.group for r in network.research_groups(n, 10).collect()}
    assert groups == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {(r.a, r.b): r["count"] for r in network.collaboration_pairs(n).collect()} == {("a", "b"): 1, ("b", "c"): 1, ("x", "y"): 1}


def test_merge(spark):
    a = spark.createDataFrame([(1, "", None, 3, "10.1/A")], "id int, title string, journal string, cited int, doi string")
    b = spark.createDataFrame([(1, "T", "J", 5, "10.1/b"), (2, "U", None, None, None)], a.schema)
    one, two = merge.merge_sources({"a": a, "b": b}).orderBy("id").collect()
    assert (one.title, one.journal, one.cited, one.doi, one.doi_conflicts, one.sources) == ("T", "J", 5, "10.1/a", "b:10.1/b", "a,b")
    assert (two.title, two.sources) == ("U", "b")


def test_graph(spark, papers):
    g = graph.union(graph.paper_triples(papers), graph.paper_triples(papers))
    assert g.count() == graph.paper_triples(papers).count()
    lines = [r.value for r in graph.n_quads(spark.createDataFrame([("s", "p", 'q"\n', "literal", None, "g")], "s string, p string, o string, o_kind string, o_datatype string, g string")).collect()]
    assert lines == ['<s> <p> "q\\"\\n" <https://example.org/kg/graph/g> .']


ARTICLE = """<!DOCTYPE article [<!ENTITY x "y">]><article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta>
<article-id pub-id-type="doi">10.1/z</article-id><title-group><article-title>On <i>h</i>earts</article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jo</given-names></name>
<xref ref-type="aff" rid="a1"/></contrib></contrib-group><aff id="a1">Lab, Paris</aff><pub-date pub-type="epub"><year>2020</year><month>3</month></pub-date><fpage>1</fpage><lpage>9</lpage><abstract><p>Short.</p></abstract></article-meta></front>
<body><sec><title>Intro</title><p>Text.</p><fig id="f1"><label>F1</label><graphic xlink:href="f.png"/></fig><table-wrap id="t1"><table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table></table-wrap></sec></body>
<back><ref-list><ref id="r1"><element-citation><article-title>Old</article-title><source>S</source><year>1999</year><pub-id pub-id-type="pmid">12</pub-id></element-citation></ref></ref-list></back></article>"""


def test_full_text(spark):
    a = fulltext.parse(spark.createDataFrame([(1, ARTICLE), (2, "<broken"), (3, None)], "id int, xml string"), "id", "xml").persist()
    good, bad, none = (r.article for r in a.orderBy("paper_id").collect())
    assert (good.title, good.doi, good.pub_date, good.pages, good.authors[0].name) == ("On h earts", "10.1/z", "2020-03", "1-9", "Jo Doe")
    assert bad.error and none.error == "empty document"
    assert [tuple(r)[2:] for r in fulltext.child(a, "tables").collect()] == [("t1", None, None, ["h"], [["1"]])]
    assert fulltext.child(a, "references").first().pmid == "12"
    assert fulltext.child(a, "figures").first().graphic == "f.png"
    assert "## Intro" in fulltext.markdown(a.where("paper_id = 1")).first().markdown
    assert fulltext.schema_coverage(a, ["article", "sec"]).first().known_tags == 2


def test_entities(spark):
    df = spark.createDataFrame([("n", "bad"), (None, "0000-0001-2345-6789")], "name string, orcid string")
    assert [r.errors for r in entities.with_errors(df, "author").collect()] == [["orcid is malformed"], ["needs a name"]]


def test_readers(spark, tmp_path):
    record = {"id": "1", "title": "T", "citedByCount": 4, "isOpenAccess": "Y", "hasPDF": "Y", "meshHeadingList": {"meshHeading": [{"descriptorName": "Heart", "majorTopic_YN": "Y"}]}, "grantsList": {"grant": [{"agency": "NIH"}]}, "journalInfo": {"journal": {"title": "Nested"}}}
    (tmp_path / "a.json").write_text(json.dumps({"hitCount": 1, "resultList": {"result": [record, {"id": "2", "citedByCount": "x"}]}}))
    flat = flatten.flat_papers(readers.search_json(spark, str(tmp_path / "a.json")))
    (row,) = flat.collect()
    assert (row.id, row.citedByCount, row.journalTitle, row.meshTerms, row.grants, row.hasPDF, row.hasAbstract) == ("1", 4, "Nested", "Heart*", "NIH", True, False)
    assert len(flat.columns) == 28
    (tmp_path / "b.xml").write_text("<responseWrapper><resultList><result><id>7</id><title>X</title></result></resultList></responseWrapper>")
    assert readers.search_xml(spark, str(tmp_path / "b.xml")).first().id == "7"
    assert readers.markdown_rows(spark.createDataFrame([("a|b", 1)], "x string, y int")).first().value == "| a\\|b | 1 |"


def test_cache_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(5)), ("a", at(14)), ("b", at(1)), ("a", at(20))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.cache_stream(spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in")), ttl=10)
    run = stream.writeStream.format("memory").queryName("served").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r.key, r.hit) for r in spark.sql("select * from served order by key, ts").collect()] == [("a", False), ("a", True), ("a", False), ("a", True), ("b", False)]


def test_latest_state(spark):
    updates = spark.createDataFrame([("q", 1, 10, "c1"), ("q", 2, 20, None)], "query string, seq int, fetched int, cursor string")
    row = state.latest_state(updates).first()
    assert (row.fetched, row.cursor, row.seq) == (20, "c1", 2)
