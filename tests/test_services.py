"""Landed answers at their edges: no JSON, empty objects, missing parts, other places of a field."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import annotations, entity_graph, reconcile
from folioscope.operators.query_language import Query
from folioscope.sources import responses

PARSERS = {"crossref": responses.crossref, "openalex": responses.openalex, "unpaywall": responses.unpaywall, "semantic_scholar": responses.semantic_scholar}


def landed(spark, *answers):
    rows = [(i, a if a is None or isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, "id long, json string")


def test_answers_without_content(spark):
    empty = landed(spark, {}, "no json", None, "[]")
    for parse in (*PARSERS.values(), responses.ror, responses.datacite):
        found = parse(empty).collect()
        assert [r.id for r in found] == [0, 1, 2, 3]
        assert all(r["title"] is None for r in found if "title" in r.asDict())
    assert responses.crossref(landed(spark)).collect() == []


def test_crossref_places(spark):
    (r,) = responses.crossref(landed(spark, {"author": [{"name": "Group"}, {"given": "A", "family": "B", "ORCID": "https://orcid.org/1", "affiliation": [{"name": "X"}, {}]}], "published": {"date-parts": [[2020, 3]]}, "funder": []})).collect()
    assert [(a.name, a.orcid, a.affiliation) for a in r.authors] == [("Group", None, []), ("A B", "https://orcid.org/1", ["X"])]
    assert (r.publication_date, r.citation_count, r.funders, r.license) == ("2020-03", 0, None, None)


def test_ror_prefers_the_shown_name_and_given_ids(spark):
    answer = {"names": [{"value": "L", "types": ["label"]}, {"value": "D", "types": ["ror_display"]}], "external_ids": [{"type": "grid", "preferred": "g1", "all": ["g1"]}, {"type": "isni", "preferred": None, "all": ["i"]}], "locations": [{}]}
    (r,) = responses.ror(landed(spark, answer)).collect()
    assert (r.display_name, r.grid_id, r.isni, r.city, r.website) == ("D", "g1", None, None, None)


def merged(spark, **answers):
    frames = {s: parse(landed(spark, *answers.get(s, []))) for s, parse in PARSERS.items()}
    return reconcile.merged(reconcile.joined_services(**frames))


def test_one_service_alone(spark):
    (r,) = merged(spark, unpaywall=[{"is_oa": True}]).collect()
    assert (r.is_oa, r.oa_status, r.oa_url, r.title, r.citation_count, r.data_sources) == (True, "closed", None, None, None, ["unpaywall"])
    (r,) = merged(spark, openalex=[{"publication_year": 1999, "biblio": {"volume": ""}}], semantic_scholar=[{"journal": {"volume": "7"}, "citationCount": 4}]).collect()
    assert (r.publication_date, r.publication_year, r.volume, r.citation_count) == (None, 1999, "7", 4)
    assert [(c.source, c["count"]) for c in r.citation_counts] == [("semantic_scholar", 4), ("openalex", 0)]


def test_paper_entities_and_dois(spark):
    records = merged(spark, crossref=[{"title": ["  T "], "DOI": "https://doi.org/10.1/X", "publisher": "  ", "license": [{"URL": " http://l "}]}])
    (r,) = reconcile.paper_entities(records).collect()
    assert (r.title, r.doi, r.publisher, r.license_url) == ("T", "10.1/x", None, "http://l")
    known = spark.createDataFrame([("PMC1", "10.2/a")], "pmcid string, doi string")
    asked = spark.createDataFrame([("https://doi.org/10.5/q",), ("10.6/r",), ("pmc1",), ("PMC2",), ("other",), (None,)], "identifier string")
    assert {r.identifier: r.doi for r in reconcile.doi_of(asked, known).collect()} == {"https://doi.org/10.5/q": "10.5/q", "10.6/r": "10.6/r", "pmc1": "10.2/a", "PMC2": None, "other": None, None: None}


def test_annotations_at_their_edges(spark):
    answers = [
        {"annotations": [{"exact": "a", "provider": "plain", "pmcid": "PMC7", "tags": []}, {"exact": "b", "annotator": {"name": "N"}, "target": {"pmcid": "8", "source": "S"}}, {"exact": "c", "creator": "me", "target": "text"}]},
        {"annotations": []}, "no json", None,
    ]
    rows = annotations.landed(landed(spark, *answers))
    assert sorted((r.id, r.pos, r.exact, r.provider, r.article, r.article_uri) for r in rows.collect()) == [
        (0, 0, "a", "plain", "PMC7", annotations.ARTICLES + "PMC7"), (0, 1, "b", "N", "PMC8", annotations.ARTICLES + "PMC8"), (0, 2, "c", "me", None, None)
    ]
    facts = {r.id: (r.total_count, r.page, r.page_size, r.valid) for r in annotations.response_facts(landed(spark, {"totalCount": 3}, "no json", None)).collect()}
    assert facts == {0: (3, 1, 25, True), 1: (0, 1, 25, False), 2: (0, 1, 25, False)}
    errors = {r.exact: r.errors for r in annotations.annotation_errors(rows.withColumn("relation", F.when(F.col("exact") == "b", "r"))).collect()}
    assert errors == {"a": [], "b": ["relationship needs two entities"], "c": ["article is missing"]}


def test_addresses_of_entities(spark):
    rows = spark.createDataFrame([("Doe J; Roe", "1999", "T", None, "", None), ("x", "1", "t", "5", "PMC1", "10.1/a"), (None, None, None, None, None, "https://doi.org/10.1/B"), (None, None, None, None, None, None)], "authors string, year string, title string, pmid string, pmcid string, doi string")
    found = [r[0] and r[0].removeprefix(entity_graph.BASE) for r in rows.select(entity_graph.reference_uri()).collect()]
    assert found[0].startswith("reference/doe-j-1999-") and found[1:] == ["reference/5", "reference/10.1/b", None]
    grants = spark.createDataFrame([("10.13039/9", "F", "A 1"), (None, "The Fund", None), (None, None, "A")], "fundref_doi string, funder string, award string")
    assert [r[0] and r[0].removeprefix(entity_graph.BASE) for r in grants.select(entity_graph.grant_uri()).collect()] == ["grant/9-a-1", "grant/the-fund", None]
    tagged = spark.createDataFrame([("s", ["a", " ", None, "b"]), ("s", None), (None, ["c"])], "s string, words array<string>")
    assert sorted(r.o for r in entity_graph.many_valued(tagged, F.col("s"), {"words": "dcterms:subject"}, "g").collect()) == ["a", "b"]


def test_accession_type():
    assert Query().accession_type(" PDB ").and_().keyword("kinase").build() == "ACCESSION_TYPE:pdb AND kinase"
    with pytest.raises(ValueError):
        Query().accession_type(" ")
