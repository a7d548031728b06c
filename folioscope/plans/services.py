"""Registered queries on landed service answers: parsing, reconciling and their graph, with SQL from the tables the answers are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import annotations, entity_graph, graph, reconcile
from folioscope.plans.views import table, view
from folioscope.sources import responses


def answers(spark: SparkSession, sf_dir: str, table_name: str, fields: dict[str, str], key: str) -> DataFrame:
    """Rows of a table as (id, json): each field an SQL expression; null fields are left out of the text."""
    made = ", ".join(f"{sql} AS `{name}`" for name, sql in fields.items())
    return table(spark, sf_dir, table_name).selectExpr(f"{key} AS id", f"to_json(struct({made})) AS json")


O = "o_orderkey"  # noqa: E741
CROSSREF = {
    "title": f"CASE WHEN {O} % 5 = 0 THEN array() ELSE array(concat('Work ', {O}), 'second') END",
    "author": f"array(named_struct('given', concat('G', {O} % 7), 'family', 'F', 'ORCID', CASE WHEN {O} % 3 = 0 THEN '0000-0001-0000-0009' WHEN {O} % 3 = 1 THEN 'https://orcid.org/0000-0001' END, 'affiliation', array(named_struct('name', concat('Org ', {O} % 4)), named_struct('name', ''))), named_struct('given', '', 'family', '', 'ORCID', CAST(NULL AS STRING), 'affiliation', CAST(array() AS array<struct<name:string>>)))",
    "abstract": f"CASE WHEN {O} % 4 = 0 THEN concat('About ', {O}) END",
    "container-title": f"CASE WHEN {O} % 6 <> 0 THEN array(concat('Journal ', {O} % 10)) END",
    "published": f"named_struct('date-parts', array(slice(array(year(o_orderdate), month(o_orderdate), day(o_orderdate)), 1, CAST({O} % 4 AS INT))))",
    "is-referenced-by-count": f"CASE WHEN {O} % 7 <> 0 THEN {O} % 50 END",
    "references-count": f"{O} % 30",
    "license": f"CASE WHEN {O} % 2 = 0 THEN array(named_struct('URL', concat('http://l/', {O} % 3), 'start', named_struct('date-time', '2020'), 'delay-in-days', 0)) END",
    "funder": f"CASE WHEN {O} % 5 = 1 THEN array(named_struct('name', concat('Funder ', {O} % 8), 'DOI', concat('10.13039/', {O} % 8), 'award', array(concat('A', {O})))) WHEN {O} % 5 = 2 THEN CAST(array() AS array<struct<name:string,DOI:string,award:array<string>>>) END",
    "volume": f"CASE WHEN {O} % 3 = 0 THEN CAST({O} % 20 AS STRING) END", "page": f"CASE WHEN {O} % 8 = 0 THEN '1-9' END", "publisher": "o_orderpriority", "DOI": f"concat('10.5/', {O})",
}
OPENALEX = {
    "id": f"concat('https://openalex.org/W', {O})", "title": f"concat('Open ', {O})", "publication_year": "year(o_orderdate)", "publication_date": f"CASE WHEN {O} % 3 = 0 THEN '' WHEN {O} % 3 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') END",
    "cited_by_count": f"{O} % 60", "open_access": f"CASE WHEN {O} % 4 <> 0 THEN named_struct('is_oa', {O} % 2 = 0, 'oa_status', 'gold', 'oa_url', concat('http://oa/', {O})) END",
    "authorships": f"array(named_struct('author_position', 'first', 'author', named_struct('id', concat('A', o_custkey), 'display_name', concat('Name ', o_custkey)), 'institutions', CASE WHEN {O} % 3 = 0 THEN array(named_struct('id', concat('I', {O} % 9), 'display_name', concat('Inst ', {O} % 9), 'country_code', 'DE', 'ror', concat('r', {O} % 9))) END))",
    "topics": f"CASE WHEN {O} % 2 = 1 THEN array(named_struct('id', 'T', 'display_name', concat('Topic ', {O} % 5), 'score', 0.5D)) END",
    "primary_location": f"CASE WHEN {O} % 5 <> 0 THEN named_struct('source', named_struct('id', 'S', 'display_name', concat('Venue ', {O} % 6))) END",
    "biblio": f"named_struct('volume', CAST({O} % 21 AS STRING), 'issue', CASE WHEN {O} % 2 = 0 THEN '4' END, 'first_page', '7', 'last_page', CASE WHEN {O} % 3 = 0 THEN '' ELSE '8' END)",
    "doi": f"CASE WHEN {O} % 2 = 0 THEN concat('https://doi.org/10.5/', {O}) END", "referenced_works_count": f"{O} % 40", "related_works": f"CASE WHEN {O} % 6 = 0 THEN array('W1', concat('W', {O})) END",
}
UNPAYWALL = {
    "is_oa": f"{O} % 3 = 0", "oa_status": f"CASE WHEN {O} % 4 <> 0 THEN 'green' END", "best_oa_location": f"CASE WHEN {O} % 3 = 0 THEN named_struct('url', concat('http://best/', {O}), 'host_type', 'repository', 'license', 'cc-by') END",
    "oa_locations": f"CASE WHEN {O} % 3 = 0 THEN array(named_struct('url', 'a', 'host_type', 'publisher'), named_struct('url', 'b', 'host_type', 'repository')) ELSE CAST(array() AS array<struct<url:string,host_type:string>>) END", "publisher": "o_orderpriority", "year": "year(o_orderdate)",
}
SEMANTIC = {
    "paperId": f"concat('s', {O})", "title": f"concat('Semantic ', {O})", "abstract": f"concat('Told of ', {O})", "citationCount": f"CASE WHEN {O} % 2 = 0 THEN {O} % 55 END", "influentialCitationCount": f"{O} % 5", "referenceCount": f"{O} % 35",
    "fieldsOfStudy": "array('Biology', 'Medicine')", "journal": f"named_struct('name', 'J', 'volume', '3', 'pages', CASE WHEN {O} % 2 = 0 THEN '10-12' END)", "externalIds": f"map('DOI', concat('10.6/', {O} % 100), 'PubMed', CAST({O} AS STRING))",
}
#: Which orders each service knows.
SERVICES = {"crossref": (CROSSREF, f"{O} % 2 = 0 OR {O} % 3 = 0"), "openalex": (OPENALEX, f"{O} % 3 <> 1"), "unpaywall": (UNPAYWALL, f"{O} % 5 = 0"), "semantic_scholar": (SEMANTIC, f"{O} % 4 = 0")}
PARSERS = {"crossref": responses.crossref, "openalex": responses.openalex, "unpaywall": responses.unpaywall, "semantic_scholar": responses.semantic_scholar}


def service(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    fields, where = SERVICES[name]
    made = ", ".join(f"{sql} AS `{field}`" for field, sql in fields.items())
    landed = table(spark, sf_dir, "orders").where(where).selectExpr(f"{O} AS id", f"to_json(struct({made})) AS json")
    return PARSERS[name](landed)


def crossref_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.get("authors", F.lit(0))
    return service(spark, sf_dir, "crossref").select(
        "id", "title", a["name"].alias("author"), a["orcid"].alias("orcid"), F.array_join(a["affiliation"], ",").alias("affiliation"), F.get("authors", F.lit(1))["name"].alias("blank_author"), "abstract", "journal",
        "publication_date", "citation_count", "references_count", F.col("license.url").alias("license_url"), F.get("funders", F.lit(0))["name"].alias("funder"), F.get(F.get("funders", F.lit(0))["award"], F.lit(0)).alias("award"), "volume", "publisher",
    )


K = "o_orderkey"
DATE = f"CASE {K} % 4 WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') END"
QUERIES = {"crossref_records": crossref_query}
ORACLES = {
    "crossref_records": f"""SELECT {K} AS id, CASE WHEN {K} % 5 <> 0 THEN 'Work ' || {K} END AS title, 'G' || {K} % 7 || ' F' AS author, CASE WHEN {K} % 3 = 0 THEN 'https://orcid.org/0000-0001-0000-0009' WHEN {K} % 3 = 1 THEN 'https://orcid.org/0000-0001' END AS orcid,
    'Org ' || {K} % 4 AS affiliation, '' AS blank_author, CASE WHEN {K} % 4 = 0 THEN 'About ' || {K} END AS abstract, CASE WHEN {K} % 6 <> 0 THEN 'Journal ' || {K} % 10 END AS journal, {DATE} AS publication_date,
    CASE WHEN {K} % 7 <> 0 THEN {K} % 50 ELSE 0 END AS citation_count, {K} % 30 AS references_count, CASE WHEN {K} % 2 = 0 THEN 'http://l/' || {K} % 3 END AS license_url, CASE WHEN {K} % 5 = 1 THEN 'Funder ' || {K} % 8 END AS funder,
    CASE WHEN {K} % 5 = 1 THEN 'A' || {K} END AS award, CASE WHEN {K} % 3 = 0 THEN CAST({K} % 20 AS VARCHAR) END AS volume, o_orderpriority AS publisher FROM orders WHERE {K} % 2 = 0 OR {K} % 3 = 0"""
}


def openalex_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, none = F.get("authors", F.lit(0)), F.lit(0)
    return service(spark, sf_dir, "openalex").select(
        "id", "openalex_id", "title", "publication_year", "citation_count", "is_oa", "oa_status", "oa_url", a["id"].alias("author_id"), F.get(a["institutions"], none)["ror_id"].alias("ror"), F.coalesce(F.size("institutions"), none).alias("n_institutions"),
        F.get("topics", none)["display_name"].alias("topic"), F.col("venue.display_name").alias("venue"), F.col("biblio.volume").alias("volume"), "referenced_works_count", F.array_join("related_works", ",").alias("related"),
    )


QUERIES["openalex_records"] = openalex_query
ORACLES["openalex_records"] = f"""SELECT {K} AS id, 'https://openalex.org/W' || {K} AS openalex_id, 'Open ' || {K} AS title, CAST(year(o_orderdate) AS INTEGER) AS publication_year, {K} % 60 AS citation_count, {K} % 4 <> 0 AND {K} % 2 = 0 AS is_oa,
    CASE WHEN {K} % 4 <> 0 THEN 'gold' ELSE 'closed' END AS oa_status, CASE WHEN {K} % 4 <> 0 THEN 'http://oa/' || {K} END AS oa_url, 'A' || o_custkey AS author_id, CASE WHEN {K} % 3 = 0 THEN 'r' || {K} % 9 END AS ror, CAST({K} % 3 = 0 AS INTEGER) AS n_institutions,
    CASE WHEN {K} % 2 = 1 THEN 'Topic ' || {K} % 5 END AS topic, CASE WHEN {K} % 5 <> 0 THEN 'Venue ' || {K} % 6 END AS venue, CAST({K} % 21 AS VARCHAR) AS volume, {K} % 40 AS referenced_works_count, CASE WHEN {K} % 6 = 0 THEN 'W1,W' || {K} END AS related FROM orders WHERE {K} % 3 <> 1"""


def unpaywall_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service(spark, sf_dir, "unpaywall").select("id", "is_oa", "oa_status", F.col("best_oa_location.url").alias("url"), F.col("best_oa_location.repository_type").alias("kind"), F.array_join(F.transform("oa_locations", lambda x: x["repository_type"]), ",").alias("kinds"), "journal_is_oa", "publisher", "year")


QUERIES["unpaywall_records"] = unpaywall_query
ORACLES["unpaywall_records"] = f"""SELECT {K} AS id, {K} % 3 = 0 AS is_oa, CASE WHEN {K} % 4 <> 0 THEN 'green' ELSE 'closed' END AS oa_status, CASE WHEN {K} % 3 = 0 THEN 'http://best/' || {K} END AS url, CASE WHEN {K} % 3 = 0 THEN 'repository' END AS kind,
    CASE WHEN {K} % 3 = 0 THEN 'publisher,repository' END AS kinds, false AS journal_is_oa, o_orderpriority AS publisher, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE {K} % 5 = 0"""

ROR = {
    "id": "concat('https://ror.org/0', s_suppkey)", "status": "'active'", "types": "array('education')", "established": "CAST(1900 + s_suppkey % 100 AS INT)",
    "names": "CASE WHEN s_suppkey % 3 = 0 THEN array(named_struct('value', 'other', 'types', array('alias')), named_struct('value', concat('Shown ', s_suppkey), 'types', array('ror_display', 'label'))) WHEN s_suppkey % 3 = 1 THEN array(named_struct('value', concat('Label ', s_suppkey), 'types', array('label'))) END",
    "locations": "CASE WHEN s_suppkey % 4 <> 0 THEN array(named_struct('geonames_details', named_struct('name', concat('City ', s_nationkey), 'country_name', concat('Country ', s_nationkey), 'country_code', 'XX', 'lat', s_nationkey + 0.5D, 'lng', 1.25D))) END",
    "links": "array(named_struct('type', 'wikipedia', 'value', 'w'), named_struct('type', 'website', 'value', concat('http://s', s_suppkey)))",
    "external_ids": "array(named_struct('type', 'grid', 'preferred', concat('grid.', s_suppkey), 'all', array('g')), named_struct('type', 'isni', 'preferred', CAST(NULL AS STRING), 'all', array('i')))", "domains": "array('a.org', concat('s', s_suppkey, '.org'))",
}


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.ror(answers(spark, sf_dir, "supplier", ROR, "s_suppkey"))


QUERIES["ror_records"] = lambda spark, d: organisations(spark, d).select("id", "ror_id", "display_name", "country", "city", "latitude", "website", "grid_id", "isni", "established", F.size("domains").alias("n_domains"))
ORACLES["ror_records"] = """SELECT s_suppkey AS id, 'https://ror.org/0' || s_suppkey AS ror_id, CASE s_suppkey % 3 WHEN 0 THEN 'Shown ' || s_suppkey WHEN 1 THEN 'Label ' || s_suppkey END AS display_name, CASE WHEN s_suppkey % 4 <> 0 THEN 'Country ' || s_nationkey END AS country,
    CASE WHEN s_suppkey % 4 <> 0 THEN 'City ' || s_nationkey END AS city, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey + 0.5 AS DOUBLE) END AS latitude, 'http://s' || s_suppkey AS website, 'grid.' || s_suppkey AS grid_id, CAST(NULL AS VARCHAR) AS isni,
    CAST(1900 + s_suppkey % 100 AS INTEGER) AS established, 2 AS n_domains FROM supplier"""

DATACITE = {
    "id": "concat('10.7/', p_partkey)",
    "attributes": "named_struct('prefix', '10.7', 'titles', CASE WHEN p_partkey % 4 <> 0 THEN array(named_struct('title', p_name), named_struct('title', 'x')) END, 'creators', array(named_struct('name', concat('Maker ', p_size))), 'publisher', p_brand, 'publicationYear', CAST(2000 + p_size AS INT), 'types', named_struct('resourceType', p_type, 'resourceTypeGeneral', 'Dataset'), 'viewCount', CASE WHEN p_partkey % 2 = 0 THEN p_size END, 'isActive', true, 'source', 'mds')",
}
QUERIES["datacite_records"] = lambda spark, d: responses.datacite(answers(spark, d, "part", DATACITE, "p_partkey")).select("id", "doi", "title", F.get("creators", F.lit(0))["name"].alias("creator"), "publisher", "publication_year", "resource_type", "resource_type_general", "view_count", "download_count", "is_active", "source_system")
ORACLES["datacite_records"] = """SELECT p_partkey AS id, '10.7/' || p_partkey AS doi, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS title, 'Maker ' || p_size AS creator, p_brand AS publisher, CAST(2000 + p_size AS INTEGER) AS publication_year, p_type AS resource_type, 'Dataset' AS resource_type_general,
    CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS BIGINT) AS view_count, CAST(0 AS BIGINT) AS download_count, true AS is_active, 'mds' AS source_system FROM part"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.merged(reconcile.joined_services(**{name: service(spark, sf_dir, name) for name in SERVICES}))


C, A, U, S = f"({K} % 2 = 0 OR {K} % 3 = 0)", f"{K} % 3 <> 1", f"{K} % 5 = 0", f"{K} % 4 = 0"
KNOWN = f"FROM orders WHERE {C} OR {A} OR {U} OR {S}"
FIRST_DATE = f"coalesce(CASE WHEN {C} THEN {DATE} END, CASE WHEN {A} AND {K} % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END)"
QUERIES["reconciled_text"] = lambda spark, d: merged(spark, d).select("id", "title", "abstract", "journal", "publication_date", "publication_year", F.array_join("data_sources", ",").alias("data_sources"))
ORACLES["reconciled_text"] = f"""SELECT {K} AS id, CASE WHEN {C} AND {K} % 5 <> 0 THEN 'Work ' || {K} WHEN {A} THEN 'Open ' || {K} WHEN {S} THEN 'Semantic ' || {K} END AS title, CASE WHEN {C} AND {K} % 4 = 0 THEN 'About ' || {K} WHEN {S} THEN 'Told of ' || {K} END AS abstract,
    CASE WHEN {C} AND {K} % 6 <> 0 THEN 'Journal ' || {K} % 10 WHEN {A} AND {K} % 5 <> 0 THEN 'Venue ' || {K} % 6 END AS journal, {FIRST_DATE} AS publication_date, CASE WHEN {FIRST_DATE} IS NULL AND {A} THEN CAST(year(o_orderdate) AS INTEGER) END AS publication_year,
    concat_ws(',', CASE WHEN {C} THEN 'crossref' END, CASE WHEN {A} THEN 'openalex' END, CASE WHEN {U} THEN 'unpaywall' END, CASE WHEN {S} THEN 'semantic_scholar' END) AS data_sources {KNOWN}"""
QUERIES["reconciled_counts"] = lambda spark, d: merged(spark, d).select("id", "citation_count", F.array_join(F.transform("citation_counts", lambda c: F.concat_ws(":", c["source"], c["count"].cast("string"))), ",").alias("counts"), "reference_count", "cited_by_count", F.array_join("related_works", ",").alias("related"), "influential_citation_count")
CITED = f"CASE WHEN {C} THEN CASE WHEN {K} % 7 <> 0 THEN {K} % 50 ELSE 0 END END", f"CASE WHEN {S} AND {K} % 2 = 0 THEN {K} % 55 END", f"CASE WHEN {A} THEN {K} % 60 END"
ORACLES["reconciled_counts"] = f"""SELECT {K} AS id, greatest({CITED[0]}, {CITED[1]}, {CITED[2]}) AS citation_count, nullif(concat_ws(',', 'crossref:' || ({CITED[0]}), 'semantic_scholar:' || ({CITED[1]}), 'openalex:' || ({CITED[2]})), '') AS counts,
    greatest(CASE WHEN {C} THEN nullif({K} % 30, 0) END, CASE WHEN {S} THEN nullif({K} % 35, 0) END, CASE WHEN {A} THEN nullif({K} % 40, 0) END) AS reference_count, CASE WHEN {A} THEN nullif({K} % 60, 0) END AS cited_by_count,
    CASE WHEN {A} AND {K} % 6 = 0 THEN 'W1,W' || {K} END AS related, CASE WHEN {S} THEN {K} % 5 END AS influential_citation_count {KNOWN}"""
QUERIES["reconciled_access"] = lambda spark, d: merged(spark, d).select("id", "is_oa", "oa_status", "oa_url", F.col("license.url").alias("license_url"), F.get("funding", F.lit(0))["doi"].alias("funder_doi"), F.get("topics", F.lit(0))["display_name"].alias("topic"), F.array_join("fields_of_study", ",").alias("fields"))
ORACLES["reconciled_access"] = f"""SELECT {K} AS id, CASE WHEN {U} THEN {K} % 3 = 0 WHEN {A} THEN {K} % 4 <> 0 AND {K} % 2 = 0 END AS is_oa, CASE WHEN {U} THEN CASE WHEN {K} % 4 <> 0 THEN 'green' ELSE 'closed' END WHEN {A} THEN CASE WHEN {K} % 4 <> 0 THEN 'gold' ELSE 'closed' END END AS oa_status,
    CASE WHEN {U} THEN CASE WHEN {K} % 3 = 0 THEN 'http://best/' || {K} END WHEN {A} AND {K} % 4 <> 0 THEN 'http://oa/' || {K} END AS oa_url, CASE WHEN {C} AND {K} % 2 = 0 THEN 'http://l/' || {K} % 3 END AS license_url,
    CASE WHEN {C} AND {K} % 5 = 1 THEN '10.13039/' || {K} % 8 END AS funder_doi, CASE WHEN {A} AND {K} % 2 = 1 THEN 'Topic ' || {K} % 5 END AS topic, CASE WHEN {S} THEN 'Biology,Medicine' END AS fields {KNOWN}"""
QUERIES["reconciled_bibliography"] = lambda spark, d: merged(spark, d).select("id", "volume", "issue", "pages", "first_page", "last_page", "publisher", "doi", F.array_join("doi_conflicts", ",").alias("doi_conflicts"), "pmid")
ORACLES["reconciled_bibliography"] = f"""SELECT {K} AS id, coalesce(CASE WHEN {C} AND {K} % 3 = 0 THEN CAST({K} % 20 AS VARCHAR) END, CASE WHEN {A} THEN CAST({K} % 21 AS VARCHAR) END, CASE WHEN {S} THEN '3' END) AS volume, CASE WHEN {A} AND {K} % 2 = 0 THEN '4' END AS issue,
    coalesce(CASE WHEN {C} AND {K} % 8 = 0 THEN '1-9' END, CASE WHEN {S} AND {K} % 2 = 0 THEN '10-12' END) AS pages, CASE WHEN {A} THEN '7' END AS first_page, CASE WHEN {A} AND {K} % 3 <> 0 THEN '8' END AS last_page, CASE WHEN {C} THEN o_orderpriority END AS publisher,
    coalesce(CASE WHEN {S} THEN '10.6/' || {K} % 100 END, CASE WHEN {A} AND {K} % 2 = 0 OR {C} THEN '10.5/' || {K} END) AS doi,
    concat_ws(',', CASE WHEN {S} AND {A} AND {K} % 2 = 0 THEN 'openalex:10.5/' || {K} END, CASE WHEN {S} AND {C} THEN 'crossref:10.5/' || {K} END) AS doi_conflicts, CASE WHEN {S} THEN CAST({K} AS VARCHAR) END AS pmid {KNOWN}"""

#: Annotations as a service lands them: single ones and ones in objects of their article, with every place for provider and article.
E = "event_id"
LANDED = {
    "totalCount": f"{E}", "annotations": f"""CASE WHEN {E} % 3 = 0 THEN array(to_json(named_struct('pmcid', concat('PMC', {E}), 'source', 'MED', 'annotations', array(named_struct('exact', concat('x', {E}), 'type', 'Gene', 'provider', named_struct('name', 'P1'), 'tags', array(named_struct('uri', concat('http://c/', {E} % 5), 'name', concat('c', {E} % 5)))), named_struct('exact', 'y', 'type', 'Gene', 'provider', named_struct('name', 'P2'), 'tags', array(named_struct('uri', 'http://c/y', 'name', 'cy')))))))
    WHEN {E} % 3 = 1 THEN array(to_json(named_struct('extId', CAST({E} AS STRING), 'source', 'MED', 'exact', 'z', 'section', 'Body', 'annotator', 'someone', 'relation', 'treats', 'tags', array(named_struct('uri', 'http://a', 'name', 'a'), named_struct('uri', 'http://b', 'name', 'b')))))
    ELSE array(to_json(named_struct('exact', 'w', 'body', 'http://identifiers.org/taxonomy/9606', 'target', named_struct('source', 'MED', 'extId', CAST({E} AS STRING), 'isPartOf', 'Title')))) END""",
}


def landed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = view(spark, sf_dir, "api_log").selectExpr("event_id AS id", f"{LANDED['annotations']} AS items", f"{LANDED['totalCount']} AS total")
    json = F.concat(F.lit('{"totalCount":'), F.col("total").cast("string"), F.lit(',"annotations":['), F.array_join("items", ","), F.lit("]}"))
    return made.select("id", json.alias("json"))


QUERIES["annotations_landed"] = lambda spark, d: annotations.landed(landed_annotations(spark, d)).select("id", "pos", "article", "article_uri", "exact", "section", "provider", "body_type", "relation", F.size("tags").alias("n_tags"))
ORACLES["annotations_landed"] = f"""SELECT {E} AS id, CAST(n AS BIGINT) AS pos, CASE {E} % 3 WHEN 0 THEN 'PMC' || {E} WHEN 1 THEN 'MED/' || {E} ELSE 'MED' END AS article, '{annotations.ARTICLES}' || CASE {E} % 3 WHEN 0 THEN 'PMC' || {E} ELSE 'MED/' || {E} END AS article_uri,
    CASE {E} % 3 WHEN 0 THEN CASE n WHEN 0 THEN 'x' || {E} ELSE 'y' END WHEN 1 THEN 'z' ELSE 'w' END AS exact, CASE {E} % 3 WHEN 0 THEN '' WHEN 1 THEN 'Body' ELSE 'Title' END AS section, CASE {E} % 3 WHEN 0 THEN 'P' || (n + 1) WHEN 1 THEN 'someone' ELSE 'Unknown' END AS provider,
    CASE {E} % 3 WHEN 0 THEN 'Gene' WHEN 1 THEN 'Unknown' ELSE 'TAXONOMY' END AS body_type, CASE WHEN {E} % 3 = 1 THEN 'treats' END AS relation, CAST(CASE {E} % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n_tags FROM events, range(2) AS r(n) WHERE n = 0 OR {E} % 3 = 0"""
QUERIES["annotation_responses"] = lambda spark, d: annotations.response_facts(landed_annotations(spark, d))
ORACLES["annotation_responses"] = f"SELECT {E} AS id, {E} AS total_count, 1 AS page, 25 AS page_size, '' AS version, '' AS source, true AS valid FROM events"


def authors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN concat('https://orcid.org/0000-0001-0000-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END AS orcid", "CASE WHEN c_custkey % 3 = 1 THEN concat('https://openalex.org/A', c_custkey) END AS openalex_id", "'' AS email")


def paper(key: str):
    return F.concat(F.lit(graph.BASE + "paper/"), F.col(key).cast("string"))


def iri_rows(subject: str, *pairs: tuple[str, str, str], source: str, g: str) -> str:
    """SQL of triples (predicate, object, datatype or '' for an address)."""
    return " UNION ".join(
        f"SELECT {subject} AS s, '{graph.iri(p)}' AS p, {o} AS o, '{'literal' if t else 'iri'}' AS o_kind, {repr(graph.iri(t)) if t else 'CAST(NULL AS VARCHAR)'} AS o_datatype, '{g}' AS g FROM {source} WHERE coalesce({o}, '') <> ''" for p, o, t in pairs
    )


ORCID_SQL = "CASE WHEN c_custkey % 3 = 0 THEN 'https://orcid.org/0000-0001-0000-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END"
SLUG = "regexp_replace(trim(lower(regexp_replace({}, '[^A-Za-z0-9 ]', '', 'g'))), ' +', '-', 'g')"
AUTHOR_SQL = f"'{graph.BASE}author/' || CASE c_custkey % 3 WHEN 0 THEN '0000-0001-0000-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'A' || c_custkey ELSE {SLUG.format('c_name')} END"
QUERIES["author_triples"] = lambda spark, d: entity_graph.authors(authors_of(spark, d))
ORACLES["author_triples"] = iri_rows(AUTHOR_SQL, ("rdf:type", f"'{graph.iri('foaf:Person')}'", ""), ("foaf:name", "c_name", "xsd:string"), ("datacite:orcid", ORCID_SQL, "xsd:string"), source="customer", g="authors")
QUERIES["organisation_triples"] = lambda spark, d: entity_graph.organisations(organisations(spark, d).select("ror_id", "display_name", "country", "website", "domains"))
ORACLES["organisation_triples"] = iri_rows(
    f"'{graph.BASE}org/0' || s_suppkey", ("rdf:type", f"'{graph.iri('org:Organization')}'", ""), ("kg:rorId", "'https://ror.org/0' || s_suppkey", "xsd:string"),
    ("skos:prefLabel", "CASE s_suppkey % 3 WHEN 0 THEN 'Shown ' || s_suppkey WHEN 1 THEN 'Label ' || s_suppkey END", "xsd:string"), ("geo:country", "CASE WHEN s_suppkey % 4 <> 0 THEN 'Country ' || s_nationkey END", "xsd:string"),
    ("foaf:homepage", "'http://s' || s_suppkey", "xsd:anyURI"), ("dcterms:subject", "'a.org'", "xsd:string"), ("dcterms:subject", "'s' || s_suppkey || '.org'", "xsd:string"), source="supplier", g="institutions",
)
QUERIES["grant_triples"] = lambda spark, d: entity_graph.grants(service(spark, d, "crossref").select("id", F.explode("funders").alias("f")).select("id", F.col("f.name").alias("funder"), F.col("f.doi").alias("fundref_doi"), F.get("f.award", F.lit(0)).alias("award")), paper("id"))
FUNDED, GRANT_SQL, PAPER_SQL = f"(SELECT * FROM orders WHERE {C} AND {K} % 5 = 1)", f"'{graph.BASE}grant/' || {K} % 8 || '-a' || {K}", f"'{graph.BASE}paper/' || {K}"
ORACLES["grant_triples"] = " UNION ".join((
    iri_rows(GRANT_SQL, ("rdf:type", f"'{graph.iri('frapo:Grant')}'", ""), ("datacite:doi", f"'10.13039/' || {K} % 8", "xsd:anyURI"), ("frapo:hasFundingAgency", f"'Funder ' || {K} % 8", "xsd:string"), ("datacite:identifier", f"'A' || {K}", "xsd:string"), ("frapo:funds", PAPER_SQL, ""), source=FUNDED, g="publications"),
    iri_rows(PAPER_SQL, ("foaf:fundedBy", GRANT_SQL, ""), source=FUNDED, g="publications"),
))
QUERIES["reference_triples"] = lambda spark, d: entity_graph.references(table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS STRING) END AS pmid", "'' AS pmcid", "CASE WHEN l_partkey % 3 = 1 THEN concat('https://doi.org/10.9/', l_partkey) END AS doi", "'Doe J, Roe R' AS authors", "'1999' AS year", "concat('Part ', l_partkey) AS title"), paper("id"))
REFERENCE_SQL = f"'{graph.BASE}reference/' || CASE l_partkey % 3 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN '10.9/' || l_partkey ELSE 'doe-j-1999-' || md5('Part ' || l_partkey)[1:8] END"
CITING_SQL = f"'{graph.BASE}paper/' || l_orderkey"
ORACLES["reference_triples"] = " UNION ".join((
    iri_rows(REFERENCE_SQL, ("rdf:type", f"'{graph.iri('bibo:Article')}'", ""), ("dcterms:title", "'Part ' || l_partkey", "xsd:string"), ("bibo:authorList", "'Doe J, Roe R'", "xsd:string"), ("dcterms:issued", "'1999'", "xsd:gYear"), ("bibo:doi", "CASE WHEN l_partkey % 3 = 1 THEN 'https://doi.org/10.9/' || l_partkey END", "xsd:anyURI"), ("cito:isCitedBy", CITING_SQL, ""), source="lineitem", g="publications"),
    iri_rows(CITING_SQL, ("cito:cites", REFERENCE_SQL, ""), source="lineitem", g="publications"),
))
QUERIES["annotation_triples"] = lambda spark, d: entity_graph.annotation_graph(annotations.landed(landed_annotations(spark, d)))
ANNOTATED = f"""(SELECT *, '{graph.BASE}annotation/' || lower(replace(article, '/', '')) || '-' || n || '-' || md5(exact)[1:8] AS uri FROM (SELECT {E}, n, {E} % 3 AS k, CASE {E} % 3 WHEN 0 THEN 'PMC' || {E} WHEN 1 THEN 'MED/' || {E} ELSE 'MED' END AS article,
    '{annotations.ARTICLES}' || CASE {E} % 3 WHEN 0 THEN 'PMC' || {E} ELSE 'MED/' || {E} END AS target, CASE {E} % 3 WHEN 0 THEN CASE n WHEN 0 THEN 'x' || {E} ELSE 'y' END WHEN 1 THEN 'z' ELSE 'w' END AS exact, CASE {E} % 3 WHEN 0 THEN '' WHEN 1 THEN 'Body' ELSE 'Title' END AS section,
    CASE {E} % 3 WHEN 0 THEN 'P' || (n + 1) WHEN 1 THEN 'someone' ELSE 'Unknown' END AS provider FROM events, range(2) AS r(n) WHERE n = 0 OR {E} % 3 = 0))"""
CONCEPTS = f"(SELECT uri, CASE k WHEN 1 THEN 'http://' || l ELSE CASE n WHEN 0 THEN 'http://c/' || {E} % 5 ELSE 'http://c/y' END END AS concept, CASE k WHEN 1 THEN l ELSE CASE n WHEN 0 THEN 'c' || {E} % 5 ELSE 'cy' END END AS label FROM {ANNOTATED}, (SELECT unnest(['a', 'b']) AS l) WHERE k < 2 AND (k = 1 OR l = 'a'))"
ORACLES["annotation_triples"] = " UNION ".join((
    iri_rows("uri", ("rdf:type", f"'{graph.iri('oa:Annotation')}'", ""), ("oa:hasBody", "exact", "xsd:string"), ("dcterms:isPartOf", "section", "xsd:string"), ("dcterms:creator", "provider", "xsd:string"), ("kg:articleId", "article", "xsd:string"), ("oa:hasTarget", "target", ""), source=ANNOTATED, g="annotations"),
    iri_rows("uri", ("oa:hasBody", "concept", ""), source=CONCEPTS, g="annotations"), iri_rows("concept", ("rdfs:label", "label", "xsd:string"), source=CONCEPTS, g="annotations"),
    iri_rows("uri", ("rdf:type", f"'{graph.iri('rdf:Statement')}'", ""), ("rdf:predicate", "'treats'", "xsd:string"), ("rdf:subject", "'http://a'", "xsd:string"), ("rdf:object", "'http://b'", "xsd:string"), source=f"(SELECT * FROM {ANNOTATED} WHERE k = 1)", g="annotations"),
))


def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_brand AS title", "CASE WHEN p_partkey % 2 = 0 THEN concat('J ', p_brand) END AS iso_abbreviation", "CAST(NULL AS STRING) AS medline_abbreviation", "'' AS nlmid", "concat('1234-', p_size) AS issn", "'' AS publisher")


JOURNAL_SQL = f"'{graph.BASE}journal/' || {SLUG.format(chr(40) + 'CASE WHEN p_partkey % 2 = 0 THEN ' + repr('J ') + ' || p_brand ELSE p_brand END' + chr(41))}"
QUERIES["journal_triples"] = lambda spark, d: entity_graph.journals(journal_rows(spark, d))
ORACLES["journal_triples"] = iri_rows(JOURNAL_SQL, ("rdf:type", f"'{graph.iri('bibo:Journal')}'", ""), ("dcterms:title", "p_brand", "xsd:string"), ("bibo:shortTitle", "CASE WHEN p_partkey % 2 = 0 THEN 'J ' || p_brand END", "xsd:string"), ("bibo:issn", "'1234-' || p_size", "xsd:string"), source="part", g="publications")


def heading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "concat('Heading ', l_partkey % 50) AS descriptor", "CASE WHEN l_partkey % 2 = 0 THEN concat('D', l_partkey % 50) END AS descriptor_id", "l_partkey % 50 % 4 = 0 AS major", "CASE WHEN l_partkey % 50 % 3 = 0 THEN array(named_struct('name', concat('Qual ', l_partkey % 50), 'major', false)) ELSE CAST(array() AS array<struct<name:string,major:boolean>>) END AS qualifiers")


QUERIES["heading_triples"] = lambda spark, d: entity_graph.headings(heading_rows(spark, d), paper("id"))
NODE_SQL = f"'{graph.BASE}paper/' || l_orderkey || '/mesh/heading-' || l_partkey % 50"
QUALIFIER_SQL = f"CASE WHEN l_partkey % 50 % 3 = 0 THEN {NODE_SQL} || '/qual-' || l_partkey % 50 END"
QUALIFIED = "(SELECT * FROM lineitem WHERE l_partkey % 50 % 3 = 0)"
ORACLES["heading_triples"] = " UNION ".join((
    iri_rows(NODE_SQL, ("rdf:type", f"'{graph.iri('meshv:TopicalDescriptor')}'", ""), ("skos:prefLabel", "'Heading ' || l_partkey % 50", "xsd:string"), ("rdfs:label", "'Heading ' || l_partkey % 50", "xsd:string"), ("dcterms:identifier", "CASE WHEN l_partkey % 2 = 0 THEN 'D' || l_partkey % 50 END", "xsd:string"), ("meshv:majorTopic", "CASE WHEN l_partkey % 50 % 4 = 0 THEN 'true' END", "xsd:boolean"), ("meshv:hasQualifier", QUALIFIER_SQL, ""), source="lineitem", g="publications"),
    iri_rows(f"'{graph.BASE}paper/' || l_orderkey", ("dcterms:subject", NODE_SQL, ""), source="lineitem", g="publications"),
    iri_rows(QUALIFIER_SQL, ("rdf:type", f"'{graph.iri('meshv:Qualifier')}'", ""), ("skos:prefLabel", "'Qual ' || l_partkey % 50", "xsd:string"), source=QUALIFIED, g="publications"),
))
QUERIES["same_as_links"] = lambda spark, d: entity_graph.same_as(authors_of(spark, d), entity_graph.author_uri(), "authors").select("s", "o")
ORACLES["same_as_links"] = f"SELECT s, o FROM (SELECT DISTINCT {AUTHOR_SQL} AS s, CASE c_custkey % 3 WHEN 0 THEN {ORCID_SQL} WHEN 1 THEN 'https://openalex.org/A' || c_custkey END AS o FROM customer) WHERE o IS NOT NULL"
QUERIES["author_quality_triples"] = lambda spark, d: entity_graph.scored(authors_of(spark, d).withColumns({"affiliation": F.lit(""), "data_sources": F.array(F.lit("registry"), F.lit("catalogue"))}), entity_graph.author_uri(), graph.author_quality(), "2024-01-01T00:00:00Z", "authors")
ORACLES["author_quality_triples"] = iri_rows(
    AUTHOR_SQL, ("kg:qualityScore", "CASE WHEN c_custkey % 3 = 0 THEN '0.9' ELSE '0.7' END", "xsd:decimal"), ("kg:confidenceLevel", "CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'medium' END", "xsd:string"),
    ("kg:lastUpdated", "'2024-01-01T00:00:00Z'", "xsd:dateTime"), ("kg:dataSource", "'registry'", "xsd:string"), ("kg:dataSource", "'catalogue'", "xsd:string"), source="customer", g="authors",
)
