"""Registered queries on what texts and landed search records say: places, citations, entities; with SQL from the keys that the texts are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import entities, places, text
from folioscope.operators import articles, citations, deep_merge, graph, identity, nodes, quarantine, record_graph, search_entities
from folioscope.plans.views import table, view
from folioscope.sources import graph_store
from folioscope.sources.tables import cut, shared_path

QUERIES: dict = {}
#: SQL with the names of the views that it uses.
ORACLES: dict[str, tuple[str, ...]] = {}


def affiliation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "affiliation_texts").select("id", places.institution(F.col("text")).alias("x"))
    return rows.select("id", "x.name", "x.city", "x.state", "x.postal_code", "x.country")


QUERIES["affiliation_places"] = affiliation_places
ORACLES["affiliation_places"] = (
    """SELECT id, CASE id % 6 WHEN 0 THEN 'Dept ' || id % 7 || ', University ' || id % 50 WHEN 1 THEN 'Institute ' || id % 50 WHEN 2 THEN 'College ' || id % 50 WHEN 3 THEN 'Centre ' || id % 50 WHEN 4 THEN 'Hospital ' || id % 50 END AS name,
    CASE id % 6 WHEN 0 THEN 'City ' || id % 30 WHEN 1 THEN 'Town ' || id % 30 WHEN 2 THEN 'Paris' WHEN 4 THEN 'Borough ' || id % 9 END AS city, CASE id % 6 WHEN 0 THEN 'CA' WHEN 1 THEN 'NSW' END AS state,
    CASE id % 6 WHEN 0 THEN '94' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(2000 + id % 500 AS VARCHAR) WHEN 4 THEN 'SW1A 1AA' END AS postal_code, CASE id % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'Australia' WHEN 2 THEN 'France' WHEN 4 THEN 'UK' END AS country FROM affiliation_texts""",
    "affiliation_texts",
)


def shared_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two institutions and their marks in one text, with a contact note at its end."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat('Lab ', o_orderkey % 5, ', Rome, Italy', if(o_orderkey % 2 = 0, ' AND ', ' and '), 'Lab ', o_orderkey % 7, ', Oslo, 0150, Norway. Email: x@y.org') AS text")
    found = rows.select("id", F.posexplode(places.institutions(F.col("text"), F.array(F.lit("1"), F.lit("2")))).alias("pos", "x"))
    return found.select("id", "pos", "x.marker", "x.name", "x.city", "x.postal_code", "x.country")


QUERIES["shared_affiliations"] = shared_affiliations
ORACLES["shared_affiliations"] = (
    """SELECT o_orderkey AS id, CAST(n AS INTEGER) AS pos, CAST(n + 1 AS VARCHAR) AS marker, 'Lab ' || CASE n WHEN 0 THEN o_orderkey % 5 ELSE o_orderkey % 7 END AS name, CASE n WHEN 0 THEN 'Rome' ELSE 'Oslo' END AS city,
    CASE n WHEN 1 THEN '0150' END AS postal_code, CASE n WHEN 0 THEN 'Italy' ELSE 'Norway' END AS country FROM orders, range(2) AS r(n)""",
)


def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.with_fields(view(spark, sf_dir, "citation_texts").select("id", "text")).drop("text")


QUERIES["citation_fields"] = citation_fields
ORACLES["citation_fields"] = (
    """SELECT id, CASE id % 4 WHEN 0 THEN 'Roe A' || id % 7 || ', Poe B' WHEN 1 THEN 'Smith J' WHEN 2 THEN 'Roe A' END AS authors, CASE WHEN id % 4 < 3 THEN title END AS title, CASE id % 4 WHEN 0 THEN 'Annals of Things' WHEN 2 THEN 'Letters' END AS source,
    CASE WHEN id % 4 < 3 THEN y WHEN regexp_matches(CAST(id AS VARCHAR), '^(19|20)[0-9]{2}$') THEN CAST(id AS VARCHAR) END AS year, CASE WHEN id % 4 IN (0, 2) THEN CAST(id % 90 + 1 AS VARCHAR) END AS volume, CASE id % 4 WHEN 0 THEN '5-' || (id % 90 + 7) END AS pages,
    CASE id % 4 WHEN 0 THEN '10.1/' || id END AS doi, CASE id % 4 WHEN 0 THEN CAST(id AS VARCHAR) END AS pmid, CASE id % 4 WHEN 3 THEN 'NOTHING ' || id END AS raw FROM citation_texts""",
    "citation_texts",
)
QUERIES["cited_papers"] = lambda spark, d: citations.cited_papers(view(spark, d, "citation_texts"), view(spark, d, "papers"))
ORACLES["cited_papers"] = (
    """SELECT id, CAST(paper AS BIGINT) AS paper, agrees AS year_agrees FROM (SELECT c.id, p.id AS paper, list_contains(c.years, p.pubYear) AS agrees,
      row_number() OVER (PARTITION BY c.id ORDER BY list_contains(c.years, p.pubYear) DESC, p.id) AS place
    FROM (SELECT id, title, regexp_extract_all(text, '\\b(?:19|20)[0-9]{2}\\b') AS years FROM citation_texts WHERE id % 4 < 3) c JOIN papers p ON c.title = p.title) WHERE place = 1""",
    "citation_texts", "papers",
)


def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of which a title with slips of the pen is found in journal, abstract or title."""
    p = view(spark, sf_dir, "papers")
    slip = F.when(F.col("id") % 3 == 0, F.concat(F.substring("title", 2, 1000), F.lit(" x"))).when(F.col("id") % 3 == 1, F.translate("title", "EI", "IE")).otherwise(F.concat(F.lit("on "), F.substring("title", 1, 9)))
    hay = F.array(*(text.normalized(F.col(c)) for c in ("journalTitle", "abstractText", "title")))
    # exploded, so that no later projection works them out again wherever it names them
    rows = p.select("id", F.explode(F.array(F.struct(text.normalized(slip).alias("needle"), hay.alias("hay")))).alias("x")).select("id", "x.*")
    return rows.select("id", text.any_match(F.col("needle"), F.slice("hay", 1, 2)).alias("elsewhere"), text.any_match(F.col("needle"), F.slice("hay", 3, 1)).alias("in_title"))


QUERIES["fuzzy_matches"] = fuzzy_matches


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search record for each order with lines: suppliers are its authors."""
    author = """named_struct('fullName', x.name, 'firstName', concat('F', x.s % 7), 'lastName', concat('L', x.s), 'initials', 'F',
      'authorId', CASE (x.s + id) % 4 WHEN 0 THEN named_struct('type', 'ORCID', 'value', concat('0000-', x.s)) WHEN 1 THEN named_struct('type', 'X', 'value', 'v') END,
      'authorAffiliationDetailsList', CASE WHEN x.s % 3 <> 0 THEN named_struct('authorAffiliation', array(named_struct('affiliation', concat('Institute ', x.s % 50, ', City ', x.s % 9, ', France')), named_struct('affiliation', ''))) END)"""
    # keys are grouped, and authors made of them afterwards
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "struct(l_linenumber AS n, concat('Author ', l_suppkey) AS name, l_suppkey AS s) AS x")
    grouped = lines.groupBy("id").agg(F.expr("array_sort(collect_list(x))").alias("xs")).select("id", F.expr(f"transform(xs, x -> {author})").alias("authors"))
    record = """to_json(named_struct('id', CAST(id AS STRING), 'doi', concat(' https://doi.org/10.9/', id), 'pmid', concat('77', id), 'title', CASE WHEN id % 4 <> 0 THEN concat(' Work ', id) END, 'journalTitle', 'Old name',
      'pubYear', CAST(1990 + id % 30 AS STRING), 'citedByCount', CASE WHEN id % 3 = 0 THEN 'x' ELSE CAST(id % 40 AS STRING) END, 'isOpenAccess', CASE WHEN id % 2 = 0 THEN 'Y' ELSE 'N' END,
      'journalInfo', CASE WHEN id % 5 <> 1 THEN named_struct('volume', CAST(id % 9 AS STRING), 'journal', named_struct('title', concat('Journal ', id % 8))) END, 'pubTypeList', named_struct('pubType', array('review', 'x')),
      'authorList', named_struct('author', authors), 'authorIdList', CASE WHEN id % 5 = 0 THEN named_struct('authorId', array(named_struct('type', 'ORCID', 'value', concat('1111-', id)), named_struct('type', 'OTHER', 'value', 'z'), named_struct('type', 'ORCID', 'value', concat('2222-', id)))) END,
      'meshHeadingList', CASE WHEN id % 3 <> 1 THEN named_struct('meshHeading', array(named_struct('descriptorName', concat('D', id % 20), 'majorTopic_YN', CASE WHEN id % 2 = 0 THEN 'Y' ELSE 'N' END, 'meshQualifierList', CASE WHEN id % 4 = 0 THEN named_struct('meshQualifier', array(named_struct('qualifierName', 'therapy', 'majorTopic_YN', 'Y'), named_struct('qualifierName', concat('q', id % 6), 'majorTopic_YN', 'N'))) END),
        named_struct('descriptorName', CAST(NULL AS STRING), 'majorTopic_YN', 'Y', 'meshQualifierList', NULL))) END,
      'grantsList', CASE WHEN id % 4 = 0 THEN named_struct('grant', array(named_struct('agency', concat(' Agency ', id % 7, ' '), 'grantId', concat('G', id)))) END,
      'fullTextUrlList', named_struct('fullTextUrl', array(named_struct('availabilityCode', 'S', 'url', 'u'), named_struct('availabilityCode', CASE WHEN id % 2 = 0 THEN 'OA' ELSE 'S' END, 'url', concat('http://x/', id))))))"""
    keywords = """CASE id % 3 WHEN 0 THEN concat(',"keywordList":{"keyword":["kw', id % 10, '","common"]}}') WHEN 1 THEN concat(',"keywordList":{"keyword":"single ', id % 10, '"}}') ELSE '}' END"""
    texts = grouped.selectExpr("id", f"{record} AS json").selectExpr("id", f"concat(substring(json, 1, length(json) - 1), {keywords}) AS json")
    return search_entities.records(texts)


QUERIES["search_authors"] = lambda spark, d: search_entities.authors(search_records(spark, d)).withColumn("affiliations", F.array_join("affiliations", ";"))
ORCID = "CASE WHEN (l_suppkey + l_orderkey) % 4 = 0 THEN '0000-' || l_suppkey END"
AUTHOR_ROWS = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Author ' || l_suppkey) - 1 AS INTEGER) AS pos, {ORCID} AS own, CASE WHEN l_suppkey % 3 <> 0 THEN 'Institute ' || l_suppkey % 50 || ', City ' || l_suppkey % 9 || ', France' END AS told,
    sum(CASE WHEN (l_suppkey + l_orderkey) % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Author ' || l_suppkey ROWS UNBOUNDED PRECEDING) AS turn FROM lineitem)"""
ORACLES["search_authors"] = (
    f"""SELECT l_orderkey AS id, pos, 'Author ' || l_suppkey AS full_name, 'F' || l_suppkey % 7 AS first_name, 'L' || l_suppkey AS last_name, 'F' AS initials,
    coalesce(own, CASE WHEN l_orderkey % 5 = 0 THEN CASE turn WHEN 1 THEN '1111-' || l_orderkey WHEN 2 THEN '2222-' || l_orderkey END END) AS orcid, told AS affiliations FROM {AUTHOR_ROWS}""",
)
QUERIES["search_institutions"] = lambda spark, d: search_entities.institutions(search_entities.authors(search_records(spark, d))).select("id", "pos", "name", "city", "country")
ORACLES["search_institutions"] = (f"SELECT l_orderkey AS id, pos, 'Institute ' || l_suppkey % 50 AS name, 'City ' || l_suppkey % 9 AS city, 'France' AS country FROM {AUTHOR_ROWS} WHERE told IS NOT NULL",)
KNOWN = "(SELECT DISTINCT l_orderkey AS id FROM lineitem)"
QUERIES["search_keywords"] = lambda spark, d: search_entities.keywords(search_records(spark, d))
ORACLES["search_keywords"] = (
    f"""SELECT id, CAST(n AS INTEGER) AS pos, k[n + 1] AS keyword FROM (SELECT id, list_concat(CASE id % 3 WHEN 0 THEN ['kw' || id % 10, 'common'] WHEN 1 THEN ['single ' || id % 10] ELSE [] END, CASE WHEN id % 3 <> 1 AND id % 2 = 0 THEN ['MeSH:D' || id % 20] ELSE [] END) AS k FROM {KNOWN}), range(3) AS r(n) WHERE n < len(k)""",
)
QUERIES["search_headings"] = lambda spark, d: search_entities.headings(search_records(spark, d)).select("id", "pos", "descriptor", "major", F.size("qualifiers").alias("n_qualifiers"), F.get("qualifiers", F.lit(0))["major"].alias("first_major"), "full_term")
ORACLES["search_headings"] = (
    f"""SELECT id, CAST(0 AS INTEGER) AS pos, 'D' || id % 20 AS descriptor, id % 2 = 0 AS major, CAST(CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_qualifiers, CASE WHEN id % 4 = 0 THEN true END AS first_major,
    'D' || id % 20 || CASE WHEN id % 4 = 0 THEN '/therapy/q' || id % 6 ELSE '' END AS full_term FROM {KNOWN} WHERE id % 3 <> 1""",
)
QUERIES["search_grants"] = lambda spark, d: search_entities.grants(search_records(spark, d))
ORACLES["search_grants"] = (f"SELECT id, CAST(0 AS INTEGER) AS pos, 'Agency ' || id % 7 AS agency, 'G' || id AS grant_id, CAST(NULL AS VARCHAR) AS acronym FROM {KNOWN} WHERE id % 4 = 0",)
QUERIES["search_papers"] = lambda spark, d: search_entities.papers(search_records(spark, d)).select("id", "doi", "pmid", "title", "journal", "volume", "year", "pub_type", "cited_by", "is_oa", "oa_url")
ORACLES["search_papers"] = (
    f"""SELECT id, '10.9/' || id AS doi, CASE WHEN length('77' || id) BETWEEN 6 AND 10 THEN '77' || id END AS pmid, CASE WHEN id % 4 <> 0 THEN 'Work ' || id END AS title, CASE WHEN id % 5 <> 1 THEN 'Journal ' || id % 8 ELSE 'Old name' END AS journal, CASE WHEN id % 5 <> 1 THEN CAST(id % 9 AS VARCHAR) END AS volume,
    CAST(1990 + id % 30 AS INTEGER) AS year, 'review' AS pub_type, CASE WHEN id % 3 <> 0 THEN id % 40 END AS cited_by, id % 2 = 0 AS is_oa, CASE WHEN id % 2 = 0 THEN 'http://x/' || id END AS oa_url FROM {KNOWN}""",
)


def author_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of all records: one where an ORCID agrees, or name and first affiliation."""
    rows = search_entities.authors(search_records(spark, sf_dir))
    first = F.get("affiliations", F.lit(0))
    mentions = rows.select((F.col("id") * 16 + F.col("pos")).alias("mention"), "full_name", "orcid", F.concat_ws("|", search_entities.name_key(F.col("full_name")), F.when(first.isNotNull(), search_entities.name_key(first))).alias("key"), first.isNotNull().alias("told"))
    keys = {"orcid": F.col("orcid"), "name": F.when(F.col("told"), F.col("key"))}
    return identity.described(identity.resolved(mentions, "mention", keys), ["full_name"])


QUERIES["author_entities"] = author_entities
ORACLES["author_entities"] = (
    f"""SELECT CAST(entity AS BIGINT) AS entity, count(*) AS mentions, min(full_name) AS full_name FROM (SELECT 'Author ' || l_suppkey AS full_name, CASE WHEN told IS NOT NULL THEN min(l_orderkey * 16 + pos) OVER (PARTITION BY l_suppkey)
      WHEN own IS NOT NULL THEN min(l_orderkey * 16 + pos) OVER (PARTITION BY l_suppkey, own IS NULL) ELSE l_orderkey * 16 + pos END AS entity FROM {AUTHOR_ROWS}) GROUP BY 1""",
)


def institution_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions of all lines, named by one or two of four identifiers each time."""
    form = "(l_orderkey + l_linenumber) % 4"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 16 + l_linenumber AS mention", f"CASE {form} WHEN 0 THEN concat('r', l_suppkey) END AS ror", f"CASE WHEN {form} < 2 THEN concat('g', l_suppkey) END AS grid", f"CASE WHEN {form} IN (1, 2) THEN concat('i', l_suppkey DIV 2) END AS isni", f"CASE {form} WHEN 2 THEN concat('Inst ', l_suppkey DIV 2) WHEN 3 THEN CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('INST  ', l_suppkey DIV 2) END END AS name")
    keys = {"ror": F.col("ror"), "grid": F.col("grid"), "isni": F.col("isni"), "name": search_entities.name_key(F.col("name"))}
    return identity.described(identity.resolved(rows, "mention", keys), ["ror", "grid", "isni", "name"])


QUERIES["institution_entities"] = institution_entities
FORM = "(l_orderkey + l_linenumber) % 4"
ORACLES["institution_entities"] = (
    f"""SELECT * FROM (WITH RECURSIVE m AS (SELECT l_orderkey * 16 + l_linenumber AS id, CASE {FORM} WHEN 0 THEN 'r' || l_suppkey END AS ror, CASE WHEN {FORM} < 2 THEN 'g' || l_suppkey END AS grid, CASE WHEN {FORM} IN (1, 2) THEN 'i' || l_suppkey // 2 END AS isni,
      CASE {FORM} WHEN 2 THEN 'Inst ' || l_suppkey // 2 WHEN 3 THEN CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'INST  ' || l_suppkey // 2 END END AS name FROM lineitem),
    n AS (SELECT min(id) AS node, ror, grid, isni, nullif(lower(replace(name, '  ', ' ')), '') AS known FROM m GROUP BY 2, 3, 4, 5),
    k AS (SELECT node, 'r' || ror AS key FROM n UNION SELECT node, 'g' || grid FROM n UNION SELECT node, 'i' || isni FROM n UNION SELECT node, 'n' || known FROM n),
    e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM k a JOIN k b ON a.key = b.key),
    r AS (SELECT node, node AS other FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
    c AS (SELECT node, min(other) AS entity FROM r GROUP BY node),
    x AS (SELECT CASE WHEN n.ror IS NULL AND n.grid IS NULL AND n.isni IS NULL AND n.known IS NULL THEN m.id ELSE c.entity END AS entity, m.* FROM m JOIN n ON m.ror IS NOT DISTINCT FROM n.ror AND m.grid IS NOT DISTINCT FROM n.grid AND m.isni IS NOT DISTINCT FROM n.isni AND nullif(lower(replace(m.name, '  ', ' ')), '') IS NOT DISTINCT FROM n.known JOIN c ON c.node = n.node),
    v AS (SELECT entity, name, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, name) AS place FROM x WHERE name <> '' GROUP BY 1, 2),
    o AS (SELECT entity, ror, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, ror) AS place FROM x WHERE ror <> '' GROUP BY 1, 2),
    g AS (SELECT entity, grid, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, grid) AS place FROM x WHERE grid <> '' GROUP BY 1, 2),
    i AS (SELECT entity, isni, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, isni) AS place FROM x WHERE isni <> '' GROUP BY 1, 2)
    SELECT t.entity, t.mentions, o.ror, g.grid, i.isni, v.name FROM (SELECT CAST(entity AS BIGINT) AS entity, count(*) AS mentions FROM x GROUP BY 1) t
    LEFT JOIN v ON v.entity = t.entity AND v.place = 1 LEFT JOIN o ON o.entity = t.entity AND o.place = 1 LEFT JOIN g ON g.entity = t.entity AND g.place = 1 LEFT JOIN i ON i.entity = t.entity AND i.place = 1)""",
)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a record for each order."""
    texts = """CASE n WHEN 0 THEN concat('{"a":', k % 3, ',"b":{"c":', k % 5, ',"d":"x"}}') WHEN 1 THEN CASE WHEN k % 4 = 0 THEN '{"b":"flat"}' WHEN k % 4 = 1 THEN 'broken' ELSE concat('{"b":{"e":[', k % 7, ']}}') END
      ELSE CASE WHEN k % 6 = 0 THEN '{"a":{"n":1},"b":{"f":{}}}' WHEN k % 6 = 1 THEN '{"a":null}' ELSE '{}' END END"""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "explode(array(0, 1, 2)) AS n").selectExpr("k AS id", "n AS seq", f"{texts} AS json")


QUERIES["merged_records"] = lambda spark, d: deep_merge.merged(versions(spark, d))
ORACLES["merged_records"] = (
    """SELECT k AS id, '{"a":' || CASE k % 6 WHEN 0 THEN '{"n":1}' WHEN 1 THEN 'null' ELSE CAST(k % 3 AS VARCHAR) END || ',"b":' || CASE WHEN k % 4 = 0 AND k % 6 <> 0 THEN '"flat"'
      ELSE '{' || concat_ws(',', CASE WHEN k % 4 <> 0 THEN '"c":' || k % 5 || ',"d":"x"' END, CASE WHEN k % 4 > 1 THEN '"e":[' || k % 7 || ']' END, CASE WHEN k % 6 = 0 THEN '"f":{}' END) || '}' END || '}' AS json FROM (SELECT o_orderkey AS k FROM orders)""",
)


def landed_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is set apart of records of which some are broken."""
    text = """CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '{"id":' WHEN 3 THEN '[1]' WHEN 4 THEN '{}' WHEN 5 THEN '{"id":" "}' ELSE concat('{"id":', event_id, '}') END"""
    rows = view(spark, sf_dir, "api_log").selectExpr("event_id", f"{text} AS json")
    path = shared_path(spark, "landed")
    quarantine.set_apart(rows, path)
    return spark.read.parquet(path).select("event_id", "fault", F.col("quarantined").cast("boolean").alias("quarantined"))


QUERIES["landed_faults"] = landed_faults
ORACLES["landed_faults"] = ("SELECT event_id, ['null', 'empty', 'no json', 'no object', 'no fields', 'no id', NULL, NULL][event_id % 8 + 1] AS fault, event_id % 8 < 6 AS quarantined FROM api_log", "api_log")


def article_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of articles made of documents: a section for each line, with a section inside of it and a list of items."""
    plain = F.regexp_replace("abstract", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]", "")
    escaped = F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    section = lambda p, i: F.concat(F.lit("<sec id='s"), i.cast("string"), F.lit("'><title>S"), i.cast("string"), F.lit("</title><p>"), p, F.lit("</p><sec kind='inner'><title>I"), i.cast("string"), F.lit("</title><p>note <b>"), i.cast("string"), F.lit("</b></p></sec></sec>"))
    xml = F.concat(F.lit("<!DOCTYPE article><article xml:lang='en'><front><article-title>T "), F.col("doc_id").cast("string"), F.lit("</article-title></front><body>"), F.array_join(F.transform(F.split(escaped, "\n"), section), ""), F.lit("</body></article>"))
    docs = view(spark, sf_dir, "docs").select("doc_id", xml.alias("xml"))
    return cut(nodes.shred(docs, "doc_id", "xml"), "nodes")


PATTERNS = {"title": "front/article-title", "outer": "body/sec/title", "inner": ".//sec[@id]/sec/title", "note": ".//sec[@kind='inner']//b", "identified": ".//body/sec[@id]"}
QUERIES["element_patterns"] = lambda spark, d: nodes.by_patterns(article_nodes(spark, d), PATTERNS, {"identified": "id"})
LINES = "(SELECT doc_id, CAST(unnest(range(len(string_split(abstract, chr(10))))) AS INTEGER) AS i FROM docs WHERE abstract IS NOT NULL)"
ORACLES["element_patterns"] = (
    f"""SELECT doc_id AS doc, 'title' AS field, CAST(0 AS INTEGER) AS pos, 'T ' || doc_id AS value FROM docs WHERE abstract IS NOT NULL UNION ALL SELECT doc_id, f, i, CASE f WHEN 'outer' THEN 'S' || i WHEN 'inner' THEN 'I' || i WHEN 'note' THEN CAST(i AS VARCHAR) ELSE 's' || i END
    FROM {LINES}, (SELECT unnest(['outer', 'inner', 'note', 'identified']) AS f)""",
    "docs",
)
QUERIES["nested_sections"] = lambda spark, d: nodes.sections(article_nodes(spark, d)).select("doc", "pos", F.col("parent_section").isNotNull().alias("inside"), "title", F.when(F.col("parent_section").isNotNull(), F.col("content")).alias("inner_content"), F.length(F.regexp_replace("content", "\\s", "")).alias("n"))
ORACLES["nested_sections"] = (
    f"""SELECT doc_id AS doc, CAST(2 * i + k AS INTEGER) AS pos, k = 1 AS inside, CASE k WHEN 0 THEN 'S' ELSE 'I' END || i AS title, CASE k WHEN 1 THEN 'note ' || i END AS inner_content, CAST(CASE k WHEN 1 THEN 4 + length(CAST(i AS VARCHAR)) ELSE length(regexp_replace(line, '[\\s\\x00-\\x1f\\x{{1c}}-\\x{{1f}}]', '', 'g')) END AS INTEGER) AS n
    FROM (SELECT doc_id, i, string_split(abstract, chr(10))[i + 1] AS line FROM (SELECT l.doc_id, l.i, d.abstract FROM {LINES} l JOIN docs d ON l.doc_id = d.doc_id)), range(2) AS r(k)""",
    "docs",
)


def grown_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers' graph, stored from a part of them and grown by two increments that overlap it and each other."""
    papers = cut(view(spark, sf_dir, "papers").select("id", graph.paper_uri().alias("s"), *graph.PAPER_FIELDS).where("s is not null"), "papers")
    rows = lambda test: papers.where(test).select("s", F.struct(*graph.PAPER_FIELDS).alias("row"))
    path = shared_path(spark, "graph")
    made = {"kinds": graph.PAPER_KINDS, "facts": graph.paper_facts}
    graph_store.store(rows("id % 3 <> 0"), path, **made)
    graph_store.add(rows("id % 6 <> 1"), path, **made)
    graph_store.add(rows("id % 2 = 1"), path, **made)
    return graph_store.stored(spark, path).drop("bucket")


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers' graph and that of their references, read back from Turtle files."""
    path = shared_path(spark, "turtle")
    graph_store.write_turtle(graph.paper_triples(view(spark, sf_dir, "papers")), path)
    return graph_store.read_turtle(spark, path)


PAPER_GRAPH = " UNION ".join(
    f"SELECT CASE WHEN coalesce(doi, '') <> '' THEN '{graph.BASE}doi/' || doi ELSE '{graph.BASE}paper/' || id END AS s, '{graph.iri(p)}' AS p, CAST({c} AS VARCHAR) AS o, 'literal' AS o_kind, '{graph.iri(t)}' AS o_datatype, 'publications' AS g FROM papers WHERE CAST({c} AS VARCHAR) <> ''"
    for c, (p, t) in graph.PAPER_FIELDS.items()
)
QUERIES |= {"grown_graph": grown_graph, "graph_files": graph_files}
ORACLES |= {"grown_graph": (f"SELECT * FROM ({PAPER_GRAPH})", "papers"), "graph_files": (f"SELECT * FROM ({PAPER_GRAPH})", "papers")}


def article_rows(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Node rows of an article for each order, as far as functions ``parts`` of ``articles`` read them: suppliers as authors, parts as references and table cells.

    They are written where several looks at them follow. Where all parts go by owners, each article is one row.
    """
    line = """struct(l_linenumber AS n, l_suppkey AS s, l_partkey AS p)"""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", f"{line} AS x").groupBy("k").agg(F.expr("array_sort(collect_list(x)) AS xs"))
    each = lambda body: f"array_join(transform(xs, (x, i) -> concat({body})), '')"
    people = each("""'<contrib contrib-type="', if(x.s % 11 = 0, 'editor', 'author'), '">', if(x.s % 2 = 0, concat('<contrib-id contrib-id-type="orcid">https://orcid.org/0-', x.s, '</contrib-id>'), ''), '<name><surname>L', x.s, '</surname><given-names>G', x.s % 7, '</given-names></name><xref ref-type="aff" rid="a', i, '"/><xref ref-type="fn" rid="a0"/></contrib>'""")
    homes = each("""'<aff id="a', i, '"><sup>', i + 1, '</sup> Institute ', x.s % 50, ', City ', x.s % 9, ', France</aff>'""")
    refs = each("""'<ref id="r', i, '">', if(x.p % 2 = 0, concat('<element-citation><person-group><name><surname>Roe</surname></name></person-group><article-title>Part ', x.p, '</article-title><source>J</source><fpage>1</fpage><lpage>', x.p % 9, '</lpage><pub-id pub-id-type="doi">10.9/', x.p, '</pub-id></element-citation>'), concat('<mixed-citation>Roe A, et al. Title ', x.p, '. Annals of X. 2001;12:3-4. doi:10.8/', x.p, '</mixed-citation>')), '</ref>'""")
    rows = each("""'<tr><th>', i, '</th><td>', x.s, '</td><td>', x.p, '</td></tr>'""")
    xml = f"""concat('<article article-type="research"><front><journal-meta><publisher><publisher-name>Pub ', k % 7, '</publisher-name>', if(k % 3 = 0, '<publisher-loc>Here</publisher-loc>', ''), '</publisher></journal-meta><article-meta><article-categories><subj-group subj-group-type="heading"><subject>S', k % 5, '</subject><subject>Two</subject></subj-group><subj-group><subject/></subj-group></article-categories><contrib-group>',
      {people}, '</contrib-group>', {homes}, '</article-meta></front><body><table-wrap><table>', {rows}, '</table></table-wrap></body><back><ref-list>', {refs}, '</ref-list></back></article>')"""
    tags = tuple(dict.fromkeys(t for part in parts for t in articles.TAGS[part]))
    owners = {o: inner for part in parts for o, inner in articles.OWNERS[part].items()} if articles.OWNERS.keys() >= set(parts) else None
    found = nodes.shred(lines.selectExpr("k", f"{xml} AS xml"), "k", "xml", tags, owners)
    return cut(found, "nodes") if len(parts) > 1 else found


LISTED = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS INTEGER) AS i FROM lineitem)"
QUERIES["article_authors"] = lambda spark, d: articles.authors(article_rows(spark, d, "authors")).select("doc", "pos", "name", "orcid", "affiliation_text", F.get("institutions", F.lit(0))["name"].alias("institution"), F.get("institutions", F.lit(0))["city"].alias("city"))
ORACLES["article_authors"] = (
    f"""SELECT l_orderkey AS doc, i AS pos, 'G' || l_suppkey % 7 || ' L' || l_suppkey AS name, CASE WHEN l_suppkey % 2 = 0 THEN '0-' || l_suppkey END AS orcid, 'Institute ' || l_suppkey % 50 || ', City ' || l_suppkey % 9 || ', France' AS affiliation_text,
    'Institute ' || l_suppkey % 50 AS institution, 'City ' || l_suppkey % 9 AS city FROM {LISTED} WHERE l_suppkey % 11 <> 0""",
)
QUERIES["article_references"] = lambda spark, d: articles.references(article_rows(spark, d, "references"))
ORACLES["article_references"] = (
    f"""SELECT l_orderkey AS doc, i AS pos, 'r' || i AS id, CASE WHEN e THEN 'Roe' ELSE 'Roe A' END AS authors, CASE WHEN e THEN 'Part ' ELSE 'Title ' END || l_partkey AS title, CASE WHEN e THEN 'J' ELSE 'Annals of X' END AS source, CASE WHEN NOT e THEN '2001' END AS year, CASE WHEN NOT e THEN '12' END AS volume,
    CASE WHEN e THEN '1-' || l_partkey % 9 ELSE '3-4' END AS pages, CASE WHEN e THEN '10.9/' ELSE '10.8/' END || l_partkey AS doi, CAST(NULL AS VARCHAR) AS pmid, CAST(NULL AS VARCHAR) AS raw FROM (SELECT *, l_partkey % 2 = 0 AS e FROM {LISTED})""",
)
QUERIES["article_categories"] = lambda spark, d: articles.categories(article_rows(spark, d, "categories")).withColumn("subjects", F.array_join("subjects", ","))
ORACLES["article_categories"] = ("SELECT DISTINCT l_orderkey AS doc, CAST(0 AS INTEGER) AS pos, 'research' AS article_type, 'heading' AS group_type, 'S' || l_orderkey % 5 || ',Two' AS subjects FROM lineitem",)
QUERIES["article_publishers"] = lambda spark, d: articles.publishers(article_rows(spark, d, "publishers"))
ORACLES["article_publishers"] = ("SELECT DISTINCT l_orderkey AS doc, 'Pub ' || l_orderkey % 7 AS name, CASE WHEN l_orderkey % 3 = 0 THEN 'Here' END AS location FROM lineitem",)
QUERIES["article_cells"] = lambda spark, d: articles.cells(article_rows(spark, d, "cells"))
ORACLES["article_cells"] = (f"""SELECT l_orderkey AS doc, CAST(0 AS INTEGER) AS "table", i AS row, CAST(n AS INTEGER) AS place, n = 0 AS header, CAST(CASE n WHEN 0 THEN i WHEN 1 THEN l_suppkey ELSE l_partkey END AS VARCHAR) AS text FROM {LISTED}, range(3) AS r(n)""",)


QUERIES["record_triples"] = lambda spark, d: record_graph.search_graph(search_records(spark, d))
SUBJECT = f"'{graph.BASE}doi/10.9/' || id"
NODE = f"'{graph.BASE}author/author-' || l_suppkey"
MESH = "'http://id.nlm.nih.gov/mesh/D' || id % 20"


def triple_sql(s: str, p: str, o: str, datatype: str, g: str, source: str) -> str:
    kind = "'literal'" if datatype else "'iri'"
    return f"SELECT {s} AS s, '{graph.iri(p)}' AS p, {o} AS o, {kind} AS o_kind, {repr(graph.iri(datatype)) if datatype else 'CAST(NULL AS VARCHAR)'} AS o_datatype, '{g}' AS g FROM {source} WHERE coalesce({o}, '') <> ''"


PEOPLE, FUNDED, HEADED = "(SELECT DISTINCT l_orderkey AS id, l_suppkey FROM lineitem)", f"(SELECT * FROM {KNOWN} WHERE id % 4 = 0)", f"(SELECT * FROM {KNOWN} WHERE id % 3 <> 1)"
GRANT = f"'{graph.BASE}grant/agency-' || id % 7 || '-g' || id"
RECORD_SQL = " UNION ".join((
    triple_sql(SUBJECT, "rdf:type", f"'{graph.iri('bibo:AcademicArticle')}'", "", "publications", KNOWN), triple_sql(SUBJECT, "dcterms:title", "CASE WHEN id % 4 <> 0 THEN 'Work ' || id END", "xsd:string", "publications", KNOWN),
    triple_sql(SUBJECT, "bibo:doi", "'10.9/' || id", "xsd:string", "publications", KNOWN), triple_sql(SUBJECT, "dcterms:issued", "CAST(1990 + id % 30 AS VARCHAR)", "xsd:gYear", "publications", KNOWN),
    triple_sql(SUBJECT, "dcterms:isPartOf", "CASE WHEN id % 5 <> 1 THEN 'Journal ' || id % 8 ELSE 'Old name' END", "xsd:string", "publications", KNOWN),
    triple_sql(NODE, "rdf:type", f"'{graph.iri('foaf:Person')}'", "", "authors", PEOPLE), triple_sql(NODE, "foaf:name", "'Author ' || l_suppkey", "xsd:string", "authors", PEOPLE), triple_sql(SUBJECT, "dcterms:creator", NODE, "", "authors", PEOPLE), triple_sql(NODE, "foaf:made", SUBJECT, "", "authors", PEOPLE),
    triple_sql(GRANT, "rdf:type", f"'{graph.iri('frapo:Grant')}'", "", "publications", FUNDED), triple_sql(GRANT, "frapo:hasFundingAgency", "'Agency ' || id % 7", "xsd:string", "publications", FUNDED), triple_sql(GRANT, "datacite:identifier", "'G' || id", "xsd:string", "publications", FUNDED),
    triple_sql(GRANT, "frapo:funds", SUBJECT, "", "publications", FUNDED), triple_sql(SUBJECT, "foaf:fundedBy", GRANT, "", "publications", FUNDED),
    triple_sql(MESH, "rdf:type", f"'{graph.iri('meshv:Descriptor')}'", "", "publications", HEADED), triple_sql(MESH, "skos:prefLabel", "'D' || id % 20", "xsd:string", "publications", HEADED), triple_sql(SUBJECT, "meshv:hasDescriptor", MESH, "", "publications", HEADED),
    triple_sql(SUBJECT, "meshv:hasDescriptor", "'single ' || id % 10", "xsd:string", "publications", f"(SELECT * FROM {KNOWN} WHERE id % 3 = 1)"),
))
ORACLES["record_triples"] = (f"SELECT * FROM ({RECORD_SQL})",)


def combined_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, articles and papers as one graph."""
    rows = article_rows(spark, sf_dir, "authors", "references")
    return record_graph.whole_graph(search_records(spark, sf_dir), articles.authors(rows), articles.references(rows), F.concat(F.lit(graph.BASE + "doi/10.9/"), F.col("doc").cast("string")))


QUERIES["combined_graph"] = combined_graph
WRITER = f"'{graph.BASE}author/g' || l_suppkey % 7 || '-l' || l_suppkey"
ORG = f"'{graph.BASE}org/' || md5('Institute ' || l_suppkey % 50)[1:16]"
WRITERS, CITING = "(SELECT l_orderkey AS id, l_suppkey FROM lineitem WHERE l_suppkey % 11 <> 0)", "(SELECT l_orderkey AS id, l_partkey, l_partkey % 2 = 0 AS e FROM lineitem)"
CITED_SQL = f"'{graph.BASE}reference/' || CASE WHEN e THEN '10.9/' ELSE '10.8/' END || l_partkey"
ORACLES["combined_graph"] = (
    f"SELECT * FROM ({RECORD_SQL}) UNION " + " UNION ".join((
        triple_sql(WRITER, "rdf:type", f"'{graph.iri('foaf:Person')}'", "", "authors", WRITERS), triple_sql(WRITER, "foaf:name", "'G' || l_suppkey % 7 || ' L' || l_suppkey", "xsd:string", "authors", WRITERS), triple_sql(SUBJECT, "dcterms:creator", WRITER, "", "authors", WRITERS), triple_sql(WRITER, "foaf:made", SUBJECT, "", "authors", WRITERS),
        triple_sql(ORG, "rdf:type", f"'{graph.iri('org:Organization')}'", "", "institutions", WRITERS), triple_sql(ORG, "skos:prefLabel", "'Institute ' || l_suppkey % 50", "xsd:string", "institutions", WRITERS), triple_sql(WRITER, "org:memberOf", ORG, "", "institutions", WRITERS),
        triple_sql(CITED_SQL, "rdf:type", f"'{graph.iri('bibo:Article')}'", "", "publications", CITING), triple_sql(CITED_SQL, "dcterms:title", "CASE WHEN e THEN 'Part ' ELSE 'Title ' END || l_partkey", "xsd:string", "publications", CITING), triple_sql(CITED_SQL, "bibo:authorList", "CASE WHEN e THEN 'Roe' ELSE 'Roe A' END", "xsd:string", "publications", CITING),
        triple_sql(CITED_SQL, "dcterms:issued", "CASE WHEN NOT e THEN '2001' END", "xsd:gYear", "publications", CITING), triple_sql(CITED_SQL, "bibo:doi", "CASE WHEN e THEN '10.9/' ELSE '10.8/' END || l_partkey", "xsd:anyURI", "publications", CITING),
        triple_sql(SUBJECT, "cito:cites", CITED_SQL, "", "publications", CITING), triple_sql(CITED_SQL, "cito:isCitedBy", SUBJECT, "", "publications", CITING),
    )),
)


def normal_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions of suppliers with odd spellings, in their normal form."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat(' ', s_name, ' ') AS display_name", "CASE s_suppkey % 4 WHEN 0 THEN ' usa' WHEN 1 THEN '12' WHEN 2 THEN 'x' ELSE concat('NATION ', s_nationkey) END AS country", "CASE WHEN s_suppkey % 2 = 0 THEN concat(' https://ror.org/0', s_suppkey) ELSE 'ror.org/x' END AS ror_id", "' City ' AS city")
    return entities.normalized(rows, "institution")


QUERIES["normal_institutions"] = normal_institutions
ORACLES["normal_institutions"] = ("SELECT s_suppkey, trim(s_name) AS display_name, CASE s_suppkey % 4 WHEN 0 THEN 'United States' WHEN 3 THEN 'Nation ' || s_nationkey END AS country, CASE WHEN s_suppkey % 2 = 0 THEN 'https://ror.org/0' || s_suppkey END AS ror_id, 'City' AS city FROM supplier",)
