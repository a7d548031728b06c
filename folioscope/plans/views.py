"""Literature views over the driver's tables, from one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

#: How each engine joins a group's distinct names in order.
NAMES = {
    "spark": "array_join(array_sort(collect_set(s_name)), ', ')",
    "duckdb": "array_to_string(list_sort(list(DISTINCT s_name)), ', ')",
}

PAPERS = """
SELECT o.o_orderkey AS id, o.o_orderkey AS pos,
  c.c_mktsegment || ' ' || o.o_orderpriority || ' ' || CAST(o.o_orderkey % 1999 AS STRING) AS title,
  CASE WHEN o.o_orderkey % 17 = 0 THEN '' ELSE 'Cohort of ' || n.n_name || ' by ' || c.c_name END AS abstractText,
  CASE WHEN o.o_orderkey % 23 = 0 THEN '' WHEN o.o_orderkey % 29 = 0 THEN 'n.d.' ELSE CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) END AS pubYear,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'journal article' WHEN 1 THEN 'review; journal article' WHEN 2 THEN 'letter' ELSE 'clinical trial ; preprint' END AS pubType,
  CASE WHEN o.o_orderkey % 31 = 0 THEN '' WHEN o.o_orderkey % 37 = 0 THEN 'Journal Title' ELSE ' ' || c.c_mktsegment || ' ' || CAST(o.o_orderkey % 12 AS STRING) END AS journalTitle,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS isOpenAccess,
  COALESCE(l.n, 0) AS citedByCount,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 11 = 0 THEN '' ELSE '10.1234/' || CAST(o.o_orderkey % 997 AS STRING) END AS doi,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE c.c_name || ' Institute, ' || n.n_name || CASE WHEN o.o_orderkey % 4 = 0 THEN '; Hospital ' || CAST(o.o_orderkey % 50 AS STRING) || ', Ward 3, NATION_' || CAST(o.o_orderkey % 25 AS STRING) ELSE '' END END AS affiliation,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'cc-by' WHEN 1 THEN 'CC-BY-NC 4.0' WHEN 2 THEN ' cc0' WHEN 4 THEN 'Publisher copyright' WHEN 5 THEN 'none' END AS license,
  CASE WHEN o.o_orderkey % 9 = 0 THEN '' ELSE 'Agency ' || CAST(o.o_orderkey % 40 AS STRING) || CASE WHEN o.o_orderkey % 3 = 0 THEN '; Agency ' || CAST(o.o_orderkey % 11 AS STRING) ELSE '; none' END END AS grants,
  o.o_orderkey % 17 <> 0 AS hasAbstract, o.o_orderkey % 2 = 0 AS hasPDF, o.o_orderkey % 3 = 0 AS inPMC, o.o_orderkey % 5 = 0 AS inEPMC,
  a.authorString
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT l_orderkey, {names} AS authorString FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_orderkey) a ON a.l_orderkey = o.o_orderkey
"""

NET_AUTHORS = "SELECT DISTINCT l_orderkey AS paper, l_partkey AS author FROM {lineitem}"

CITATIONS = "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM {lineitem}"

DOCS = """
SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.lang, d.source, l.quality AS relevant
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: Three overlapping descriptions of parts, with gaps and conflicts.
SOURCE_A = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS journal, p_size AS cited, '10.1/' || CAST(p_partkey AS STRING) AS doi FROM {part} WHERE p_partkey % 2 = 0"
SOURCE_B = "SELECT p_partkey AS id, p_name || ' b' AS title, p_type AS journal, p_size + 1 AS cited, 'https://doi.org/10.1/' || CAST(p_partkey % 100 AS STRING) AS doi FROM {part} WHERE p_partkey % 3 = 0"
SOURCE_C = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name || ' c' END AS title, CAST(NULL AS STRING) AS journal, p_size - 1 AS cited, CAST(NULL AS STRING) AS doi FROM {part} WHERE p_partkey % 5 <> 1"

#: Affiliations with states, postal codes and countries in several places, or none.
AFFILIATION_TEXTS = """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Dept ' || o_orderkey % 7 || ', University ' || o_orderkey % 50 || ', City ' || o_orderkey % 30 || ', CA 94' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ', USA'
  WHEN 1 THEN 'Institute ' || o_orderkey % 50 || ', Town ' || o_orderkey % 30 || ', NSW, ' || (2000 + o_orderkey % 500) || ', Australia' WHEN 2 THEN 'College ' || o_orderkey % 50 || ', Paris, France.'
  WHEN 3 THEN 'Centre ' || o_orderkey % 50 WHEN 4 THEN 'Hospital ' || o_orderkey % 50 || ', Borough ' || o_orderkey % 9 || ', SW1A 1AA, UK' WHEN 5 THEN '' END AS text FROM {orders}
"""

#: Citations as plain text, in several forms.
CITATION_TEXTS = """
SELECT o.o_orderkey AS id, c.c_mktsegment || ' ' || o.o_orderpriority || ' ' || CAST(o.o_orderkey % 1999 AS STRING) AS title, CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) AS y,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Roe A' || o.o_orderkey % 7 || ', Poe B, et al. ' || c.c_mktsegment || ' ' || o.o_orderpriority || ' ' || CAST(o.o_orderkey % 1999 AS STRING) || '. Annals of Things. ' || CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) || ';' || (o.o_orderkey % 90 + 1) || ':5-' || (o.o_orderkey % 90 + 7) || '. doi:10.1/' || o.o_orderkey || '. PMID: ' || o.o_orderkey
    WHEN 1 THEN 'Smith J. ' || c.c_mktsegment || ' ' || o.o_orderpriority || ' ' || CAST(o.o_orderkey % 1999 AS STRING) || ' (' || CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) || ')'
    WHEN 2 THEN 'Roe A et al. ' || c.c_mktsegment || ' ' || o.o_orderpriority || ' ' || CAST(o.o_orderkey % 1999 AS STRING) || '. Letters ' || (o.o_orderkey % 90 + 1) || '(' || CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) || ')' ELSE 'NOTHING ' || o.o_orderkey END AS text
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

API_LOG = "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}"

VIEWS = {"papers": PAPERS, "net_authors": NET_AUTHORS, "citations": CITATIONS, "docs": DOCS, "source_a": SOURCE_A, "source_b": SOURCE_B, "source_c": SOURCE_C, "api_log": API_LOG, "affiliation_texts": AFFILIATION_TEXTS, "citation_texts": CITATION_TEXTS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a lazy DataFrame; only the tables it names are opened."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{names}", NAMES["spark"]), **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(query: str, *names: str) -> str:
    """SQL for the other engine: the named views as common table expressions, then ``query``."""
    def text(name: str) -> str:
        return VIEWS[name].replace("{names}", NAMES["duckdb"]).replace("{", "").replace("}", "")

    views = ", ".join(f"{n} AS MATERIALIZED ({text(n)})" for n in names)
    return f"WITH {views} {query}" if views else query
