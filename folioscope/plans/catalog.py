"""Registered queries of the literature operators and their SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import affiliation, entities, identifiers, text, vectors
from folioscope.operators import annotations, dedupe, filters, fulltext, graph, merge, network, query_language, stats
from folioscope.plans import mined, services
from folioscope.plans.views import oracle, table, view
from folioscope.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "(PUB_YEAR:[1996 TO 2000]) AND OPEN_ACCESS:y"


def register(name: str, query: Query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle(sql, *views)


def on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(view(spark, sf_dir, name))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-access papers of some years: counts and citation statistics by year."""
    found = query_language.search(view(spark, sf_dir, "papers"), FLAGSHIP)
    return rounded(stats.trend_analysis(found), "mean_citations").orderBy("year")


YEAR = "TRY_CAST(TRY_CAST(pubYear AS DOUBLE) AS INTEGER)"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
AUTHORS = "list_filter(list_transform(string_split(authorString, ','), lambda a: trim(a)), lambda a: a <> '')"
AGENCIES = "list_filter(list_transform(string_split(grants, ';'), lambda a: trim(a)), lambda a: lower(a) NOT IN ('', 'none', 'n/a'))"
TITLED = "array_to_string(list_transform(string_split({}, '_'), lambda w: upper(w[1]) || lower(w[2:])), '_')"
PARTS = "(SELECT id, trim(u.part) AS part FROM papers, unnest(string_split(affiliation, ';')) AS u(part) WHERE affiliation IS NOT NULL)"
TREND_TERMS = {"build": ["BUILDING", "machinery 2"], "house": ["household", "cohort of nation_3"]}

register("year_distribution", on("papers", stats.publication_year_distribution), "SELECT TRY_CAST(pubYear AS DOUBLE) AS year, count(*) AS count FROM papers WHERE TRY_CAST(pubYear AS DOUBLE) IS NOT NULL GROUP BY 1", "papers")
register(
    "citation_stats",
    on("papers", lambda p: rounded(stats.citation_statistics(p), "mean_citations", "std_citations")),
    """SELECT count(*) AS total_papers, round(avg(citedByCount), 6) AS mean_citations, round(stddev_samp(citedByCount), 6) AS std_citations, min(citedByCount) AS min_citations, max(citedByCount) AS max_citations,
    CAST(sum(citedByCount) AS BIGINT) AS total_citations, count(*) FILTER (citedByCount > 0) AS papers_with_citations, count(*) FILTER (citedByCount = 0) AS papers_without_citations,
    CAST(quantile_cont(citedByCount, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont(citedByCount, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(citedByCount, 0.75) AS DOUBLE) AS p75, CAST(quantile_cont(citedByCount, 0.9) AS DOUBLE) AS p90,
    CAST(quantile_cont(citedByCount, 0.95) AS DOUBLE) AS p95, CAST(quantile_cont(citedByCount, 0.5) AS DOUBLE) AS median_citations FROM papers""",
    "papers",
)
register(
    "quality_metrics",
    on("papers", lambda p: rounded(stats.quality_metrics(p), *(f"{n}_percentage" for n in ("open_access", "with_abstract", "with_doi", "in_pmc", "with_pdf", "peer_reviewed")))),
    """WITH c AS (SELECT count(*) AS total_papers, count(*) FILTER (isOpenAccess = 'Y') AS open_access_count, count(*) FILTER (hasAbstract) AS with_abstract_count, count(doi) AS with_doi_count, count(*) FILTER (inPMC) AS in_pmc_count,
    count(*) FILTER (hasPDF) AS with_pdf_count, count(*) FILTER (regexp_matches(lower(pubType), 'journal article|research article|review|clinical trial|case reports')) AS peer_reviewed_count FROM papers)
    SELECT *, round(open_access_count / total_papers * 100, 6) AS open_access_percentage, round(with_abstract_count / total_papers * 100, 6) AS with_abstract_percentage, round(with_doi_count / total_papers * 100, 6) AS with_doi_percentage,
    round(in_pmc_count / total_papers * 100, 6) AS in_pmc_percentage, round(with_pdf_count / total_papers * 100, 6) AS with_pdf_percentage, round(peer_reviewed_count / total_papers * 100, 6) AS peer_reviewed_percentage FROM c""".replace("WITH c AS", "SELECT * FROM (WITH c AS", 1) + ")",
    "papers",
)
register("type_distribution", on("papers", stats.publication_type_distribution), "SELECT trim(t) AS pub_type, count(*) AS count FROM papers, unnest(string_split(pubType, ';')) AS u(t) GROUP BY 1", "papers")
register("journal_top_n", on("papers", stats.journal_distribution), f"SELECT {STRIP.format('journalTitle')} AS journal, count(*) AS count FROM papers WHERE length({STRIP.format('journalTitle')}) > 2 AND lower({STRIP.format('journalTitle')}) NOT IN ('journaltitle', 'journal title') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "papers")
register(
    "author_stats",
    on("papers", lambda p: rounded(stats.author_statistics(p), "avg_collaboration_size", "avg_authors_per_paper")),
    f"""SELECT * FROM (WITH a AS (SELECT {AUTHORS} AS authors FROM papers), n AS (SELECT len(authors) AS n FROM a)
    SELECT CAST(sum(n) AS BIGINT) AS total_author_mentions, CAST(max(n) AS INTEGER) AS max_authors_per_paper, CAST(min(n) AS INTEGER) AS min_authors_per_paper, count(*) FILTER (n = 1) AS single_author_papers, count(*) FILTER (n > 1) AS multi_author_papers,
    count(*) FILTER (n = 2) AS two_author_papers, count(*) FILTER (n = 3) AS three_author_papers, count(*) FILTER (n >= 4) AS four_or_more_author_papers, round(avg(n) FILTER (n > 1), 6) AS avg_collaboration_size,
    (SELECT count(DISTINCT x) FROM a, unnest(authors) AS u(x)) AS total_authors, round(sum(n) / count(*), 6) AS avg_authors_per_paper FROM n)""",
    "papers",
)
register("top_authors", on("papers", stats.top_authors), f"SELECT x AS author, count(*) AS count FROM papers, unnest({AUTHORS}) AS u(x) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "papers")
register("geo_countries", on("papers", stats.country_distribution), f"SELECT {TITLED.format('trim(string_split(part, chr(44))[-1])')} AS country, count(*) AS count FROM {PARTS} WHERE contains(part, ',') GROUP BY 1", "papers")
register("geo_institutions", on("papers", lambda p: stats.institution_distribution(p, 20)), f"SELECT trim(string_split(part, ',')[1]) AS institution, count(*) AS count FROM {PARTS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "papers")
register(
    "collaboration_rate",
    on("papers", stats.collaboration_rate),
    f"""SELECT * FROM (WITH m AS (SELECT id FROM {PARTS} WHERE contains(part, ',') GROUP BY id HAVING count(DISTINCT upper(trim(string_split(part, ',')[-1]))) > 1),
    c AS (SELECT count(*) AS total_papers, count(affiliation) AS papers_with_affiliation, (SELECT count(*) FROM m) AS multi_country_papers FROM papers) SELECT *, round(multi_country_papers / papers_with_affiliation * 100, 2) AS international_collaboration_rate FROM c)""",
    "papers",
)
register(
    "access_distribution",
    on("papers", stats.access_distribution),
    """SELECT *, round(open_access_count / total_papers * 100, 2) AS open_access_percentage, round(closed_access_count / total_papers * 100, 2) AS closed_access_percentage, round(has_fulltext_count / total_papers * 100, 2) AS has_fulltext_percentage,
    round(no_fulltext_count / total_papers * 100, 2) AS no_fulltext_percentage FROM (SELECT count(*) AS total_papers, count(*) FILTER (isOpenAccess = 'Y') AS open_access_count, count(*) FILTER (hasPDF OR inPMC OR inEPMC) AS has_fulltext_count,
    count(*) FILTER (hasPDF) AS pdf, count(*) FILTER (inPMC) AS pmc, count(*) FILTER (inEPMC) AS epmc, count(*) FILTER (isOpenAccess <> 'Y') AS closed_access_count, count(*) FILTER (NOT (hasPDF OR inPMC OR inEPMC)) AS no_fulltext_count FROM papers)""",
    "papers",
)
register("license_distribution", on("papers", stats.license_distribution), "SELECT CASE trim(license) WHEN 'cc-by' THEN 'CC-BY' WHEN 'CC-BY-NC 4.0' THEN 'CC-BY-NC' WHEN 'cc0' THEN 'CC0' ELSE 'Publisher' END AS license, count(*) AS count FROM papers WHERE license IS NOT NULL AND license <> 'none' GROUP BY 1", "papers")
register(
    "citation_by_access",
    on("papers", lambda p: rounded(stats.citation_by_access_type(p), "mean_citations", "std_citations")),
    """SELECT isOpenAccess = 'Y' AS open_access, count(*) AS count, round(avg(citedByCount), 6) AS mean_citations, CAST(quantile_cont(citedByCount, 0.5) AS DOUBLE) AS median_citations, round(coalesce(stddev_samp(citedByCount), 0), 6) AS std_citations,
    CAST(sum(citedByCount) AS BIGINT) AS total_citations, CAST(quantile_cont(citedByCount, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont(citedByCount, 0.75) AS DOUBLE) AS p75, CAST(quantile_cont(citedByCount, 0.9) AS DOUBLE) AS p90 FROM papers GROUP BY 1""",
    "papers",
)
#: Both groups have thousands of papers, where 1.96 stands for the 5 % point of Student's t.
register("access_effect", on("papers", stats.access_citation_effect), """SELECT coalesce(round(CASE WHEN n_o > 1 AND n_c > 1 AND p > 0 THEN (m_o - m_c) / p END, 4), 0.0) AS effect_size, coalesce(n_o > 1 AND n_c > 1 AND abs((m_o - m_c) / sqrt(v_o / n_o + v_c / n_c)) > 1.962, false) AS is_significant,
    coalesce(round(CASE WHEN m_c > 0 THEN (m_o - m_c) / m_c * 100 END, 2), 0.0) AS citation_impact_score FROM (SELECT *, sqrt((v_o * (n_o - 1) + v_c * (n_c - 1)) / (n_o + n_c - 2)) AS p FROM (SELECT count(*) FILTER (o) AS n_o, count(*) FILTER (NOT o) AS n_c, avg(c) FILTER (o) AS m_o, avg(c) FILTER (NOT o) AS m_c,
    var_samp(c) FILTER (o) AS v_o, var_samp(c) FILTER (NOT o) AS v_c FROM (SELECT CAST(citedByCount AS DOUBLE) AS c, isOpenAccess = 'Y' AS o FROM papers)))""", "papers")
TREND = " UNION ALL ".join(f"SELECT '{k}' AS key, {YEAR} AS year FROM papers WHERE " + " OR ".join(f"contains(lower(title) || ' ' || lower(abstractText), '{t.lower()}')" for t in ts) for k, ts in TREND_TERMS.items())
TREND_COUNTS = f"(SELECT key, year, count(*) AS count FROM ({TREND}) WHERE year IS NOT NULL GROUP BY 1, 2)"
register("disease_trends", on("papers", lambda p: stats.disease_trends(p, TREND_TERMS)), f"SELECT key, year, count FROM {TREND_COUNTS}", "papers")
register("growth_rates", on("papers", lambda p: stats.growth_rates(stats.disease_trends(p, TREND_TERMS))), f"SELECT key, CAST(sum(count) AS BIGINT) AS total_publications, round((pow(arg_max(count, year) / arg_min(count, year), 1.0 / (max(year) - min(year))) - 1) * 100, 2) AS growth_rate FROM {TREND_COUNTS} GROUP BY 1", "papers")
register(
    "trend_crossover",
    on("papers", lambda p: stats.trend_crossover(stats.disease_trends(p, TREND_TERMS), "build", "house")),
    f"""SELECT year AS overtaken_year, round(ratio, 4) AS ratio_at_crossover FROM (SELECT *, coalesce(lag(ratio) OVER (ORDER BY year), 0) AS before FROM (SELECT year, CAST(coalesce(sum(count) FILTER (key = 'house'), 0) / coalesce(sum(count) FILTER (key = 'build'), 0) AS DOUBLE) AS ratio
    FROM {TREND_COUNTS} GROUP BY year)) WHERE before < 1 AND ratio >= 1 ORDER BY year LIMIT 1""",
    "papers",
)
register("trend_analysis", on("papers", lambda p: rounded(stats.trend_analysis(p), "mean_citations")), f"SELECT {YEAR} AS year, round(avg(citedByCount), 6) AS mean_citations, CAST(quantile_cont(citedByCount, 0.5) AS DOUBLE) AS median_citations, count(*) AS count FROM papers WHERE {YEAR} IS NOT NULL GROUP BY 1", "papers")
register("citation_histogram", on("papers", stats.citation_histogram), "SELECT CAST(least(floor((citedByCount - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS count FROM papers, (SELECT min(citedByCount) AS lo, max(citedByCount) AS hi FROM papers) GROUP BY 1", "papers")
FUNDERS = f"(SELECT id, pubYear, a AS agency FROM papers, unnest({AGENCIES}) AS u(a))"
register("funder_distribution", on("papers", stats.funder_distribution), f"SELECT agency, count(*) AS count FROM {FUNDERS} GROUP BY 1", "papers")
register("funder_year", on("papers", stats.funding_by_year), f"SELECT {YEAR} AS year, agency, count(*) AS count FROM {FUNDERS} WHERE {YEAR} IS NOT NULL GROUP BY 1, 2", "papers")
register(
    "funding_hhi",
    on("papers", stats.funding_summary),
    f"""SELECT count(*) FILTER (len({AGENCIES}) > 0) AS total_funded_papers, count(*) FILTER (len({AGENCIES}) > 1) AS multi_funder_papers,
    (SELECT round(sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n)), 6) FROM (SELECT count(*) AS n FROM {FUNDERS} GROUP BY agency)) AS concentration_index FROM papers""",
    "papers",
)

register("duplicate_groups", on("papers", lambda p: dedupe.duplicate_groups(p, "doi").select("key", F.array_join("positions", ",").alias("positions"))), "SELECT doi AS key, array_to_string(list_sort(list(pos)), ',') AS positions FROM papers WHERE doi <> '' GROUP BY 1 HAVING count(*) > 1", "papers")
for keep, order in (("first", "pos"), ("last", "pos DESC"), ("most_cited", "citedByCount DESC, pos")):
    register(f"dedupe_{keep}", on("papers", lambda p, k=keep: dedupe.remove_duplicates(p, "doi", k).select("id", "doi", "citedByCount")), f"SELECT id, doi, citedByCount FROM papers QUALIFY row_number() OVER (PARTITION BY doi ORDER BY {order}) = 1", "papers")
register("dedupe_title", on("papers", lambda p: dedupe.remove_duplicates(p, "title").select("id", "title")), "SELECT id, title FROM papers QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY pos) = 1", "papers")

PAIRS = "(SELECT a.author AS a, b.author AS b, count(*) AS count FROM net_authors a JOIN net_authors b ON a.paper = b.paper AND a.author < b.author GROUP BY 1, 2)"
DEGREES = f"(SELECT author, count(*) AS degree FROM (SELECT a AS author FROM {PAIRS} UNION ALL SELECT b FROM {PAIRS}) GROUP BY 1)"
TOP = "(SELECT author, count(*) AS n FROM net_authors GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {})"
register("coauthor_pairs", on("net_authors", network.collaboration_pairs), f"SELECT a, b, count FROM {PAIRS}", "net_authors")
register("degree_centrality", on("net_authors", network.degree_centrality), f"SELECT t.author, round(coalesce(d.degree, 0) / (SELECT max(degree) FROM {DEGREES}), 4) AS centrality FROM {TOP.format(10)} t LEFT JOIN {DEGREES} d ON d.author = t.author", "net_authors")
register("core_researchers", on("net_authors", network.core_researchers), f"SELECT d.author, d.degree FROM {DEGREES} d JOIN {TOP.format(10)} t ON t.author = d.author WHERE d.degree >= greatest((SELECT list_sort(list(degree))[CAST(floor(count(*) / 2) AS BIGINT) + 1] FROM {DEGREES}), 2)", "net_authors")
register("collaboration_matrix", on("net_authors", lambda n: network.collaboration_matrix(n, 40)), f"SELECT * FROM (WITH t AS (SELECT author FROM {TOP.format(40)}), p AS (SELECT * FROM {PAIRS} WHERE a IN (SELECT author FROM t) AND b IN (SELECT author FROM t)) SELECT a, b, count FROM p UNION ALL SELECT b, a, count FROM p)", "net_authors")
register(
    "research_groups",
    on("net_authors", lambda n: network.research_groups(n, 40)),
    f"""SELECT * FROM (WITH RECURSIVE t AS (SELECT author FROM {TOP.format(40)}), p AS (SELECT a, b FROM {PAIRS} WHERE a IN (SELECT author FROM t) AND b IN (SELECT author FROM t)), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r(author, reach) AS (SELECT a, a FROM e UNION SELECT r.author, e.b FROM r JOIN e ON e.a = r.reach) SELECT author, min(reach) AS "group" FROM r GROUP BY 1)""",
    "net_authors",
)

WANTED = ("journal article", "letter")
register("filter_and", on("papers", lambda p: filters.filter_papers(p, 3, 1996, 2000, WANTED, "Y", abstract={"cohort", "nation_1"}).select("id", "pubYear", "citedByCount")), "SELECT id, pubYear, citedByCount FROM papers WHERE citedByCount >= 3 AND (pubYear = '' OR TRY_CAST(pubYear AS INTEGER) BETWEEN 1996 AND 2000) AND lower(pubType) IN ('journal article', 'letter') AND isOpenAccess = 'Y' AND contains(lower(abstractText), 'cohort') AND contains(lower(abstractText), 'nation_1')", "papers")
register("filter_or", on("papers", lambda p: filters.filter_papers_or(p.withColumn("kw", F.split("journalTitle", " ")), 2, 1994, None, (), None, abstract={"nation_7", "customer#00000001"}, keywords={"machinery"}, keyword_column="kw").select("id")), "SELECT id FROM papers WHERE citedByCount >= 2 AND (pubYear = '' OR TRY_CAST(pubYear AS INTEGER) >= 1994) AND (contains(lower(abstractText), 'nation_7') OR contains(lower(abstractText), 'customer#00000001') OR contains(lower(journalTitle), 'machinery'))", "papers")
register("filter_or_empty_set", on("papers", lambda p: filters.filter_papers_or(p, 2, 1994, None, (), None, abstract=set()).select("id")), "SELECT id FROM papers WHERE false", "papers")

COMPILED = {
    "year_oa": (FLAGSHIP, "TRY_CAST(pubYear AS DOUBLE) BETWEEN 1996 AND 2000 AND isOpenAccess = 'Y'"),
    "boolean": ('(TITLE:furniture OR TITLE:"building 1-URGENT") AND NOT OPEN_ACCESS:y AND CITED:[2 TO *]', "(contains(lower(title), 'furniture') OR contains(lower(title), 'building 1-urgent')) AND isOpenAccess <> 'Y' AND citedByCount >= 2"),
    "free_text": ('"nation_3 by" OR machinery GRANT_AGENCY:"agency 7"', "contains(lower(title), 'nation_3 by') OR contains(lower(abstractText), 'nation_3 by') OR ((contains(lower(title), 'machinery') OR contains(lower(abstractText), 'machinery')) AND contains(lower(grants), 'agency 7'))"),
    "exact": ("DOI:10.1234/77 OR EXT_ID:42 OR PUB_YEAR:1998", "coalesce(doi = '10.1234/77', false) OR id = 42 OR coalesce(TRY_CAST(pubYear AS DOUBLE) = 1998, false)"),
}
for name, (text_query, where) in COMPILED.items():
    register(f"query_compile_{name}", on("papers", lambda p, q=text_query: query_language.search(p, q).select("id", "pubYear")), f"SELECT id, pubYear FROM papers WHERE {where}", "papers")
register("query_cites", lambda spark, d: query_language.cites(view(spark, d, "papers"), view(spark, d, "citations"), 17).select("id", "title"), "SELECT id, title FROM papers WHERE id IN (SELECT src FROM citations WHERE dst = 17)", "papers", "citations")
register("query_evaluate", on("docs", lambda d: rounded(query_language.evaluate(d, "the OR der"), "recall", "precision", "f1_score")), """SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score FROM (SELECT tp, fp, fn, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM (SELECT count(*) FILTER (hit AND relevant = 1) AS tp, count(*) FILTER (hit AND relevant = 0) AS fp,
    count(*) FILTER (NOT hit AND relevant = 1) AS fn FROM (SELECT relevant, contains(lower(title), 'the') OR contains(lower(title), 'der') AS hit FROM docs WHERE relevant IS NOT NULL)))""", "docs")

NORMAL = "regexp_replace(lower({}), '^(https?://)?(dx\\.)?doi\\.org/', '')"
register(
    "merge_sources",
    lambda spark, d: merge.merge_sources({n: view(spark, d, f"source_{n}") for n in "abc"}),
    f"""SELECT id, coalesce(nullif(a.title, ''), b.title, c.title) AS title, coalesce(a.journal, b.journal) AS journal, greatest(a.cited, b.cited, c.cited) AS cited, coalesce({NORMAL.format('a.doi')}, {NORMAL.format('b.doi')}) AS doi,
    CASE WHEN a.doi IS NOT NULL AND b.doi IS NOT NULL AND {NORMAL.format('a.doi')} <> {NORMAL.format('b.doi')} THEN 'b:' || {NORMAL.format('b.doi')} ELSE '' END AS doi_conflicts,
    concat_ws(',', CASE WHEN a.id IS NOT NULL THEN 'a' END, CASE WHEN b.id IS NOT NULL THEN 'b' END, CASE WHEN c.id IS NOT NULL THEN 'c' END) AS sources
    FROM source_a a FULL JOIN source_b b USING (id) FULL JOIN source_c c USING (id)""",
    "source_a", "source_b", "source_c",
)


def author_sources(lineitem: DataFrame) -> DataFrame:
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_linenumber")
    a = lines.select(F.col("l_orderkey").alias("paper"), F.lit("a").alias("source"), F.lit(0).alias("source_rank"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("orcid"), F.concat(F.lit("Org "), F.col("l_suppkey").cast("string")).alias("affiliation"))
    b = lines.where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("paper"), F.lit("b").alias("source"), F.lit(1).alias("source_rank"), F.col("l_linenumber").alias("pos"), F.concat(F.lit(" SUPPLIER "), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_suppkey").cast("string").alias("orcid"), F.lit("").alias("affiliation"))
    return a.unionByName(b)


register("merge_authors", lambda spark, d: merge.merge_authors(author_sources(table(spark, d, "lineitem"))), """SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY n_sources DESC, seen, lower(name)) AS INTEGER) AS place, name, orcid, affiliation, n_sources FROM (SELECT l_orderkey AS paper, 'Supplier ' || l_suppkey AS name, CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS orcid,
    'Org ' || l_suppkey AS affiliation, CAST(CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_sources, min(l_linenumber) AS seen FROM lineitem GROUP BY ALL)""")

QUALITY = "least(1.0, 0.5 + CASE WHEN coalesce(doi, '') <> '' THEN 0.2 ELSE 0.0 END + CASE WHEN title <> '' THEN 0.1 ELSE 0.0 END + CASE WHEN citedByCount > 0 THEN 0.1 ELSE 0.0 END)"


def paper_scores(p: DataFrame) -> DataFrame:
    p = p.withColumn("pmid", F.lit(None).cast("string"))
    return p.select("id", F.round(graph.paper_quality(), 6).alias("quality_score"), graph.confidence_level(graph.paper_quality()).alias("confidence_level"))


register("quality_scores", on("papers", paper_scores), f"SELECT id, CAST(round({QUALITY}, 6) AS DOUBLE) AS quality_score, CASE WHEN {QUALITY} >= 0.8 THEN 'high' WHEN {QUALITY} >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_level FROM papers", "papers")
URI = "CASE WHEN coalesce(doi, '') <> '' THEN 'https://example.org/kg/doi/' || doi ELSE 'https://example.org/kg/paper/' || id END"
MELT = " UNION ".join(f"SELECT {URI} AS s, '{graph.iri(p)}' AS p, CAST({c} AS VARCHAR) AS o, 'literal' AS o_kind, '{graph.iri(t)}' AS o_datatype, 'publications' AS g FROM papers WHERE CAST({c} AS VARCHAR) <> ''" for c, (p, t) in graph.PAPER_FIELDS.items())
register("triples_melt", on("papers", graph.paper_triples), f"SELECT * FROM ({MELT})", "papers")
register("coauthor_edges", on("net_authors", lambda n: graph.collaboration_links(n).select("s", "p", "o")), f"SELECT DISTINCT 'https://example.org/kg/author/' || a.author AS s, '{graph.iri('foaf:knows')}' AS p, 'https://example.org/kg/author/' || b.author AS o FROM net_authors a JOIN net_authors b ON a.paper = b.paper AND a.author <> b.author", "net_authors")
register("citation_edges", on("citations", lambda c: graph.citation_links(c).select("s", "p", "o")), "".join(f"{' UNION ' if i else ''}SELECT 'https://example.org/kg/paper/' || {s} AS s, '{graph.iri(p)}' AS p, 'https://example.org/kg/paper/' || {o} AS o FROM citations" for i, (s, p, o) in enumerate((("src", "cito:cites", "dst"), ("dst", "cito:isCitedBy", "src")))), "citations")
register("shacl_max1", on("papers", lambda p: graph.too_many_values(graph.paper_triples(p), {"dcterms:title": 1, "dcterms:issued": 2})), f"SELECT s, p, count(*) AS n FROM ({MELT}) WHERE p IN ('{graph.iri('dcterms:title')}', '{graph.iri('dcterms:issued')}') GROUP BY 1, 2 HAVING count(*) > CASE WHEN p = '{graph.iri('dcterms:title')}' THEN 1 ELSE 2 END", "papers")
register("n_quads", on("papers", lambda p: graph.n_quads(graph.paper_triples(p))), f"SELECT '<' || s || '> <' || p || '> \"' || o || '\"^^<' || o_datatype || '> <https://example.org/kg/graph/publications> .' AS value FROM ({MELT})", "papers")
register("institution_members", on("papers", lambda p: graph.institution_members(p.select(F.col("id").alias("author"), "affiliation"))), "SELECT 'https://example.org/kg/org/' || sha256(affiliation)[1:16] AS org, affiliation AS name, count(DISTINCT id) AS members FROM papers WHERE affiliation <> '' GROUP BY affiliation", "papers")


def identifier_rows(p: DataFrame) -> DataFrame:
    raw = p.select("id", F.concat(F.lit(" HTTPS://doi.org/"), "doi").alias("d"), F.concat(F.lit("pmc"), F.col("id").cast("string")).alias("c"), F.concat((F.col("id") % 3000).cast("string"), F.when(F.col("id") % 2 == 0, "K").otherwise("")).alias("z"), "pubYear")
    return raw.select("id", identifiers.normalized_doi(F.col("d")).alias("doi"), identifiers.pmcid(F.col("c")).alias("pmcid"), identifiers.pmid(F.concat(F.lit("77"), F.col("id").cast("string"))).alias("pmid"), identifiers.file_size(F.col("z")).alias("bytes"), identifiers.year(F.col("pubYear")).alias("year"), identifiers.archive_range(F.col("id")).alias("r")).select("*", "r.low", "r.high").drop("r")


register("ids_normalised", on("papers", identifier_rows), """SELECT id, nullif(lower(doi), '') AS doi, 'PMC' || id AS pmcid, CASE WHEN length('77' || id) BETWEEN 6 AND 10 THEN '77' || id END AS pmid, CASE WHEN id % 2 = 0 THEN (id % 3000) * 1024 END AS bytes, TRY_CAST(pubYear AS INTEGER) AS year,
    CAST(floor(id / w) * w AS BIGINT) AS low, CAST(floor(id / w) * w + w - 1 AS BIGINT) AS high FROM (SELECT *, CASE WHEN id < 10000 THEN 1000 WHEN id < 1000000 THEN 10000 ELSE 100000 END AS w FROM papers)""", "papers")
register("postal_match", on("papers", lambda p: p.select("id", affiliation.is_postal_code(F.col("id").cast("string")).alias("is_postal"))), "SELECT id, regexp_full_match(CAST(id AS VARCHAR), '\\d{5}(-\\d{4})?') OR regexp_full_match(CAST(id AS VARCHAR), '\\d{4,6}') AS is_postal FROM papers", "papers")
register("paper_errors", on("papers", lambda p: entities.with_errors(p, "paper").select("id", F.array_join("errors", ",").alias("errors"))), "SELECT id, CASE WHEN pubYear = 'n.d.' THEN 'publication year is out of range' ELSE '' END AS errors FROM papers", "papers")


def jaccard_rows(p: DataFrame) -> DataFrame:
    a, b = (F.array_distinct(text.tokens(text.ascii_normalized(F.col(c)))) for c in ("title", "journalTitle"))
    return p.select("id", F.round(text.token_jaccard(a, b), 6).alias("jaccard"))


WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
register("token_jaccard", on("papers", jaccard_rows), f"SELECT id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS jaccard FROM (SELECT id, {WORDS.format('title')} AS a, {WORDS.format('journalTitle')} AS b FROM papers)", "papers")
register("sentence_split", on("docs", lambda d: d.select("doc_id", F.size(text.sentences(F.col("abstract"))).cast("long").alias("sentences"))), "SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS BIGINT) AS sentences FROM docs", "docs")


def fuzzy_scores(p: DataFrame) -> DataFrame:
    """The score of every paper's title and abstract; each distinct pair of normalised texts is scored once."""
    both = p.select("id", text.normalized(F.col("title")).alias("a"), text.normalized(F.col("abstractText")).alias("b"))
    scored = both.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct().select("x", "y", F.round(text.token_set_ratio(F.col("x"), F.col("y")), 4).alias("score"))
    return both.join(scored, F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).select("id", "score")


register("fuzzy_token_set", on("papers", fuzzy_scores))

EXAMPLES = ([1, 2, 3], [4, 5])
register("recommend_pos_neg", lambda spark, d: vectors.recommend(table(spark, d, "embeddings"), *EXAMPLES, 10).select("vec_id", F.round("score", 6).alias("score")), """SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.v) AS score FROM embeddings e,
    (SELECT list(x ORDER BY i) AS v FROM (SELECT i, sum(w * x) AS x FROM (SELECT CASE WHEN vec_id <= 3 THEN 1.0 / 3 ELSE -0.5 END AS w, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id BETWEEN 1 AND 5) GROUP BY i)) m
    WHERE e.vec_id NOT BETWEEN 1 AND 5 ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.v), 9) DESC, e.vec_id LIMIT 10)""")


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "api_log")
    tag = lambda n: F.struct(F.concat(F.lit("http://identifiers.org/"), "event_type", F.lit("/"), n.cast("string")).alias("uri"), F.concat(F.lit("n"), n.cast("string")).alias("name"), F.lit(None).cast("string").alias("type"))
    tags = F.when(F.col("k") % 3 == 0, F.array(tag(F.col("k")), tag(F.col("k") + 1))).when(F.col("k") % 3 == 1, F.array(tag(F.col("k")))).otherwise(F.array().cast("array<struct<uri:string,name:string,type:string>>"))
    none = F.lit(None).cast("string")
    return e.select(F.col("event_id").alias("pos"), (F.col("user_id") % 50).cast("string").alias("article"), F.when(F.col("k") % 5 == 0, "Sentence").otherwise("Entity").alias("type"), F.concat(F.lit("x"), (F.col("k") % 7).cast("string")).alias("exact"), none.alias("prefix"), none.alias("postfix"), F.lit("Body").alias("section"), F.col("event_type").alias("provider"), F.when(F.col("k") % 2 == 0, "t").alias("target"), F.when(F.col("k") % 4 == 0, "treats").alias("relation"), tags.alias("tags"))


register("annotation_entities", lambda spark, d: annotations.entities(annotation_rows(spark, d)), """SELECT article, entity_id, entity_name, entity_type, exact, 'Body' AS section, arg_min(event_type, pos * 2 + tag_pos) AS provider, min(pos) AS pos FROM (
    SELECT event_id AS pos, n AS tag_pos, CAST(user_id % 50 AS VARCHAR) AS article, 'x' || k % 7 AS exact, event_type, CASE WHEN k % 3 < 2 THEN 'http://identifiers.org/' || event_type || '/' || (k + n) ELSE 'entity:' || sha256(concat_ws('|', CAST(user_id % 50 AS VARCHAR), 'x' || k % 7, kind))[1:16] END AS entity_id,
    CASE WHEN k % 3 < 2 THEN 'n' || (k + n) ELSE 'x' || k % 7 END AS entity_name, kind AS entity_type FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'Sentence' ELSE 'Entity' END AS kind FROM api_log), range(2) AS r(n) WHERE n = 0 OR k % 3 = 0) GROUP BY article, entity_id, entity_name, entity_type, exact""", "api_log")
register("annotation_sentences", lambda spark, d: annotations.sentences(annotation_rows(spark, d)), "SELECT event_id AS pos, CAST(user_id % 50 AS VARCHAR) AS article, 'x' || k % 7 AS sentence, 'Body' AS section, event_type AS provider FROM api_log WHERE k % 5 = 0 AND k % 2 = 0", "api_log")
register("annotation_relationships", lambda spark, d: annotations.relationships(annotation_rows(spark, d)), "SELECT event_id AS pos, CAST(user_id % 50 AS VARCHAR) AS article, 'n' || k AS subject, 'treats' AS predicate, 'n' || (k + 1) AS object FROM api_log WHERE k % 3 = 0 AND k % 4 = 0", "api_log")


def jats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles made of documents: title line, then a section for each further line."""
    d = view(spark, sf_dir, "docs")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(esc(F.regexp_replace("abstract", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")), "\n"), lambda p, i: F.concat(F.lit("<sec><title>S"), i.cast("string"), F.lit("</title><p>"), p, F.lit("</p></sec>"))), "")
    xml = F.concat(F.lit("<!DOCTYPE article><article><front><article-meta><title-group><article-title>T"), F.col("doc_id").cast("string"), F.lit("</article-title></title-group></article-meta></front><body>"), body, F.lit("</body></article>"))
    return fulltext.parse(d.select("doc_id", xml.alias("xml")), "doc_id", "xml")


register("section_rows", lambda spark, d: fulltext.child(jats(spark, d), "sections").select("paper_id", F.col("pos").cast("int").alias("pos"), "title"), "SELECT doc_id AS paper_id, CAST(unnest(range(len(string_split(abstract, chr(10))))) AS INTEGER) AS pos, 'S' || pos AS title FROM docs", "docs")
register("tag_frequencies", lambda spark, d: fulltext.tag_frequencies(jats(spark, d)), """SELECT t AS tag, CAST(sum(CASE WHEN t IN ('sec', 'title', 'p') THEN lines ELSE 1 END) AS BIGINT) AS count FROM (SELECT len(string_split(abstract, chr(10))) AS lines FROM docs WHERE abstract IS NOT NULL),
    (SELECT unnest(['article', 'front', 'article-meta', 'title-group', 'article-title', 'body', 'sec', 'title', 'p']) AS t) GROUP BY 1""", "docs")
register("rate_window_1s", on("api_log", lambda e: state.rate_windows(e, 2, 1)), "SELECT date_trunc('second', ts) AS start, count(*) AS requests, count(*) >= 1.6 AS warned, count(*) > 2 AS exceeded FROM api_log GROUP BY 1", "api_log")
#: A key's first event misses, and so does its first one later than the time to live after the miss before.
MISSES = """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS moment FROM api_log WHERE ts IS NOT NULL),
    m AS (SELECT user_id, min(moment) AS moment FROM e GROUP BY user_id UNION ALL SELECT m.user_id, min(e.moment) FROM m JOIN e ON e.user_id = m.user_id AND e.moment > m.moment + 86400000000 GROUP BY m.user_id, m.moment),
    f AS (SELECT e.user_id, e.moment, min(e.event_id) AS event_id FROM e JOIN m USING (user_id, moment) GROUP BY e.user_id, e.moment)"""
register(
    "cache_hit_rate",
    on("api_log", lambda e: rounded(state.hit_rates(state.exact_cache_hits(e.select("event_id", "ts", "user_id", "event_type"), "user_id", 86400), "event_type"), "hit_rate")),
    f"SELECT * FROM ({MISSES} SELECT event_type, count(*) AS reads, count(*) FILTER (hit) AS hits, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate FROM (SELECT event_type, event_id NOT IN (SELECT event_id FROM f) AS hit FROM api_log) GROUP BY 1)",
    "api_log",
)
register("crawl_progress", on("api_log", lambda e: rounded(state.crawl_progress(e.select("event_id", F.col("k").alias("fetched"), (F.col("user_id") % 200).alias("total"), F.round(F.col("value") + 1, 2).alias("elapsed"))), "progress_percent", digits=1).withColumn("remaining_s", F.floor("remaining_s"))), """SELECT event_id, k AS fetched, user_id % 200 AS total, round(value + 1, 2) AS elapsed, CASE WHEN user_id % 200 > 0 THEN round(least(100.0, k / (user_id % 200) * 100), 1) ELSE 0.0 END AS progress_percent,
    CASE WHEN k > 0 AND round(value + 1, 2) > 0 THEN CAST(floor((user_id % 200 - k) / (k / round(value + 1, 2))) AS BIGINT) END AS remaining_s FROM api_log""", "api_log")
register("gc_lru_running_sum", on("api_log", lambda e: state.evicted(e.select(F.col("event_id").alias("artifact_id"), (F.col("k") + 1).alias("size"), F.col("ts").alias("last_accessed")), 5000)), "SELECT artifact_id, size, CAST(freed_before AS BIGINT) AS freed_before FROM (SELECT event_id AS artifact_id, k + 1 AS size, coalesce(sum(k + 1) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM api_log) WHERE freed_before < 5000", "api_log")
register("content_addressed", on("docs", lambda d: state.content_table(d.select("doc_id", F.col("abstract").alias("content")))), "SELECT sha256(abstract) AS hash, CAST(first(length(abstract)) AS INTEGER) AS size, count(*) AS \"references\" FROM docs GROUP BY abstract", "docs")
register("prisma_summary", on("api_log", lambda e: stats.prisma_summary(e.select(F.col("event_type").alias("database"), F.col("k").alias("results"), F.col("event_id").alias("seq")))), "SELECT count(*) AS databases, CAST(sum(r) AS BIGINT) AS total_records FROM (SELECT arg_max(k, event_id) AS r FROM api_log GROUP BY event_type)", "api_log")

for name, query in services.QUERIES.items():
    register(name, query, services.ORACLES.get(name))
for name, query in mined.QUERIES.items():
    register(name, query, *mined.ORACLES.get(name, ()))

#: Names under which whole tables were read while the plain names read a part of them; both are the same now.
for name in ("coauthor_pairs", "degree_centrality", "core_researchers", "collaboration_matrix", "research_groups", "coauthor_edges", "merge_authors"):
    QUERIES[f"{name}_all"], ORACLES[f"{name}_all"] = QUERIES[name], ORACLES[name]
QUERIES["cache_hit_rate_exact"], ORACLES["cache_hit_rate_exact"] = QUERIES["cache_hit_rate"], ORACLES["cache_hit_rate"]
