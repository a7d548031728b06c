"""Aggregations over the flat paper table.

Scalar results are one-row DataFrames and distributions one row for each value;
ties in rankings go to the smaller key. Every function takes and returns lazy
DataFrames; percentages are unrounded where the literature tools leave them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import affiliation as geo
from folioscope.functions.text import trimmed

PEER_REVIEWED = ("journal article", "research article", "review", "systematic review", "clinical trial", "case reports")
NO_LICENSE = ("", "none", "null", "n/a")
NO_AGENCY = ("", "none", "n/a")


def year_of(column: str = "pubYear") -> Column:
    """A publication year as an integer, null where it isn't a number."""
    return F.col(column).try_cast("double").try_cast("int")


def ranked(df: DataFrame, key: str, top_n: int | None = None, count: str = "count") -> DataFrame:
    """Rows counted by ``key``, most frequent first."""
    counted = df.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key)
    return counted if top_n is None else counted.limit(top_n)


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def publication_year_distribution(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("pubYear").try_cast("double").alias("year")).where("year is not null and not isnan(year)").groupBy("year").agg(F.count("*").alias("count")).orderBy("year")


def citation_statistics(papers: DataFrame) -> DataFrame:
    """One row of counts, moments and exact percentiles of ``citedByCount``."""
    c = F.col("citedByCount").try_cast("bigint")
    points = F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    out = papers.agg(
        F.count("*").alias("total_papers"), F.avg(c).alias("mean_citations"), F.stddev_samp(c).alias("std_citations"),
        F.min(c).alias("min_citations"), F.max(c).alias("max_citations"), F.coalesce(F.sum(c), F.lit(0)).alias("total_citations"),
        F.count_if(c > 0).alias("papers_with_citations"), F.count_if(c == 0).alias("papers_without_citations"), points.alias("p"),
    )
    return out.select("*", *(F.get("p", F.lit(i)).alias(f"p{n}") for i, n in enumerate((25, 50, 75, 90, 95)))).drop("p").withColumn("median_citations", F.col("p50"))


def is_peer_reviewed(pub_type: Column) -> Column:
    found = F.lit(False)
    for name in PEER_REVIEWED:
        found = found | F.contains(F.lower(pub_type), F.lit(name))
    return F.coalesce(found, F.lit(False))


def quality_metrics(papers: DataFrame) -> DataFrame:
    """Counts and percentages; an empty DOI counts as one, as only absence doesn't."""
    parts = {
        "open_access": F.col("isOpenAccess") == "Y", "with_abstract": F.col("hasAbstract"), "with_doi": F.col("doi").isNotNull(),
        "in_pmc": F.col("inPMC"), "with_pdf": F.col("hasPDF"), "peer_reviewed": is_peer_reviewed(F.col("pubType")),
    }
    counted = papers.agg(F.count("*").alias("total_papers"), *(F.count_if(c).alias(f"{n}_count") for n, c in parts.items()))
    return counted.select("*", *(percent(F.col(f"{n}_count"), F.col("total_papers")).alias(f"{n}_percentage") for n in parts))


def publication_type_distribution(papers: DataFrame) -> DataFrame:
    types = papers.where("pubType <> ''").select(F.explode(F.transform(F.split("pubType", ";"), trimmed)).alias("pub_type"))
    return ranked(types, "pub_type")


def journal_distribution(papers: DataFrame, top_n: int = 10) -> DataFrame:
    names = papers.select(trimmed(F.col("journalTitle")).alias("journal"))
    kept = names.where((F.length("journal") > 2) & ~F.lower("journal").isin("journaltitle", "journal title"))
    return ranked(kept, "journal", top_n)


def author_lists(papers: DataFrame) -> DataFrame:
    """``papers`` with ``authors``, the names of the comma-separated ``authorString`` (a final dot stays)."""
    names = F.filter(F.transform(F.split("authorString", ","), trimmed), lambda a: a != "")
    return papers.withColumn("authors", F.when(F.col("authorString").isNotNull(), names))


def author_statistics(papers: DataFrame) -> DataFrame:
    """One row; papers without an author string count in the average's denominator only."""
    listed = author_lists(papers).select("authors", F.size("authors").alias("n"))
    n = F.when(F.col("authors").isNotNull(), F.col("n"))
    one = listed.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_author_mentions"), F.count("*").alias("rows"),
        F.max(n).alias("max_authors_per_paper"), F.min(n).alias("min_authors_per_paper"),
        F.count_if(n == 1).alias("single_author_papers"), F.count_if(n > 1).alias("multi_author_papers"),
        F.count_if(n == 2).alias("two_author_papers"), F.count_if(n == 3).alias("three_author_papers"), F.count_if(n >= 4).alias("four_or_more_author_papers"),
        F.coalesce(F.avg(F.when(n > 1, n)), F.lit(0.0)).alias("avg_collaboration_size"),
    )
    distinct = listed.select(F.explode("authors").alias("author")).agg(F.count_distinct("author").alias("total_authors"))
    return one.crossJoin(distinct).withColumn("avg_authors_per_paper", F.when(F.col("rows") > 0, F.col("total_author_mentions") / F.col("rows")).otherwise(0.0)).drop("rows")


def top_authors(papers: DataFrame, top_n: int = 10) -> DataFrame:
    return ranked(author_lists(papers).select(F.explode("authors").alias("author")), "author", top_n)


def affiliation_parts(papers: DataFrame) -> DataFrame:
    """One row for each affiliation of a paper with its country and institution."""
    parts = papers.where("affiliation is not null").select("id", F.posexplode(geo.split_affiliations(F.col("affiliation"))).alias("part", "text"))
    return parts.select("id", "part", geo.country_of(F.col("text")).alias("country"), geo.institution_of(F.col("text")).alias("institution"))


def named_counts(papers: DataFrame, raw: Column, name: Column, top_n: int | None) -> DataFrame:
    """Counts by ``name``, a column over ``raw``: equal raw texts of affiliations ``text`` are counted first, so each is read once."""
    texts = papers.where("affiliation is not null").select(F.explode(geo.split_affiliations(F.col("affiliation"))).alias("text"))
    raw_counts = texts.select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    counts = raw_counts.select(name.alias("name"), "n").where("name <> ''").groupBy("name").agg(F.sum("n").alias("count"))
    ordered = counts.orderBy(F.desc("count"), "name")
    return ordered if top_n is None else ordered.limit(top_n)


def country_distribution(papers: DataFrame, top_n: int | None = None) -> DataFrame:
    last = F.when(F.contains("text", F.lit(",")), F.substring_index("text", ",", -1))
    return named_counts(papers, last, geo.normalized_country(F.col("raw")), top_n).withColumnRenamed("name", "country")


def institution_distribution(papers: DataFrame, top_n: int | None = None) -> DataFrame:
    return named_counts(papers, F.col("text"), geo.institution_of(F.col("raw")), top_n).withColumnRenamed("name", "institution")


def collaboration_rate(papers: DataFrame) -> DataFrame:
    """Share in percent of papers with an affiliation whose affiliations name two countries or more."""
    countries = F.array_distinct(F.filter(F.transform(geo.split_affiliations(F.col("affiliation")), geo.country_of), lambda c: c != ""))
    one = papers.agg(F.count("*").alias("total_papers"), F.count("affiliation").alias("papers_with_affiliation"), F.count_if(F.size(countries) > 1).alias("multi_country_papers"))
    return one.withColumn("international_collaboration_rate", F.round(percent(F.col("multi_country_papers"), F.col("papers_with_affiliation")), 2))


#: Wordings that name a class of licences, the first that a text holds counts.
LICENSE_WORDS = {"cc0": "CC0", "public domain": "Public Domain", "publisher": "Publisher", "copyright": "Publisher", "open access": "Open Access", "creative commons": "Creative Commons (other)"}
#: A Creative Commons code: its conditions are the parts behind "cc-by".
LICENSE_CODE = "cc-by((?:-(?:nc|nd|sa))*)"


def normalized_license(license: Column) -> Column:
    """The class of a licence: that of its code, else of its wording, else the text itself.

    A code's class is made of the conditions in it, whatever else the text says; share-alike isn't told apart.
    """
    low = F.lower(trimmed(license))
    conditions = F.split(F.regexp_extract(low, LICENSE_CODE, 1), "-")
    named = [F.when(F.array_contains(conditions, c), F.lit(c.upper())) for c in ("nc", "nd")]
    code = F.when(F.rlike(low, F.lit(LICENSE_CODE)), F.concat_ws("-", F.lit("CC-BY"), *named))
    worded = [F.when(F.contains(low, F.lit(text)), F.lit(name)) for text, name in LICENSE_WORDS.items()]
    return F.coalesce(code, F.when(low == "pd", F.lit("Public Domain")), *worded, F.nullif(trimmed(license), F.lit("")), F.lit("Unknown"))


def license_distribution(papers: DataFrame, top_n: int | None = None) -> DataFrame:
    stated = papers.where(F.col("license").isNotNull() & ~F.lower(trimmed(F.col("license"))).isin(*NO_LICENSE))
    return ranked(stated.select(normalized_license(F.col("license")).alias("license")), "license", top_n)


def access_distribution(papers: DataFrame) -> DataFrame:
    """Open and closed access, full-text availability and its sources, in one row."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    full = flag("hasPDF") | flag("inPMC") | flag("inEPMC")
    one = papers.agg(
        F.count("*").alias("total_papers"), F.count_if(F.col("isOpenAccess") == "Y").alias("open_access_count"), F.count_if(full).alias("has_fulltext_count"),
        F.count_if(flag("hasPDF")).alias("pdf"), F.count_if(flag("inPMC")).alias("pmc"), F.count_if(flag("inEPMC")).alias("epmc"),
    )
    total = F.col("total_papers")
    one = one.withColumn("closed_access_count", total - F.col("open_access_count")).withColumn("no_fulltext_count", total - F.col("has_fulltext_count"))
    shares = ("open_access", "closed_access", "has_fulltext", "no_fulltext")
    return one.select("*", *(F.round(percent(F.col(f"{n}_count"), total), 2).alias(f"{n}_percentage") for n in shares))


def citation_by_access_type(papers: DataFrame) -> DataFrame:
    """Citation statistics of open and closed papers; a group of one has a deviation of 0."""
    c = F.col("citedByCount").cast("double")
    grouped = papers.groupBy(F.coalesce(F.col("isOpenAccess") == "Y", F.lit(False)).alias("open_access")).agg(
        F.count("*").alias("count"), F.avg(c).alias("mean_citations"), F.percentile(c, F.lit(0.5)).alias("median_citations"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_citations"), F.sum("citedByCount").alias("total_citations"),
        F.percentile(c, F.lit(0.25)).alias("p25"), F.percentile(c, F.lit(0.75)).alias("p75"), F.percentile(c, F.lit(0.9)).alias("p90"),
    )
    return grouped


def access_citation_effect(papers: DataFrame) -> DataFrame:
    """Cohen's d, Welch's t with its degrees of freedom, and the open-access advantage in percent.

    The sums of one pass give all of them. ``is_significant`` compares |t| with the 5 %
    point of Student's t from a series in 1/df (exact to three digits from five
    degrees of freedom on).
    """
    c, is_open = F.col("citedByCount").cast("double"), F.coalesce(F.col("isOpenAccess") == "Y", F.lit(False))
    s = papers.agg(*(f(F.when(which, c)).alias(f"{n}_{side}") for side, which in (("o", is_open), ("c", ~is_open)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    enough = (F.col("n_o") > 1) & (F.col("n_c") > 1)
    pooled = F.sqrt((F.col("v_o") * (F.col("n_o") - 1) + F.col("v_c") * (F.col("n_c") - 1)) / (F.col("n_o") + F.col("n_c") - 2))
    gap = F.col("m_o") - F.col("m_c")
    eo, ec = F.col("v_o") / F.col("n_o"), F.col("v_c") / F.col("n_c")
    t = gap / F.sqrt(eo + ec)
    df = (eo + ec) ** 2 / (eo**2 / (F.col("n_o") - 1) + ec**2 / (F.col("n_c") - 1))
    z = 1.959963984540054
    critical = F.lit(z) + F.lit((z**3 + z) / 4) / df + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / df**2 + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / df**3
    return s.select(
        F.coalesce(F.round(F.when(enough & (pooled > 0), gap / pooled), 4), F.lit(0.0)).alias("effect_size"),
        F.coalesce(enough & (F.abs(t) > critical), F.lit(False)).alias("is_significant"),
        F.coalesce(F.round(F.when(F.col("m_c") > 0, gap / F.col("m_c") * 100), 2), F.lit(0.0)).alias("citation_impact_score"),
    )


def disease_trends(papers: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """``(key, year, count)``: papers by year whose title or abstract holds one of a key's terms."""
    text = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower(F.coalesce("abstractText", F.lit(""))))
    def hit(names: list[str]) -> Column:
        found = F.lit(False)
        for n in names:
            found = found | F.contains(text, F.lit(n.lower()))
        return found
    keys = F.array_compact(F.array(*(F.when(hit(names), F.lit(key)) for key, names in terms.items())))
    dated = papers.select(year_of().alias("year"), keys.alias("keys")).where("year is not null and size(keys) > 0")
    return dated.select(F.explode("keys").alias("key"), "year").groupBy("key", "year").agg(F.count("*").alias("count"))


def growth_rates(trends: DataFrame) -> DataFrame:
    """Totals and compound annual growth in percent between each key's first and last year."""
    one = trends.groupBy("key").agg(F.sum("count").alias("total_publications"), F.min("year").alias("y0"), F.max("year").alias("y1"), F.min_by("count", "year").alias("c0"), F.max_by("count", "year").alias("c1"))
    rate = F.round((F.pow(F.col("c1") / F.col("c0"), F.lit(1.0) / (F.col("y1") - F.col("y0"))) - 1) * 100, 2)
    return one.select("key", "total_publications", F.when(F.col("y1") > F.col("y0"), rate).otherwise(0.0).alias("growth_rate"))


def trend_crossover(trends: DataFrame, first: str, second: str) -> DataFrame:
    """The first year in which ``second`` comes up to ``first``, and the ratio then; no row if it never does."""
    by_year = trends.groupBy("year").agg(F.coalesce(F.sum(F.when(F.col("key") == first, F.col("count"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("key") == second, F.col("count"))), F.lit(0)).alias("b")).where("a > 0 or b > 0")
    ratio = F.when(F.col("a") > 0, F.col("b") / F.col("a")).when(F.col("b") > 0, F.lit(float("inf"))).otherwise(0.0)
    # a row for each year: the window's only partition has as many rows as there are years
    stepped = by_year.withColumn("ratio", ratio).withColumn("before", F.expr("coalesce(lag(ratio) over (order by year), 0.0)"))
    return stepped.where("before < 1 and ratio >= 1").orderBy("year").limit(1).select(F.col("year").alias("overtaken_year"), F.round("ratio", 4).alias("ratio_at_crossover"))


def trend_analysis(papers: DataFrame) -> DataFrame:
    c = F.col("citedByCount").cast("double")
    return papers.select(year_of().alias("year"), c.alias("c")).where("year is not null").groupBy("year").agg(F.avg("c").alias("mean_citations"), F.percentile("c", F.lit(0.5)).alias("median_citations"), F.count("*").alias("count"))


def citation_histogram(papers: DataFrame, bins: int = 30) -> DataFrame:
    """Equal bins between the least and the highest count; the last one holds its upper end."""
    ends = papers.agg(F.min("citedByCount").alias("lo"), F.max("citedByCount").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("citedByCount") - F.col("lo")) / width), F.lit(bins - 1)))
    return papers.select("citedByCount").crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def agencies(papers: DataFrame) -> DataFrame:
    """``papers`` with ``agencies`` from the "; "-joined ``grants``."""
    parts = F.filter(F.transform(F.split("grants", ";"), trimmed), lambda a: ~F.lower(a).isin(*NO_AGENCY))
    return papers.withColumn("agencies", F.coalesce(parts, F.array().cast("array<string>")))


def funding_summary(papers: DataFrame) -> DataFrame:
    """Funded papers, papers of several funders, and the concentration of funders (sum of squared shares)."""
    listed = agencies(papers).select("agencies")
    one = listed.agg(F.count_if(F.size("agencies") > 0).alias("total_funded_papers"), F.count_if(F.size("agencies") > 1).alias("multi_funder_papers"))
    counted = listed.select(F.explode("agencies").alias("agency")).groupBy("agency").agg(F.count("*").alias("n"))
    shares = counted.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum("n").alias("all"))
    index = F.coalesce(F.round(F.col("squares") / (F.col("all").cast("double") * F.col("all")), 6), F.lit(0.0))
    return one.crossJoin(shares).select("total_funded_papers", "multi_funder_papers", index.alias("concentration_index"))


def funder_distribution(papers: DataFrame, top_n: int | None = None) -> DataFrame:
    return ranked(agencies(papers).select(F.explode("agencies").alias("agency")), "agency", top_n)


def funding_by_year(papers: DataFrame) -> DataFrame:
    listed = agencies(papers).select(year_of().alias("year"), F.explode("agencies").alias("agency")).where("year is not null")
    return listed.groupBy("year", "agency").agg(F.count("*").alias("count"))


def prisma_summary(log: DataFrame) -> DataFrame:
    """Records found over all databases, where a database's last entry by ``seq`` counts, and the later totals."""
    last = log.groupBy("database").agg(F.max_by("results", "seq").alias("records"))
    return last.agg(F.count("*").alias("databases"), F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of an enrichment run over rows of (identifier, sources): one is a success if it has a source."""
    n = F.size(F.coalesce("sources", F.array().cast("array<string>")))
    one = results.agg(F.count("*").alias("total"), F.count_if(n > 0).alias("successful"), F.avg(F.when(n > 0, n)).alias("avg_sources_per_success"))
    used = results.select(F.explode("sources").alias("source")).groupBy("source").count()
    best = used.agg(F.max_by("source", F.struct("count", "source")).alias("most_used_source"))
    rate = percent(F.col("successful"), F.col("total"))
    return one.crossJoin(best).select("*", (F.col("total") - F.col("successful")).alias("failed"), rate.alias("success_rate"))
