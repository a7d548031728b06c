"""Raw records as the flat paper table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name) == "Y", F.lit(False))


def journal_title() -> Column:
    return F.coalesce(F.nullif(F.col("journalTitle"), F.lit("")), F.col("journalInfo.journal.title"), F.lit(""))


def mesh_terms() -> Column:
    """Descriptors joined by "; ", major topics with a star."""
    named = F.filter("meshHeadingList.meshHeading", lambda m: m["descriptorName"].isNotNull())
    return _text(F.array_join(F.transform(named, lambda m: F.concat(m["descriptorName"], F.when(m["majorTopic_YN"] == "Y", "*").otherwise(""))), "; "))


def grant_agencies() -> Column:
    return _text(F.array_join(F.transform(F.filter("grantsList.grant", lambda g: g["agency"] != ""), lambda g: g["agency"]), "; "))


def flat_papers(raw: DataFrame) -> DataFrame:
    """The 27 columns and ``pos``; a record whose citation count is no number is dropped.

    ``pos`` is that of ``raw`` (a page's readers give it), which doesn't depend on how files
    are split; without one, rows are numbered as they come.
    """
    cited = F.coalesce(F.nullif(F.col("citedByCount"), F.lit("")), F.lit("0")).try_cast("bigint")
    rows = raw.select(
        F.col("id"), _text(F.col("source")).alias("source"), _text(F.col("title")).alias("title"), _text(F.col("authorString")).alias("authorString"), journal_title().alias("journalTitle"),
        F.col("pubYear"), _text(F.col("pubType")).alias("pubType"), F.coalesce("isOpenAccess", F.lit("N")).alias("isOpenAccess"), cited.alias("citedByCount"), F.col("doi"), F.col("pmid"), F.col("pmcid"),
        _text(F.col("abstractText")).alias("abstractText"), (_text(F.col("abstractText")) != "").alias("hasAbstract"), _yes("hasPDF").alias("hasPDF"), _yes("inPMC").alias("inPMC"), _yes("inEPMC").alias("inEPMC"),
        _text(F.col("language")).alias("language"), _text(F.col("pageInfo")).alias("pageInfo"), _text(F.col("affiliation")).alias("affiliation"), mesh_terms().alias("meshTerms"), grant_agencies().alias("grants"),
        _text(F.col("bookOrReportDetails.publisher")).alias("publisher"), _text(F.col("firstPublicationDate")).alias("firstPublicationDate"),
        _yes("hasReferences").alias("hasReferences"), _yes("hasTextMinedTerms").alias("hasTextMinedTerms"), _yes("hasDbCrossReferences").alias("hasDbCrossReferences"),
        (F.col("pos") if "pos" in raw.columns else F.monotonically_increasing_id()).alias("pos"),
    )
    return rows.where("citedByCount is not null")


def paper_authors(raw: DataFrame) -> DataFrame:
    """``(id, pos, author)`` by full name, else last name."""
    listed = raw.select("id", F.posexplode("authorList.author").alias("pos", "a"))
    return listed.select("id", "pos", F.coalesce(F.nullif(F.col("a.fullName"), F.lit("")), F.col("a.lastName")).alias("author")).where("author is not null")


def open_access_url(raw: DataFrame) -> DataFrame:
    """The first full-text address marked as open access."""
    first = F.get(F.filter("fullTextUrlList.fullTextUrl", lambda u: u["availabilityCode"] == "OA"), F.lit(0))["url"]
    return raw.select("id", _yes("isOpenAccess").alias("is_oa"), first.alias("oa_url"))
