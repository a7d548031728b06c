"""One record for each work from what four services say of it (the frames of ``sources.responses``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.identifiers import normalized_doi
from folioscope.operators.merge import first_of, side_by_side

SERVICES = ("crossref", "openalex", "unpaywall", "semantic_scholar")


def joined_services(key: str = "id", **frames: DataFrame) -> DataFrame:
    """``key`` and one struct for each service, null where it doesn't know the work."""
    return side_by_side({s: frames[s] for s in SERVICES}, key)


def dates() -> dict[str, Column]:
    """The first date; the year takes its place where none is known."""
    day = first_of(F.col("crossref.publication_date"), F.col("openalex.publication_date"))
    return {"publication_date": day, "publication_year": F.when(day.isNull(), F.nullif(F.col("openalex.publication_year"), F.lit(0)))}


def citations() -> dict[str, Column]:
    """Each service's count, and the largest."""
    said = lambda s: F.when(F.col(f"{s}.citation_count").isNotNull(), F.struct(F.lit(s).alias("source"), F.col(f"{s}.citation_count").alias("count")))
    counts = F.array_compact(F.array(said("crossref"), said("semantic_scholar"), said("openalex")))
    return {"citation_counts": F.when(F.size(counts) > 0, counts), "citation_count": F.array_max(F.transform(counts, lambda c: c["count"]))}


def open_access() -> dict[str, Column]:
    """All of it from the open-access service where that knows the work, else from the catalogue."""
    either = lambda a, b: F.when(F.col("unpaywall").isNotNull(), F.col(f"unpaywall.{a}")).otherwise(F.col(f"openalex.{b}"))
    return {"is_oa": either("is_oa", "is_oa"), "oa_status": either("oa_status", "oa_status"), "oa_url": either("best_oa_location.url", "oa_url")}


def bibliography() -> dict[str, Column]:
    """Each field from the registry, else the catalogue, else the citation graph; first and last page are the catalogue's alone."""
    of = {
        "volume": ("crossref.volume", "openalex.biblio.volume", "semantic_scholar.journal.volume"), "issue": ("crossref.issue", "openalex.biblio.issue"),
        "pages": ("crossref.page", "semantic_scholar.journal.pages"), "first_page": ("openalex.biblio.first_page",), "last_page": ("openalex.biblio.last_page",),
        "publisher": ("crossref.publisher",), "type": ("crossref.type",),
    }
    issn = F.col("crossref.issn")
    return {name: first_of(*map(F.col, paths)) for name, paths in of.items()} | {"issn": F.when(F.size(issn) > 0, issn)}


def references() -> dict[str, Column]:
    """The largest count of references above 0, citations by the catalogue, related works."""
    counts = ("crossref.references_count", "semantic_scholar.reference_count", "openalex.referenced_works_count")
    related = F.col("openalex.related_works")
    return {
        "reference_count": F.greatest(*(F.nullif(F.col(c), F.lit(0)) for c in counts)),
        "cited_by_count": F.nullif(F.col("openalex.citation_count"), F.lit(0)),
        "related_works": F.when(F.size(related) > 0, related),
    }


def identifiers() -> dict[str, Column]:
    """The DOI of the first service that has one, and what others say instead."""
    said = [(s, normalized_doi(F.col(f"{s}.doi"))) for s in ("semantic_scholar", "openalex", "crossref")]
    chosen = F.coalesce(*(d for _, d in said))
    others = F.array_compact(F.array(*(F.when(d != chosen, F.concat(F.lit(f"{s}:"), d)) for s, d in said)))
    return {"doi": chosen, "doi_conflicts": others, "pmid": F.nullif(F.col("semantic_scholar.pmid"), F.lit(""))}


def merged(joined: DataFrame, key: str = "id") -> DataFrame:
    """Every field of the joined services, one column each; a field that no service knows is null."""
    text = {
        "title": first_of(F.col("crossref.title"), F.col("openalex.title"), F.col("semantic_scholar.title")), "abstract": first_of(F.col("crossref.abstract"), F.col("semantic_scholar.abstract")),
        "journal": first_of(F.col("crossref.journal"), F.col("openalex.venue.display_name")),
    }
    single = {
        "influential_citation_count": F.col("semantic_scholar.influential_citation_count"), "fields_of_study": F.col("semantic_scholar.fields_of_study"), "topics": F.col("openalex.topics"),
        "license": F.col("crossref.license"), "funding": F.col("crossref.funders"),
    }
    fields = text | dates() | citations() | open_access() | single | bibliography() | references() | identifiers()
    known = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.lit(s)) for s in SERVICES)))
    return joined.select(key, *(c.alias(n) for n, c in fields.items()), known.alias("data_sources"))


def paper_entities(records: DataFrame, key: str = "id") -> DataFrame:
    """Merged records as rows of the paper entity: blank text is null, outer space goes, booleans and counts keep their kind."""
    text = [f.name for f in records.schema.fields if f.dataType.simpleString() == "string" and f.name not in (key, "doi")]
    cleaned = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in text}
    return records.withColumns(cleaned | {"doi": normalized_doi(F.col("doi")), "license_url": F.nullif(F.trim(F.col("license.url")), F.lit(""))})


def doi_of(identifiers: DataFrame, known: DataFrame, column: str = "identifier") -> DataFrame:
    """``identifiers`` with ``doi``: DOI addresses and bare DOIs as they are, PMC ids by the table ``known`` of (pmcid, doi); else null."""
    given = F.trim(F.col(column))
    direct = F.regexp_extract(given, "^(?:https?://(?:dx\\.)?doi\\.org/)?(10\\..+)$", 1)
    pmcid = F.when(F.startswith(F.upper(given), F.lit("PMC")), F.upper(given))
    table = known.select(F.upper("pmcid").alias("__pmcid"), F.col("doi").alias("__doi"))
    joined = identifiers.withColumn("__key", pmcid).join(table, F.col("__key") == F.col("__pmcid"), "left")
    return joined.withColumn("doi", F.coalesce(F.nullif(direct, F.lit("")), F.col("__doi"))).drop("__key", "__pmcid", "__doi")
