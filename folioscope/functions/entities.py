"""Row checks of entities: an array of messages, empty where a row is valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import affiliation
from folioscope.functions import identifiers as ids
from folioscope.functions.text import normalize_string


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))


def wrong(c: str, normal: Column) -> Column:
    """A value is given that has no normal form."""
    return ~blank(c) & normal.isNull()


#: Checks by entity: (message, columns it needs, condition of the fault).
CHECKS = {
    "paper": [
        ("needs a pmcid, doi or title", ("pmcid", "doi", "title"), lambda: blank("pmcid") & blank("doi") & blank("title")),
        ("citedByCount is negative", ("citedByCount",), lambda: F.col("citedByCount") < 0),
        ("publication year is out of range", ("pubYear",), lambda: wrong("pubYear", ids.year(F.col("pubYear")))),
        ("pmcid is malformed", ("pmcid",), lambda: wrong("pmcid", ids.pmcid(F.col("pmcid")))),
        ("pmid is malformed", ("pmid",), lambda: wrong("pmid", ids.pmid(F.col("pmid")))),
        ("oa_url is no absolute address", ("oa_url",), lambda: wrong("oa_url", ids.uri(F.col("oa_url")))),
    ],
    "author": [
        ("needs a name", ("name",), lambda: blank("name")),
        ("orcid is malformed", ("orcid",), lambda: wrong("orcid", ids.orcid(F.col("orcid")))),
        ("email is malformed", ("email",), lambda: wrong("email", ids.email(F.col("email")))),
    ],
    "institution": [
        ("needs a display name", ("display_name",), lambda: blank("display_name")),
        ("position is out of range", ("latitude", "longitude"), lambda: ids.position(F.col("latitude"), F.col("longitude")).isNull() & F.col("latitude").isNotNull()),
        ("established is negative", ("established",), lambda: F.col("established") < 0),
    ],
    "journal": [("needs a title", ("title",), lambda: blank("title")), ("issn is malformed", ("issn",), lambda: wrong("issn", ids.issn(F.col("issn"))))],
    "section": [("content is missing", ("content",), lambda: F.col("content").isNull()), ("begin isn't before end", ("begin", "end"), lambda: (F.col("begin") < 0) | (F.col("begin") >= F.col("end")))],
    "figure": [("graphic_uri is no absolute address", ("graphic_uri",), lambda: wrong("graphic_uri", ids.uri(F.col("graphic_uri"))))],
    "reference": [("year is out of range", ("year",), lambda: wrong("year", ids.year(F.col("year").cast("string"))))],
    "annotation": [("exact is missing", ("exact",), lambda: blank("exact"))],
    "table_row": [("needs cells", ("cells",), lambda: F.coalesce(F.size("cells") == 0, F.lit(True)))],
    "table": [
        ("rows differ in width", ("rows",), lambda: F.size(F.array_distinct(F.transform("rows", F.size))) > 1),
        ("headers don't fit the rows", ("headers", "rows"), lambda: (F.size("rows") > 0) & (F.size("headers") > 0) & (F.size("headers") != F.size(F.get("rows", F.lit(0))))),
    ],
}


def with_errors(df: DataFrame, entity: str) -> DataFrame:
    """``df`` with ``errors``; checks whose columns are absent don't apply."""
    tests = [F.when(F.coalesce(test(), F.lit(False)), F.lit(message)) for message, needs, test in CHECKS[entity] if set(needs) <= set(df.columns)]
    return df.withColumn("errors", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def valid(df: DataFrame, entity: str) -> DataFrame:
    return with_errors(df, entity).where("size(errors) = 0").drop("errors")


def text(c: str) -> Column:
    return normalize_string(F.col(c), allow_empty=True)


def country(c: str) -> Column:
    """A country's usual name; null for what is too short or a number."""
    name = F.nullif(affiliation.normalized_country(F.col(c)), F.lit(""))
    return F.when((F.length(name) >= 2) & ~F.rlike(name, F.lit("^\\d+$")), name)


def of(normal: Callable[[Column], Column]) -> Callable[[str], Column]:
    return lambda c: normal(F.col(c))


#: Normal forms by entity and column; text has no outer space, identifiers without a normal form are null.
NORMAL = {
    "author": dict.fromkeys(("name", "full_name", "first_name", "last_name", "initials", "affiliation_text", "position", "semantic_scholar_author_id", "scopus_author_id", "researcher_id"), text)
    | {"orcid": of(ids.orcid), "email": of(ids.email), "openalex_id": of(ids.uri), "semantic_scholar_id": of(ids.uri)},
    "institution": dict.fromkeys(("display_name", "country_code", "city", "institution_type", "grid_id", "isni", "wikidata_id", "fundref_id"), text) | {"ror_id": of(ids.uri), "openalex_id": of(ids.uri), "website": of(ids.uri), "country": country},
    "grant": dict.fromkeys(("fundref_doi", "funding_source", "award_id", "recipient"), text),
    "table_row": {"cells": lambda c: F.transform(F.filter(c, lambda x: x != ""), lambda x: normalize_string(x, allow_empty=True))},
}


def normalized(df: DataFrame, entity: str) -> DataFrame:
    """``df`` with the columns that the entity knows in their normal form; others stay, and the required name of a person or place is never null."""
    required = {"author": "full_name", "institution": "display_name"}.get(entity)
    found = {c: form(c) for c, form in NORMAL[entity].items() if c in df.columns}
    if required in found:
        found[required] = F.coalesce(found[required], F.lit(""))
    return df.withColumns(found)
