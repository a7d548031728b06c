"""Paper filters: all criteria, or the basic ones and any of the content criteria."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meets_year(least: int, most: int | None = None) -> Column:
    """A missing or empty year passes, an unreadable one fails."""
    y = F.col("pubYear")
    number = y.try_cast("int")
    inside = (number >= least) & (F.lit(True) if most is None else number <= most)
    return y.isNull() | (y == "") | F.coalesce(inside, F.lit(False))


def meets_type(types: Column, allowed: Collection[str]) -> Column:
    """``types`` is an array of whole type strings; null (both fields absent) passes, an empty one fails."""
    if not allowed:
        return F.lit(True)
    names = [a.lower() for a in allowed]
    return types.isNull() | F.exists(types, lambda t: F.lower(t).isin(*names))


def meets_access(wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.coalesce("isOpenAccess", F.lit("N")) == wanted


def meets_basic(min_citations: int, min_year: int, max_year: int | None, allowed: Collection[str], open_access: str | None, types: Column) -> Column:
    cited = F.coalesce(F.col("citedByCount").try_cast("bigint") >= min_citations, F.lit(False))
    return F.coalesce(cited & meets_year(min_year, max_year) & meets_type(types, allowed) & meets_access(open_access), F.lit(False))


def terms_in(values: Column, terms: Collection[str], every: bool) -> Column:
    """Whether every (or any) term is part of some value of an array, in any case."""
    def holds(term: str) -> Column:
        return F.coalesce(F.exists(values, lambda v: F.contains(F.lower(v), F.lit(term.lower()))), F.lit(False))

    tests = [holds(t) for t in sorted(terms)]
    out = F.lit(every)
    for test in tests:
        out = out & test if every else out | test
    return out


def filter_papers(
    papers: DataFrame, min_citations: int = 0, min_year: int = 2000, max_year: int | None = None, allowed: Collection[str] = (), open_access: str | None = "Y",
    mesh: Collection[str] | None = None, keywords: Collection[str] | None = None, abstract: Collection[str] | None = None,
    mesh_column: str = "mesh", keyword_column: str = "keywords", types: Column | None = None,
) -> DataFrame:
    """Papers that meet everything; an empty set of terms is no criterion."""
    types = F.array("pubType") if types is None else types
    test = meets_basic(min_citations, min_year, max_year, allowed, open_access, types)
    for terms, values in ((mesh, mesh_column), (keywords, keyword_column)):
        if terms:
            test = test & terms_in(F.col(values), terms, every=True)
    if abstract:
        test = test & terms_in(F.array("abstractText"), abstract, every=True)
    return papers.where(test)


def filter_papers_or(
    papers: DataFrame, min_citations: int = 0, min_year: int = 2000, max_year: int | None = None, allowed: Collection[str] = (), open_access: str | None = "Y",
    mesh: Collection[str] | None = None, keywords: Collection[str] | None = None, abstract: Collection[str] | None = None,
    mesh_column: str = "mesh", keyword_column: str = "keywords", types: Column | None = None,
) -> DataFrame:
    """Papers that meet the basic criteria and any content one. None is absent, an empty set never matches;
    without any content criterion the basic ones decide."""
    types = F.array("pubType") if types is None else types
    test = meets_basic(min_citations, min_year, max_year, allowed, open_access, types)
    given = [(t, c) for t, c in ((mesh, mesh_column), (keywords, keyword_column), (abstract, None)) if t is not None]
    if given:
        content = F.lit(False)
        for terms, values in given:
            content = content | terms_in(F.col(values) if values else F.array("abstractText"), terms, every=False)
        test = test & content
    return papers.where(test)


def available(ids: DataFrame, inventory: DataFrame, kind: str) -> DataFrame:
    """The ids for which the inventory of (pmcid, format) has a format."""
    return ids.join(inventory.where(F.col("format") == kind).select("pmcid"), "pmcid", "left_semi")
