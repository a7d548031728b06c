"""Reconciling the same work across sources: the first source that knows a field gives it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.identifiers import normalized_doi
from folioscope.functions.text import trimmed


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def side_by_side(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """``key`` and a struct for each frame, null where it has no row of the key: one union and one grouping, whatever their number.

    A frame has one row for each key; of several one is taken.
    """
    kinds = {n: f"struct<{', '.join(f'`{c}`:{df.schema[c].dataType.simpleString()}' for c in df.columns if c != key)}>" for n, df in frames.items()}
    rows = [df.select(key, *(F.struct(*(c for c in df.columns if c != key)).alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n) for n in frames)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(*(F.first(n, ignorenulls=True).alias(n) for n in frames))


def merge_sources(sources: dict[str, DataFrame], key: str = "id", text: tuple[str, ...] = ("title", "journal"), counts: tuple[str, ...] = ("cited",), ids: tuple[str, ...] = ("doi",)) -> DataFrame:
    """One row for each key of any source, sources in the order of their trust.

    Text fields take the first value; counts become the largest, with each source's
    own; identifiers take the first in normal form, and differing later ones are
    listed as conflicts; ``sources`` names who had the work.
    """
    joined = side_by_side({name: df.select(key, *text, *counts, *ids) for name, df in sources.items()}, key)
    names = list(sources)
    columns = [first_of(*(F.col(f"{n}.{f}") for n in names)).alias(f) for f in text]
    columns += [F.greatest(*(F.col(f"{n}.{f}") for n in names)).alias(f) for f in counts] if len(names) > 1 else [F.col(f"{names[0]}.{f}") for f in counts]
    for f in ids:
        values = [normalized_doi(F.col(f"{n}.{f}")) if f == "doi" else F.nullif(trimmed(F.col(f"{n}.{f}")), F.lit("")) for n in names]
        chosen = F.coalesce(*values)
        listed = F.array_compact(F.array(*(F.when(v.isNotNull() & (v != chosen), F.concat(F.lit(f"{n}:"), v)) for n, v in zip(names, values))))
        columns += [chosen.alias(f), F.array_join(listed, ",").alias(f"{f}_conflicts")]
    known = F.array_join(F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names))), ",")
    return joined.select(key, *columns, known.alias("sources"))


def merge_authors(authors: DataFrame) -> DataFrame:
    """Rows (paper, source, source_rank, pos, name, orcid, affiliation) as one row for each person of a paper.

    Names meet in lower case without outer spaces; each field takes the first known
    value by source and position. People of more sources come first, then by first appearance, then by name.
    """
    order = F.struct("source_rank", "pos")
    first = lambda c: F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), order))
    grouped = authors.groupBy("paper", F.lower(trimmed(F.col("name"))).alias("person")).agg(
        F.min_by("name", order).alias("name"), first("orcid").alias("orcid"), first("affiliation").alias("affiliation"),
        F.count_distinct("source").alias("n_sources"), F.min(order).alias("seen"),
    )
    place = F.expr("row_number() over (partition by paper order by n_sources desc, seen, person)")
    return grouped.select("paper", place.alias("place"), "name", "orcid", "affiliation", "n_sources")


def fill_blank(base: DataFrame, extra: DataFrame, key: str, source: str) -> DataFrame:
    """``base`` with blank text fields filled from ``extra`` and the source's name added to ``data_sources``."""
    shared = [c for c in base.columns if c in extra.columns and c not in (key, "data_sources")]
    other = extra.select(key, *(F.col(c).alias(f"__{c}") for c in shared), F.lit(True).alias("__found"))
    joined = base.join(other, key, "left")
    filled = {c: F.coalesce(F.nullif(trimmed(F.col(c).cast("string")), F.lit("")).cast(base.schema[c].dataType), F.col(f"__{c}")) for c in shared}
    if "data_sources" in base.columns:
        filled["data_sources"] = F.when(F.col("__found"), F.array_union("data_sources", F.array(F.lit(source)))).otherwise(F.col("data_sources"))
    return joined.withColumns(filled).select(base.columns)


def ror_key(c: Column) -> Column:
    """A research organisation id without URL and slashes; null if it has other characters."""
    t = F.regexp_replace(F.lower(trimmed(c)), "^(https?://)?(www\\.)?ror\\.org/|/+$", "")
    return F.when(F.rlike(t, F.lit("^[a-z0-9-]+$")), t)


def enrich_institutions(institutions: DataFrame, registry: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Left join by organisation id; the registry's fields win where it has them."""
    other = registry.select(ror_key(F.col("ror_id")).alias("__ror"), *(F.col(f).alias(f"__{f}") for f in fields))
    joined = institutions.withColumn("__key", ror_key(F.col("ror_id"))).join(other, F.col("__key") == F.col("__ror"), "left")
    merged = {f: F.coalesce(F.col(f"__{f}"), F.col(f)) if f in institutions.columns else F.col(f"__{f}") for f in fields}
    return joined.withColumns(merged | {"ror_enriched": F.col("__ror").isNotNull()}).drop("__key", "__ror", *(f"__{f}" for f in fields))


def match_authors(authors: DataFrame, enriched: DataFrame) -> DataFrame:
    """Fill blank author ids from the first enriched author of the paper with the same name but for titles."""
    plain = lambda c: trimmed(F.regexp_replace(F.lower(c), "\\b(dr|prof|mr|mrs|ms)\\.? ", ""))
    first = enriched.groupBy("paper", plain(F.col("name")).alias("__name")).agg(F.min_by("orcid", "pos").alias("__orcid"))
    joined = authors.withColumn("__name", plain(F.col("name"))).join(first, ["paper", "__name"], "left")
    return joined.withColumn("orcid", first_of(F.col("orcid"), F.col("__orcid"))).drop("__name", "__orcid")
