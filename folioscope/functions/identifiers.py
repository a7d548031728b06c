"""Identifier, date and number checks: a valid value in its normal form, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed

#: Bytes of a size unit.
UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


def matching(c: Column, pattern: str) -> Column:
    return F.when(F.rlike(c, F.lit(pattern)), c)


def normalized_doi(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(trimmed(c)), "^(https?://)?(dx\\.)?doi\\.org/", ""), F.lit(""))


def orcid(c: Column) -> Column:
    return matching(F.upper(F.regexp_replace(trimmed(c), "(?i)^(https?://)?(www\\.)?orcid\\.org/", "")), "^\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX]$")


def pmcid(c: Column) -> Column:
    t = F.upper(trimmed(c))
    return matching(F.when(t.startswith("PMC"), t).otherwise(F.concat(F.lit("PMC"), t)), "^PMC\\d+$")


def pmid(c: Column) -> Column:
    return matching(trimmed(c), "^\\d{6,10}$")


def issn(c: Column) -> Column:
    return matching(F.upper(trimmed(c)), "^\\d{4}-\\d{3}[\\dX]$")


def email(c: Column) -> Column:
    return matching(F.lower(trimmed(c)), "^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$")


def uri(c: Column) -> Column:
    """An absolute URI with scheme and host."""
    return matching(trimmed(c), "^[A-Za-z][A-Za-z0-9+.-]*://[^/\\s]+")


def year(c: Column) -> Column:
    y = trimmed(c).try_cast("int")
    return F.when(y.between(1000, 2100), y)


def iso_date(c: Column) -> Column:
    """The first of the usual spellings that fits."""
    t = trimmed(c)
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy MMM d", "yyyy-MM", "yyyy")
    return F.coalesce(*(F.try_to_date(t, f) for f in forms))


def volume_number(c: Column) -> Column:
    return trimmed(c.cast("string")).try_cast("int")


def boolean(c: Column) -> Column:
    low = F.lower(trimmed(c.cast("string")))
    return F.when(low.isin("true", "1", "yes", "y", "on"), True).when(low.isin("false", "0", "no", "n", "off"), False)


def non_negative(c: Column) -> Column:
    n = trimmed(c.cast("string")).try_cast("bigint")
    return F.when(n >= 0, n)


def position(lat: Column, lon: Column) -> Column:
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("latitude"), lon.alias("longitude")))


def clamped_int(c: Column, default: int, least: int = 1, most: int = 1000) -> Column:
    n = c.cast("string").try_cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(least)), F.lit(most))).otherwise(default)


def file_size(c: Column) -> Column:
    """Bytes of "289K" or "2.8M"; null for dates, years and other words."""
    number, unit = F.regexp_extract(trimmed(c), "^(\\d+(?:\\.\\d+)?)\\s*([BKMG])$", 1), F.regexp_extract(trimmed(c), "^(\\d+(?:\\.\\d+)?)\\s*([BKMG])$", 2)
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return (F.nullif(number, F.lit("")).try_cast("double") * F.element_at(units, unit)).try_cast("bigint")


def archive_range(number: Column) -> Column:
    """``struct(low, high)`` of the bulk archive that holds a numeric id: wider ranges for longer ids."""
    width = F.when(number < 10_000, 1_000).when(number < 1_000_000, 10_000).otherwise(100_000)
    low = (F.floor(number / width) * width).cast("bigint")
    return F.struct(low.alias("low"), (low + width - 1).cast("bigint").alias("high"))


def slug_text(c: Column) -> Column:
    """``slug`` that may be empty."""
    return F.regexp_replace(trimmed(F.lower(F.regexp_replace(c, "[^A-Za-z0-9 ]", ""))), " +", "-")


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case with hyphens between words; other characters vanish."""
    return F.nullif(slug_text(c), F.lit(""))


def cache_key(kind: str, prefix: Column, params: Column, version: int = 1) -> Column:
    """``kind:vN:prefix:digest`` with 16 hex digits of the parameters' canonical JSON."""
    return F.concat_ws(":", F.lit(kind), F.lit(f"v{version}"), prefix, F.substring(F.sha2(params.cast("binary"), 256), 1, 16))
