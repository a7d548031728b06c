"""Affiliation, country and place expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed

#: Title-case spellings of countries that stand for another name.
COUNTRIES = {
    "Usa": "United States",
    "Us": "United States",
    "U.S.A.": "United States",
    "U.S.": "United States",
    "America": "United States",
    "Uk": "United Kingdom",
    "U.K.": "United Kingdom",
    "England": "United Kingdom",
    "Scotland": "United Kingdom",
    "Wales": "United Kingdom",
    "Northern Ireland": "United Kingdom",
    "Deutschland": "Germany",
    "Italia": "Italy",
    "España": "Spain",
}
#: What is cut from institution names, and beginnings of names of units rather than institutions.
CUT_PREFIXES = ("Department of", "Institute of", "Center for", "Centre for", "Laboratory of")
UNIT_STARTS = "^(dept|department|lab)"


def split_affiliations(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(c, "\n", ";"), ";"), trimmed), lambda a: a != "")


def titled(c: Column) -> Column:
    """Each run of letters with its first letter in upper case, also behind dots and hyphens."""
    parts = F.split(F.lower(c), "(?<=[^\\p{L}])|(?=[^\\p{L}])")
    return F.array_join(F.transform(parts, F.initcap), "")


def normalized_country(c: Column) -> Column:
    name = titled(trimmed(c))
    names = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, name), name)


def country_of(affiliation: Column) -> Column:
    """The last of two comma-separated parts or more, as a country; else empty."""
    parts = F.transform(F.split(affiliation, ","), trimmed)
    return F.when(F.size(parts) >= 2, normalized_country(F.element_at(parts, -1))).otherwise("")


def institution_of(affiliation: Column) -> Column:
    """The first comma-separated part without words that hold "@" and common prefixes; units are empty."""
    words = F.filter(F.split(trimmed(affiliation), "\\s+"), lambda w: ~F.contains(w, F.lit("@")))
    first = trimmed(F.split_part(F.array_join(words, " "), F.lit(","), F.lit(1)))
    name = first
    for prefix in CUT_PREFIXES:
        name = trimmed(F.replace(name, F.lit(prefix), F.lit("")))
    return F.when((F.length(first) < 3) | F.rlike(F.lower(name), F.lit(UNIT_STARTS)), "").otherwise(name)


def clean_affiliation(c: Column) -> Column:
    """Without e-mail addresses, links, phone numbers and contact notes."""
    out = F.regexp_replace(c, "(?i)(electronic address|e-?mail|correspondence|contact)\\s*:.*$", "")
    out = F.regexp_replace(F.regexp_replace(out, "\\S+@\\S+", ""), "https?://\\S+|www\\.\\S+", "")
    out = F.regexp_replace(out, "(?i)\\b(tel|phone|fax)\\b[.:]?\\s*[+0-9() -]+", "")
    return trimmed(F.regexp_replace(out, "\\s+", " "))


def is_postal_code(c: Column) -> Column:
    t = trimmed(c)
    return F.rlike(t, F.lit("^\\d{5}(-\\d{4})?$")) | F.rlike(t, F.lit("(?i)^[a-z]\\d[a-z]\\s?\\d[a-z]\\d$")) | F.rlike(t, F.lit("(?i)^[a-z]{1,2}\\d[a-z\\d]?\\s*\\d[a-z]{2}$")) | F.rlike(t, F.lit("^\\d{4,6}$"))


def place_parts(affiliation: Column) -> Column:
    """``struct(institution, city, postal_code, country)`` of one affiliation by the order of its parts."""
    parts = F.filter(F.transform(F.split(affiliation, ","), trimmed), lambda p: p != "")
    country = F.when(F.size(parts) >= 2, normalized_country(F.element_at(parts, -1)))
    rest = F.when(F.size(parts) >= 2, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    postal = F.get(F.filter(rest, is_postal_code), F.lit(0))
    named = F.filter(rest, lambda p: ~is_postal_code(p))
    city = F.when(F.size(named) >= 2, F.element_at(named, -1))
    return F.struct(F.get(named, F.lit(0)).alias("institution"), city.alias("city"), postal.alias("postal_code"), country.alias("country"))
