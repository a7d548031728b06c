"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space at both ends; ``trim`` alone takes spaces only. Only the ends are looked at, unlike by a pattern."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def collapsed(c: Column) -> Column:
    """Each run of white space as one space; single spaces, which most runs are, stay as they are."""
    return F.regexp_replace(c, r"\s{2,}|[\t\n\x0B\f\r]", " ")


def normalize_string(c: Column, allow_empty: bool = False) -> Column:
    t = trimmed(c)
    return t if allow_empty else F.nullif(t, F.lit(""))


def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def normalized(c: Column) -> Column:
    """Lower case without marks; punctuation becomes a space, and spaces collapse.

    ASCII texts stay in built-in expressions; others are decomposed in an Arrow batch.
    """
    low = F.lower(c)
    decomposed = F.pandas_udf(_without_marks, "string")(low)
    plain = F.when(F.rlike(low, F.lit("[^\\x00-\\x7F]")), decomposed).otherwise(low)
    return trimmed(F.regexp_replace(F.regexp_replace(plain, "(?U)[^\\w\\s]", " "), "(?U)\\s+", " "))


def ascii_normalized(c: Column) -> Column:
    """``normalized`` for texts known to be ASCII, without Python."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\w\\s]", " "), "\\s+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays, 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def sentences(c: Column) -> Column:
    return F.filter(F.split(trimmed(c), "(?<=[.!?])\\s+"), lambda s: s != "")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: a carry runs through all places of ``a`` at once."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return lead
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for x in b:
        at = places.get(x)
        if at is not None:
            hit = free & at
            free = (free + hit | free - hit) & whole
    return lead + len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent."""
    if a == b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def token_set_score(a: str | None, b: str | None) -> float:
    """The best ratio among shared tokens and each side's tokens: 100 where one side's tokens are all shared."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join([*filter(None, [common]), *sorted(z)]) for z in (x - y, y - x))
    n = len(common)
    # the shared tokens lead both sides, so their part of the subsequence is known
    return max(indel_ratio(left, right), *(200.0 * n / (n + len(side)) for side in (left, right)))


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)], dtype="float64")


def token_set_ratio(a: Column, b: Column) -> Column:
    """``token_set_score`` of two columns of normalised text."""
    return F.pandas_udf(_scores, "double")(a, b)


def token_set_bounds(a: Column, b: Column) -> Column:
    """``struct(low, high)``: what the score of two normalised texts is at least and at most, by tokens and lengths alone.

    The score of the shared tokens with either side is exact; the sides' own tokens add at most their shorter length.
    """
    x, y = F.array_distinct(tokens(F.coalesce(a, F.lit("")))), F.array_distinct(tokens(F.coalesce(b, F.lit(""))))
    size = lambda t: F.length(F.array_join(t, " "))
    shared = F.array_intersect(x, y)
    n, left, right = size(shared), size(F.array_except(x, y)), size(F.array_except(y, x))
    gap = (n > 0).cast("int")
    none, all_shared = (F.size(x) == 0) | (F.size(y) == 0), (n > 0) & ((left == 0) | (right == 0))
    both = 2 * (n + gap) + left + right
    low = F.when(n > 0, 200 * n / (2 * n + 1 + F.least(left, right))).otherwise(0.0)
    high = F.greatest(low, 200 * (n + gap + F.least(left, right)) / both)
    value = lambda v: F.when(none, 0.0).when(all_shared, 100.0).otherwise(v)
    return F.struct(value(low).alias("low"), value(high).alias("high"))


def matches(needle: str, text: str, jaccard: float, fuzzy: float) -> bool:
    """Whether one of two normalised texts holds the other, or they share tokens enough or score ``fuzzy``; lengths rule most pairs out before they are scored."""
    if needle in text or text in needle:
        return True
    x, y = set(needle.split()), set(text.split())
    if not x or not y:
        return False
    shared = x & y
    if len(shared) >= jaccard * (len(x) + len(y) - len(shared)) or shared and (x <= y or y <= x):
        return True
    size = lambda z: sum(map(len, z)) + max(len(z) - 1, 0)
    n, left, right = size(shared), size(x - y), size(y - x)
    gap = n > 0
    highest = max(200 * (n + gap + min(left, right)) / (2 * (n + gap) + left + right), 200 * n / (2 * n + 1 + min(left, right)))
    return highest >= fuzzy and token_set_score(needle, text) >= fuzzy


def _reach(needle: pd.Series, hay: pd.Series, jaccard: pd.Series, limit: pd.Series) -> pd.Series:
    rows = zip(needle, hay, jaccard, limit)
    return pd.Series([bool(n) and h is not None and any(x and matches(n, x, share, least) for x in h) for n, h, share, least in rows], dtype="bool")


#: Least token-set score and least share of common tokens of a match.
FUZZY, SHARED = 85, 0.5


def _plain_match(needle: Column, h: Column, jaccard: float) -> Column:
    return F.contains(h, needle) | F.contains(needle, h) | (token_jaccard(F.array_distinct(tokens(h)), F.array_distinct(tokens(needle))) >= jaccard)


def any_match(needle: Column, hay: Column, jaccard: float = SHARED, fuzzy: float | None = FUZZY) -> Column:
    """Whether a normalised needle and one of an array of normalised texts hold each other, share tokens enough or score ``fuzzy``.

    A task compares a pair in one look, where built-in expressions would repeat each other; with ``fuzzy`` None there is no Python.
    An empty or null needle, and null or empty texts, match nothing.
    """
    if fuzzy is not None:
        return F.pandas_udf(_reach, "boolean")(needle, hay, F.lit(float(jaccard)), F.lit(float(fuzzy)))
    texts = F.filter(F.coalesce(hay, F.array().cast("array<string>")), lambda h: h.isNotNull() & (h != ""))
    return F.coalesce(needle != "", F.lit(False)) & F.exists(texts, lambda h: _plain_match(needle, h, jaccard))


def all_needles_match(needles: list[Column], hay: Column, jaccard: float = SHARED, fuzzy: float | None = FUZZY) -> Column:
    """Whether each of the needles matches; with none, true."""
    out = F.lit(True)
    for n in needles:
        out = out & any_match(n, hay, jaccard, fuzzy)
    return out


def any_needles_match(needles: list[Column], hay: Column, jaccard: float = SHARED, fuzzy: float | None = FUZZY) -> Column:
    """Whether one of the needles matches; with none, false."""
    out = F.lit(False)
    for n in needles:
        out = out | any_match(n, hay, jaccard, fuzzy)
    return out
