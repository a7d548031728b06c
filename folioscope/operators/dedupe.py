"""Duplicate detection and removal by title or identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import trimmed

KEYS = ("title", "doi", "pmid", "pmcid")


def key_of(method: str) -> Column:
    if method not in KEYS:
        raise ValueError(f"method must be one of {', '.join(KEYS)}")
    return F.lower(trimmed(F.col("title"))) if method == "title" else F.col(method)


def duplicate_groups(papers: DataFrame, method: str = "title") -> DataFrame:
    """``(key, positions)``: positions in order of the papers that share a key; empty and null keys are none.

    The collected positions of a group are its result; counting first keeps single papers out.
    """
    keyed = papers.select(key_of(method).alias("key"), "pos").where("key <> ''")
    grouped = keyed.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.where(F.size("positions") > 1)


def remove_duplicates(papers: DataFrame, method: str = "title", keep: str = "first") -> DataFrame:
    """One paper for each key: the first, the last or the most cited by position; null keys are one key."""
    # a struct's extreme is found by partial aggregation, so a hot key doesn't meet in one window
    best = {"last": F.max("pos"), "most_cited": F.max(F.struct("citedByCount", (-F.col("pos")).alias("place")))}.get(keep, F.min("pos"))
    chosen = papers.groupBy(key_of(method).alias("__key")).agg(best.alias("__best"))
    place = (-F.col("__best.place")) if keep == "most_cited" else F.col("__best")
    return papers.join(chosen.select(place.alias("pos")), "pos", "left_semi")
