"""Recursive merge of JSON objects of any depth: objects are merged key by key, any other value of a later one replaces what was there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.sources.tables import cut

#: Levels that are opened between two writes; deeper objects take more rounds.
LEVELS = 4


def inside(v: Column) -> Column:
    """The keys and values of an object, null for any other value."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def settled(level: DataFrame) -> DataFrame:
    """One level of ``(id, path, turn, v, value)`` opened, of which rows with a ``value`` are done.

    Of the versions at a path those before the last value that isn't an object are left out. If it is the
    last of all, its text is the ``value``; else the later objects are opened, or are empty.
    """
    at = W.partitionBy("id", "path")
    rows = level.withColumn("m", inside(F.col("v")))
    rows = rows.select("*", F.max("turn").over(at).alias("last"), F.coalesce(F.max(F.when(F.col("m").isNull(), F.col("turn"))).over(at), F.lit(0)).alias("solid"), F.max(F.when(F.size("m") > 0, F.col("turn"))).over(at).alias("filled"))
    one = lambda path, v, value: F.struct(path.alias("path"), v.alias("v"), value.alias("value"))
    none = F.lit(None)
    text = F.coalesce("value", F.to_json("v"), F.lit("null"))
    below = F.transform(F.map_entries("m"), lambda e: one(F.array_append("path", e["key"]), e["value"], none.cast("string")))
    hollow = (F.size("m") == 0) & F.coalesce(F.col("filled") < F.col("solid"), F.lit(True))
    made = F.when(F.col("m").isNull(), F.array(one(F.col("path"), none.cast("variant"), text))).when(hollow, F.array(one(F.col("path"), none.cast("variant"), F.lit("{}")))).otherwise(below)
    kept = rows.where("turn >= solid and (turn = last or size(m) > 0)")
    return kept.select("id", "turn", F.inline(made)).select("id", "path", "turn", "v", "value")


def values(versions: DataFrame) -> DataFrame:
    """``(id, path, value)`` of what is left of ``(id, seq, json)``: values that aren't objects with keys. Texts that hold no object are left out.

    Versions meet by id, once for each round.
    """
    level = versions.select("id", "seq", F.try_parse_json(F.col("json")).alias("v")).where(inside(F.col("v")).isNotNull())
    turn = F.row_number().over(W.partitionBy("id").orderBy("seq"))
    level = level.select("id", F.array().cast("array<string>").alias("path"), turn.alias("turn"), "v", F.lit(None).cast("string").alias("value"))
    done = []
    while True:
        for _ in range(LEVELS):
            level = settled(level)
        found = cut(level.select("id", "path", "turn", F.to_json("v").alias("open"), "value"), "level")  # values travel as text between the rounds
        done.append(found.where("value is not null").select("id", "path", "value"))
        more = found.where("value is null")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level = more.repartition("id").select("id", "path", "turn", F.parse_json(F.coalesce("open", F.lit("null"))).alias("v"), "value")


def rebuilt(found: DataFrame) -> DataFrame:
    """``(id, json)`` from ``(id, path, value)``. In the order of paths each value follows what closes the objects of the one before it, and opens its own."""
    quoted = lambda k: F.when(F.rlike(k, F.lit("^[A-Za-z0-9_]*$")), F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", ""))
    top = F.array().cast("array<string>")

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get("items", i - 1)["path"], top)
        same = F.array_position(F.zip_with(x["path"], before, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int") - 1  # keys in common
        opened = F.array_join(F.transform(F.slice(x["path"], same + 1, F.size(x["path"])), lambda k: F.concat(quoted(k), F.lit(":"))), "{")
        closed = F.concat(F.repeat(F.lit("}"), F.size(before) - same - 1), F.lit(","))
        return F.when(F.size(x["path"]) == 0, x["value"]).otherwise(F.concat(F.when(i == 0, F.lit("{")).otherwise(closed), opened, x["value"]))

    grouped = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("items"))
    return grouped.select("id", F.concat(F.array_join(F.transform("items", piece), ""), F.repeat(F.lit("}"), F.size(F.element_at("items", -1)["path"]))).alias("json"))


def merged(versions: DataFrame, id_col: str = "id", seq_col: str = "seq", json_col: str = "json") -> DataFrame:
    """``(id, json)``: for each id, its JSON objects merged in the order of ``seq``, as text with sorted keys.

    Null, broken and non-object texts are left out, and ids that have no other with them; so are rows with a null id.
    An id's versions have distinct ``seq``. An empty table gives no rows.
    """
    rows = versions.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{seq_col}`").alias("seq"), F.col(f"`{json_col}`").alias("json")).where("id is not null")
    return rebuilt(values(rows))
