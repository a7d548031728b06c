"""Entities behind mentions that share an identifier: whatever is connected by equal keys is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.sources.tables import cut


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for rows of ``(node, key)``: nodes that share keys, also by way of others, get their smallest node as label.

    A round gives each key its nodes' least label and each node its keys' least, and follows labels to their own label,
    so chains shrink by halves; links stay in written tables. Null keys connect nothing.
    """
    links = cut(links.where("node is not null and key is not null").distinct(), "identity-links")
    labels = cut(links.select("node", F.col("node").alias("label")).distinct(), "identity")
    while True:
        least = links.join(labels, "node").groupBy("key").agg(F.min("label").alias("least"))
        lowered = links.join(least, "key").groupBy("node").agg(F.min("least").alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        moved = labels.join(lowered, "node").join(above, "low")
        moved = cut(moved.select("node", "label", F.least("low", "top").alias("new")), "identity")
        if moved.where("new <> label").isEmpty():
            return labels
        labels = moved.select("node", F.col("new").alias("label"))


def resolved(mentions: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """``mentions`` with ``entity``: the smallest id among all mentions that its keys connect it with.

    ``keys`` names the identifiers; equal values of one name connect, null and empty ones don't, and a
    mention without keys is an entity of its own. Mentions that agree in all keys count as one node, so a
    thing that a third of all rows mention is one row in the loop. Ids are unique; rows with a null id get no entity.
    """
    named = {f"__k{i}": F.when(value.cast("string") != "", F.concat(F.lit(name + ":"), value.cast("string"))) for i, (name, value) in enumerate(keys.items())}
    told = cut(mentions.withColumns(named), "mentions")
    any_key = F.coalesce(*named).isNotNull()
    keyed, alone = told.where(any_key), told.where(~any_key)  # keyless mentions would be one group
    nodes = cut(keyed.groupBy(*named).agg(F.min(id_col).alias("__node")), "identity-nodes")
    pairs = nodes.select(F.col("__node").alias("node"), F.explode(F.array_compact(F.array(*named))).alias("key"))
    labels = components(pairs).select(F.col("node").alias("__node"), F.col("label").alias("entity"))
    known = nodes.join(labels, "__node").drop("__node").withColumnsRenamed({k: f"{k}_of" for k in named})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in named]
    on = same[0]
    for other in same[1:]:
        on = on & other
    found = keyed.join(known, on, "left").drop(*named, *(f"{k}_of" for k in named))
    own = F.col(f"`{id_col}`")
    return found.withColumn("entity", F.coalesce("entity", own)).unionByName(alone.drop(*named).withColumn("entity", own))


def described(found: DataFrame, fields: list[str]) -> DataFrame:
    """``(entity, mentions, *fields)``: each field is the value that most of the entity's mentions give, the smallest of equals; empty and null values count for nothing."""
    items = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields)))
    votes = found.select("entity", items.alias("x")).where("x.value <> ''").groupBy("entity", "x.field", "x.value").count()
    best = votes.groupBy("entity").pivot("field", fields).agg(F.min(F.struct(-F.col("count"), F.col("value").alias("value"))))
    counts = found.groupBy("entity").agg(F.count("*").alias("mentions"))
    return counts.join(best, "entity", "left").select("entity", "mentions", *(F.col(f"`{f}`.value").alias(f) for f in fields))
