"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``; the label is one node of its component.

    Each round lets every node point to its smallest neighbour, follows the pointers
    twice and contracts the links, until none is left; stars take one round, paths a
    logarithmic number. Labels and links stay in tables; the driver sees none of them.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while labels is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "up")
        second = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(second, "up").select(F.col("a").alias("node"), F.col("up"), "top"), "up")
        of_a, of_b = (up.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top")) for c in "ab")
        contracted = links.join(of_a, "a").join(of_b, "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
        climbed = up.select(F.col("top").alias("node")).distinct().join(up.select("node", F.col("top").alias("above")), "node")
        chain = climbed.select(F.col("node").alias("a"), F.col("above").alias("b"))
        moved = up.select("node", F.col("top").alias("label"))
        if labels is not None:
            moved = labels.join(up.select(F.col("node").alias("label"), "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = materialize(moved, "labels")
        links = contracted.unionByName(chain).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = materialize(links.where("a <> b").distinct(), "links")
    return labels
