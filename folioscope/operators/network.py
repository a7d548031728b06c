"""Co-authorship networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.stats import ranked
from folioscope.sources.tables import cut


#: Pairs that one task makes distinct.
PAIRS = 1_000_000


def shared_papers(authorship: DataFrame) -> DataFrame:
    """``(a, b)`` with a < b for each paper that two authors share; equal pairs are in one task.

    There are as many tasks as the number of pairs, which the papers' sizes tell, asks for, and pairs reach them as they are:
    neither the join's tasks nor these hold more of them as tables grow.
    """
    links = cut(authorship.select("paper", "author").distinct(), "links")
    expected = links.where("paper is not null").groupBy("paper").count().agg(F.sum(F.expr("CAST(count AS DOUBLE) * (count - 1) / 2"))).first()[0] or 0
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(expected // PAIRS) + 1)
    other = links.select("paper", F.col("author").alias("b"))
    return links.withColumnRenamed("author", "a").join(other, "paper").where("a < b").select("a", "b").repartition(tasks, "a", "b")


def collaboration_pairs(authorship: DataFrame) -> DataFrame:
    """``(a, b, count)`` with a < b: papers that two authors share, from distinct (paper, author) rows."""
    return shared_papers(authorship).groupBy("a", "b").agg(F.count("*").alias("count"))


def degrees(pairs: DataFrame) -> DataFrame:
    """``(author, degree)``: distinct co-authors, by one pass over the pairs."""
    return pairs.select(F.explode(F.array("a", "b")).alias("author")).groupBy("author").agg(F.count("*").alias("degree"))


def top_authors(authorship: DataFrame, top_n: int = 10) -> DataFrame:
    return ranked(authorship.select("author"), "author", top_n)


def degree_centrality(authorship: DataFrame, top_n: int = 10) -> DataFrame:
    """Degree over the largest degree, to four digits, for the most prolific authors; degrees are worked out once."""
    found = cut(degrees(collaboration_pairs(authorship)), "degrees")
    highest = found.agg(F.max("degree").alias("highest"))
    top = top_authors(authorship, top_n).select("author")
    scored = top.join(found, "author", "left").crossJoin(F.broadcast(highest))
    return scored.select("author", F.round(F.coalesce("degree", F.lit(0)) / F.coalesce("highest", F.lit(1)), 4).alias("centrality"))


def core_researchers(authorship: DataFrame, top_n: int = 10) -> DataFrame:
    """Prolific authors whose degree reaches the upper median degree, and 2 at least.

    The median comes from counts by degree, a table no longer than the largest degree.
    """
    found = cut(degrees(collaboration_pairs(authorship)), "degrees")
    counted = found.groupBy("degree").agg(F.count("*").alias("n"))
    running = counted.withColumn("upto", F.expr("sum(n) over (order by degree)")).withColumn("all", F.expr("sum(n) over ()"))
    median = running.where("upto > floor(all / 2)").agg(F.min("degree").alias("median"))
    top = top_authors(authorship, top_n).select("author")
    return found.join(top, "author", "left_semi").crossJoin(F.broadcast(median)).where("degree >= greatest(median, 2)").select("author", "degree")


def collaboration_matrix(authorship: DataFrame, top_n: int = 10) -> DataFrame:
    """The counts between the most prolific authors in long form, both directions; only their rows meet."""
    top = cut(top_authors(authorship, top_n).select("author"), "top-authors")
    inner = collaboration_pairs(authorship.join(F.broadcast(top), "author", "left_semi"))  # as many rows as top_n
    return inner.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "count").select("x.*", "count")


def research_groups(authorship: DataFrame, top_n: int = 10) -> DataFrame:
    """``(author, group)`` for components of two or more of the prolific authors; a group has its smallest author's name.

    Labels spread over the links between these authors and jump to their label's
    label each round, until none changes; labels only fall, so that ends.
    """
    links = cut(collaboration_matrix(authorship, top_n).select("a", "b"))
    labels = cut(links.select(F.col("a").alias("author"), F.col("a").alias("group")).distinct())
    while True:
        near = links.join(labels.withColumnRenamed("author", "b"), "b").groupBy(F.col("a").alias("author")).agg(F.min("group").alias("near"))
        stepped = labels.join(near, "author").select("author", F.col("group").alias("before"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("author").alias("group"), F.col("group").alias("farther"))
        stepped = cut(stepped.join(jump, "group", "left").select("author", "before", F.least("group", F.coalesce("farther", "group")).alias("group")))
        labels = stepped.select("author", "group")
        if stepped.where("group <> before").isEmpty():
            return labels
