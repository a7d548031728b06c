"""Hard negatives: rows of other labels that score just below an anchor's positives.

Both searches run over the index of one-dimensional keys (pivot, distance): annuli are
read in the order of the least distance to a block of queries, until what is left is too far for
any of their k-th best. A positive's window of scores is a shell around its anchor,
so annuli that lie inside of it are left out too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.pivot_index import HIGHEST, LOWEST, OTHER, SAME, build, by_dimension, integers, search

#: Production parameters: positives of an anchor, negatives of a positive, anchors (ids divisible by), scale of the integers.
POSITIVES, NEGATIVES, EVERY, SCALE = 5, 10, 100, 256.0
#: A negative's score in hundredths of the positive's, and the rows whose label is one further among ``LABELS``.
LEAST, MOST, SHIFTED, LABELS = 30, 90, 7, 10


def bound(score: str, share: int, up: bool):
    """``share`` hundredths of a score, rounded up or down to a whole number."""
    wide = F.col(score).cast("decimal(20,0)") * share
    return (F.ceil(wide / 100) if up else F.floor(wide / 100)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = EVERY,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    shares: list[float] | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows with an id divisible by ``every``. An anchor's positives are its
    best other rows of the same label; a positive's negatives the best rows of other
    labels with 30 to 90 hundredths of its score, ties to smaller ids. Rows with a null label, id or vector,
    or null or non-finite parts take no part. Repeated rows are rows of their own, as anchors too.
    Sums are exact; one that passes 64 bits counts as the nearest 64-bit number. Only
    vectors of equal dimension meet; an empty table gives no rows.
    """
    own = F.col(f"`{label_col}`")
    label = F.when(F.col(f"`{id_col}`") % SHIFTED == 0, (own + 1) % LABELS).otherwise(own)
    rows = materialize(integers(vectors, id_col, vector_col, scale, label.cast("int")).where("label is not null"), "vectors")
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for n, part in by_dimension(rows):
        index = build(part, n)
        anchors = part.where(F.pmod("vec_id", F.lit(every)) == 0)
        asked = anchors.select(F.col("uid").alias("query"), "*", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
        near = search(index, materialize(asked, "anchors"), positives, SAME, shares)
        # a query for each positive; 30 hundredths aren't less than 90 of a negative score
        pairs = near.select(F.col("query").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("query"))
        pairs = materialize(pairs.where("positive_score >= 0"), "positives")
        windows = pairs.select("query", "uid", bound("positive_score", LEAST, True).alias("low"), bound("positive_score", MOST, False).alias("high")).where("low <= high")
        asked = materialize(windows.join(anchors, "uid").select("query", "uid", "vec_id", "label", "v", "low", "high"), "windows")
        found = search(index, asked, negatives, OTHER, shares)
        of = found.select("query", F.col("query_id").alias("anchor_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = out.unionByName(of.join(pairs.select("query", "positive_id", "positive_score"), "query").drop("query"))
    return out


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.uid, q.vec_id AS anchor_id, c.uid AS other, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0
), positives AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score, place
  FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5
), negatives AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.uid, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.uid = n.uid AND NOT n.same
  WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
