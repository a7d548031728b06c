"""Exact top-k inner products over the index of pivots and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.pivot_index import HIGHEST, LOWEST, build, by_dimension, integers, search

#: Production parameters: results per query, queries (ids divisible by), scale of the integers.
K, EVERY, SCALE = 10, 100, 1024.0


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shares: list[float] | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query, ties to smaller ids.

    Queries are the rows with an id divisible by ``every``; candidates are all other
    rows, repeated ones and those with the query's id too, and a repeated query has its
    own k results each time. Null vectors and those with null or non-finite parts take
    no part, nor do rows with a null id. Sums are exact; one that passes 64 bits counts as
    the nearest 64-bit number. Only vectors of equal dimension meet, empty ones with a score of 0, one pass
    for each dimension; an empty table gives no rows. ``shares`` takes the share of (query, vector) pairs
    compared, for each dimension.
    """
    rows = materialize(integers(vectors, id_col, vector_col, scale, F.lit(0)), "vectors")
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for n, part in by_dimension(rows):
        asked = part.where(F.pmod("vec_id", F.lit(every)) == 0)
        asked = materialize(asked.select(F.col("uid").alias("query"), "*", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")), "queries")
        found = found.unionByName(search(build(part, n), asked, k, shares=shares).select("query_id", "rank", "vec_id", "score"))
    return found


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""
