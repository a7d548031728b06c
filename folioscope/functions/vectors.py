"""Vector similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def recommend(vectors: DataFrame, positive: list[int], negative: list[int], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to the mean of the positive examples less the mean of the negative ones, ties to smaller ids.

    The examples are a given list, so one averaged vector goes to all rows.
    """
    sign = F.when(F.col(id_col).isin(positive), 1.0 / len(positive)).otherwise(-1.0 / max(1, len(negative)))
    examples = vectors.where(F.col(id_col).isin([*positive, *negative])).select(sign.alias("w"), F.posexplode(vector_col).alias("i", "x"))
    mean = examples.groupBy("i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("__mean"))
    rest = vectors.where(~F.col(id_col).isin([*positive, *negative])).crossJoin(F.broadcast(mean))
    scored = rest.select(id_col, cosine(F.col(vector_col), F.col("__mean")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), id_col).limit(k)
