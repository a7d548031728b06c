"""An index of vectors by pivots and distances, and exact searches by inner product over it.

Vectors get one more component so that all have the same length; then the
highest inner product is the nearest neighbour, and the triangle inequality holds.
Each vector is keyed by its nearest pivot and its distance to it; vectors in the
order of that key are cut in annuli of bounded size. Queries, likewise in blocks of
near ones, expand annuli by the least distance that these may have, in waves of
which each is four times as long as the one before. A wave raises the queries' k-th best
scores and so shrinks their radii; annuli that no radius reaches any more are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import few, materialize

#: Bounds of what every task holds: sampled vectors, the least and most pivots; vectors of an annulus and queries of a block.
SAMPLE, PIVOTS, MOST_PIVOTS, BLOCK, QUERIES = 2_000, 48, 512, 1_024, 256
#: Annuli of a pivot that one task lists for the blocks of queries, on average.
LISTED = 2_048
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Which vectors a query takes: all others, or those of its own label, or those of other labels.
ANY, SAME, OTHER = "any", "same", "other"
VECTOR = "uid long, vec_id long, label int, v array<double>"
ASKED = f"query long, {VECTOR}, low long, high long"


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, label: Column) -> DataFrame:
    """``(uid, vec_id, label, v)`` with ``v`` = floor(scale * x), whole numbers as doubles; rows with a null id, no
    vector, or parts that are null or, themselves or scaled, non-finite go. ``uid`` tells rows apart that are alike;
    write the table before using it twice.
    """
    x = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda y: y * scale)
    whole = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"), whole.alias("whole"))
    kept = rows.where("vec_id is not null and x is not null and whole")
    big = lambda y: F.abs(y) >= float(1 << 53)  # noqa: E731  whole by themselves
    return kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.transform("x", lambda y: F.when(big(y), y).otherwise(F.floor(y).cast("double"))).alias("v"))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as int64: exact, and those beyond 64 bits are held at its bounds."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q @ v.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)
    sums = whole(q) @ whole(v).T
    return np.array([[max(LOWEST, min(HIGHEST, x)) for x in row] for row in sums.tolist()], np.int64).reshape(sums.shape)


def spread_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows far apart: each next one has the largest distance to those taken."""
    taken = [0]
    near = np.linalg.norm(rows - rows[0], axis=1)
    while len(taken) < min(n, len(rows)) and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(rows - rows[taken[-1]], axis=1))
    return rows[taken]


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component that makes their length ``longest``."""
    return np.concatenate([v, np.sqrt(np.maximum(longest**2 - (v * v).sum(1), 0.0))[:, None]], 1)


def best(scores: np.ndarray, ids: np.ndarray, k: int, least: int) -> np.ndarray:
    """Places of the k highest scores of at least ``least``, ties to smaller ids."""
    if len(scores) > k:
        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Number and columns of successive blocks of at most ``limit`` rows that agree in the first column, of sorted rows."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            while a < b:
                if held and held[0].column(0)[0].as_py() != key[a]:
                    number, held = number + 1, (yield number, held) or []
                take = min(b - a, limit - sum(x.num_rows for x in held))
                held.append(batch.slice(a, take))
                a += take
                if sum(x.num_rows for x in held) == limit:
                    number, held = number + 1, (yield number, held) or []
    if held:
        yield number, held


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def joined(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([x.column(name).to_numpy() for x in held])


@dataclass(frozen=True)
class Index:
    """The pivots with what tasks need besides, and the written table ``blocks`` of annuli."""

    dimension: int
    longest: float
    pivots: np.ndarray
    sample_uids: np.ndarray
    sample_labels: np.ndarray
    sample_v: np.ndarray
    blocks: DataFrame

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries, whose own last part is 0, to the pivots."""
        return self.to_pivots(np.concatenate([q, np.zeros((len(q), 1))], 1))

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + self.longest)

    def radius(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far a vector of that score is; without a bound, of the lowest score, infinite."""
        square = (q * q).sum(1) + self.longest**2 - 2.0 * scores
        return np.where(scores == LOWEST, np.inf, np.sqrt(np.maximum(square, 0.0)))


def light(index: Index) -> Index:
    """The same without its table, for tasks."""
    return Index(index.dimension, index.longest, index.pivots, index.sample_uids, index.sample_labels, index.sample_v, None)


def in_order(rows: DataFrame, index: Index, as_queries: bool) -> DataFrame:
    """``rows`` behind columns ``pivot`` and ``distance`` and sorted by them; the number of the row lets equal vectors go to several tasks."""
    at, own = light(index), rows.schema
    names = ["pivot", "distance", *own.names]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), at.dimension)
                d = at.of_queries(v) if as_queries else at.to_pivots(lifted(v, at.longest))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *b.columns], names)

    order = ["pivot", "distance", "query" if as_queries else "uid"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    keys = rows.mapInArrow(key, f"pivot int, distance double, {kinds}")
    return materialize(keys, "pivot-index").repartitionByRange(*order).sortWithinPartitions(*order)


def build(vectors: DataFrame, dimension: int, block: int | None = None) -> Index:
    """The index of a written table ``VECTOR`` of vectors of one dimension that has rows."""
    limit = block or BLOCK
    longest = float(vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)))).first()[0])
    rows = vectors.count()
    share = few(rows, SAMPLE)  # else each task would send a sample of its own
    sample = vectors.where(F.pmod(F.xxhash64("uid", "vec_id"), F.lit(1 << 20)) < share).orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE).collect()
    sample_v = np.array([r.v for r in sample], np.float64).reshape(len(sample), dimension)
    pivots = spread_pivots(lifted(sample_v, longest), min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows) // 8)))
    index = Index(dimension, longest, pivots, np.array([r.uid for r in sample]), np.array([r.label for r in sample]), sample_v, None)
    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("n", pa.int64()), ("uids", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in blocks_of(batches, limit):
            v = np.concatenate([matrix(x.column("v"), dimension) for x in held]).astype("<f8")
            d = joined(held, "distance")
            yield pa.RecordBatch.from_pylist([{
                "block": number, "pivot": held[0].column(0)[0].as_py(), "near": float(d[0]), "far": float(d[-1]), "n": len(d), "uids": joined(held, "uid").astype("<i8").tobytes(),
                "ids": joined(held, "vec_id").astype("<i8").tobytes(), "labels": joined(held, "label").astype("<i4").tobytes(), "rows": v.tobytes(),
            }], schema=schema)

    kinds = "block long, pivot int, near double, far double, n long, uids binary, ids binary, labels binary, rows binary"
    blocks = materialize(in_order(vectors, index, False).mapInArrow(pack, kinds), "annuli")
    return Index(dimension, longest, pivots, index.sample_uids, index.sample_labels, sample_v, blocks)


def fits(labels: np.ndarray, own: int, wanted: str) -> np.ndarray | bool:
    return True if wanted == ANY else labels == own if wanted == SAME else labels != own


def search(index: Index, queries: DataFrame, k: int, wanted: str = ANY, shares: list[float] | None = None) -> DataFrame:
    """``(query, query_id, vec_id, score, rank, uid)``: the k highest scores of each query, ties to smaller ids.

    ``queries`` is a written table ``ASKED``; ``query`` is unique, ``uid`` the vector that isn't its own partner, and
    scores lie between ``low`` and ``high``. The share of all (query, vector) pairs that were compared is added to ``shares``.
    """
    spark, at, dimension = queries.sparkSession, light(index), index.dimension
    names = ["queries", "m", "low", "high", "reach", "start", "query", "quids", "qids", "qlabels", "least", "most", "q"]
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    query_schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), doubles, doubles, pa.float64(), pa.float64(), longs, longs, longs, longs, longs, longs, pa.binary()])))
    kinds = "queries long, m long, low array<double>, high array<double>, reach double, start double, query array<long>, quids array<long>, qids array<long>, qlabels array<long>, least array<long>, most array<long>, q binary"

    def far_end(q: np.ndarray, least: np.ndarray) -> float:
        return float((at.radius(q, least) + at.slack).max())

    def near_end(q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Vectors that are nearer have too high a score."""
        return np.where(most == HIGHEST, 0.0, np.maximum(at.radius(q, most) - at.slack, 0.0))

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with a first bound of each one's k-th score, by the sample."""
        for number, held in blocks_of(batches, QUERIES):
            q = np.concatenate([matrix(x.column("v"), dimension) for x in held])
            number_of, uids, ids, labels, least, most = (joined(held, c) for c in ("query", "uid", "vec_id", "label", "low", "high"))
            least = least.copy()
            for i, scores in enumerate(products(q, at.sample_v)):
                fit = scores[(at.sample_uids != uids[i]) & fits(at.sample_labels, labels[i], wanted) & (scores <= most[i])]
                if len(fit) >= k:
                    least[i] = max(least[i], np.partition(fit, len(fit) - k)[len(fit) - k])
            d = at.of_queries(q)
            values = [number, len(q), d.min(0).tolist(), d.max(0).tolist(), far_end(q, least), float(near_end(q, most).min()), *(x.astype(np.int64).tolist() for x in (number_of, uids, ids, labels, least, most)), q.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=query_schema)

    packed = materialize(in_order(queries, index, True).mapInArrow(pack_queries, kinds), "query-blocks")

    # the annuli that a block of queries may need, by the least distance, in waves
    sides = packed.select("queries", "m", "reach", "start", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "d"))
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("d.high"), F.col("d.low") - F.col("far"))
    salts = 1 + index.blocks.count() // (len(at.pivots) * LISTED)  # so many tasks for each pivot
    salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    annuli = index.blocks.select("block", "pivot", "near", "far", "n", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    pairs = salted.join(annuli, ["pivot", "salt"]).drop("salt").withColumn("gap", gap)
    pairs = pairs.where((F.col("gap") <= F.col("reach")) & (F.col("far") + F.col("d.high") >= F.col("start")))
    place = F.expr("row_number() over (partition by queries order by gap, block)")
    pairs = materialize(pairs.withColumn("wave", F.floor(F.log2(place) / 2).cast("int")).select("queries", "block", "gap", "wave", (F.col("m") * F.col("n")).alias("work")), "waves")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, ...]] = []
            for i in range(b.num_rows):
                pivot, near, far = (b.column(c)[i].as_py() for c in ("pivot", "near", "far"))
                uids, ids = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("uids", "ids"))
                labels = np.frombuffer(b.column("labels")[i].as_py(), "<i4")
                v = np.frombuffer(b.column("rows")[i].as_py(), "<f8").reshape(len(ids), dimension)
                number_of, quids, qids, qlabels, least, most = (b.column(c)[i].values.to_numpy() for c in ("query", "quids", "qids", "qlabels", "least", "most"))
                q = np.frombuffer(b.column("q")[i].as_py(), "<f8").reshape(len(qids), dimension)
                d, r, s = at.of_queries(q)[:, pivot], at.radius(q, least) + at.slack, near_end(q, most)
                inside = np.flatnonzero((far >= d - r) & (near <= d + r) & (far + d >= s))
                if not len(inside):
                    continue
                once, place = np.unique(quids[inside], return_index=True, return_inverse=True)[1:]  # several queries may start from one vector
                scores = products(q[inside][once], v)[place.reshape(-1)]
                for j, row in zip(inside.tolist(), scores):
                    fit = np.flatnonzero((uids != quids[j]) & fits(labels, qlabels[j], wanted) & (row <= most[j]))
                    for p in fit[best(row[fit], ids[fit], k, int(least[j]))].tolist():
                        out.append((int(number_of[j]), int(qids[j]), int(ids[p]), int(row[p]), int(uids[p])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, ["query", "query_id", "vec_id", "score", "uid"])

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with the k-th scores of what was found, where they are higher than the bounds before."""
        for b in batches:
            rows = b.to_pylist()
            for row in rows:
                found = dict((x["query"], x["score"]) for x in row.pop("kth") or [])
                row["least"] = [max(a, found.get(u, LOWEST)) for a, u in zip(row["least"], row["query"])]
                row["reach"] = far_end(np.frombuffer(row["q"], "<f8").reshape(row["m"], dimension), np.array(row["least"], np.int64))
            yield pa.RecordBatch.from_pylist(rows, schema=query_schema)

    rank = F.expr("row_number() over (partition by query order by score desc, vec_id, uid)")
    result = "query long, query_id long, vec_id long, score long, uid long"
    found, compared = None, 0
    waves = pairs.agg(F.max("wave")).first()[0]
    for wave in range(-1 if waves is None else waves + 1):
        live = pairs.join(packed.select("queries", "reach"), "queries").where("gap <= reach")
        left = live.where(F.col("wave") >= wave).agg(F.min("wave"), F.sum(F.when(F.col("wave") == wave, F.col("work")))).first()
        if left[0] is None:
            break  # no radius reaches an annulus that wasn't searched
        if left[0] > wave:
            continue
        compared += left[1]
        now = live.where(F.col("wave") == wave).select("queries", "block").join(packed, "queries").join(index.blocks, "block")
        fresh = now.select("pivot", "near", "far", "uids", "ids", "labels", "rows", "query", "quids", "qids", "qlabels", "least", "most", "q").mapInArrow(compare, result)
        fresh = fresh if found is None else fresh.unionByName(found.drop("rank"))
        found = materialize(fresh.withColumn("rank", rank).where(F.col("rank") <= k), "found")
        places = packed.select("queries", F.explode("query").alias("query"))
        kth = found.where(F.col("rank") == k).join(places, "query").groupBy("queries").agg(F.collect_list(F.struct("query", "score")).alias("kth"))
        packed = materialize(packed.join(kth, "queries", "left").select(*names, "kth").mapInArrow(raised, kinds), "query-blocks")
    if shares is not None:
        n = index.blocks.agg(F.sum("n")).first()[0] * queries.count()
        shares.append(compared / n if n else 0.0)
    return spark.createDataFrame([], f"{result}, rank int") if found is None else found


def by_dimension(rows: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """The rows of each length of ``v``; only vectors of equal dimension meet."""
    for n in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect()):
        yield n, rows.where(F.size("v") == n)
