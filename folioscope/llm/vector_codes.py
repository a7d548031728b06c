"""Product quantisation in whole numbers: every vector becomes one entry index for each of its parts.

The codebooks are small (16 parts of 64 entries) and go to the tasks with their
function. A round's tasks assign Arrow batches and give one sum for each entry,
which a grouped shuffle adds up; the next codebooks are made of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.ngram_join import checked_broadcast
from folioscope.llm.pivot_index import HIGHEST, integers

#: Production parameters: parts of a vector, entries of a codebook, rounds, scale of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Sums pass the shuffle in limbs of so many bits, and batches are cut at so many rows.
LIMB, ROWS = 40, 4_096


def cut(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Rows x parts x width, of doubles that are whole; rows end with zeros where they are short."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), parts * width))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out.reshape(len(column), parts, width)


def exact(x: np.ndarray, wide: bool) -> np.ndarray:
    """Whole doubles as int64, or as Python's numbers where squares may pass 64 bits."""
    if not wide:
        return x.astype(np.int64)
    return np.array([int(y) for y in x.reshape(-1).tolist()], object).reshape(x.shape)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors in whole numbers, with each part's nearest entry, the first of equals, and its squared distance.

    ``books`` has parts x entries x width of Python's numbers. By |x - c|^2 = |x|^2 - 2 x.c + |c|^2.
    """
    top = max(float(np.abs(x).max(initial=0)), float(max((abs(c) for c in books.reshape(-1)), default=0)))
    wide = 4 * x.shape[2] * (top + 1) ** 2 >= 2.0**62
    x, books = exact(x, wide), books if wide else books.astype(np.int64)
    code, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], x.dtype)
    for p in range(x.shape[1]):
        distance = (x[:, p] * x[:, p]).sum(1)[:, None] - 2 * (x[:, p] @ books[p].T) + (books[p] * books[p]).sum(1)[None, :]
        code[:, p] = distance.argmin(1)
        error[:, p] = distance[np.arange(len(x)), code[:, p]]
    return x, code, error


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of the mean of its parts; an unused one stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x, code, _ = assign(cut(batch.column("v").slice(at, ROWS), parts, width), books)
                part = np.zeros((parts, entries, width), x.dtype)
                for p in range(parts):
                    np.add.at(part[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
                total += part.astype(object)
        out = []
        for p, e in np.argwhere(count).tolist():
            out.append((p, e, -1, 0, int(count[p, e])))
            for k in range(width):
                value, limb = int(total[p, e, k]), 0
                while value not in (0, -1):  # what is left of a negative number in the end is -1
                    out.append((p, e, k, limb, value & (1 << LIMB) - 1))
                    value, limb = value >> LIMB, limb + 1
                out.append((p, e, k, limb, value))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["part", "entry", "place", "limb", "value"])

    merged = rows.select("v").mapInArrow(sums, "part int, entry int, place int, limb int, value long").groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    count, total = {}, {}
    for r in merged.collect():  # at most parts x entries x (width + 1) values of a few limbs
        if r.place < 0:
            count[r.part, r.entry] = r.value
        else:
            total[r.part, r.entry, r.place] = total.get((r.part, r.entry, r.place), 0) + (r.value << LIMB * r.limb)
    out = books.copy()
    for (p, e), n in count.items():
        for k in range(width):
            out[p, e, k] = total[p, e, k] // n
    return out


def first_books(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (of repeated ones, the smallest vectors)."""
    first = rows.orderBy("vec_id", "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    return exact(cut(first, parts, width), True).transpose(1, 0, 2)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(c) for c in books.reshape(-1)).encode()).hexdigest()


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` as a written table, and the codebooks as parts x entries x width.

    Rows whose id or vector is null, or whose vector holds null or non-finite parts, are dropped. Vectors are cut in
    equal parts; where their lengths differ or don't divide, they count as if they ended with zeros.
    Repeated rows are kept; ties go to the first entry; an error beyond 64 bits is held at their largest number.
    """
    rows = materialize(integers(vectors, id_col, vector_col, scale, F.col(f"`{label_col}`")).drop("uid"), "vectors")
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    books = first_books(rows, parts, entries, width)
    for _ in range(rounds):
        books = next_books(rows, books)
    label = rows.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = batch.slice(at, ROWS)
                _, codes, errors = assign(cut(x.column("v"), parts, width), books)
                texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                held = [min(HIGHEST, int(e)) for e in errors.sum(1).tolist()]
                yield pa.RecordBatch.from_arrays([x.column("vec_id"), x.column("label"), pa.array(texts, pa.string()), pa.array(held, pa.int64())], ["vec_id", "label", "code", "error"])

    return materialize(rows.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), "codes"), books


def code_report(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for every kept row of ``encode`` with production parameters.

    ``label_error`` adds up the errors of rows with an equal label, null being one more label. An empty table gives no rows.
    """
    coded, books = encode(vectors)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(HIGHEST)).cast("long").alias("label_error"))
    by_label = coded.join(checked_broadcast(materialize(sums, "label-errors")), F.col("label").eqNullSafe(F.col("of")))
    return by_label.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


ROUND_SQL = """, assigned{i} AS (
  SELECT uid, part, entry, error FROM (
    SELECT p.uid, p.part, c.entry, d.error, row_number() OVER (PARTITION BY p.uid, p.part ORDER BY d.error, c.entry) AS place
    FROM parts p JOIN books{i} c ON p.part = c.part, LATERAL (SELECT list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS error) d
  ) WHERE place = 1
)"""
NEXT_SQL = """, means{i} AS (
  SELECT part, entry, list(mean ORDER BY place) AS v FROM (
    SELECT a.part, a.entry, t.place, CAST(floor(sum(p.v[t.place]) / count(*)) AS BIGINT) AS mean
    FROM assigned{h} a JOIN parts p ON a.uid = p.uid AND a.part = p.part, (SELECT unnest(range(1, 5)) AS place) t GROUP BY ALL
  ) GROUP BY ALL
), books{i} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{h} b LEFT JOIN means{i} m ON b.part = m.part AND b.entry = m.entry)"""

#: For vectors of 64 components.
ORACLE = (
    """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT uid, part, list_slice(v, 4 * part + 1, 4 * part + 4) AS v FROM kept, (SELECT unnest(range(16)) AS part) t),
books0 AS (SELECT part, uid - 1 AS entry, v FROM parts WHERE uid <= 64)"""
    + ROUND_SQL.format(i=0) + NEXT_SQL.format(i=1, h=0) + ROUND_SQL.format(i=1) + NEXT_SQL.format(i=2, h=1) + ROUND_SQL.format(i=2)
    + """, coded AS (SELECT uid, string_agg(lpad(printf('%x', CAST(entry AS BIGINT)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM assigned2 GROUP BY uid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN coded c ON k.uid = c.uid, digest d
"""
)
