"""Token ids as ORC files in document order.

Spark writes ORC integers in run-length encoding (version 2), cuts the files in
stripes that tasks read in parallel, and keeps row indexes and a Bloom filter on
the document id, so a lookup by id skips stripes and row groups by metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import tokenizing
from folioscope.llm.common import id_text, slices, table_path

#: Id 2 closes each document.
END_ID = 2
#: Layout of the files: stripes, rows for each index entry, Bloom filter column.
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode every text and write ``(part, offset, doc_id, n_tokens, ids)`` as ORC under ``path``.

    Documents are range-partitioned and sorted by id before they are encoded, so
    the files follow each other in ascending id order (null ids first, repeated
    ids side by side, in any order). ``offset`` counts the ids before the document
    within its part. Null and empty texts give just the end id; an empty table
    gives files without rows. Columns besides the two named ones are ignored.
    ``partitions`` follows the number of input partitions, which grows with the
    input's bytes, but is never below the session's number of shuffle partitions.
    """
    tokenizer = tokenizer or tokenizing.tokenizer_path()
    source = id_text(docs, id_col, text_col)
    if partitions is None:
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dtype = tokenizing.id_type(tokenizer)
        end = np.array([end_id], dtype).tobytes()
        part, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            for x in slices(batch):
                ids = [y + end for y in tokenizing.encode_bytes(tokenizer, x.column(1).to_pylist())]
                sizes = np.array([len(y) for y in ids], np.int64) // len(end)
                ends = np.cumsum(sizes)
                values = np.frombuffer(b"".join(ids), dtype).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(offset + ends - sizes), x.column(0), pa.array(sizes), lists],
                    ["part", "offset", "doc_id", "n_tokens", "ids"],
                )
                offset += int(ends[-1])

    schema = f"part int, offset long, doc_id {kind.simpleString()}, n_tokens long, ids array<int>"
    (
        source.repartitionByRange(partitions, "id")
        .sortWithinPartitions("id")
        .mapInArrow(encode, schema)
        .write.options(**ORC_OPTIONS)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; ``start`` counts the ids of all documents before.

    The sums over the parts read two integer columns; the parts are as many as
    the writing job's tasks, so their running total is a small window and small enough to broadcast.
    """
    files = spark.read.orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.select(
        "part",
        F.coalesce(F.expr("sum(tokens) over (order by part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("before"),
    )
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the pushed filter prunes by row index and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids))


def ids_digest(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``n_tokens`` counted anew and ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            ends = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long"
    return tokens.select("doc_id", "start", "ids").mapInArrow(digest, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder and return their digest per document."""
    spark = docs.sparkSession
    path = table_path(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return ids_digest(read_token_files(spark, path))
