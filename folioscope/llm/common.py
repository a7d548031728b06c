"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python step holds at once.
BATCH_CHARS = 2_000_000
#: Bytes that a worker's table of remembered words may hold in each of its two generations,
#: what an entry costs besides its key and value, and the longest key that is remembered.
MEMO_BYTES, ENTRY_BYTES, LONGEST_KEY = 112 << 20, 96, 256
#: Rows of an Arrow batch while a table is written: whole texts of 10,000 rows, the default, take 64 MB beside the heap in each task.
BATCH_ROWS = 2_000
#: The bound of tables whose values are cheap to make anew.
SMALL_MEMO_BYTES = 40 << 20


_memos: list[weakref.ref] = []


def forget_others(owner: str) -> None:
    """Empty the tables of a worker that belong to other operators, whose stages are over; a worker serves them one after the other."""
    for m in [r() for r in _memos]:
        if m is not None and m.owner != owner:
            m.forget()
    _memos[:] = [r for r in _memos if r() is not None]
    give_back()


def give_back() -> None:
    """Return what a worker has freed to the system. An executor has up to twice as many workers as cores, and the idle ones keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Memo(dict):
    """What ``make`` gave for each key, within a bound of bytes; look keys up with ``[]``.

    When the younger generation is full it becomes the older one, from which keys
    that come again move on; longer keys (texts without spaces) are made anew each time.
    """

    def __init__(self, make: Callable, limit: int = MEMO_BYTES, owner: str = ""):
        super().__init__()
        self.make, self.limit, self.owner = make, limit, owner
        self.old: dict = {}
        self.held = 0
        _memos.append(weakref.ref(self))

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(key) <= LONGEST_KEY:
            if self.held >= self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += getsizeof(key) + getsizeof(value) + ENTRY_BYTES
        return value


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine serves, which only
    local mode (tests) can use; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with replicated files instead of cached blocks, so a lost
    executor costs only its own running tasks.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(setting)
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(setting, rows)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """From now on the session passes at most ``BATCH_ROWS`` rows at once to Python: what a step returns is planned after the step."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def few(rows: int, wanted: int) -> int:
    """Of 2**20 values of a hash, so many that about four times the wanted rows have one of them."""
    return min(1 << 20, 4 * wanted * (1 << 20) // max(rows, 1) + 1)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just ``id`` and ``text`` (null text: empty), free of clashing names."""
    return df.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def as_row(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs clashes with those of a step; ``row.*`` gives them back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def slices(batch: pa.RecordBatch, text_index: int = 1, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each part holds about ``limit`` bytes of text or one row."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with the 1-based place of each row in the order of ``order``, nulls last.

    Rows are range-partitioned and written, numbered within their partition, and
    moved on by the partitions' row counts, so no task sees all rows.
    """
    from functools import reduce

    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    part = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    part = materialize(part, "numbered")
    sums = part.groupBy("__part").count()
    before = sums.select("__part", F.coalesce(F.expr("sum(count) over (order by __part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("__before"))
    listing = reduce(lambda a, b: f"{a}, {b}", (f"`{c}` nulls last" for c in order))
    own = F.expr(f"row_number() over (partition by __part order by {listing})")
    return part.withColumn(name, own).join(before, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
