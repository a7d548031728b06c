"""Stateful operators: rate windows, expiring caches, crawl state and eviction.

Each works on a stream (event time with watermarks) or, with the same columns, on
a table; the functions that need all rows in order say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Seconds that entries live by kind.
TTL = {"search": 300, "record": 86_400, "fulltext": 2_592_000, "error": 30}


def rate_windows(log: DataFrame, limit: int, seconds: int = 1, late: str | None = None) -> DataFrame:
    """Requests in each fixed window, with flags from 80 % of the limit and above it; ``late`` sets a watermark for streams."""
    source = log.withWatermark("ts", late) if late else log
    counted = source.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("start"), "requests", (F.col("requests") >= 0.8 * limit).alias("warned"), (F.col("requests") > limit).alias("exceeded"))


def cache_hits(log: DataFrame, key: str, ttl: int) -> DataFrame:
    """``log`` with ``hit``: the key's last read or write is no older than ``ttl`` seconds. Every miss writes.

    As reads renew nothing, an entry written at a miss serves reads until it expires;
    this approximates by the gap to the key's event before, which is exact for gaps
    longer than ``ttl`` and for the first read after each.
    """
    gap = F.expr(f"unix_micros(ts) - lag(unix_micros(ts)) over (partition by {key} order by ts, event_id)")
    return log.withColumn("hit", F.coalesce(gap <= ttl * 1_000_000, F.lit(False)))


def exact_cache_hits(log: DataFrame, key: str, ttl: int) -> DataFrame:
    """``log`` with ``hit``: the key's last miss is no older than ``ttl`` seconds. Every miss writes, reads renew nothing.

    A key's rows come in order of time to one task, batch by batch, and only the last
    write is carried on, so no key is held whole. Rows without a time miss and write nothing.
    """
    life, at = ttl * 1_000_000, log.columns.index(key)
    schema = StructType([*log.schema.fields, StructField("hit", BooleanType())])
    timed = log.withColumn("__at", F.unix_micros("ts"))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, written = None, None
        for b in batches:
            hits = []
            for k, now in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if k != last:
                    last, written = k, None
                hit = now is not None and written is not None and now - written <= life
                if not hit and now is not None:
                    written = now
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, pa.bool_())], schema.names)

    return timed.repartition(F.col(key)).sortWithinPartitions(key, "__at", "event_id").mapInArrow(serve, schema)


def hit_rates(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count("*").alias("reads"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def cache_health(stats: DataFrame) -> DataFrame:
    """The first that holds: nearly full, filling, failing, rarely hit, healthy; from used, capacity, errors, reads, hits."""
    full = F.col("used") / F.col("capacity")
    rate = F.col("hits") / F.greatest(F.col("reads"), F.lit(1))
    level = (
        F.when(full > 0.95, "critical").when(full > 0.8, "warning").when(F.col("errors") / F.greatest(F.col("reads"), F.lit(1)) > 0.05, "warning")
        .when((rate < 0.5) & (F.col("reads") > 100), "warning").otherwise("healthy")
    )
    return stats.withColumn("health", level)


def cache_stream(events: DataFrame, ttl: int, late: str = "10 minutes") -> DataFrame:
    """Exact hits of an expiring cache over a stream of (key, ts): state holds each key's last write.

    Emits ``(key, ts, hit)``; a key's state goes when the watermark passes its expiry.
    """
    def serve(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        written = state.get[0] if state.exists else None
        for rows in batches:
            out = []
            for ts in sorted(rows["ts"]):
                now = int(ts.timestamp() * 1_000_000)
                hit = written is not None and 0 <= now - written <= ttl * 1_000_000
                written = written if hit else now
                out.append((key[0], ts, hit))
            yield pd.DataFrame(out, columns=["key", "ts", "hit"])
        state.update((written,))
        state.setTimeoutTimestamp(max(written // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(serve, "key string, ts timestamp, hit boolean", "written long", "append", "EventTimeTimeout")


def crawl_progress(state: DataFrame) -> DataFrame:
    """Progress in percent and remaining seconds at the rate so far, from fetched, total and elapsed."""
    percent = F.when(F.col("total") > 0, F.least(F.lit(100.0), F.col("fetched") / F.col("total") * 100)).otherwise(0.0)
    rate = F.col("fetched") / F.col("elapsed")
    left = F.when((F.col("fetched") > 0) & (F.col("elapsed") > 0) & F.col("total").isNotNull(), (F.col("total") - F.col("fetched")) / rate)
    return state.select("*", percent.alias("progress_percent"), left.alias("remaining_s"))


def latest_state(updates: DataFrame, key: str = "query") -> DataFrame:
    """The newest state of each crawl by ``seq``; fields that an update leaves null keep their last value."""
    fields = [c for c in updates.columns if c not in (key, "seq")]
    return updates.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields), F.max("seq").alias("seq"))


def content_table(artifacts: DataFrame) -> DataFrame:
    """Each distinct content once under its digest, from (artifact_id, content)."""
    return artifacts.select(F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.length("content").alias("size")).groupBy("hash").agg(F.first("size").alias("size"), F.count("*").alias("references"))


def evicted(artifacts: DataFrame, bytes_to_free: Column | int) -> DataFrame:
    """The least recently used artifacts that free so many bytes: those with less freed before them.

    The running sum is by day first and then within the last day needed, so no window holds all rows.
    """
    day = F.to_date("last_accessed")
    days = artifacts.groupBy(day.alias("day")).agg(F.sum("size").alias("bytes"))
    before = days.withColumn("before", F.expr("coalesce(sum(bytes) over (order by day rows between unbounded preceding and 1 preceding), 0)"))
    needed = before.where(F.col("before") < bytes_to_free)
    rows = artifacts.withColumn("day", day).join(F.broadcast(needed.select("day", "before")), "day")
    own = F.expr("coalesce(sum(size) over (partition by day order by last_accessed, artifact_id rows between unbounded preceding and 1 preceding), 0)")
    return rows.withColumn("freed_before", F.col("before") + own).where(F.col("freed_before") < bytes_to_free).select("artifact_id", "size", "freed_before")


def orphans(contents: DataFrame, index: DataFrame) -> DataFrame:
    return contents.join(index.select("hash"), "hash", "left_anti")
