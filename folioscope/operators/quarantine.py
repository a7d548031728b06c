"""Landed records that can't be used, set apart in the pass that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Faults in the order in which they are looked for; a record has the first one.
FAULTS = ("null", "empty", "no json", "no object", "no fields", "no id")


def fault(json: Column, id_field: str = "id") -> Column:
    """What is wrong with a record's text; null for a good one."""
    v = F.try_parse_json(json)
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    own = F.try_variant_get(v, f"$.{id_field}", "string")
    tests = (json.isNull(), F.trim(json) == "", v.isNull(), fields.isNull(), F.size(fields) == 0, F.coalesce(F.trim(own) == "", F.lit(True)))
    out = F.lit(None).cast("string")
    for name, test in reversed(list(zip(FAULTS, tests))):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def with_faults(records: DataFrame, json_col: str = "json", id_field: str = "id") -> DataFrame:
    """``records`` with ``fault``."""
    return records.withColumn("fault", fault(F.col(f"`{json_col}`"), id_field))


def set_apart(records: DataFrame, path: str, json_col: str = "json", id_field: str = "id") -> dict[str, int]:
    """Write all records to ``path``, those with a fault below ``quarantined=true``; the number of all and of each fault, counted in the same pass."""
    rows = with_faults(records, json_col, id_field)
    counts = Observation()
    measures = [F.count("*").alias("records"), *(F.count_if(F.col("fault") == f).alias(f) for f in FAULTS)]
    rows.observe(counts, *measures).withColumn("quarantined", F.col("fault").isNotNull()).write.mode("append").partitionBy("quarantined").parquet(path)
    return dict(counts.get)


def stream_apart(records: DataFrame, path: str, checkpoint: str, json_col: str = "json", id_field: str = "id") -> StreamingQuery:
    """The same for a stream of records, batch by batch, until what is there is read; batches go to folders of their own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = with_faults(batch, json_col, id_field).withColumn("quarantined", F.col("fault").isNotNull())
        rows.write.mode("overwrite").partitionBy("quarantined").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
