"""Incremental runs: new files are processed once, by a checkpoint instead of marker files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def run_new(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str | None = "doc_id", fmt: str = "parquet", time: str | None = None, within: str = "7 days") -> StreamingQuery:
    """Takes what is new below `source` through `step` to Parquet, and ends. A row whose key came before is dropped: whenever it
    came, with a state of one entry a key that stays for ever, or, with a time column, if both are less than `within`
    apart, with a state of the keys of that time only. A rerun without new files writes nothing."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    if key:
        rows = rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])
    return step(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_new(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """As run_new, with a writer for each batch: write(rows, batch number) has to bear being called again with the same batch."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    return step(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
