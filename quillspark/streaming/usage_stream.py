"""Usage tables that grow with each delivery of documents, equal to those of a batch run over all of them.

A repeated delivery is dropped by built-in stream state that forgets after some time; what comes again later than that, or in
another version, is found in the table of counted documents. Documents are therefore counted once, and counts of deliveries
add up: nothing that was counted is read again but the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import usage
from ..sources.places import written

_SUMS = {
    "entries": "dataset string, id string, class string, oracle string, n_mentions long, n_docs long",
    "dbs": "dataset string, n_docs long",
    "classes": "class string, n_docs long",
    "done": "n long",
}


def _part(folder: str, name: str, batch: int) -> str:
    return f"{folder}/{name}/batch={batch}"


def merge(rows: DataFrame, batch: int, step: Callable[[DataFrame], DataFrame], folder: str, key: str = "doc_id") -> None:
    """Counts the documents of one delivery that weren't counted before it. Called again with the same number, it writes the same
    again, as only earlier batches are looked at and each part is overwritten; `done` comes last, and only batches that have it are read."""
    spark = rows.sparkSession
    versions = written(rows.groupBy(key).agg(F.min("_print").alias("_print")), "versions")
    counted = spark.read.parquet(f"{folder}/counted").filter(F.col("batch") < batch).select(key)
    repeated = counted.join(versions.select(key), key, "left_semi")  # the delivery is the small side: old ids stay where they are
    versions.join(repeated, key, "left_anti").write.mode("overwrite").parquet(_part(folder, "counted", batch))
    fresh = spark.read.parquet(_part(folder, "counted", batch))
    base = written(step(rows.join(fresh, [key, "_print"], "left_semi").drop("_print", "_arrived")), "references")
    sums = {
        "entries": usage.by_entry(base),
        "dbs": base.groupBy("dataset").agg(F.count_distinct("doc_id").alias("n_docs")),
        "classes": base.groupBy("class").agg(F.count_distinct("doc_id").alias("n_docs")),
        "done": fresh.agg(F.count(F.lit(1)).alias("n")),
    }
    for name, table in sums.items():
        table.write.mode("overwrite").parquet(_part(folder, name, batch))


def count_new(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str = "doc_id", within: str = "30 days", fmt: str = "parquet", most_files: int = 10_000) -> StreamingQuery:
    """Takes the new files below `source` into the usage tables in `folder`, and ends. step: documents to confirmed references
    (doc_id, dataset, id, class, oracle, …), as usage.confirmed_mentions gives them.

    A document counts as it stood in the first batch that had it; of several versions in one batch, that with the smallest hash
    of all columns. Later deliveries of its id change nothing, however late. Rows without an id can't be told apart and are
    left out. State holds hashes of what arrived `within` that time before the last batch's start, and nothing of what is older;
    time is that of arrival, so no document is too late. folder and checkpoint belong together.
    """
    for name, columns in (*_SUMS.items(), ("counted", None)):
        empty = spark.createDataFrame([], columns) if columns else spark.createDataFrame([], schema).select(key, F.lit(0).cast("long").alias("_print"))
        empty.write.mode("ignore").parquet(_part(folder, name, -1))
    rows = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", most_files).load(source)
    rows = rows.filter(F.col(key).isNotNull()).withColumn("_print", F.xxhash64(*rows.columns)).withColumn("_arrived", F.current_timestamp())
    rows = rows.withWatermark("_arrived", within).dropDuplicatesWithinWatermark([key, "_print"])
    return rows.writeStream.foreachBatch(lambda df, n: merge(df, n, step, folder, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    done = spark.read.parquet(f"{folder}/done").select("batch")
    return spark.read.parquet(f"{folder}/{name}").join(done, "batch", "left_semi").drop("batch")


def by_entry(spark: SparkSession, folder: str) -> DataFrame:
    """usage.by_entry of all documents so far."""
    return _read(spark, folder, "entries").groupBy("dataset", "id").agg(F.max("class").alias("class"), F.max("oracle").alias("oracle"), F.sum("n_mentions").alias("n_mentions"), F.sum("n_docs").alias("n_docs"))


def by_db(spark: SparkSession, folder: str) -> DataFrame:
    """usage.by_db of all documents so far."""
    docs = _read(spark, folder, "dbs").groupBy("dataset").agg(F.sum("n_docs").alias("n_docs"))
    entries = by_entry(spark, folder).groupBy("dataset").agg(F.max("class").alias("class"), F.count(F.lit(1)).alias("n_unique_entries"), F.sum("n_mentions").alias("n_mentions"))
    return entries.join(docs, "dataset").select("dataset", "class", "n_unique_entries", "n_mentions", "n_docs")


def by_class(spark: SparkSession, folder: str) -> DataFrame:
    """usage.by_class of all documents so far, where a dataset has one class."""
    docs = _read(spark, folder, "classes").groupBy("class").agg(F.sum("n_docs").alias("n_docs"))
    entries = by_entry(spark, folder).groupBy("class").agg(F.count_distinct("dataset").alias("n_dbs"), F.count(F.lit(1)).alias("n_entries"), F.sum("n_mentions").alias("n_mentions"))
    return entries.join(docs, "class").select("class", "n_dbs", "n_entries", "n_mentions", "n_docs")
