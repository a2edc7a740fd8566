"""Places for files that all executors see, and tables that are written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A folder below spark.checkpoint.dir, or in local mode, where that is unset, below one of our own. On a cluster no
    folder of one machine would do, so there the setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what reads it more than once computes it once, and a lost executor loses
    nothing. The table goes when the session ends."""
    spark = df.sparkSession
    path = scratch(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, column: str, *order) -> DataFrame:
    """df with `column`: the row's place in the order, from 0. Rows are dealt out by ranges of the order and numbered within
    them; only the counts of the ranges, one row each, are summed up in one task."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(first, "_range").withColumn(column, (F.row_number().over(own) - 1 + F.col("_first")).cast("long")).drop("_range", "_first")
