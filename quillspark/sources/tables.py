"""Tables at rest: tolerant readers and the writers of the usage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "verified": "dataset string, id string, status string, oracle string",
    "mentions": "doc_id string, db string, surface string, offset bigint, confidence string",
    "doc_year": "doc_id string, year string",
    "candidates": "db string, surface string",
    "db_class": "dataset string, class string",
}


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "").csv(path)


def read_shards(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet shards of a folder; markers and other files beside them are passed over."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, compressed or not; blank lines are passed over."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    """Verified entries with or without a header; short rows are filled with `-`."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter((F.trim(F.col("value")) != "") & ~F.startswith(F.col("value"), F.lit("dataset\t")))
    return rows.select(*(F.coalesce(F.nullif(F.get(f, F.lit(i)), F.lit("")), F.lit("-")).alias(c) for i, c in enumerate(("dataset", "id", "status", "oracle"))))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first two fields of each line; blank lines and those that start with # are passed over."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter((F.trim(F.col("value")) != "") & ~F.startswith(F.col("value"), F.lit("#")) & (F.size(f) >= 2))
    return rows.select(F.get(f, F.lit(0)).alias("dataset"), F.get(f, F.lit(1)).alias("id")).dropDuplicates()


def only_targets(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a target; no targets at all keep every row."""
    return rows.join(targets.select(key).distinct(), key, "left_semi") if targets.take(1) else rows


def read_markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a pipe table; escaped pipes stay in their cells, header and rule rows are passed over."""
    cells = F.split(F.regexp_replace(F.trim(F.col("value")), r"^\||\|$", ""), r"(?<!\\)\|")
    rows = spark.read.text(path).filter(F.startswith(F.trim(F.col("value")), F.lit("|")) & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    out = rows.select(*(F.replace(F.trim(F.get(cells, F.lit(i))), F.lit("\\|"), F.lit("|")).alias(c) for i, c in enumerate(columns)))
    return out.filter(F.col(columns[0]) != columns[0])


def read_external_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, repository, id) of JSON lines whose repository is an object with a title, or a string."""
    v = F.col("value")
    as_object = F.get_json_object(v, "$.repository.title")
    return spark.read.text(path).filter(F.trim(v) != "").select(F.get_json_object(v, "$.doc_id").alias("doc_id"), F.coalesce(as_object, F.get_json_object(v, "$.repository")).alias("repository"), F.get_json_object(v, "$.id").alias("id"))


def source_databases(files: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct database names: of a column, found whatever its case, else of the file names (path) without part numbers and endings."""
    if column:
        name = next(c for c in files.columns if c.lower() == column.lower())
        return files.select(F.col(name).alias("db")).filter("db is not null").distinct()
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?:[._-]?(?:part)?\d+)?(?:\.[A-Za-z]+)+$", "")
    return files.select(stem.alias("db")).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, zstd; with a partition column only the partitions at hand are replaced, so a rerun changes nothing else."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by) if partition_by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def summary(df: DataFrame) -> str:
    """The one row of an aggregate as JSON."""
    return df.toJSON().first()


def first_readable(spark: SparkSession, *folders: str) -> DataFrame:
    """Shards of the first folder that has any."""
    for i, folder in enumerate(folders):
        try:
            return read_shards(spark, folder)
        except Exception:
            if i + 1 == len(folders):
                raise
    raise ValueError("no folder given")
