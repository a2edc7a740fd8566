"""Usage counts that merge, by shard, so that a new shard needs no rescan of the others: sketches of documents and entries, which
are estimates beyond their size, and tables of the distinct documents and entries, which are exact at any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.places import written

#: Up to 2 to this power distinct values a sketch counts exactly; beyond, its relative standard error is about 1 / sqrt of that.
SIZE = 16


def shard_sketches(base: DataFrame, shard: str = "shard_id", size: int = SIZE) -> DataFrame:
    """(shard, dataset, class, n_mentions, docs, entries) of confirmed mentions: counts and theta sketches of the distinct
    documents and of the distinct (dataset, id). Null documents or ids count nowhere but as mentions."""
    return base.groupBy(F.col(shard).cast("string").alias("shard"), "dataset").agg(
        F.max("class").alias("class"), F.count(F.lit(1)).alias("n_mentions"),
        F.theta_sketch_agg(F.col("doc_id").cast("string"), size).alias("docs"),
        F.theta_sketch_agg(F.concat_ws("\0", "dataset", F.col("id").cast("string")), size).alias("entries"),
    )


def _add(spark: SparkSession, base: DataFrame, folder: str, shard: str, step) -> DataFrame:
    try:
        done = written(spark.read.parquet(folder).select("shard").distinct(), "shards")  # of known size: mentions stay where they are
        base = base.join(done, F.col(shard).cast("string") == F.col("shard"), "left_anti")
    except AnalysisException:  # no table yet
        pass
    step(base).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def add_shards(spark: SparkSession, base: DataFrame, folder: str, shard: str = "shard_id", size: int = SIZE) -> DataFrame:
    """Sketches of all shards so far, after those of new shards were added to the table in the folder. Shards that it has
    are skipped by their ids, which are read from the table; none of their rows is counted again."""
    return _add(spark, base, folder, shard, lambda new: shard_sketches(new, shard, size))


def shard_members(base: DataFrame, shard: str = "shard_id") -> DataFrame:
    """(shard, dataset, kind, member, n) of confirmed mentions: each distinct document (kind doc) and entry (kind entry) of a dataset and
    shard, null ones too, once, with its mentions. Members are what sketches stand for, so they merge alike, and exactly."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("member")) for k, c in (("doc", "doc_id"), ("entry", "id")))))
    return base.select(F.col(shard).cast("string").alias("shard"), "dataset", kinds.alias("m")).groupBy("shard", "dataset", "m.kind", "m.member").agg(F.count(F.lit(1)).alias("n"))


def add_members(spark: SparkSession, base: DataFrame, folder: str, shard: str = "shard_id") -> DataFrame:
    """Members of all shards so far, as add_shards does it for sketches."""
    return _add(spark, base, folder, shard, lambda new: shard_members(new, shard))


def exact_counts(members: DataFrame, size: int = SIZE) -> DataFrame:
    """Mentions, documents and entries by dataset, exact at any size. `exact` tells whether a sketch of the documents would have been, too."""
    once = members.groupBy("dataset", "kind", "member").agg(F.sum("n").alias("n"))
    counts = {k: F.count_if((F.col("kind") == k) & F.col("member").isNotNull()) for k in ("doc", "entry")}
    out = once.groupBy("dataset").agg(F.sum(F.when(F.col("kind") == "doc", F.col("n"))).alias("n_mentions"), counts["doc"].alias("n_docs"), counts["entry"].alias("n_entries"))
    return out.withColumn("exact", F.col("n_docs") < (1 << size))


def shared_members(base: DataFrame) -> DataFrame:
    """shared_documents of mentions (dataset, doc_id), exact at any size. A document is reduced to the set of its datasets, a few dozen at
    most, and sets to their numbers; only these are taken apart in pairs. Datasets or documents that are null count nowhere."""
    sets = base.filter("doc_id is not null and dataset is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("dataset")).alias("of"))
    sets = written(sets.groupBy("of").agg(F.count(F.lit(1)).alias("n")), "sets")
    one = written(sets.select(F.explode("of").alias("dataset"), "n").groupBy("dataset").agg(F.sum("n").alias("n")), "sizes")
    both = sets.select(F.explode("of").alias("dataset"), "of", "n").select("dataset", F.explode("of").alias("other"), "n").filter("dataset < other").groupBy("dataset", "other").agg(F.sum("n").alias("n_both"))
    pairs = one.join(one.withColumnsRenamed({"dataset": "other", "n": "m"}), F.col("dataset") < F.col("other")).join(both, ["dataset", "other"], "left").na.fill(0, ["n_both"])
    return pairs.select("dataset", "other", "n_both", (F.col("n") + F.col("m") - F.col("n_both")).alias("n_either"), (F.col("n") - F.col("n_both")).alias("n_only"))


def _number(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def merged(sketches: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """Sketches of several shards as one for each value of `by` (or one row over all): still sketches, so merges merge again."""
    return sketches.groupBy(*by).agg(F.sum("n_mentions").alias("n_mentions"), F.theta_union_agg("docs", size).alias("docs"), F.theta_union_agg("entries", size).alias("entries"))


def usage_counts(sketches: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """Mentions, documents and entries by dataset, class or both. `exact` tells whether both counts are below 2^size, where
    sketches keep every value; else they are estimates."""
    out = merged(sketches, *by, size=size).select(*by, "n_mentions", _number(F.col("docs")).alias("n_docs"), _number(F.col("entries")).alias("n_entries"))
    return out.withColumn("exact", F.greatest("n_docs", "n_entries") < (1 << size))


def shared_documents(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """(dataset, other, n_both, n_either, n_only) of each two datasets, a few dozen: documents that use both, at least one, and the
    first but not the other, by set operations on their merged sketches."""
    m = merged(sketches, "dataset", size=size).select("dataset", "docs")
    other = m.withColumnsRenamed({"dataset": "other", "docs": "more"})
    pairs = m.join(other, F.col("dataset") < F.col("other"))
    return pairs.select("dataset", "other", _number(F.theta_intersection("docs", "more")).alias("n_both"), _number(F.theta_union("docs", "more", size)).alias("n_either"), _number(F.theta_difference("docs", "more")).alias("n_only"))
