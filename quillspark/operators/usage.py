"""Identifier layer: candidates, confirmed mentions and usage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def candidates(hits: DataFrame) -> DataFrame:
    """Distinct (db, surface): each is looked up once, however often it is mentioned."""
    return hits.select("db", "surface").distinct()


def mentions(hits: DataFrame, high_only: bool = False) -> DataFrame:
    m = hits.select("doc_id", "db", "surface", F.col("offset").cast("long").alias("offset"), "confidence")
    return m.filter("confidence = 'high'") if high_only else m


def confirmed_mentions(mentions: DataFrame, verified: DataFrame, classes: DataFrame) -> DataFrame:
    """Mentions of confirmed entries, on the surface as it stands (version included). classes is a dimension of a few dozen
    rows; databases without a class are out of scope."""
    v = verified.filter("status = 'confirmed'").select("dataset", "id", "oracle")
    base = mentions.join(v, (mentions["db"] == v["dataset"]) & (mentions["surface"] == v["id"]))
    out = base.join(classes, "dataset", "left")
    return out.select("doc_id", "dataset", "id", F.coalesce("class", F.lit(rules.OUT_OF_SCOPE)).alias("class"), "oracle", "confidence", "offset")


def by_entry(base: DataFrame) -> DataFrame:
    return base.groupBy("dataset", "id").agg(F.max("class").alias("class"), F.max("oracle").alias("oracle"), F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"))


def by_db(base: DataFrame) -> DataFrame:
    return base.groupBy("dataset").agg(F.max("class").alias("class"), F.count_distinct("id").alias("n_unique_entries"), F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"))


def by_doc(base: DataFrame) -> DataFrame:
    """n_entries counts ids, whatever their dataset; dbs are in order."""
    return base.groupBy("doc_id").agg(F.count_distinct("id").alias("n_entries"), F.count_distinct("dataset").alias("n_dbs"), F.array_join(F.array_sort(F.collect_set("dataset")), ",").alias("dbs"))


def long_form(base: DataFrame) -> DataFrame:
    return base.groupBy("doc_id", "dataset", "id").agg(F.max("class").alias("class"), F.max("oracle").alias("oracle"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_in_doc"))


def by_class(base: DataFrame) -> DataFrame:
    return base.groupBy("class").agg(F.count_distinct("dataset").alias("n_dbs"), F.count_distinct("dataset", "id").alias("n_entries"), F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"))


def by_year(mentions: DataFrame, base: DataFrame, doc_years: DataFrame) -> DataFrame:
    """For each known year: documents with any mention, with a confirmed one, and with one of each class. One row a document
    and year before the years are counted, so nothing fans out and no distinct count is needed."""
    flags = {"n_deposit_rec": "deposited_research_record", "n_deposit_ent": "deposited_entity_registry", "n_curated": "curated_entity_registry", "n_derived": "derived_curated"}
    docs = base.groupBy("doc_id").agg(*(F.bool_or(F.col("class") == c).alias(k) for k, c in flags.items())).withColumn("_any", F.lit(True))
    years = doc_years.filter("year <> 'NA'").select("doc_id", "year").distinct()
    out = mentions.select("doc_id").distinct().join(years, "doc_id").join(docs, "doc_id", "left")
    return out.groupBy("year").agg(F.count(F.lit(1)).alias("n_docs_total"), F.count("_any").alias("n_docs_anydata"), *(F.count_if(F.col(k)).alias(k) for k in flags))


def rates(mentions: DataFrame, base: DataFrame) -> DataFrame:
    """Share of documents (of those with any mention) that have a confirmed reference of each class, and of any."""
    total = mentions.agg(F.count_distinct("doc_id")).scalar()
    each = base.groupBy("class").agg(F.count_distinct("doc_id").alias("n_docs"))
    either = base.agg(F.lit("any").alias("class"), F.count_distinct("doc_id").alias("n_docs"))
    return each.unionByName(either).withColumn("n_total", total).withColumn("rate", F.coalesce(F.try_divide("n_docs", "n_total"), F.lit(0.0)))


def oracle_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("oracle", "status").agg(F.count(F.lit(1)).alias("n"))


def trend(years: DataFrame, measure: str = "n_docs_anydata", least: int = 50) -> DataFrame:
    """First and last year with enough documents, and the difference of the rates."""
    y = years.filter(F.col("n_docs_total") >= least).withColumn("rate", F.col(measure) / F.col("n_docs_total"))
    return y.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("rate", "year").alias("first_rate"), F.max_by("rate", "year").alias("last_rate")).withColumn("delta", F.col("last_rate") - F.col("first_rate"))


def profile(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("surface").alias("n_surfaces"), F.count_distinct("doc_id").alias("n_docs"), F.count_if(F.col("confidence") == "high").alias("n_high"))


def unclassified(base_datasets: DataFrame, classes: DataFrame) -> DataFrame:
    return base_datasets.select("dataset").distinct().join(classes, "dataset", "left_anti")


def gate_report(gated: DataFrame) -> DataFrame:
    """By database: kept and rejected, and up to eight rejected identifiers, the first in order."""
    rejected = F.slice(F.array_sort(F.collect_set(F.when(~F.col("gate_pass"), F.col("identifier")))), 1, 8)
    return gated.groupBy("db").agg(F.count(F.lit(1)).alias("n"), F.count_if("gate_pass").alias("n_pass"), F.count_if(~F.col("gate_pass")).alias("n_fail"), F.array_join(rejected, ",").alias("samples"))


def year_histogram(years: DataFrame) -> DataFrame:
    """Documents by year, and the middle year of the sorted list beside each row."""
    n = years.filter("year <> 'NA'").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy().orderBy("year")
    every = Window.partitionBy()
    c = n.withColumn("_c", F.sum("n").over(upto)).withColumn("_t", F.sum("n").over(every))
    middle = F.min(F.when(F.col("_c") > F.floor(F.col("_t") / 2), F.col("year"))).over(every)  # at most a few hundred years
    return c.withColumn("middle_year", middle).select("year", "n", "middle_year")
