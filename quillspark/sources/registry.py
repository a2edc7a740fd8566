"""A registry of endpoints from a folder of configuration files, one sub-folder a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_HOSTS = r"test91|sparql-dev|virtuoso:"


def build_registry(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """files (path, value): whole texts of prefix.yaml, endpoint.yaml and model.yaml below a folder named like the database.
    One row a database: endpoint, graph, loaded, subject namespace and example, needs_review, queryable."""
    db, name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)

    def of(kind):
        return F.coalesce(F.max(F.when(name == f"{kind}.yaml", F.col("value"))), F.lit("")).alias(kind)

    d = files.groupBy(db.alias("db")).agg(of("prefix"), of("endpoint"), of("model"))
    own = F.nullif(F.regexp_extract("endpoint", r"(https?://[^\s#]+sparql[^\s#]*)", 1), F.lit(""))
    if overrides:
        own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)), F.col("db")), own)
    behind = F.regexp_extract("endpoint", r"(?s)graph:\s*(.*)", 1)
    graph = F.get(F.filter(F.regexp_extract_all(behind, F.lit(r"(https?://[^\s#]+)"), 1), lambda g: ~F.contains(g, F.lit("sparql"))), F.lit(0))
    subject = r"(?m)^-\s+\S+\s+([A-Za-z0-9_.\-]+):(\S+?):"
    out = d.select("db", own.alias("endpoint_url"), graph.alias("graph"), (~F.col("endpoint").rlike(r"(?i)not\s+yet\s+loaded|TODO")).alias("loaded"), F.regexp_extract("model", subject, 1).alias("_p"), F.nullif(F.regexp_extract("model", subject, 2), F.lit("")).alias("example"), "prefix")
    out = out.withColumn("subj_uri_ns", F.expr(r"nullif(regexp_extract(prefix, concat('(?m)^\\s*\\Q', _p, '\\E\\s*:\\s*<([^>]+)>'), 1), '')"))
    review = F.coalesce(F.col("endpoint_url").rlike(TEST_HOSTS), F.lit(False))
    return out.select("db", F.col("endpoint_url").alias("endpoint"), "graph", "loaded", "subj_uri_ns", "example", review.alias("needs_review"), (F.col("endpoint_url").isNotNull() & F.col("subj_uri_ns").isNotNull() & F.col("loaded") & ~review).alias("queryable"))


def read_registry(spark: SparkSession, folder: str, overrides: dict[str, str] | None = None) -> DataFrame:
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").text(folder)
    return build_registry(files.select(F.input_file_name().alias("path"), "value"), overrides)
