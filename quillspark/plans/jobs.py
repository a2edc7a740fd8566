"""Jobs that read and write tables, in phases, and the orchestrator over them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import concept, extract, roles, tagging, usage, windows
from ..sources import articles, places, shards, tables


def preprocess(spark: SparkSession, xml: str, out: str, shard_size: int = 500) -> None:
    """Articles to passages, documents and exchange lines, by shard; articles that don't parse are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,nxml}").load(xml)
    listing = shards.plan(files.select("path"), shard_size)
    docs = articles.parse_articles(files.select("path", "content"))
    tables.write_jsonl(articles.to_bioc(docs), f"{out}/bioc")
    passages = articles.passage_rows(docs)
    tables.write_table(passages, f"{out}/passages")
    sizes = passages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total_chars"), F.count(F.lit(1)).alias("n_passages"))
    tables.write_table(docs.select(F.col("id").alias("doc_id"), "pmid", "doi", F.element_at("infon", F.lit("journal")).alias("journal"), F.element_at("infon", F.lit("year")).alias("year")).join(sizes, "doc_id", "left"), f"{out}/documents")
    tables.write_table(listing, f"{out}/shards")


def extract_accessions(spark: SparkSession, out: str, gate: bool = True, drop: bool = False) -> None:
    """Passages to accession rows with document-wide offsets; gated, and failing ones dropped if asked for."""
    hits = extract.extract(spark.read.parquet(f"{out}/passages").withColumnRenamed("offset", "_at"))
    rows = hits.withColumn("offset", F.col("_at") + F.col("offset")).withColumn("ann_id", F.concat(F.lit("A"), F.col("hit_no").cast("string"))).drop("_at", "text")
    if gate:
        rows = rows.withColumn("g", X.gate(F.col("db"), F.col("surface"))).select("*", "g.*").drop("g")
        rows = rows.filter("gate_pass") if drop else rows
    tables.write_table(rows, f"{out}/accessions")


def annotate(spark: SparkSession, out: str, tagger) -> None:
    """Passages to cleaned concept annotations by a tagger."""
    tagged = extract.tag(spark.read.parquet(f"{out}/passages"), tagger).withColumn("identifier", F.lit(None).cast("string"))
    tables.write_table(concept.clean_annotations(tagged), f"{out}/annotations")


def annotate_names(spark: SparkSession, out: str, names: DataFrame) -> None:
    """As annotate, by a vocabulary (name, entity_type) of any size."""
    passages = spark.read.parquet(f"{out}/passages").withColumnRenamed("offset", "_at")
    found = tagging.tag_names(passages, names).withColumn("offset", F.col("_at") + F.col("start")).withColumn("length", F.col("end") - F.col("start"))
    found = extract.numbered(found, ["doc_id", "passage_idx"], "T", 1).drop("_at", "text", "start", "end").withColumns({"score": F.lit(1.0), "identifier": F.lit(None).cast("string")})
    tables.write_table(concept.clean_annotations(found), f"{out}/annotations")


def ask_roles(spark: SparkSession, out: str, model: roles.Model, name: str, temperature: float = 0.0, tries: int = 4) -> None:
    """Payloads to answers of a language model, and these with the rules' roles to final ones. Documents that have an answer
    without error already aren't asked again, so a run that broke off goes on where it was."""
    todo = spark.read.parquet(f"{out}/payloads").withColumn("body", roles.request_body(name, temperature))
    old = None
    if tables.exists(spark, f"{out}/llm_results"):
        old = places.written(spark.read.parquet(f"{out}/llm_results").filter("error is null"), "answers")
        todo = todo.join(old.select("doc_id", "chunk"), ["doc_id", "chunk"], "left_anti")
    asked = roles.classify(todo.select(F.struct("doc_id", "chunk").alias("doc_id"), "body"), model, tries).select("doc_id.*", "results", "error")
    tables.write_table(asked if old is None else asked.unionByName(old), f"{out}/llm_results")
    answers = spark.read.parquet(f"{out}/llm_results")
    tables.write_table(roles.merge_roles(spark.read.parquet(f"{out}/role_prelim"), answers), f"{out}/roles")


def aggregate(spark: SparkSession, out: str) -> None:
    tables.write_table(concept.unique_surfaces(spark.read.parquet(f"{out}/annotations")), f"{out}/unique_surfaces")


def link(spark: SparkSession, out: str, linker, mode: str = "full") -> None:
    """Distinct surfaces without an id to a dictionary."""
    tables.write_table(extract.link_surfaces(spark.read.parquet(f"{out}/unique_surfaces").filter("n_missing_id > 0"), linker, mode), f"{out}/identifier_dict")


def link_known(spark: SparkSession, out: str, known: DataFrame, mode: str = "full", short: int = 3) -> None:
    """As link, by a table (entity_type, surface, identifier) of any size instead of a linker; of several identifiers the
    smallest counts."""
    todo = spark.read.parquet(f"{out}/unique_surfaces").filter("n_missing_id > 0").select("surface", "entity_type").distinct()
    todo = todo.filter(F.length("surface") <= short) if mode == "short" else todo.limit(0) if mode == "none" else todo
    found = todo.join(known.groupBy("surface", "entity_type").agg(F.min("identifier").alias("identifier")), ["surface", "entity_type"], "left")
    tables.write_table(found.withColumn("linker_status", F.when(F.col("identifier").isNull(), "no_id").otherwise("ok")), f"{out}/identifier_dict")


def inject(spark: SparkSession, out: str) -> None:
    tables.write_table(concept.inject_ids(spark.read.parquet(f"{out}/annotations"), spark.read.parquet(f"{out}/identifier_dict")), f"{out}/injected")


def build_candidates(spark: SparkSession, out: str) -> None:
    hits = spark.read.parquet(f"{out}/accessions")
    tables.write_tsv(usage.candidates(hits), f"{out}/candidates", header=False)
    tables.write_tsv(usage.mentions(hits), f"{out}/mentions", header=False)


def build_metrics(spark: SparkSession, out: str, verified: DataFrame, doc_years: DataFrame | None = None) -> None:
    """All usage tables from the mentions and the verified entries. The confirmed mentions are read by every output, so they
    are written once."""
    mentions = tables.read_tsv(spark, f"{out}/mentions", tables.SCHEMAS["mentions"])
    tables.write_table(usage.confirmed_mentions(mentions, verified, rules.db_classes(spark)), f"{out}/usage_base")
    base = spark.read.parquet(f"{out}/usage_base")
    results = {"entry": (usage.by_entry, [F.desc("n_docs"), F.desc("n_mentions"), "dataset", "id"]), "db": (usage.by_db, [F.desc("n_unique_entries"), "dataset"]), "doc": (usage.by_doc, [F.desc("n_entries"), "doc_id"]), "long": (usage.long_form, ["doc_id", "dataset", "id"]), "class": (usage.by_class, [F.desc("n_entries"), "class"])}
    for name, (table, order) in results.items():
        tables.write_tsv(table(base).orderBy(*order), f"{out}/usage_by_{name}" if name != "long" else f"{out}/usage_long")
    if doc_years is not None:
        tables.write_tsv(usage.by_year(mentions, base, doc_years).orderBy("year"), f"{out}/usage_by_year")


def build_roles(spark: SparkSession, out: str) -> None:
    """Windows around confirmed references, rolled up and routed."""
    base = spark.read.parquet(f"{out}/usage_base").filter("class <> 'out_of_scope'").select("doc_id", "dataset", "id", "class").distinct()
    hits = windows.member_mentions(spark.read.parquet(f"{out}/accessions"), base)
    passages = spark.read.parquet(f"{out}/passages").select("doc_id", "passage_idx", F.col("offset").alias("_at"), "text", F.col("passage_type").alias("section_type"))
    located = hits.drop("text", "passage_type").join(passages, ["doc_id", "passage_idx"]).withColumn("within", (F.col("offset") - F.col("_at")).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "dataset", "id")).cast("string")
    tables.write_table(windows.build_windows(located.withColumns({"position": F.col("offset"), "n_in_doc": n}).drop("_at")), f"{out}/windows")
    tables.write_table(roles.prelim(roles.roll_up(spark.read.parquet(f"{out}/windows"))), f"{out}/role_prelim")


class StageClock:
    """Seconds and rows of stages, measured while they run: the rows by an observation on the plan, so nothing is counted twice."""

    def __init__(self):
        self.stages: list[tuple[str, float, int]] = []

    def write(self, name: str, df: DataFrame, path: str) -> None:
        seen, began = Observation(name), time.perf_counter()
        tables.write_table(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), path)
        self.stages.append((name, time.perf_counter() - began, seen.get["n_rows"]))

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage, seconds, n_rows, share of all seconds)."""
        total = sum(s for _, s, _ in self.stages) or 1.0
        return spark.createDataFrame([(n, s, r, s / total) for n, s, r in self.stages], "stage string, seconds double, n_rows long, share double")


PHASES = ("preprocess", "extract", "annotate", "aggregate", "link", "inject", "candidates", "metrics", "roles")


def run(steps: dict[str, Callable[[], None]], first: str = PHASES[0], last: str = PHASES[-1], skip: tuple[str, ...] = (), plan_only: bool = False, n_shards: int = 0) -> list[str]:
    """Runs the given phases from first to last, in order, and returns their names; plan_only returns them, and the estimated
    hours, without running anything."""
    a, z = PHASES.index(first), PHASES.index(last)
    chosen = [p for p in PHASES[a : z + 1] if p in steps and p not in skip]
    if plan_only:
        return [*chosen, f"about {shards.estimate_hours(n_shards):.1f} hours"]
    for p in chosen:
        steps[p]()
    return chosen
