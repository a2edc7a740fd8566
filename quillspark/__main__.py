"""Command line: python -m quillspark COMMAND …"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, roles, usage, verify, windows
from .plans import catalog, jobs
from .sources import connectors, shards, tables


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple):
        c = sub.add_parser(name)
        for flag, options in args:
            c.add_argument(flag, **options)

    out = ("--out", {"required": True})
    command("plan", ("--input", {"required": True}), out, ("--shard-size", {"type": int, "default": 500}))
    command("preprocess", ("--input", {"required": True}), out, ("--shard-size", {"type": int, "default": 500}))
    command("extract", out, ("--no-gate", {"action": "store_true"}), ("--drop", {"action": "store_true"}))
    command("candidates", out)
    command("inspect", out)
    command("verify", out, ("--known", {"required": True, "help": "Parquet table (db, id)"}))
    command("metrics", out, ("--verified", {"required": True}), ("--doc-year", {}))
    command("roles", out)
    command("annotate", out, ("--names", {"required": True, "help": "TSV of names and their entity types"}))
    command("aggregate", out)
    command("link", out, ("--dictionary", {"required": True, "help": "TSV of entity types, surfaces and identifiers"}), ("--mode", {"choices": ["full", "short", "none"], "default": "full"}))
    command("inject", out)
    command("payloads", out, ("--per-chunk", {"type": int, "default": 20}), ("--system-text", {"default": ""}))
    command("ask", out, ("--url", {"action": "append", "required": True, "help": "address of a chat service; several are taken in turn"}), ("--model", {"required": True}), ("--temperature", {"type": float, "default": 0.0}), ("--tries", {"type": int, "default": 4}), ("--key-variable", {"default": "CHAT_KEY", "help": "environment variable that holds the key"}))
    command("sample", ("--input", {"required": True, "help": "Parquet table with a column of strata"}), out, ("--size", {"type": int, "default": 200}), ("--key", {"required": True}), ("--stratum", {"default": "stratum"}))
    command("evaluate", ("--gold", {"required": True}), ("--key", {"required": True}), out)
    command("query", ("name", {}), ("--data", {"required": True}), ("--rows", {"type": int, "default": 20}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"quillspark {a.command}").getOrCreate()
    if a.command == "plan":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,nxml}").load(a.input).select("path")
        tables.write_table(shards.plan(files, a.shard_size), f"{a.out}/shards")
    elif a.command == "preprocess":
        jobs.preprocess(spark, a.input, a.out, a.shard_size)
    elif a.command == "extract":
        jobs.extract_accessions(spark, a.out, not a.no_gate, a.drop)
    elif a.command == "candidates":
        jobs.build_candidates(spark, a.out)
    elif a.command == "inspect":
        usage.profile(spark.read.parquet(f"{a.out}/accessions"), "db", "category").orderBy(F.desc("n_rows")).show(40, False)
    elif a.command == "verify":
        c = tables.read_tsv(spark, f"{a.out}/candidates", tables.SCHEMAS["candidates"]).withColumnRenamed("surface", "id")
        found = verify.look_up_known(c, spark.read.parquet(a.known))
        tables.write_tsv(found.select(F.col("db").alias("dataset"), "id", F.when(F.col("answer") == "confirmed", "confirmed").otherwise("pending").alias("status"), F.lit("table").alias("oracle")), f"{a.out}/verified")
    elif a.command == "metrics":
        years = tables.read_tsv(spark, a.doc_year, tables.SCHEMAS["doc_year"]) if a.doc_year else None
        jobs.build_metrics(spark, a.out, tables.read_verified(spark, a.verified), years)
    elif a.command == "roles":
        jobs.build_roles(spark, a.out)
    elif a.command == "annotate":
        jobs.annotate_names(spark, a.out, tables.read_tsv(spark, a.names, "name string, entity_type string"))
    elif a.command == "aggregate":
        jobs.aggregate(spark, a.out)
    elif a.command == "link":
        jobs.link_known(spark, a.out, tables.read_tsv(spark, a.dictionary, "entity_type string, surface string, identifier string"), a.mode)
    elif a.command == "inject":
        jobs.inject(spark, a.out)
    elif a.command == "payloads":
        rows = roles.llm_rows(spark.read.parquet(f"{a.out}/role_prelim"))
        tables.write_table(roles.payloads(rows, windows.best_window(spark.read.parquet(f"{a.out}/windows")), a.per_chunk, a.system_text), f"{a.out}/payloads")
    elif a.command == "ask":
        models = [connectors.chat(u, os.environ.get(a.key_variable)) for u in a.url]
        jobs.ask_roles(spark, a.out, connectors.rotating(models), a.model, a.temperature, a.tries)
    elif a.command == "sample":
        rows = spark.read.parquet(a.input)
        strata = rows.groupBy(F.col(a.stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("stock"))
        drawn = evaluate.draw(rows.withColumnRenamed(a.stratum, "stratum"), evaluate.allocate(strata, a.size), a.key)
        tables.write_table(evaluate.numbered(drawn, "G", a.key), f"{a.out}/sample")
    elif a.command == "evaluate":
        pairs = evaluate.join_gold(spark.read.parquet(a.gold), spark.read.parquet(a.key)).filter("reason is null")
        tables.write_table(evaluate.scores(pairs.select(F.col("gold_role").alias("gold"), F.col("model_role").alias("pred"))), f"{a.out}/scores")
    else:
        df = catalog.QUERIES[a.name](spark, a.data)
        for line in df.limit(a.rows).toJSON().collect():
            print(json.dumps(json.loads(line), ensure_ascii=False))


if __name__ == "__main__":
    main()
