"""Role layer: roll-up of windows, routing, payloads for a language model, and the merge of its answers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .verify import with_retry

ROLES = ("generated", "used", "mentioned")
SIGNALS = ("gen_dep", "use_acq", "avail", "ref_use", "das")
RESULTS = "array<struct<id:string,role:string,evidence_span:string,confidence:string>>"


def roll_up(windows: DataFrame, keys=("doc_id", "dataset", "id"), position: str = "position") -> DataFrame:
    """One row an entity: signals and flat_table in any of its matched windows, their number, class and n_in_doc of the last
    row, and the section of the first matched window with a deposit cue, else of the first that has a section."""
    m = F.coalesce("matched", F.lit(False))
    w = windows.withColumns({k: m & c for k, c in X.signals(F.col("window_text")).items()})
    section = F.when(m, F.struct(F.col("section_type").isNull(), ~F.col("gen_dep"), F.col(position)))
    return w.groupBy(*keys).agg(
        *(F.bool_or(k).alias(k) for k in SIGNALS), F.bool_or(m & F.coalesce("flat_table", F.lit(False))).alias("flat_table"), F.count_if(m).alias("n_win"), F.bool_or(m).alias("matched"),
        F.max_by("class", position).alias("class"), F.max_by("n_in_doc", position).alias("n_in_doc"), F.min_by("section_type", section).alias("section_type"),
    )


def prelim(entities: DataFrame) -> DataFrame:
    """entities with role, prior, role_source, to_llm and note; those without a matched window aren't routed."""
    none = F.struct(F.lit("").alias("role"), F.lit("").alias("prior"), F.lit("no_window").alias("role_source"), F.lit(False).alias("to_llm"), F.lit("no_window").alias("note"))
    routed = X.route(F.col("class"), F.col("dataset"), *(F.col(k) for k in SIGNALS), F.col("flat_table"))
    return entities.withColumn("_r", F.when(F.col("matched"), routed).otherwise(none)).select(*entities.columns, "_r.*")


def outcome_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("class", "role_source", "note").agg(F.count(F.lit(1)).alias("n"))


def llm_rows(routed: DataFrame) -> DataFrame:
    """Rows for the model: prior none where it is empty, section empty where it is null."""
    return routed.filter("to_llm").withColumns({"prior": F.coalesce(F.nullif(F.col("prior"), F.lit("")), F.lit("none")), "section_type": F.coalesce("section_type", F.lit(""))})


def payloads(rows: DataFrame, best: DataFrame, per_chunk: int = 20, system_text: str = "") -> DataFrame:
    """One row for each chunk of a document's entities: their ids, the numbered blocks, token bound and tier. Entities
    without a window are left out; per_chunk of 0 or less keeps a document whole."""
    r = rows.join(best.select("doc_id", "dataset", "id", "window_text"), ["doc_id", "dataset", "id"])
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("dataset", "id")) - 1
    r = r.withColumn("chunk", F.floor(n / per_chunk).cast("int") if per_chunk > 0 else F.lit(0)).withColumn("k", (n % per_chunk if per_chunk > 0 else n) + 1)
    block = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] id: "), "id", F.lit("\ndataset: "), "dataset", F.lit("\nclass: "), "class", F.lit("\nsection: "), "section_type", F.lit("\nprior: "), "prior", F.lit("\ntext: "), "window_text")
    out = r.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_entities"), F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("expected_ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("blocks"), F.bool_or(F.col("class").isin("deposited_research_record", "deposited_entity_registry")).alias("_d"))
    out = out.withColumn("user_text", F.concat("blocks", F.lit("\n\nids: "), F.array_join("expected_ids", ", "))).withColumn("tier", F.when(F.col("_d"), "upper").otherwise("lower"))
    return out.withColumns({"max_tokens": F.least(F.lit(2048), F.lit(120) + 60 * F.col("n_entities")).cast("int"), "n_tokens": X.estimated_tokens(F.concat(F.lit(system_text), "user_text")), "system_text": F.lit(system_text)}).drop("blocks", "_d")


def cost(payloads: DataFrame, system_tokens: int) -> DataFrame:
    """Input tokens with the system text sent once, and sent each time."""
    return payloads.agg(F.sum(X.estimated_tokens(F.col("user_text"))).alias("_u"), F.count(F.lit(1)).alias("_n")).select((F.col("_u") + system_tokens).alias("cached"), (F.col("_u") + F.col("_n") * system_tokens).alias("naive"))


def request_body(model: str, temperature: float = 0.0) -> Column:
    """JSON of a chat request, from system_text, user_text and max_tokens."""
    def message(role, text):
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.col("max_tokens"), F.array(message("system", F.col("system_text")), message("user", F.col("user_text"))).alias("messages"), F.struct(F.lit("json_object").alias("type")).alias("response_format")))


def parse_results(answer: Column) -> Column:
    """Results of an answer {"results": [...]}; entries without id or role go, a broken answer gives null."""
    return F.filter(F.from_json(answer, f"results {RESULTS}")["results"], lambda x: x["id"].isNotNull() & x["role"].isNotNull())


class Model(Protocol):
    def __call__(self, body: str) -> str: ...


def classify(requests: DataFrame, model: Model, tries: int = 4) -> DataFrame:
    """requests (doc_id, body) with the results and, where the model failed every time, the error. model(body) -> answer."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def ask(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in bodies:
            out = []
            for body in b:
                try:
                    out.append((with_retry(lambda: json.dumps(json.loads(model(body))), tries, 0.0), None))  # noqa: B023
                except Exception as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["answer", "error"])

    out = requests.withColumn("_a", ask("body"))
    return out.select("doc_id", parse_results(F.col("_a.answer")).alias("results"), F.col("_a.error").alias("error"))


def merge_roles(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """Final roles: the rule's, else the model's by (doc_id, id), else error where the document had one, else missing. Rows
    that neither a rule nor the model is asked for are dropped. Of repeated answers for an id, the smallest role counts."""
    found = answers.select("doc_id", F.explode("results").alias("r")).groupBy("doc_id", F.col("r.id").alias("id")).agg(F.min(F.struct("r.role", "r.confidence", "r.evidence_span")).alias("a"))
    failed = answers.filter("error is not null").groupBy("doc_id").agg(F.min("error").alias("e"))
    out = routed.filter("to_llm or role <> ''").join(found, ["doc_id", "id"], "left").join(failed, "doc_id", "left")

    def row(role, source, confidence, span, note):
        return F.struct(role.alias("role"), F.lit(source).alias("role_source"), confidence.alias("role_confidence"), span.alias("evidence_span"), note.alias("note"))

    empty = F.lit("")
    last = F.when(~F.col("to_llm"), row(F.col("role"), "rule", empty, empty, F.col("note"))).when(F.col("a").isNotNull(), row(F.col("a.role"), "llm", F.coalesce("a.confidence", empty), F.coalesce("a.evidence_span", empty), F.col("prior"))).when(F.col("e").isNotNull(), row(F.lit("error"), "llm", empty, empty, F.substring("e", 1, 80))).otherwise(row(F.lit("missing"), "llm", empty, empty, F.lit("id_not_in_output")))
    return out.select("doc_id", "dataset", "id", "class", last.alias("_x")).select("doc_id", "dataset", "id", "class", "_x.*")
