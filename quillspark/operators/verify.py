"""Existence checks: external lookups behind one interface, and how their answers combine."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Names of the oracles in the verified table, and of the service that settles pending rows.
BY_LABEL, BY_SUBJECT, BY_SERVICE = "togoid_label", "rdfportal_native", "ncbi_eutils"
# End of fixed values.


class Lookup(Protocol):
    """Answers for a batch of ids of one database: id -> confirmed, absent or error."""

    def __call__(self, db: str, ids: list[str]) -> dict[str, str]: ...


def batched(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """rows with a batch number within keys, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("int"))


def with_retry(call: Callable, tries: int = 4, wait: float = 1.0, sleep=time.sleep):
    """call() until it doesn't raise, waiting 1, 2, 4 and at most 8 times `wait`; the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k + 1 == tries:
                raise
            sleep(min(2**k, 8) * wait)


def bisect_lookup(ask: Callable[[list[str]], set[str] | None], ids: list[str]) -> dict[str, str]:
    """Answers of a service that refuses a whole batch for one bad id: halves are asked again. None means refused; a single
    refused id is absent, and an exception (a transport failure) leaves its ids as errors, never as absent."""
    if not ids:
        return {}
    try:
        found = ask(ids)
    except Exception:
        return dict.fromkeys(ids, "error")
    if found is None:
        if len(ids) == 1:
            return {ids[0]: "absent"}
        half = len(ids) // 2
        return bisect_lookup(ask, ids[:half]) | bisect_lookup(ask, ids[half:])
    return {i: "confirmed" if i in found else "absent" for i in ids}


def look_up(candidates: DataFrame, lookup: Lookup, batch: int = 400, cache: DataFrame | None = None) -> DataFrame:
    """(db, id, answer) of distinct candidates (db, id). Known answers of the cache (db, id, answer), errors apart, aren't
    asked again; the rest go to the lookup in batches of one database, inside the tasks."""
    todo = candidates.select("db", "id").distinct()
    known = None
    if cache is not None:
        known = cache.filter("answer <> 'error'").select("db", "id", "answer")
        todo = todo.join(known, ["db", "id"], "left_anti")

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            for db, part in f.groupby("db", sort=True):
                ids = sorted(part["id"])
                for k in range(0, len(ids), batch):
                    got = lookup(db, ids[k : k + batch])
                    yield pd.DataFrame({"db": db, "id": ids[k : k + batch], "answer": [got.get(i, "absent") for i in ids[k : k + batch]]})

    asked = todo.repartition("db", "id").sortWithinPartitions("db", "id").mapInPandas(run, "db string, id string, answer string")
    if known is None:
        return asked
    return asked.unionByName(candidates.select("db", "id").distinct().join(known, ["db", "id"]))


def look_up_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(db, id, answer) of each candidate by a table (db, id) of any size: confirmed where it is known, else absent."""
    there = known.select("db", "id").distinct().withColumn("_known", F.lit(True))
    out = candidates.select("db", "id").distinct().join(there, ["db", "id"], "left")
    return out.select("db", "id", F.when(F.col("_known"), "confirmed").otherwise("absent").alias("answer"))


def combine_graphs(candidates: DataFrame, label_hits: DataFrame, native_hits: DataFrame) -> DataFrame:
    """candidates (dataset, id) with status and oracle: found by label, found natively, else pending. Nothing is absent here."""
    a = label_hits.select("dataset", "id").distinct().withColumn("_a", F.lit(True))
    b = native_hits.select("dataset", "id").distinct().withColumn("_b", F.lit(True))
    out = candidates.join(a, ["dataset", "id"], "left").join(b, ["dataset", "id"], "left")
    oracle = F.when(F.col("_a"), BY_LABEL).when(F.col("_b"), BY_SUBJECT).otherwise("-")
    return out.select("dataset", "id", F.when(F.col("_a") | F.col("_b"), "confirmed").otherwise("pending").alias("status"), oracle.alias("oracle"))


def merge_answers(verified: DataFrame, answers: DataFrame, routed: DataFrame, oracle: str = BY_SERVICE) -> DataFrame:
    """verified with pending rows of routed datasets settled by answers (dataset, id, answer); errors stay pending."""
    a = answers.filter("answer in ('confirmed', 'absent')").select("dataset", "id", "answer")
    r = routed.select("dataset").distinct().withColumn("_routed", F.lit(True))
    out = verified.join(r, "dataset", "left").join(a, ["dataset", "id"], "left")
    change = (F.col("status") == "pending") & F.col("_routed") & F.col("answer").isNotNull()
    return out.select("dataset", "id", F.when(change, F.col("answer")).otherwise(F.col("status")).alias("status"), F.when(change, oracle).otherwise(F.col("oracle")).alias("oracle"))


def route_report(verified: DataFrame, routed: DataFrame) -> DataFrame:
    r = routed.select("dataset").distinct().withColumn("_routed", F.lit(True))
    return verified.filter("status = 'pending'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_pending")).join(r, "dataset", "left").withColumn("route", F.when(F.col("_routed"), "routed").otherwise("held")).drop("_routed")


def resolve_routes(dbs: DataFrame, registry: DataFrame, router: DataFrame, covered: DataFrame) -> DataFrame:
    """db with the registry id it resolves to (itself, else by the router) and a verdict: T2b, T2a or MISS."""
    reg = registry.select(F.col("db").alias("_r")).distinct()
    out = dbs.join(reg, F.col("db") == F.col("_r"), "left").join(router.select(F.col("db").alias("_db"), F.col("target").alias("_t")), F.col("db") == F.col("_db"), "left")
    out = out.join(covered.select(F.col("dataset").alias("_c")).distinct(), F.col("db") == F.col("_c"), "left").withColumn("resolved", F.coalesce("_r", "_t"))
    return out.withColumn("verdict", F.when(F.col("_c").isNotNull(), "T2b").when(F.col("resolved").isNotNull(), "T2a").otherwise("MISS")).select(*dbs.columns, "resolved", "verdict")


def layered(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(db, surface) against known (db, id): exact, then by the first normaliser that changes the surface (version, isoform,
    capitals), else unverified; surfaces that can't stand in an IRI are skipped."""
    k = known.select("db", "id").distinct()
    s = F.col("surface")
    c = candidates.withColumn("_n", F.coalesce(X.without_version(s), X.without_isoform(s), X.in_capitals(s)))
    c = c.join(k.select("db", F.col("id").alias("surface"), F.lit(True).alias("_x")), ["db", "surface"], "left").join(k.select("db", F.col("id").alias("_n"), F.lit(True).alias("_y")), ["db", "_n"], "left")
    status = F.when(~X.safe_for_iri(s), "skipped_unsafe").when(F.col("_x"), "verified_exact").when(F.col("_y"), "verified_normalized").otherwise("unverified")
    return c.select(*candidates.columns, status.alias("existence_status"))


def unify(status):
    """Both layers' answers in one vocabulary: verified, unverified, error, skipped_unsafe."""
    return F.when(status.isin("verified_exact", "verified_normalized", "exists"), "verified").when(status.isin("unverified", "not_found"), "unverified").when(status == "skipped_unsafe", "skipped_unsafe").otherwise("error")


def write_back(hits: DataFrame, checked: DataFrame) -> DataFrame:
    """hits with existence_status by (db, surface); null where the database isn't supported."""
    return hits.join(checked.select("db", "surface", "existence_status"), ["db", "surface"], "left")


def status_pivot(checked: DataFrame) -> DataFrame:
    return checked.groupBy("db").pivot("existence_status", ["verified_exact", "verified_normalized", "unverified", "skipped_unsafe"]).count().na.fill(0)


def key_alignment(hits: DataFrame, verifier: DataFrame) -> DataFrame:
    """Databases of both sides: matched, hits_only or verifier_only."""
    a, b = hits.select("db").distinct().withColumn("_a", F.lit(True)), verifier.select("db").distinct().withColumn("_b", F.lit(True))
    return a.join(b, "db", "full").select("db", F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "hits_only").otherwise("verifier_only").alias("side"))


def scrape_routes(text: str) -> list[tuple[str, str]]:
    """(database, target) pairs of a routing table that stands in a source text as "a": "b" lines."""
    return list(dict.fromkeys(re.findall(r"""["']([A-Za-z0-9_]+)["']\s*:\s*["']([A-Za-z0-9_.\-]+)["']""", text)))


def probe_databases(hits: DataFrame, probe: Callable[[str], bool]) -> DataFrame:
    """Databases by volume, with whether a label graph answers for each: one question for each distinct database."""
    volume = hits.groupBy("db").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("surface").alias("n_surfaces"))

    def run(frames):
        for f in frames:
            answers = []
            for db in f["db"]:
                try:
                    answers.append(bool(probe(db)))
                except Exception:
                    answers.append(False)
            yield f.assign(covered=answers)

    return volume.repartition("db").mapInPandas(run, "db string, n long, n_surfaces long, covered boolean").orderBy(F.desc("n"), "db")


def diagnose(present: DataFrame, expected: DataFrame) -> DataFrame:
    """Why an expected (db, graph, ns, id) isn't found among present (graph, ns, id, place): found, graph_mismatch, object_only,
    wrong_namespace or missing."""
    p = present.select("graph", "ns", "id", "place")
    j = expected.join(p.select("id", F.col("graph").alias("g"), F.col("ns").alias("m"), "place"), "id", "left")
    same_ns, same_graph = F.col("m") == F.col("ns"), F.col("g") == F.col("graph")
    why = F.when(same_ns & same_graph & (F.col("place") == "subject"), 0).when(same_ns & (F.col("place") == "subject"), 1).when(same_ns, 2).when(F.col("m").isNotNull(), 3).otherwise(4)
    names = F.array(*map(F.lit, ("found", "graph_mismatch", "object_only", "wrong_namespace", "missing")))
    return j.groupBy("db", "id").agg(F.get(names, F.min(why)).alias("reason"))
