"""Connected components by alternating large and small stars; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

#: Keys of very many rows that are sent to all tasks at most, some tens of bytes each.
MOST_SENT = 50_000


def join_one(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with `one`, which has a row for each key, with n, how many of the `total` rows have it.

    Keys of more than total / MOST_SENT rows, 1,000 at least, are fewer than MOST_SENT by their number alone: they are sent
    to all tasks, so the rows of such a key stay where they are. Only the others are shuffled.
    """
    most, columns = max(1_000, -(-total // MOST_SENT)), [c for c in one.columns if c not in (key, "n")]
    heavy = one.filter(F.col("n") > most).select(F.col(key).alias("_heavy"), *columns)
    met = rows.join(F.broadcast(heavy), rows[key] == F.col("_heavy"), "left")
    light = met.filter("_heavy is null").select(*rows.columns).join(one.filter(F.col("n") <= most).drop("n"), key)
    return met.filter("_heavy is not null").select(*rows.columns, *columns).unionByName(light)


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"), "n")
    return join_one(both.filter("v > u"), low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    low = _lowest(edges)
    return join_one(edges, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: u, v long. (node, component) of each node that has an edge and isn't the smallest of its component; the
    component is the smallest node. Loops and repeated edges do no harm; no edges give no rows."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(e):
        # u is only ever pointed lower; a round that keeps every edge has only stars
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    was = mark(edges)
    for _ in range(most_rounds):
        edges = written(_small(_large(edges, was[0]), was[0]), "edges")
        now = mark(edges)
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        was = now
    raise RuntimeError("components did not settle")
