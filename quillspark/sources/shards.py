"""Shards: numbered slices of a sorted file list, selection, and tables at their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import number_rows


def shard_id(number):
    return F.lpad(number.cast("string"), 6, "0")


def plan(files: DataFrame, size: int = 500, path: str = "path") -> DataFrame:
    """files with the shard_id of each, `size` files a shard in path order; files are numbered by ranges of their paths."""
    out = number_rows(files, "_file", path)
    return out.withColumn("shard_id", shard_id(F.floor(F.col("_file") / size).cast("int"))).select(*files.columns, "shard_id")


def select(planned: DataFrame, ids: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the listed shards, else of the half-open range."""
    if ids is not None:
        return planned.filter(F.col("shard_id").isin(*ids)) if ids else planned.limit(0)
    number = F.col("shard_id").cast("int")
    out = planned if low is None else planned.filter(number >= low)
    return out if high is None else out.filter(number < high)


def assign(planned: DataFrame, workers: int) -> DataFrame:
    """Round robin over shards."""
    return planned.withColumn("worker", F.pmod(F.col("shard_id").cast("int"), F.lit(workers)))


def pending(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Shards that aren't done yet: a rerun does nothing twice."""
    return planned.join(done.select("shard_id").distinct(), "shard_id", "left_anti")


def paths(out: str) -> dict[str, str]:
    return {t: f"{out}/{t}" for t in ("annotations", "documents", "passages")}


def estimate_hours(n_shards: int, shards_per_hour: float = 57.1) -> float:
    return n_shards / shards_per_hour
