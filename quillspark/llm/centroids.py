"""Plain Lloyd clustering of integer vectors: broadcast centroids, exact distances, sums of each partition merged by cluster."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, table, written

#: Components of centroids that may be sent to all tasks: 32 MB.
MOST_SENT = 4_000_000
#: Integers are held to this, so that 1,024 squared differences fit in 63 bits.
LARGEST = (1 << 25) - 1
MOST_COMPONENTS = 1_024
#: Vectors whose differences from one centroid are held at a time.
ROWS = 4_096


def usable(vector: Column, components: int) -> Column:
    """Whether a vector has exactly so many components, none null, NaN or infinite. Never null."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, held between -LARGEST and LARGEST."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; the smaller number of equally near ones."""
    cluster, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), ROWS):
        some = x[a : a + ROWS]
        far = np.empty((len(some), len(centroids)), dtype=np.int64)
        for k, c in enumerate(centroids):
            d = some - c
            far[:, k] = np.einsum("ij,ij->i", d, d)
        cluster[a : a + ROWS] = far.argmin(axis=1)
        distance[a : a + ROWS] = far.min(axis=1)
    return cluster, distance


def matrix(vectors: pd.Series, components: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), components)


def first_centroids(kept: DataFrame, id_column: str, vector: str, k: int, seed: int) -> np.ndarray:
    """The k vectors whose `seed:id` has the smallest lower-case hexadecimal sha256, in that order: k rows reach the driver.
    Null ids come last; rows with the same id in the order of their vectors."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    rows = kept.select(rank.alias("rank"), F.col(vector).alias("vector")).orderBy(F.col("rank").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def moved(kept: DataFrame, vector: str, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid with vectors becomes the floor of their mean, component by component; the others stay.

    A task gives one row a cluster, its count and sums; groupBy merges these, and as many rows as there are centroids reach
    the driver. The vectors themselves are never shuffled, so the size of a cluster doesn't matter.
    """
    n_clusters, components = centroids.shape
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(frames):
        counts, sums = np.zeros(n_clusters, dtype=np.int64), np.zeros((n_clusters, components), dtype=np.int64)
        for f in frames:
            x = matrix(f[vector], components)
            cluster, _ = nearest(x, sent.value)
            counts += np.bincount(cluster, minlength=n_clusters)
            for k in np.unique(cluster):
                sums[k] += x[cluster == k].sum(axis=0)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some], "sums": pd.Series(list(sums[some]), dtype=object)})

    part = kept.select(vector).mapInPandas(run, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(components)]
    out = centroids.copy()
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(components)]
    sent.unpersist()
    return out


def assigned(kept: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """All columns of kept but the vector, with cluster and distance. These columns travel as strings, as pandas would make
    floating point numbers of whole ones beside nulls."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)
    others = [c for c in kept.columns if c != vector]

    def run(frames):
        for f in frames:
            cluster, distance = nearest(matrix(f[vector], centroids.shape[1]), sent.value)
            yield f[others].assign(cluster=cluster, distance=distance)

    schema = ", ".join([*(f"`{c}` string" for c in others), "cluster int, distance long"])
    out = kept.select(*(F.col(c).cast("string") for c in others), vector).mapInPandas(run, schema)
    return out.select(*(F.col(c).cast(kept.schema[c].dataType) for c in others), "cluster", "distance")


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: float = 64.0, seed: int = 1, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster int, distance, cluster_inertia, inertia long, centroid_sha256) of each usable vector.

    Vectors of another length, null ones, and those with a null, NaN or infinite component give no row. A component is the
    integer floor(scale * x); beyond 33,554,431 in size it is held to that, and inertias to what a long holds. Fewer usable vectors than k give as many
    centroids; none give no rows. Rows with the same id, or the same vector, are vectors of their own; a null id can only
    start a centroid when ids run out. Of equal starting centroids the later ones get no vectors and stay. Other columns of
    the input are ignored. Arithmetic is exact, so results depend neither on partitions nor on the order of rows.

    The integers are written once in the shared folder; each round reads them, and a lost executor repeats its tasks only.
    """
    if components > MOST_COMPONENTS or k * components > MOST_SENT:
        raise ValueError(f"centroids of at most {MOST_COMPONENTS} components, {MOST_SENT} in all, are sent to all tasks")
    kept = vectors.filter(usable(F.col(vector), components)).select(F.col(id_column).alias("id"), integers(F.col(vector), scale).alias("v"))
    kept = written(kept, "vectors")
    centroids = first_centroids(kept, "id", "v", k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        (id_type,) = (f.dataType.simpleString() for f in kept.schema if f.name == "id")
        return spark.createDataFrame([], f"`{id_column}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, "v", centroids)
    out = written(assigned(kept, "v", centroids), "assigned")
    # one row a centroid
    spread = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = (1 << 63) - 1
    of = spark.createDataFrame([(j, min(spread[j], most), min(sum(spread.values()), most), digest(centroids[j])) for j in sorted(spread)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    (name,) = fresh(of, id_column)
    out = out.join(F.broadcast(of), "cluster")  # at most k rows
    return out.select(F.col("id").alias(name), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
