"""Document fingerprints by winnowing: rolling hashes of k-grams, the smallest of each window with ties to the right."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import corpus_size, mix, table

GRAM, WIDTH = 16, 32
BUCKET_BYTES = 16 << 20
#: Buckets at most, so that their bounds and first ids stay small; larger ones are longer streams.
MOST_BUCKETS = 10_000


def grams(points: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of each `gram` code points: two neighbouring hashes of n points give one of 2n."""
    one = mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    base, power, held, have = np.uint64(0xD6E8FEB86659FD93), 1, None, 0
    while True:
        if gram & power:
            held, have = (one, power) if held is None else (held[: len(one) - have] * base + one[have:], have + power)
        if 2 * power > gram:
            return mix(held.copy())
        one, base, power = one[: len(one) - power] * base + one[power:], base * base, 2 * power


def winnow(text: str, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from a text, by position: 32-bit hashes of the grams that are smallest in some window of
    `width` grams, the rightmost where several are. Two texts that share gram + width - 1 code points share a hash.

    A text shorter than a gram is one gram, an empty one has none; with fewer grams than a window, all are one window.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        low = grams(points, min(gram, len(points)))
    at, width = np.arange(len(low)), min(width, len(low))
    hashes, done = low, 1
    while done < width:
        step = min(done, width - done)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        done += step
    at = np.unique(at)
    return (hashes[at] >> np.uint64(32)).astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash, in the order of the text."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>) of each row; null texts are empty. Other columns are ignored."""

    def run(batches):
        for b in batches:
            both = [winnow(x or "", gram, width) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x[0].astype(np.int64) for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>"


def compare_neighbours(docs: DataFrame, gram: int = GRAM, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each row's fingerprint against that of its edited text (its last quarter replaced by the first code points of the
    next document) and that of the next document: the next larger doc_id, after the last one the first.

    Documents are sorted within buckets of ids, bounded by quantiles, so of about as many rows each wherever the ids lie; a
    bucket also gets the first document of the next one, so no task sees more than its bucket, as a stream. Null ids come first; rows with the same id follow in the order of their texts. A document alone is
    its own next one. An empty table gives no rows.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = corpus_size(rows)
    buckets = max(1, min(n, -(-size // bucket_bytes), MOST_BUCKETS))
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("k", shares, 20 * MOST_BUCKETS)).first()[0] if shares else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    @F.pandas_udf("long")
    def bucket_of(k):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right"))

    rows = rows.withColumn("bucket", bucket_of("k"))
    # the first document of each bucket, again, at the end of the bucket before it
    heads = rows.groupBy("bucket").agg(F.min("k").alias("k"))
    order = Window.partitionBy().orderBy("bucket")
    whole = Window.partitionBy()
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(whole))).select("before", F.col("k").alias("head"))
    # at most MOST_BUCKETS short rows: sent to all tasks, so that texts aren't shuffled to find a few of them
    ends = rows.join(F.broadcast(heads), F.col("k") == F.col("head")).groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("end"), F.lit(0).cast("long").alias("k"), "text", F.col("before").alias("bucket"))
    stream = rows.select("doc_id", F.lit(0).alias("end"), "k", "text", "bucket").union(ends).repartition("bucket").sortWithinPartitions("bucket", "end", "k", "text")

    def run(batches):
        last = None  # (bucket, id, text, hashes, positions)
        for b in batches:
            out = []
            for doc, end, text, bucket in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                hashes, at = winnow(text, gram, width)
                if last and last[0] == bucket:
                    _, own, whole, mine, places = last
                    q = len(whole) // 4
                    edited = whole[: len(whole) - q] + text[:q]
                    other, _ = winnow(edited, gram, width)
                    out.append((own, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine), as_text(other), likeness(mine, other), likeness(mine, hashes), places))
                last = None if end else (bucket, doc, text, hashes, at)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 8, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return stream.mapInArrow(run, RESULT)


def op4(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
