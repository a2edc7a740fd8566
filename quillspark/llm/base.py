"""Helpers that the training-data operators share: table access, the shared folder, and word and byte views of texts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the complement of ``[^\x20\x09-\x0D]+``.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or in local mode, where that is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads that back. The table goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes, in one pass."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """A view of the eight bytes that start at each byte, as little-endian integers; buf needs eight bytes of padding."""
    return np.ndarray((max(0, len(buf) - 7),), dtype="<u8", buffer=buf, strides=(1,))


_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; buf needs eight bytes of padding. Loops once for each eight bytes of the longest range."""
    view = eights(buf)
    h = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    todo, at = np.arange(len(starts)), starts.astype(np.int64)
    while len(todo):
        left = ends[todo] - at
        h[todo] = mix((h[todo] ^ (view[at] & _LOW[np.minimum(left, 8)])) * np.uint64(0xA0761D6478BD642F))
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return h


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose words are joined by one space (or by newline between documents): the padded bytes, word starts and ends."""
    buf = np.frombuffer(joined + b"\x20" * 9, dtype=np.uint8)
    gap = np.flatnonzero((buf[: len(joined) + 1] == 0x20) | (buf[: len(joined) + 1] == 0x0A))
    starts = np.concatenate(([0], gap[:-1] + 1)) if len(gap) else gap
    full = gap > starts
    return buf, starts[full], gap[full]


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
