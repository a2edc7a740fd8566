"""Token-id output: best-fit-decreasing packing with a segment tree over capacities, into binary id matrices."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import corpus_size, table, written
from .pattern_packing import CAPACITY, END
from .tokens import cut, shared_encoder

#: Ids that are packed together, about: 16 MB of them in memory.
GROUP_IDS = 4_000_000
#: UTF-8 bytes of text for each task at least, on average: those of a group, at four bytes an id.
TASK_BYTES = 4 * GROUP_IDS
SCHEMA = "shard string, n_rows int, seq_len int, ids binary, n_segments array<int>, cu_seqlens binary, position_resets binary, doc_ids array<long>, pieces array<int>, starts array<long>"


class Capacities:
    """A segment tree that counts bins by free room, and finds the least room of at least r in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.tree[k] += n
            k >>= 1

    def least(self, room: int) -> int | None:
        k = room + self.size
        if self.tree[k]:
            return room
        while k > 1:
            if not k & 1 and self.tree[k + 1]:  # a right sibling with bins
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices. Ties go to the earlier piece and to the bin that last came to that room."""
    tree, rooms, bins = Capacities(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            bins.append([])
            k, room = len(bins) - 1, capacity
        else:
            k = rooms[room].pop()
            tree.add(room, -1)
        bins[k].append(i)
        left = room - lengths[i]
        rooms.setdefault(left, []).append(k)
        tree.add(left, 1)
    return bins


def pack_ids(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, pad: int = 0) -> DataFrame:
    """Shards of packed sequences, one row each: an id matrix (n_rows x seq_len, little-endian unsigned 32-bit, row-major),
    and for all rows one after the other the number of segments, the cumulative segment lengths (from 0 in each row,
    int32), the places where positions go back to 0 (int32), and document, piece and start of each segment.

    Each task packs what it reads, four million ids at a time: no shuffle. Small partitions are read together first, so that
    there is at most one task for each 16 MB of text, rounded up, and as many part-filled tails. A document of more than `capacity` ids (its
    end id 2 included) is cut into pieces without loss. Null texts are empty; empty tables give no shards.
    """

    def shard(name, todo):
        bins = best_fit_decreasing([len(p[3]) // 4 for p in todo], capacity)
        matrix = np.full((len(bins), capacity), pad, dtype="<u4")
        cu, order = [], []
        for r, held in enumerate(bins):
            at = 0
            cu.append(0)
            for i in held:
                ids = np.frombuffer(todo[i][3], dtype="<u4")
                matrix[r, at : at + len(ids)] = ids
                at += len(ids)
                cu.append(at)
                order.append(i)
        firsts, k = [], 0
        for held in bins:
            firsts += cu[k : k + len(held)]
            k += len(held) + 1
        row = [name, len(bins), capacity, matrix.tobytes(), [len(b) for b in bins], np.array(cu, dtype="<i4").tobytes(), np.array(firsts, dtype="<i4").tobytes(), *([todo[i][c] for i in order] for c in range(3))]
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches):
        encoder, tail = shared_encoder(tokenizer), np.array([END], dtype="<u4").tobytes()
        todo, held, n, task = [], 0, 0, TaskContext.get().partitionId()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    todo.append((doc, k, start, ids[4 * start : 4 * (start + length)]))
                held += len(ids) // 4
                if held >= GROUP_IDS:
                    yield shard(f"{task:06d}-{n:06d}", todo)
                    todo, held, n = [], 0, n + 1
        if todo:
            yield shard(f"{task:06d}-{n:06d}", todo)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.coalesce(max(1, -(-corpus_size(docs)[1] // TASK_BYTES))).mapInArrow(run, SCHEMA)


def unpack_ids(shards: DataFrame) -> DataFrame:
    """The segments of shards, with a checksum of their ids: (doc_id, piece, start, length, ids_crc32, shard, row, offset)."""

    def run(batches):
        for b in batches:
            out = []
            for s in b.to_pylist():
                matrix, cu, k, seg = np.frombuffer(s["ids"], dtype="<u4").reshape(s["n_rows"], s["seq_len"]), np.frombuffer(s["cu_seqlens"], dtype="<i4"), 0, 0
                for r, n in enumerate(s["n_segments"]):
                    for j in range(n):
                        a, z = int(cu[k + j]), int(cu[k + j + 1])
                        out.append((s["doc_ids"][seg], s["pieces"][seg], s["starts"][seg], z - a, zlib.crc32(matrix[r, a:z].tobytes()), s["shard"], r, a))
                        seg += 1
                    k += n + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "row", "offset"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 8, types, strict=True)], names=names)

    return shards.select(*(c.split()[0] for c in SCHEMA.split(", "))).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, shard string, row int, offset long")


def op6(spark, sf_dir: str) -> DataFrame:
    return unpack_ids(written(pack_ids(table(spark, sf_dir, "documents")), "packed"))
