"""Suffix-array dedup: common prefixes of at least a minimum length by breadth-first interval expansion on a
Burrows-Wheeler transform, and removal of the bytes that they cover."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import eights, spans, table
from .blocks import Cut, find_repeats

LENGTH = 50
#: Ends a string in the matched text; no byte of UTF-8 has this value.
STOP = 0xFF
#: Bytes whose suffixes are sorted at once. So many stay in a core's cache, which counts more than fewer calls.
MOST = 400_000
#: Bytes of strings with one sub key that are still sorted at once: place and two ranks fit into 64 bits.
MOST_ALONE = (1 << 21) - 1


def sort_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` bytes (beyond the end: STOP); ties in any order. Doubling: the order by
    2k bytes follows from the ranks by k bytes at two places. Ranks and the place itself are sorted as one integer where
    they fit into 64 bits, which is several times faster than sorting places by keys."""
    n = len(text)
    bits = max(1, n.bit_length())
    place = np.arange(n, dtype=np.uint64)
    padded = np.concatenate((text, np.full(length + 8, STOP, dtype=np.uint8)))
    done = min(length, (64 - bits) // 8)
    key = eights(padded)[: n + length].byteswap() >> np.uint64(64 - 8 * done)
    packed = 3 * bits <= 64
    while True:
        if packed:
            key = key[:n] << np.uint64(bits)
            key |= place
            key.sort()
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
            key >>= np.uint64(bits)
        else:
            order = np.argsort(key[:n])
            key = key[order]
        if done >= length:
            return order
        new = np.empty(n, dtype=np.uint32)
        new[0] = 0
        np.cumsum(key[1:] != key[:-1], dtype=np.uint32, out=new[1:])
        rank = np.full(n + length, n, dtype=np.uint64)  # the padding comes last, as it holds the largest byte
        rank[order] = new
        step = min(done, length - done)
        key = rank[:n] << np.uint64(bits if packed else 32)
        key |= rank[step : n + step]
        done += step


def prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes sorted by `length` bytes, and for each row whether its longest common prefix with the row
    above is shorter than `length`, that is, whether it starts a group of suffixes with the same first `length` bytes.

    The prefix lengths are derived by increasing value: the rows that start a group of equal l-byte prefixes are known;
    an interval of such a group, extended backward by each character that precedes its rows, gives an interval of l+1
    bytes whose first row starts a group of l+1 bytes. Only intervals whose first row is new at length l are extended,
    as the others gave their rows before. Strings with STOP inside aren't told apart.
    """
    n = len(text)
    order = sort_suffixes(text, length)
    before = np.concatenate((text[-1:], text))[order]  # the transform: the byte in front of each row
    by_byte = np.argsort(before, kind="stable").astype(np.int32)
    back = np.empty(n, dtype=np.int32)  # the row of the suffix that is one byte longer
    back[by_byte] = np.arange(n, dtype=np.int32)
    above = np.full(n, -1, dtype=np.int32)  # the row above that has the same byte in front
    same = before[by_byte]
    linked = np.flatnonzero(same[1:] == same[:-1]) + 1
    above[by_byte[linked]] = by_byte[linked - 1]
    above[before == STOP] = n  # never extended
    head = text[order]
    first = np.ones(n + 1, dtype=bool)
    first[1:n] = head[1:] != head[:-1]
    new, count = np.flatnonzero(first[:n]).astype(np.int32), np.arange(n, dtype=np.int32)
    for _ in range(1, length):
        edges = np.flatnonzero(first).astype(np.int32)
        at = np.cumsum(first, dtype=np.int32)[new] if 20 * len(new) > n else np.searchsorted(edges, new) + 1
        size = edges[at] - new
        start = np.repeat(new, size)
        rows = start - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
        rows += count[: len(rows)]
        found = back[rows[above[rows] < start]]
        new = np.sort(found[~first[found]])  # in order, as scattered reads cost most
        if not len(new):
            break
        first[new] = True
    return order, first[:n]


def least_owners(strings: list[bytes], doc: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` bytes of each string, one after the other, the smallest document of the suffixes that
    share it: those between two rows that start a group in the order of the transform."""
    text = np.frombuffer(b"\xff".join([*strings, b""]), dtype=np.uint8)
    size = np.array([len(s) for s in strings], dtype=np.int64) + 1
    order, first = prefix_groups(text, length)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(doc, size)
    window = np.arange(len(text)) - np.repeat(start, size) <= np.repeat(size - 1 - length, size)
    rows = order[window[order]]
    if not len(rows):
        return owner[:0]
    group = (np.cumsum(first) - 1)[window[order]]
    edge = np.flatnonzero(np.concatenate(([True], np.diff(group) > 0)))
    least = np.minimum.reduceat(owner[rows], edge)
    out = np.empty(len(text), dtype=np.int64)
    out[rows] = np.repeat(least, np.diff(np.concatenate((edge, [len(rows)]))))
    return out[window]


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (n[0] of them), first[1], …"""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def matcher(length: int = LENGTH, most: int = MOST, most_alone: int = MOST_ALONE):
    """Each distinct string enters a transform once, owned by the smallest document that has it; a window of an entry came
    earlier if the least owner in the transform is smaller than the entry's document.

    Strings with different sub keys share no window, so a large bin is matched in parts of at most `most` bytes; what
    has one sub key and more than `most_alone` bytes is matched by single windows, by classes of their checksums."""

    def run(strings, sub, string, doc, at):
        owner = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(owner, string, doc)
        size = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        n = size - length
        start = np.cumsum(n) - n
        least = np.empty(int(n.sum()), dtype=np.int64)
        order = np.argsort(sub, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(sub[order]) > 0)))  # of each sub key
        held = np.concatenate(([0], np.cumsum(size[order])))
        upto, parts, k = np.append(held[first[1:]], held[-1]), [], 0
        while k < len(first):
            # as many sub keys as fit, one at least
            last = max(k, int(np.searchsorted(upto, held[first[k]] + most, side="right")) - 1)
            parts.append(order[first[k] : first[last + 1] if last + 1 < len(first) else len(order)])
            k = last + 1
        for ids in parts:
            if size[ids].sum() <= most_alone or sub[ids[0]] != sub[ids[-1]]:
                least[_each(start[ids], n[ids])] = least_owners([strings[k] for k in ids.tolist()], owner[ids], length)
                continue
            classes = int(n[ids].sum() * (length + 1) // most) + 1
            parted: list[list] = [[] for _ in range(classes)]
            for k, windows in zip(ids.tolist(), n[ids].tolist(), strict=True):
                for o in range(windows):
                    parted[zlib.crc32(strings[k][o : o + length]) % classes].append((k, o))
            for mine in filter(None, parted):
                k, o = np.array(mine).T
                least[start[k] + o] = least_owners([strings[i][j : j + length] for i, j in mine], owner[k], length)
        return least[_each(start[string], n[string])] < np.repeat(doc, n[string]), n[string]

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"


def finish(keep_texts: bool):
    def run(ids: list, texts: list[bytes], cut: Cut, covered: np.ndarray) -> pa.Table:
        rows = []
        for doc, text, a in zip(ids, texts, cut.first.tolist(), strict=False):
            starts, ends = spans(covered[a : a + len(text)])
            kept, at = [], 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.append(text[at:s])
                at = e
            left = b"".join([*kept, text[at:]])
            rows.append((doc, len(text), len(text) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left if keep_texts else None, starts.tolist() if keep_texts else None, ends.tolist() if keep_texts else None))
        types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(RESULT.split(", "), zip(*rows, strict=True), types, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep_texts: bool = True, **options) -> DataFrame:
    """For each row of docs: sizes, number and places of the removed byte spans, the bytes that are left and their digest.

    A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. The first document
    keeps what it has, repeats within one document stay, matches never cross documents. Bytes are removed as they are,
    so what is left of a text may end inside a character. Null texts are empty, texts shorter than `length` stay, rows
    with the same id don't remove one another, an empty table gives an empty result; other columns are ignored.
    """
    return find_repeats(docs, length, False, matcher(length), finish(keep_texts), RESULT, **options)


def op1(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), keep_texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
