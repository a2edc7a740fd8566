"""Best-fit packing by patterns: few-document length patterns are fitted to the histogram of lengths by non-negative least
squares, their counts are rounded, and what is left is packed best fit, longest first."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import table, written
from .tokens import cut, shared_encoder

CAPACITY = 1024
END = 2
#: Pieces of one length that one salt holds, about: each of them is numbered within its salt.
PER_SALT = 5_000
#: Fraction from which a fitted count is rounded up, and share of the fit that is placed; what is left is packed best fit.
SHARES = [(up, share) for up in (0.5, 1.0) for share in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece of each text: its ids and the end id 2. Null texts are
    empty and have the end id alone; rows with the same doc_id are separate documents."""

    def run(batches):
        encoder, tail = shared_encoder(tokenizer), np.array([END], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + tail
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(part), part) if keep_ids else (doc, k, start, n, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * (5 + keep_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _parts(have: np.ndarray, total: int, k: int, top: int, most: int) -> np.ndarray:
    """Rows of k lengths, each at most the one before it and the first at most `top`, that sum up to `total`; no more than
    about `most` rows, those of the longest first lengths."""
    if k == 1:
        return np.array([[total]] if 0 < total <= top and have[total] else [], dtype=np.int64).reshape(-1, 1)
    first = np.flatnonzero(have[: min(top, total - k + 1) + 1]) if total >= k else np.zeros(0, dtype=np.int64)
    first = first[first * k >= total][::-1]
    if k == 2:
        first = first[have[total - first]]
        return np.stack([first, total - first], 1)
    out, n = [np.zeros((0, k), dtype=np.int64)], 0
    for x in first.tolist():
        rest = _parts(have, total - x, k - 1, x, most - n)
        out.append(np.concatenate([np.full((len(rest), 1), x), rest], 1))
        n += len(rest)
        if n >= most:
            break
    return np.concatenate(out)


def patterns(lengths: list[int], capacity: int, most: int = 90_000, most_waste: int = 16, documents: int = 4) -> np.ndarray:
    """Patterns of one to `documents` lengths that fill the capacity, or fall short of it by at most `most_waste`, as rows of
    lengths padded with 0: single lengths, then exact fills, then by waste, each time those of fewer documents first, until
    there are about `most`. All exact fills of two and three lengths up to 1024 are fewer than that."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[[x for x in lengths if 0 < x < capacity]] = True
    single = np.flatnonzero(have[capacity - most_waste :] if capacity > most_waste else have) + max(0, capacity - most_waste)
    found, n = [np.pad(single[:, None], ((0, 0), (0, documents - 1)))], len(single)
    for waste in range(min(most_waste, capacity - 1) + 1):
        for k in range(2, documents + 1):
            rows = _parts(have, capacity - waste, k, capacity, most - n) if n < most else np.zeros((0, k), dtype=np.int64)
            found.append(np.pad(rows, ((0, 0), (0, documents - k))))
            n += len(rows)
    return np.concatenate(found)


def fit(rows: np.ndarray, histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = 150, most_added: int = 64, shy: float = 1e-3) -> np.ndarray:
    """x >= 0 that makes |A x - histogram| small, A having a column for each pattern, and a last row that holds `shy` times
    what the pattern wastes against 0: an active-set method.

    The columns with the largest gradient that share no length are taken into the passive set, least squares are solved
    on it, and columns that turn negative leave it, until none does: at first all at once; when that gains nothing more,
    only those that come to 0 first on the way, which never raises the error. The set never holds many more columns than
    there are lengths, so most of x is 0 and rounding keeps most of the rest. It ends where no gradient is left, where
    eight rounds gain little, or after about `rounds` solutions, with the best x so far, a valid start for the rounding in any case.
    """
    size = len(histogram)
    h = np.concatenate((histogram.astype(float), [0.0]))
    h[0] = 0.0
    waste = shy * (capacity - rows.sum(1))

    def columns(which):  # dense columns of A
        a = np.zeros((size + 1, len(which)))
        for part in rows[which].T:
            np.add.at(a, (part, np.arange(len(which))), part > 0)
        a[size] = waste[which]
        return a

    x, passive, blocked = np.zeros(len(rows)), np.zeros(0, dtype=np.int64), np.zeros(len(rows), dtype=bool)
    a, gram, since, least, kept = columns(passive), np.zeros((0, 0)), 0, np.inf, x
    careful, solved = False, 0
    while True:
        left = h - a @ x[passive]
        left[0] = 0.0
        gradient = (left[rows] * (rows > 0)).sum(1) + waste * left[size]
        gradient[passive] = 0.0
        gradient[blocked] = 0.0
        order = np.argsort(-gradient, kind="stable")[: 64 * most_added]
        taken, added = np.zeros(size, dtype=bool), []
        for j in order[gradient[order] > 1e-3].tolist():
            part = rows[j][rows[j] > 0]
            if not taken[part].any():
                taken[part] = True
                added.append(j)
                if len(added) == most_added:
                    break
        if not added:
            break
        blocked[:] = False
        new = columns(np.array(added))
        across, own = a.T @ new, new.T @ new + 1e-9 * np.eye(len(added))
        passive, a, gram = np.concatenate((passive, added)).astype(np.int64), np.concatenate((a, new), 1), np.block([[gram, across], [across.T, own]])
        while len(passive):
            best, solved = np.linalg.solve(gram, a.T @ h), solved + 1
            stay = best > 1e-9
            if stay.all():
                break
            if careful:  # go from x towards the solution as far as none turns negative; those that stop it leave
                now = x[passive]
                step = float(np.min(now[~stay] / np.maximum(now[~stay] - best[~stay], 1e-300)))
                best = np.maximum(0.0, now + step * (best - now))
                stay |= best > 1e-9
            x[passive] = np.where(stay, best, 0.0)
            blocked[passive[~stay]] = True
            passive, a, gram = passive[stay], a[:, stay], gram[np.ix_(stay, stay)]
        x[:] = 0.0
        if len(passive):
            x[passive] = best
        error = float(((h - a @ x[passive]) ** 2).sum())
        if error < 0.99 * least:
            since = 0
        else:
            since += 1
        if error < least:
            least, kept = error, x.copy()
        if least <= 1e-5 * float((h**2).sum()) or since == 8 or solved >= rounds:
            break
        if since == 2 and not careful:
            careful, x, passive = True, kept.copy(), np.flatnonzero(kept)
            a = columns(passive)
            gram = a.T @ a + 1e-9 * np.eye(len(passive))
    return kept


def pack_rest(rest: Counter, capacity: int) -> Counter:
    """Best fit, longest first, on counts of lengths: pattern (lengths) -> count. The work is bounded by the lengths."""
    open_bins: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(rest, reverse=True):
        todo = rest[length]
        while todo:
            room = min((c for c, bins in open_bins.items() if c >= length and bins), default=None)
            if room is None:
                each = capacity // length
                if todo >= each:
                    open_bins[capacity - each * length][(length,) * each] += todo // each
                    todo %= each
                if todo:
                    open_bins[capacity - todo * length][(length,) * todo] += 1
                    todo = 0
                break
            held, n = next(iter(open_bins[room].items()))
            take = min(n, todo)
            open_bins[room][held] -= take
            if not open_bins[room][held]:
                del open_bins[room][held]
            open_bins[room - length][(*held, length)] += take
            todo -= take
    return sum((bins for bins in open_bins.values()), Counter())


def rounded(rows: np.ndarray, x: np.ndarray, histogram: Counter, up: float, capacity: int) -> Counter:
    """Patterns by their fitted counts, the largest first, each as often as there are lengths left for it; a count is rounded
    up from a fraction of `up` on. What is left is packed best fit."""
    left, out = Counter(histogram), Counter()
    chosen = np.flatnonzero(x > 1e-6)
    for k in chosen[np.argsort(-x[chosen], kind="stable")].tolist():
        row = Counter(int(v) for v in rows[k] if v)
        n = min(math.floor(x[k] + 1 - up), *(left[v] // m for v, m in row.items()))
        if n > 0:
            out[tuple(sorted(row.elements(), reverse=True))] += n
            for v, m in row.items():
                left[v] -= m * n
    return out + pack_rest(+left, capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and counts that use each length as often as it occurs: of some shares of the fit and ways to round it, the
    one with the fewest sequences, the first of equal ones. The histogram has at most `capacity` entries, so this runs on the driver."""
    left, out = Counter(histogram), Counter()
    if left.get(capacity):
        out[(capacity,)] = left.pop(capacity)
    rows = patterns(list(left), capacity)
    x = fit(rows, np.array([left.get(k, 0) for k in range(capacity + 1)]), capacity) if len(rows) else np.zeros(0)
    least, best = -(-sum(k * n for k, n in left.items()) // capacity), None
    for up, share in SHARES:
        way = rounded(rows, share * x, left, up, capacity)
        best = way if best is None or sum(way.values()) < sum(best.values()) else best
        if sum(best.values()) <= least:
            break
    return sorted((out + best).items(), reverse=True)


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, columns: first number in the length, first sequence, offset. The k-th piece of a length goes to the last row that starts at or before k."""
    used, out, base = Counter(), defaultdict(list), 0
    for lengths, count in chosen:
        at = 0
        for length in lengths:
            out[length].append((used[length], base, at))
            used[length] += count
            at += length
        base += count
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (read more than once, so written before) with sequence_id and offset. Pieces of a length are numbered within
    salts, so that a length that many pieces have isn't numbered in one task; only the histogram reaches the driver."""
    n = pieces.count()
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, -(-n // PER_SALT)))))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    chosen = plan({int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    where = slots(chosen)
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_k", F.row_number().over(own)).join(offsets, ["length", "_salt"]).withColumn("_k", F.col("_k") - 1 + F.col("_before"))
    keep = pieces.columns
    i, j = keep.index("length"), len(keep)

    def run(batches):
        for b in batches:
            lengths, k = b.column(i).to_numpy(), b.column(j).to_numpy()
            seq, off = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.int64)
            for length in np.unique(lengths):
                mine, t = lengths == length, where[int(length)]
                s = np.searchsorted(t[:, 0], k[mine], side="right") - 1
                seq[mine], off[mine] = t[s, 1] + k[mine] - t[s, 0], t[s, 2]
            yield pa.record_batch([*b.columns[:j], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*keep, "_k").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there. Empty tables give no rows; other
    columns of docs are ignored."""
    return place(written(pieces_of(docs, capacity, tokenizer, keep_ids), "pieces"), capacity)


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
