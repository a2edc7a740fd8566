"""Repeated windows across a corpus: texts are cut where the smallest gram hash of a window changes, so that equal windows
land in the same bin whatever surrounds them; bins are then matched exactly by the caller's method.

Rows between stages are a few large blobs for each (block of documents, bin), never a row for each window:

1. each block asks the filter bins which of its gram hashes occur again anywhere (five bytes and a count for each);
2. each block sends the distinct strings that carry a repeated hash to match bins, each with its first place in the block
   and, where it has more, its next one: these are its entries;
3. a match bin answers, for each entry, which of its windows came earlier in the corpus, by the caller's method;
4. each block marks the windows of every place by the answer for its entry, and builds its result.

Nothing is marked but by an answer. A string's third and further places share the entry of the second, since what makes the
second's windows repeated makes theirs, so what a block sends for a string is the same whether it has it twice or a thousand
times. Blocks work out their strings again in step 4 instead of keeping them, and all three passes read one exchange of the
documents. Nothing reaches the driver but the row and byte counts. A hash that very many places have (a common phrase in
different surroundings) is sent on window by window, each window to a bin of its own hash, so no bin gathers all of its
surroundings.

Blocks and bins both grow with the square root of the corpus, so the rows between stages, at most one for each block and
bin, grow in proportion to it: one for each BLOB bytes of text, whatever the size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import corpus_size, eights, mix, spans, word_bounds, word_hashes

#: Bytes of text for each pair of a block and a bin.
BLOB = 2048
#: Match bins to a filter bin, which gets six bytes for some eighteen of text.
BINS_A_FILTER = 4
#: Occurrences from which a gram hash is sent on by single windows.
HOT = 30_000
NO_ID = -(1 << 63)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = width - done
    return np.minimum(h[:-rest], h[rest:]) if rest else h


@dataclass
class Cut:
    """A block of documents, cut into runs of windows with the same key. Units are bytes or words, numbered through the block."""

    data: bytes
    first: np.ndarray  # of each document, its first unit, and the number of units at the end
    low: np.ndarray | None  # byte at which a unit starts, or None where units are bytes
    high: np.ndarray | None
    window: int
    unit: np.ndarray  # of each run: its first window
    n: np.ndarray  # and its number of windows
    key: np.ndarray
    count: np.ndarray  # times that the gram of the key is in the run: over 1, the run may repeat a window of its own

    def strings(self, unit: np.ndarray, n: np.ndarray) -> list[bytes]:
        last = unit + n + (self.window - 2)
        a, z = (unit, last + 1) if self.low is None else (self.low[unit], self.high[last])
        return [self.data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]


def _runs(m: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(m), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | ~valid[:-1]
    start = np.flatnonzero(valid & new)
    stop = np.ones(len(m), dtype=bool)
    stop[:-1] = new[1:] | ~valid[1:]
    return start, np.flatnonzero(valid & stop) - start + 1


def cut_bytes(texts: list[bytes], window: int, gram: int = 16, step: int = 1 << 18) -> Cut:
    """Units are bytes; grams are 16 bytes, read as two eights. Hashes are held for a step of bytes at a time."""
    data = b"".join(texts)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    buf = np.frombuffer(data + b"\0" * (window + gram), dtype=np.uint8)
    view, starts, keys, last = eights(buf), [], [], None
    for a in range(0, len(data), step):
        end = min(a + step, len(data))
        z = end + window - gram
        h = mix(view[a:z] * np.uint64(0xD6E8FEB86659FD93) ^ (view[a + 8 : z + 8] * np.uint64(0xA0761D6478BD642F) >> np.uint64(3)) + view[a + 8 : z + 8])
        m = sliding_min(h, window - gram + 1)
        new = np.ones(len(m), dtype=bool)
        new[1:] = m[1:] != m[:-1]
        new[0] = last is None or m[0] != last
        new[first[np.searchsorted(first, a) : np.searchsorted(first, end)] - a] = True
        last, at = m[-1], np.flatnonzero(new)
        starts.append(at + a)
        keys.append(m[at])
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return Cut(data, first, None, None, window, none, none, np.zeros(0, dtype=np.uint64), none)
    start, key = np.concatenate(starts), np.concatenate(keys)
    # a run ends at the next one, or behind its document's last window
    n = np.minimum(np.append(start[1:], len(data)), first[np.searchsorted(first, start, side="right")] - (window - 1)) - start
    some = n > 0
    return Cut(data, first, None, None, window, start[some], n[some], key[some], np.ones(int(some.sum()), dtype=np.int64))


def cut_words(texts: list[bytes], window: int, gram: int = 4) -> Cut:
    """Units are words, joined by one space within a document; grams are four words."""
    words = [t.split() for t in texts]  # bytes.split() splits at 0x09-0x0D and 0x20, and at nothing else
    lens = np.array([len(w) for w in words], dtype=np.int64)
    data = b"\n".join(b" ".join(w) for w in words)
    first = np.concatenate(([0], np.cumsum(lens)))
    buf, low, high = word_bounds(data)
    h = word_hashes(buf, low, high)
    g = np.full(len(h), np.uint64(0x9E3779B97F4A7C15))
    for k in range(gram):
        g[: len(h) - k] = mix(g[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
    keys = sliding_min(np.concatenate((g, np.zeros(window, dtype=np.uint64))), window - gram + 1)[: len(h)]
    valid = np.arange(window, len(h) + window) <= np.repeat(first[1:], lens)
    start, n = _runs(keys, valid) if len(h) else (np.zeros(0, dtype=np.int64),) * 2
    wide = n + (window - gram)
    at = np.cumsum(wide) - wide
    hit = g[np.repeat(start - at, wide) + np.arange(wide.sum())] == np.repeat(keys[start], wide)
    return Cut(data, first, low, high, window, start, n, keys[start], np.add.reduceat(hit, at, dtype=np.int64) if len(at) else n)


@dataclass(frozen=True)
class Plan:
    blocks: int
    filters: int
    bins: int
    window: int
    words: bool
    hot: int

    @classmethod
    def of(cls, size: int, window: int, words: bool, hot: int = HOT, block_bytes: int | None = None, bin_bytes: int | None = None) -> Plan:
        """For a corpus of `size` bytes: as many blocks as bins, of the same number of bytes each, unless told otherwise."""
        each = max(1, math.isqrt(size * BLOB))
        blocks, bins = (max(1, -(-size // (n or each))) for n in (block_bytes, bin_bytes))
        return cls(blocks, -(-bins // BINS_A_FILTER), bins, window, words, hot)

    def cut(self, texts: list[bytes]) -> Cut:
        return (cut_words if self.words else cut_bytes)(texts, self.window)


def _asked(cut: Cut, plan: Plan):
    """Distinct keys by filter bin, the bin of each, its count, and the place of each run's key among them."""
    u, back = np.unique(cut.key, return_inverse=True)
    counts = np.bincount(back, cut.count, len(u)).astype(np.int64)
    where = (u % np.uint64(plan.filters)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    place = np.empty(len(u), dtype=np.int64)
    place[order] = np.arange(len(u))
    return u[order], where[order], counts[order], place[back]


def _groups(where: np.ndarray):
    """(value, start, end) of the runs of a sorted array."""
    edge = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, [len(where)])) if len(where) else np.zeros(1, dtype=np.int64)
    return [(int(where[a]), int(a), int(z)) for a, z in zip(edge[:-1], edge[1:], strict=True)]


def _order(t: pa.Table) -> pa.Table:
    """The documents of a block in order."""
    ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
    return t.take(sorted(range(len(ids)), key=lambda k: (NO_ID if ids[k] is None else ids[k], texts[k] or b"")))


def _texts(t: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Documents of a block in order: ids as they are, ids to compare by, texts."""
    t = _order(t.select(["doc_id", "text"]))
    ids = t.column("doc_id").to_pylist()
    return ids, np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), [x or b"" for x in t.column("text").to_pylist()]


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(schema.items(), cols, strict=True)})


def _spark(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{k} {names[t]}" for k, t in schema.items())


ASK = {"block": pa.int32(), "bin": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "many": pa.binary()}
TOLD = {"block": pa.int32(), "bin": pa.int32(), "again": pa.binary(), "hot": pa.binary()}
SENT = {"block": pa.int32(), "bin": pa.int32(), "size": pa.binary(), "data": pa.binary(), "doc": pa.binary(), "at": pa.binary(), "sub": pa.binary(), "later": pa.binary(), "later_doc": pa.binary(), "later_at": pa.binary()}


def ask(plan: Plan) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        keys, where, counts, _ = _asked(plan.cut(_texts(t)[2]), plan)
        low = np.ascontiguousarray((keys // np.uint64(plan.filters)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        short, rows = np.minimum(counts, 255).astype(np.uint8), []
        for b, a, z in _groups(where):
            big = np.flatnonzero(short[a:z] == 255)  # their counts don't fit into a byte
            rows.append((block, b, low[a:z].tobytes(), short[a:z].tobytes(), np.stack([big, counts[a:z][big]]).astype("<i8").tobytes() if len(big) else None))
        return _table(ASK, rows)

    return run


def tell(plan: Plan) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype=np.uint8).reshape(-1, 5) for x in t.column("keys").to_pylist()]
        wide = np.zeros((sum(map(len, parts)), 8), dtype=np.uint8)
        wide[:, :5] = np.concatenate(parts)
        _, back = np.unique(wide.view("<u8").ravel(), return_inverse=True)
        count = np.frombuffer(b"".join(t.column("counts").to_pylist()), dtype=np.uint8).astype(np.float64)
        start = np.cumsum([0, *map(len, parts)])
        for k, many in enumerate(t.column("many").to_pylist()):
            if many:
                where, how_many = np.frombuffer(many, dtype="<i8").reshape(2, -1)
                count[start[k] + where] = how_many
        n = np.bincount(back, count)[back]
        rows, at = [], 0
        for block, b, part in zip(t.column("block").to_pylist(), t.column("bin").to_pylist(), parts, strict=True):
            mine = n[at : at + len(part)]
            hot = mine > plan.hot
            rows.append((block, b, np.packbits(mine > 1).tobytes(), np.packbits(hot).tobytes() if hot.any() else None))
            at += len(part)
        return _table(TOLD, rows)

    return run


@dataclass
class Strings:
    """The distinct strings that a block sends, by match bin, and its places of them."""

    texts: list[bytes]
    where: np.ndarray  # match bin of each string, sorted
    sub: np.ndarray
    doc: np.ndarray  # id of the first document that has it in this block
    at: np.ndarray  # where words are counted, the first place in that document
    later: np.ndarray  # the strings that the block has in another document too, or (words) at another place, in order
    later_doc: np.ndarray  # and the first such document and place
    later_at: np.ndarray
    unit: np.ndarray  # of each place: its first window
    n: np.ndarray
    string: np.ndarray
    is_later: np.ndarray


def strings_of(cut: Cut, ids: np.ndarray, told: dict[int, tuple[bytes, bytes | None]], plan: Plan) -> Strings:
    keys, where, _, back = _asked(cut, plan)
    again, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for b, a, z in _groups(where):
        bits = told[b]
        again[a:z] = np.unpackbits(np.frombuffer(bits[0], dtype=np.uint8), count=z - a)
        if bits[1]:
            hot[a:z] = np.unpackbits(np.frombuffer(bits[1], dtype=np.uint8), count=z - a)
    take, single = again[back] & ~hot[back], again[back] & hot[back]
    unit, n, key = cut.unit[take], cut.n[take], cut.key[take]
    texts = cut.strings(unit, n)
    if single.any():
        count = cut.n[single]
        more = np.repeat(cut.unit[single], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        extra = cut.strings(more, np.ones_like(more))
        own = mix(np.array([zlib.crc32(x) | zlib.adler32(x) << 32 for x in extra], dtype=np.uint64))
        unit, n, key, texts = np.concatenate((unit, more)), np.concatenate((n, np.ones_like(more))), np.concatenate((key, own)), texts + extra
    seen: dict[bytes, int] = {}
    string = np.array([seen.setdefault(x, len(seen)) for x in texts], dtype=np.int64)
    distinct = list(seen)
    sample = np.full(len(distinct), -1, dtype=np.int64)
    sample[string[::-1]] = np.arange(len(texts))[::-1]
    bins = (key[sample] % np.uint64(plan.bins)).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    new = np.empty(len(order), dtype=np.int64)
    new[order] = np.arange(len(order))
    string = new[string]
    d = np.searchsorted(cut.first, unit, side="right") - 1
    d = np.minimum(d, len(ids) - 1)
    # by bytes, all places in one document are alike
    place_doc, place_at = ids[d], unit - cut.first[d] if plan.words else np.zeros(len(d), dtype=np.int64)
    by = np.lexsort((place_at, place_doc, string))
    lead = by[np.concatenate(([True], np.diff(string[by]) > 0))] if len(by) else by
    doc, at = place_doc[lead], place_at[lead]
    is_later = (place_doc != doc[string]) | (place_at != at[string])
    after = by[is_later[by]]
    later, pick = np.unique(string[after], return_index=True)
    sub = (key[sample] // np.uint64(plan.bins)).astype(np.uint32)
    return Strings([distinct[i] for i in order], bins[order], sub[order], doc, at, later, place_doc[after[pick]], place_at[after[pick]], unit, n, string, is_later)


def _told(t: pa.Table) -> dict[int, tuple[bytes, bytes | None]]:
    return {b: (a, h) for b, a, h in zip(t.column("bin").to_pylist(), t.column("again").to_pylist(), t.column("hot").to_pylist(), strict=True) if a is not None}


def send(plan: Plan) -> Callable:
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(SENT, [])
        block = docs.column("block")[0].as_py()
        _, ids, texts = _texts(docs)
        s = strings_of(plan.cut(texts), ids, _told(told), plan)
        size, rows = np.array([len(x) for x in s.texts], dtype="<i4"), []
        for b, a, z in _groups(s.where):
            i, j = np.searchsorted(s.later, (a, z))
            rows.append((block, b, size[a:z].tobytes(), b"".join(s.texts[a:z]), s.doc[a:z].tobytes(), s.at[a:z].tobytes(), s.sub[a:z].tobytes(), (s.later[i:j] - a).astype("<u4").tobytes(), s.later_doc[i:j].tobytes(), s.later_at[i:j].tobytes()))
        return _table(SENT, rows)

    return run


#: matcher(strings, sub keys, string of each entry, its document, its place) -> for each entry, one after the other, which of
#: its windows came earlier, and the number of its windows. Strings are distinct; those with different sub keys share no window.
Matcher = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def match(matcher: Matcher) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        sub_of: list[np.ndarray] = []
        strings, docs, ats = [], [], []
        for size, data, doc, at, sub, later, later_doc, later_at in zip(*(t.column(c).to_pylist() for c in list(SENT)[2:]), strict=True):
            edge = np.concatenate(([0], np.cumsum(np.frombuffer(size, dtype="<i4")))).tolist()
            before = len(seen)
            mine = np.array([seen.setdefault(data[a:z], len(seen)) for a, z in zip(edge[:-1], edge[1:], strict=True)], dtype=np.int64)
            sub_of.append(np.frombuffer(sub, dtype=np.uint32)[mine >= before])  # new ones are numbered as they come
            strings.append(np.concatenate((mine, mine[np.frombuffer(later, dtype="<u4")])))
            docs.append(np.frombuffer(doc + later_doc, dtype=np.int64))
            ats.append(np.frombuffer(at + later_at, dtype=np.int64))
        bits, n = matcher(list(seen), np.concatenate(sub_of), np.concatenate(strings), np.concatenate(docs), np.concatenate(ats))
        edge = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, strings)])]
        return _table(TOLD, [(block, b, np.packbits(bits[a:z]).tobytes(), None) for block, b, a, z in zip(t.column("block").to_pylist(), t.column("bin").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)])

    return run


def earlier_windows(cut: Cut, s: Strings, answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    """For each unit of the block, whether the window that starts there came earlier."""
    size = int(cut.first[-1])
    n = np.ones(len(s.texts), dtype=np.int64)
    n[s.string] = s.n
    offset, later_offset, bits, base = np.zeros(len(s.texts), dtype=np.int64), np.zeros(len(s.texts), dtype=np.int64), [], 0
    for b, a, z in _groups(s.where):
        i, j = np.searchsorted(s.later, (a, z))
        held = np.concatenate((n[a:z], n[s.later[i:j]]))
        at = base + np.cumsum(held) - held
        offset[a:z], later_offset[s.later[i:j]] = at[: z - a], at[z - a :]
        bits.append(np.unpackbits(np.frombuffer(answers[b][0], dtype=np.uint8), count=int(held.sum())))
        base += int(held.sum())
    bits = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)
    total = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
    o = np.where(s.is_later, later_offset[s.string], offset[s.string])
    marked = total[o + s.n] - total[o]
    whole, some = marked == s.n, (marked > 0) & (marked < s.n)
    out = np.zeros(size + 1, dtype=np.int32)
    np.add.at(out, s.unit[whole], 1)
    np.add.at(out, s.unit[whole] + s.n[whole], -1)
    mask = np.cumsum(out, dtype=np.int32, out=out)[:size] > 0
    for u, a, m in zip(s.unit[some].tolist(), o[some].tolist(), s.n[some].tolist(), strict=True):
        mask[u : u + m] |= bits[a : a + m].view(bool)
    return mask


def covered(windows: np.ndarray, width: int) -> np.ndarray:
    """Units inside a marked window. Marked windows never reach beyond their document."""
    c = np.cumsum(windows, dtype=np.int32)
    out = c > 0
    out[width:] = c[width:] > c[:-width]
    return out


#: finish(ids, texts, cut, covered units) -> the rows of a block.
Finish = Callable[[list, list[bytes], Cut, np.ndarray], pa.Table]


def find_repeats(docs: DataFrame, window: int, words: bool, matcher: Matcher, finish: Finish, schema: str, bin_bytes: int | None = None, hot: int = HOT, block_bytes: int | None = None, carry: bool = False) -> DataFrame:
    """docs: doc_id long, text; with `carry`, the result has another column, `row`, a struct of all columns of docs but text. By bytes, a window came earlier if it is in a document with a smaller id; by words, also if
    it starts earlier in the same document. Null texts are empty; a null id comes before all others; rows with the same
    id count as one document, and where they differ may be in different blocks: they don't repeat one another by bytes,
    nor, at the same place, by words."""
    plan = Plan.of(corpus_size(docs)[1], window, words, hot, block_bytes, bin_bytes)
    columns = [F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(plan.blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    rows = docs.select(*columns)
    whole, result = rows, StructType.fromDDL(schema)
    if carry:
        whole = docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
        result = result.add("row", whole.schema["row"].dataType)
    asked = rows.groupBy("block").applyInArrow(ask(plan), _spark(ASK))
    told = asked.groupBy("bin").applyInArrow(tell(plan), _spark(TOLD))
    sent = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send(plan), _spark(SENT))
    answers = sent.groupBy("bin").applyInArrow(match(matcher), _spark(TOLD))
    both = told.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))

    def end(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, keys, texts = _texts(docs)
        kind = np.array(replies.column("kind").to_pylist())
        told, answers = (_told(replies.filter(pa.array(kind == k))) for k in (0, 1))
        cut = plan.cut(texts)
        marks = earlier_windows(cut, strings_of(cut, keys, told, plan), answers)
        out = finish(ids, texts, cut, covered(marks, window))
        return out.append_column("row", _order(docs).column("row")) if carry else out

    return whole.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(end, result)


__all__ = ["Cut", "Plan", "covered", "cut_bytes", "cut_words", "find_repeats", "spans"]
