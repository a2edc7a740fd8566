"""Dictionary tagging: names of a vocabulary of any size in texts, whole words, leftmost and then longest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.places import written

#: Bytes of names up to which a vocabulary is sent to all tasks; larger ones are joined to the texts.
MOST_SENT = 48 << 20
#: Characters that are looked at in one go; longer texts are looked at alone.
CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_word: np.ndarray | None = None
_powers: list[np.ndarray] = []


def word_table() -> np.ndarray:
    """Whether each code point belongs to a word, as \\w of Python's patterns says."""
    global _word
    if _word is None:
        _word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
        _word[ord("_")] = True
    return _word


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16), b, dtype=np.uint64)))) for b in (_BASE, _BACK)]
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """Some texts as code points, one after the other, each followed by a zero; the hash of any stretch takes two lookups.

    Tokens are words and single characters outside of words; at[k] and at[k + 1] are where token k starts and ends.
    """

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        is_word = word_table()[self.points]
        self.behind_word = np.concatenate(([False], is_word[:-1]))  # whether a word's character stands before a place
        first = ~is_word | ~self.behind_word
        self.at = np.concatenate((np.flatnonzero(first), [len(self.points)]))
        self.is_word = is_word[self.at[:-1]]
        up, self.back = powers(len(self.points))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * up)))
        ends = np.zeros(len(self.points), dtype=bool)
        ends[self.starts[1:] - 1] = True
        self.is_end = ends[self.at[:-1]]  # tokens that are a text's closing zero

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.back[start]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))


class Vocabulary:
    """A trie of names whose nodes are the beginnings of names that end with a token. A node is known by the hash of its
    whole beginning, so the trie is one sorted array of hashes, and beside each the number of the name that ends there or
    -1. All places of many texts walk down it together, a token a step. Hits are compared with the name's text."""

    def __init__(self, names: list[tuple[str, str]]):
        best: dict[str, str] = {}
        for name, kind in names:
            if name:
                best[name] = min(kind, best.get(name, kind))
        self.names, self.kinds = list(best), list(best.values())
        parts, marks = [], []
        for a in range(0, len(self.names), 100_000):
            some = Texts(self.names[a : a + 100_000])
            of = np.searchsorted(some.starts, some.at[:-1], side="right") - 1
            keep = ~some.is_end
            start, end, of = some.starts[of[keep]], some.at[1:][keep], of[keep]
            parts.append(some.hashes(start, end))
            marks.append(np.where(end == some.starts[of + 1] - 1, of + a, -1))
        keys = np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
        marks = np.concatenate([np.zeros(0, dtype=np.int64), *marks])
        order = np.lexsort((-marks, keys))  # of a node's entries, the one with a name comes first
        keys, marks = keys[order], marks[order]
        once = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        self.keys, self.marks = keys[once], marks[once].astype(np.int32)
        self.seen = np.zeros(1 << 22, dtype=bool)  # by the hash's first bits: most places end here
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def _hits(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, start, end, name) of each place where a name stands as whole words, in no order."""
        t = Texts(texts)
        token = np.flatnonzero(~t.is_end & ~t.behind_word[t.at[:-1]])
        start, step = t.at[token], 0
        while len(token):
            end = t.at[token + step + 1]
            h = t.hashes(start, end)
            some = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
            node = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            right = self.keys[node] == h[some]
            some, node = some[right], node[right]
            token, start, end, name = token[some], start[some], end[some], self.marks[node]
            closed = t.is_word[token + step] | ~t.is_word[np.minimum(token + step + 1, len(t.is_word) - 1)]
            hit = np.flatnonzero((name >= 0) & closed)
            of = np.searchsorted(t.starts, start[hit], side="right") - 1
            for k, a, z, n in zip(of.tolist(), (start[hit] - t.starts[of]).tolist(), (end[hit] - t.starts[of]).tolist(), name[hit].tolist(), strict=True):
                if texts[k][a:z] == self.names[n]:
                    yield k, a, z, n
            step += 1
            more = ~t.is_end[token + step]
            token, start = token[more], start[more]

    def spans(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat arrays: how many spans each text has, and of all of them, text by text, start, end and number of the name. Of the
        names that start first the longest is taken, then on behind it. Null texts have none."""
        counts, parts = np.zeros(len(texts), dtype=np.int64), [[np.zeros(0, dtype=np.int32)] for _ in range(3)]
        a = 0
        while a < len(texts) and self.names:
            z, size = a + 1, len(texts[a] or "")
            while z < len(texts) and size + len(texts[z] or "") <= CHARS:
                size += len(texts[z] or "")
                z += 1
            last, behind, kept = -1, 0, []
            for k, start, minus_end, n in sorted((k, s, -e, n) for k, s, e, n in self._hits([t or "" for t in texts[a:z]])):
                behind = behind if k == last else 0
                if start >= behind:
                    kept.append((start, -minus_end, n))
                    counts[a + k] += 1
                    behind = -minus_end
                last = k
            for part, column in zip(parts, np.array(kept, dtype=np.int32).reshape(len(kept), 3).T, strict=True):
                part.append(column)
            a = z
        return counts, *(np.concatenate(x) for x in parts)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) in each text."""
        counts, *flat = self.spans(texts)
        rows = [(a, z, self.kinds[n]) for a, z, n in zip(*(x.tolist() for x in flat), strict=True)]
        ends = np.cumsum(counts).tolist()
        return [rows[z - n : z] for z, n in zip(ends, counts.tolist(), strict=True)]

    def arrow(self, texts: list[str | None]) -> pa.ListArray:
        """The spans as a column of lists of (start, end, entity_type, surface)."""
        counts, start, end, n = self.spans(texts)
        columns = [pa.array(start), pa.array(end), pa.array(self.kinds, pa.string()).take(pa.array(n)), pa.array(self.names, pa.string()).take(pa.array(n))]
        whole = pa.StructArray.from_arrays(columns, names=["start", "end", "entity_type", "surface"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), whole)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in pieces of at most CHARS bytes, or one text: what is held in Python doesn't grow with a batch."""
    sizes, a, size = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for z, n in enumerate(sizes):
        if z > a and size + n > CHARS:
            yield texts.slice(a, z - a)
            a, size = z, 0
        size += n
    if a < len(sizes):
        yield texts.slice(a)


class DictionaryTagger:
    """The vocabulary behind the annotator interface: text -> [(start, end, entity type, score)]. It stands in for a neural
    model, which is loaded in the same place: the first call in each worker."""

    def __init__(self, names: dict[str, str]):
        self.names, self.vocabulary = names, None

    def __getstate__(self):
        return {"names": self.names, "vocabulary": None}

    def __call__(self, text: str) -> list[tuple[int, int, str, float]]:
        if self.vocabulary is None:
            self.vocabulary = Vocabulary(list(self.names.items()))
        return [(a, z, kind, 1.0) for a, z, kind in self.vocabulary.find([text])[0]]


def token_hashes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token): the hash of each distinct token of a text."""

    def run(batches):
        for b in batches:
            for k, value in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                t = Texts([value])
                found = np.unique(t.hashes(t.at[:-1], t.at[1:])[~t.is_end]).view(np.int64)
                yield pa.record_batch([pa.array([k.as_py()] * len(found), pa.string()), pa.array(found, pa.int64())], names=["key", "token"])

    return texts.select(key, text).mapInArrow(run, "key string, token long")


#: With the surface, as cutting it out of a long text by an expression would walk the text for each name.
SPANS = "array<struct<start:int,end:int,entity_type:string,surface:string>>"


def tag_names(passages: DataFrame, names: DataFrame, text: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """passages with a row for each name in their text: surface, entity_type, start and end (code points of the text, from 0).

    names (name, entity_type): of several types of a name the smallest counts; null and empty names are left out, a null
    type is an empty one. A name stands where no word goes on before or behind it, case and all; names that overlap are taken from the left, the longest
    first. Texts are whole, whatever their length; null ones and an empty vocabulary give no rows.

    A vocabulary of at most `most_sent` bytes goes to all tasks. A larger one is joined: each name is known by that of its
    tokens that the fewest distinct texts have, and a text only gets the names whose rarest token it has; names with a token
    that no text has meet none. No task sees the whole vocabulary then.
    """
    known = names.select(F.col("name").cast("string").alias("name"), F.coalesce(F.col("entity_type").cast("string"), F.lit("")).alias("kind")).filter("name <> ''").groupBy("name").agg(F.min("kind").alias("kind"))
    known = written(known, "names")
    size = known.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("kind")), F.lit(0)).alias("n")).first()["n"]
    columns = passages.columns
    if size <= most_sent:
        sent = passages.sparkSession.sparkContext.broadcast(pa.Table.from_batches(known.select("name", "kind").toArrow().to_batches(), pa.schema([("name", pa.string()), ("kind", pa.string())])))
        held: list[Vocabulary] = []

        @F.arrow_udf(SPANS)
        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if not held:
                held.append(Vocabulary(list(zip(*(c.to_pylist() for c in sent.value.columns), strict=True))))
            for b in batches:
                for some in slices(b):
                    yield held[0].arrow(some.to_pylist())

        met = passages.withColumn("_spans", find.asNondeterministic()(F.col(text).cast("string")))
    else:
        texts = written(passages.select(F.col(text).cast("string").alias("text")).filter("text <> ''").select(F.md5("text").alias("key"), "text").dropDuplicates(["key"]), "texts")
        of_texts = written(token_hashes(texts, "key", "text"), "tokens")
        numbers = of_texts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        of_names = token_hashes(known, "name", "name").join(numbers, "token", "left").groupBy("key").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.count_if(F.col("n").isNull()).alias("absent")).filter("absent = 0")
        rare = of_names.select(F.col("key").alias("name"), "token").join(known, "name")
        some = of_texts.join(rare, "token").groupBy("key").agg(F.collect_list(F.struct("name", "kind")).alias("names"))

        @F.arrow_udf(SPANS)
        def find_some(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for b, lists in batches:
                yield pa.concat_arrays([Vocabulary([(x["name"], x["kind"]) for x in few.as_py()]).arrow([t.as_py()]) for t, few in zip(b, lists, strict=True)])

        found = texts.join(some, "key").select(F.col("key").alias("_key"), find_some.asNondeterministic()("text", "names").alias("_spans"))
        met = passages.join(written(found, "spans"), F.md5(F.col(text).cast("string")) == F.col("_key"))
    out = met.select(*(F.col(f"`{c}`") for c in columns), F.explode("_spans").alias("_s"))
    return out.select(*(F.col(f"`{c}`") for c in columns), F.col("_s.surface").alias("surface"), F.col("_s.entity_type").alias("entity_type"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
