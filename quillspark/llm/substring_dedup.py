"""Substring dedup by relative Lempel-Ziv parsing: documents are factored greedily against indexed reference blocks, and
sufficiently long factors are the duplicate spans."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh, table
from .blocks import Cut, find_repeats

WINDOW = 20


def parse(words: list[int], reference: list[int], index: dict[tuple, int], limit: int, window: int) -> list[tuple[int, int]]:
    """Greedy factors (start, length) of at least `window` words of `words` in reference[:limit].

    index has the first place of each `window` words. Where the next words are in the index, the factor goes on for as
    long as the words agree; else one word is a literal. Factors are looked for from each factor's last window - 1 words
    on, so that a window across a factor's boundary is checked too.
    """
    out, i, n = [], 0, len(words)
    while i + window <= n:
        at = index.get(tuple(words[i : i + window]))
        if at is None:
            i += 1
            continue
        k, most = window, min(n - i, limit - at)
        if words[i : i + most] == reference[at : at + most]:
            k = most
        while k < most and reference[at + k] == words[i + k]:
            k += 1
        out.append((i, k))
        i += k - window + 1
    return out


def matcher(window: int = WINDOW):
    """The bin's strings in corpus order are one reference block. Every entry, repeats included, is parsed against what the
    documents before its own gave; of what is new in a document, the first place stays. Strings enter the reference once,
    with the windows that were new."""

    def run(strings, sub, string, doc, at):
        names: dict[bytes, int] = {b"\n": 0}
        reference: list[int] = []
        index: dict[tuple, int] = {}
        words_of: list = [None] * len(strings)
        out: list = [None] * len(string)
        order = np.lexsort((at, doc))
        groups = np.split(order, np.flatnonzero(np.diff(doc[order])) + 1)
        for group in groups:  # of one document
            limit, fresh = len(reference), {}  # window -> its first place in this document
            for e in group.tolist():
                words = words_of[string[e]]
                if words is None:
                    words = words_of[string[e]] = [names.setdefault(w, len(names)) for w in strings[string[e]].split(b" ")]
                earlier = np.zeros(len(words) - window + 1, dtype=bool)
                for i, size in parse(words, reference, index, limit, window):
                    earlier[i : i + size - window + 1] = True
                place = int(at[e])
                for i in np.flatnonzero(~earlier).tolist():
                    w = tuple(words[i : i + window])
                    fresh[w] = min(fresh.get(w, place + i), place + i)
                out[e] = earlier
            if not fresh:
                continue
            for e in group.tolist():
                words, place, base = words_of[string[e]], int(at[e]), len(reference)
                new = np.flatnonzero(~out[e]).tolist()
                if new:
                    reference += words
                    reference.append(0)
                for i in new:
                    w = tuple(words[i : i + window])
                    if fresh[w] == place + i:
                        index.setdefault(w, base + i)
                    else:
                        out[e][i] = True
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, starts array<long>, lengths array<long>"


def finish(keep_texts: bool):
    def run(ids: list, texts: list[bytes], cut: Cut, covered: np.ndarray) -> pa.Table:
        rows = []
        for doc, text, a, z in zip(ids, texts, cut.first[:-1].tolist(), cut.first[1:].tolist(), strict=True):
            gone = covered[a:z]
            words = text.split()
            left = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]) if gone.any() else b" ".join(words)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist() if keep_texts else None
            # a text that loses nothing stays as it is, its white space included
            kept = (left if gone.any() else text).decode("utf-8", "replace") if keep_texts else None
            rows.append((doc, z - a, int(gone.sum()), hashlib.sha256(left).hexdigest(), kept, edge and edge[::2], edge and [y - x for x, y in zip(edge[::2], edge[1::2], strict=True)]))
        types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(RESULT.split(", "), zip(*rows, strict=True), types, strict=True)})

    return run


def dedup_spans(docs: DataFrame, window: int = WINDOW, keep_texts: bool = True, **options) -> DataFrame:
    """For each row of docs: word counts, removed spans, what is left and its digest.

    A word goes if `window` words around it also start earlier: in a document with a smaller id, or before in the same
    one. The first place in the corpus stays. Null texts have no words; shorter texts stay; rows with the same id don't
    remove each other at the same place; an empty table gives an empty result; other columns are ignored.
    """
    return find_repeats(docs, window, True, matcher(window), finish(keep_texts), RESULT, **options)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of text, and n_chars, where there is one, counted again. Every row comes back
    once, with all its columns, whatever they are called; rows may have the same id, and null texts stay null. The columns
    travel with the text, so nothing is joined by id."""
    (blank,) = fresh(docs, "blank")
    marked = docs.withColumn(blank, F.col("text").isNull())
    out = find_repeats(marked, window, True, matcher(window), finish(True), RESULT, carry=True)
    text, gone = F.when(~F.col(f"row.`{blank}`"), F.col("kept")), F.col("n_removed") > 0

    def column(c):
        if c == "text":
            return text.alias(c)
        own = F.col(f"row.`{c}`")
        return (F.when(gone, F.length(text).cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own).alias(c)

    return out.select(*map(column, docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"), keep_texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
