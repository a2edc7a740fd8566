"""Extraction of identifiers from texts by ordered patterns, with overlaps resolved greedily."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.literals import Scanner
from .tagging import DictionaryTagger  # noqa: F401 (a tagger for tag())

HITS = "array<struct<surface:string,db:string,category:string,identifier:string,curie:string,offset:int,length:int,confidence:string>>"


@dataclass(frozen=True)
class Pattern:
    """One kind of identifier. name(surface) gives (surface, identifier, curie), or None where the match isn't one."""

    db: str
    category: str
    regex: str
    confidence: str
    context: tuple[str, ...]
    name: Callable[[str], tuple[str, str, str] | None]


def _catalog_name(db: str, uri: str | None):
    def name(surface: str):
        return surface, f"{db}:{surface}", (uri + surface) if uri else f"{db}:{surface}"

    return name


def _hand_name(db: str, prefix: str):
    def name(surface: str):
        body = surface
        if db == "pdb":
            if not re.search("[A-Za-z]", surface):
                return None
            body = surface.upper()
        elif db == "ec":
            body = re.sub(r"^EC[ :]?", "", surface)
        elif db == "go":
            body = surface.removeprefix("GO:")
        return surface, prefix + body, prefix + body

    return name


def catalog_patterns(rows=rules.CATALOG_PATTERNS) -> list[Pattern]:
    return [Pattern(db, category, regex, "high", (), _catalog_name(db, uri)) for db, category, regex, uri in rows]


def hand_patterns(rows=rules.HAND_PATTERNS) -> list[Pattern]:
    return [Pattern(db, "", regex, confidence, words, _hand_name(db, prefix)) for db, regex, prefix, confidence, words in rows]


class Extractor:
    """Finds identifiers in one text. Matches are ordered by offset, then (if longest_first) by length, then confidence, then
    by the order of the patterns; each is kept if it overlaps none before it. Sorted by offset, that means it starts where
    the last kept one has ended. All patterns are looked for in one scan.
    """

    def __init__(self, patterns: list[Pattern], longest_first: bool = True):
        self.patterns, self.longest_first = patterns, longest_first
        self.scanner = Scanner([p.regex for p in patterns])

    def __call__(self, text: str | None) -> list[tuple]:
        if not text:
            return []
        low, found = None, []
        for k, a, z in self.scanner.matches(text):
            p = self.patterns[k]
            if p.confidence == "context":
                low = text.lower() if low is None else low
                if not any(w in low[max(0, a - rules.CONTEXT) : z + rules.CONTEXT] for w in p.context):
                    continue
            named = p.name(text[a:z])
            if named:
                found.append(((a, -(z - a) if self.longest_first else 0, p.confidence != "high", k), (named[0], p.db, p.category, named[1], named[2], a, z - a, p.confidence)))
        kept, end = [], 0
        for _, hit in sorted(found, key=lambda x: x[0]):
            if hit[5] >= end:
                kept.append(hit)
                end = hit[5] + hit[6]
        return kept


def extract(passages: DataFrame, patterns: list[Pattern] | None = None, longest_first: bool = True, text: str = "text") -> DataFrame:
    """passages with one row for each identifier: surface, db, category, identifier, curie, offset (in the passage, from 0),
    length, confidence, and its number in the passage. Null texts and texts without any give no rows."""
    extractor = Extractor(patterns or catalog_patterns(), longest_first)

    @F.pandas_udf(HITS)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([extractor(x) for x in t])

    # so marked, it isn't run again for the filter that Spark infers below the explode
    out = passages.withColumn("_hits", find.asNondeterministic()(text)).select(*passages.columns, F.posexplode("_hits").alias("hit_no", "_h"))
    return out.select(*passages.columns, "hit_no", "_h.*")


def resolve_native(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The same resolution on rows (offset, length, confidence, pattern_no) that come from elsewhere: a fold over each key's
    sorted hits, in the JVM."""
    order = F.array_sort(F.collect_list(F.struct("offset", (-F.col("length")).alias("neg"), (F.col("confidence") != "high").alias("low"), "pattern_no", *[c for c in hits.columns if c not in {*keys, "offset", "pattern_no"}])))
    dtype = hits.groupBy(*keys).agg(order.alias("h")).schema["h"].dataType.simpleString()
    kept = F.aggregate(order, F.struct(F.lit(-1).cast("int").alias("end"), F.from_json(F.lit("[]"), dtype).alias("kept")), lambda s, h: F.when(h["offset"] >= s["end"], F.struct((h["offset"] - h["neg"]).cast("int").alias("end"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return hits.groupBy(*keys).agg(kept.alias("_k")).select(*keys, F.explode("_k").alias("_h")).select(*keys, *(F.col(f"_h.{c}").alias(c) for c in hits.columns if c not in keys))


def numbered(hits: DataFrame, keys: list[str], prefix: str, first: int = 0) -> DataFrame:
    """Ordinal ids within keys, by offset: prefix0, prefix1, …"""
    w = Window.partitionBy(*keys).orderBy("offset", "length")
    return hits.withColumn("ann_id", F.concat(F.lit(prefix), (F.row_number().over(w) - 1 + first).cast("string")))


def has_context(text: Column, offset: Column, length: Column, words, reach: int = rules.CONTEXT) -> Column:
    """Whether one of the words is within `reach` code points of a match at offset (from 0)."""
    start = F.greatest(offset - reach, F.lit(0))
    near = F.lower(F.substr(text, start + 1, offset + length + reach - start))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(near, w))


def chunks_of(text: str, most: int = 900_000) -> list[tuple[int, str]]:
    """(offset, chunk) of a long text, cut behind a line, else a sentence, else a space, else anywhere."""
    out, at = [], 0
    while len(text) - at > most:
        end = next((k + n for mark, n in (("\n", 1), (". ", 2), (" ", 1)) if (k := text.rfind(mark, at, at + most - n + 1)) > at), at + most)
        out.append((at, text[at:end]))
        at = end
    return [*out, (at, text[at:])]


def tag(passages: DataFrame, tagger, text: str = "text") -> DataFrame:
    """passages (doc_id, passage_idx, offset, text) with annotation rows: ann_id T1, T2, …, surface, entity_type, offset (in the document), length, score."""

    @F.pandas_udf("array<struct<start:int,end:int,entity_type:string,score:double>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([[(at + a, at + z, kind, score) for at, part in chunks_of(x or "") for a, z, kind, score in tagger(part)] for x in t])

    out = passages.withColumn("_t", find.asNondeterministic()(text)).select("*", F.posexplode("_t").alias("_n", "_h"))
    surface = F.substr(text, F.col("_h.start") + 1, F.col("_h.end") - F.col("_h.start"))
    return out.select(*[c for c in passages.columns if c not in ("offset", text)], F.concat(F.lit("T"), (F.col("_n") + 1).cast("string")).alias("ann_id"), surface.alias("surface"), F.col("_h.entity_type").alias("entity_type"), (F.col("offset") + F.col("_h.start")).alias("offset"), (F.col("_h.end") - F.col("_h.start")).alias("length"), F.col("_h.score").alias("score"))


def link_surfaces(surfaces: DataFrame, linker, mode: str = "full", short: int = 3, chunk: int = 5_000, tries: int = 2) -> DataFrame:
    """(surface, entity_type, identifier, linker_status) of distinct surfaces. linker(entity_type, surfaces) -> ids, in chunks
    of one type; a chunk that fails `tries` times is logged and gives predict_error rows. Mode short links surfaces of at most `short` characters, none no one."""
    todo = surfaces.select("surface", "entity_type").distinct()
    todo = todo.filter(F.length("surface") <= short) if mode == "short" else todo.limit(0) if mode == "none" else todo

    def run(frames):
        for f in frames:
            for kind, part in f.groupby("entity_type", sort=True):
                names = sorted(part["surface"])
                for k in range(0, len(names), chunk):
                    some = names[k : k + chunk]
                    ids, status = [None] * len(some), ["predict_error"] * len(some)
                    for attempt in range(tries):
                        try:
                            ids = linker(kind, some)
                            status = ["ok" if i else "no_id" for i in ids]
                            break
                        except Exception:  # whatever a linker raises is its chunk's failure, not the job's
                            logging.getLogger(__name__).exception("linking %d surfaces of type %s failed, try %d", len(some), kind, attempt + 1)
                    yield pd.DataFrame({"surface": some, "entity_type": kind, "identifier": ids, "linker_status": status})

    return todo.repartition("entity_type", "surface").mapInPandas(run, "surface string, entity_type string, identifier string, linker_status string")
