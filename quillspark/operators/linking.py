"""Linking surfaces to names: an index of character n-grams in shards, exact top-k by upper bounds, re-ranking by context."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import written

GRAM = 3
#: Names of a shard and surfaces of a block, on average; a task holds one index shard and asks it one block.
SHARD, BLOCK = 50_000, 20_000
#: Scores this near are equal, so that the order of sums doesn't decide.
DIGITS = 9


def grams(name: Column, size: int = GRAM) -> Column:
    """Character n-grams of a name in lower case between two marks, with repeats; white space is one space."""
    s = F.concat(F.lit("^"), F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (size - 1), F.lit(1))), lambda i: F.substr(s, i, F.lit(size)))


def _counted(rows: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, gram, tf): the type is part of the gram, so that only names of the same type have grams in common."""
    g = rows.select(key, kind, F.explode(grams(F.col(text))).alias("g"))
    return g.groupBy(key, F.xxhash64(kind, "g").alias("gram")).agg(F.count(F.lit(1)).alias("tf"))


def _vectors(counted: DataFrame, idf: DataFrame, key: str, unseen: Column) -> DataFrame:
    """(key, grams, weights): tf times idf, of length 1; grams that no name has count for the length only."""
    w = counted.join(idf, "gram", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    parts = F.array_sort(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("gram", "w"))))
    v = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), parts.alias("parts"))
    return v.select(key, F.col("parts.gram").alias("grams"), F.transform("parts", lambda p: p["w"] / F.col("norm")).alias("weights"))


class Index:
    """Postings of a shard: for each gram the names that have it, by number, with their weights, and the largest weight."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, grams: np.ndarray, weights: np.ndarray):
        order = np.lexsort((of, grams))
        self.ids, self.of, self.weights = ids, of[order].astype(np.int32), weights[order]
        self.grams, self.starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(self.starts, len(order))
        self.largest = np.maximum.reduceat(self.weights, self.starts[:-1]) if len(order) else np.zeros(0)
        self.scores = np.zeros(len(ids))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, of=self.of, weights=self.weights, grams=self.grams, starts=self.starts, largest=self.largest)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        self = cls.__new__(cls)
        for k, v in np.load(io.BytesIO(data)).items():
            setattr(self, k, v)
        self.scores = np.zeros(len(self.ids))
        return self

    def search(self, grams: np.ndarray, weights: np.ndarray, k: int, least: float) -> list[tuple[int, float]]:
        """(id, cosine) of the k best names of at least `least`, equal ones in the order of the names' numbers; exact.

        Grams are taken by what they can add at most. Names are let in as long as those that come can still reach the k-th
        best score so far; from there on, only names that are in and can reach it are looked up in the longer lists.
        """
        at = np.searchsorted(self.grams, grams)
        have = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == grams) if len(self.grams) else []
        if not len(have):
            return []
        bound = self.largest[at[have]] * weights[have]
        order = np.argsort(-bound, kind="stable")
        lists, bound = at[have][order], bound[order]
        own = weights[have][order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # what list i and those behind it add at most
        scores, touched, floor, i = self.scores, [], least, 0
        slack = 10.0**-DIGITS
        while i < len(lists) and rest[i] >= floor - slack:
            a, z = self.starts[lists[i]], self.starts[lists[i] + 1]
            scores[self.of[a:z]] += own[i] * self.weights[a:z]
            touched.append(self.of[a:z])
            i += 1
            # a new bound costs a selection; it pays off before long lists only
            if i < len(lists) and self.starts[lists[i] + 1] - self.starts[lists[i]] > 64:
                some = scores[np.unique(np.concatenate(touched))]
                if len(some) >= k:
                    floor = max(floor, np.partition(some, len(some) - k)[len(some) - k])
        inside = np.unique(np.concatenate(touched)) if touched else np.zeros(0, dtype=np.int32)
        for j in range(i, len(lists)):
            inside_scores = scores[inside]
            if len(inside) >= k:
                floor = max(floor, np.partition(inside_scores, len(inside) - k)[len(inside) - k])
            stay = inside_scores + rest[j] >= floor - slack
            scores[inside[~stay]] = 0.0
            inside = inside[stay]
            a, z = self.starts[lists[j]], self.starts[lists[j] + 1]
            spot = np.minimum(np.searchsorted(self.of[a:z], inside), z - a - 1) + a
            hit = self.of[spot] == inside
            scores[inside[hit]] += own[j] * self.weights[spot[hit]]
        found = np.round(scores[inside], DIGITS)
        scores[inside] = 0.0
        good = found >= least
        inside, found = inside[good], found[good]
        best = np.lexsort((inside, -found))[:k]
        return list(zip(self.ids[inside[best]].tolist(), found[best].tolist(), strict=True))


def candidates(surfaces: DataFrame, names: DataFrame, k: int = 5, least: float = 0.5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(surface, entity_type, identifier, name, score, rank): for each distinct (surface, entity_type) the k names of its type
    of the highest cosine between their weighted character n-grams, of at least `least`.

    names (identifier, entity_type, name): equal rows count once; a null or blank name, or a null type, on either side meets
    nothing. A gram's weight is how often it stands in the name times ln((1 + names) / (1 + names with it)) + 1. Equal scores
    are ordered by name and identifier. The result is what comparing all pairs gives, as searches end by upper bounds only.

    Names are dealt out to index shards by hash, surfaces to blocks; a task holds one shard and answers one block, so its
    memory is bounded whatever the tables' sizes, and each surface gets at most k rows from each shard.
    """
    blank = "trim(name) = ''"
    known = names.select("identifier", "entity_type", "name").filter(f"name is not null and not ({blank}) and entity_type is not null").distinct()
    known = written(known.withColumn("id", F.xxhash64("name", "entity_type", "identifier")), "names")
    asked = surfaces.select("surface", "entity_type").filter(f"surface is not null and not ({blank.replace('name', 'surface')}) and entity_type is not null").distinct()
    asked = written(asked.withColumn("q", F.xxhash64("surface", "entity_type")), "surfaces")
    total, n_asked = known.count(), asked.count()
    counted = written(_counted(known, "id", "name", "entity_type"), "grams")
    idf = counted.groupBy("gram").agg((F.log(F.lit(1.0 + total) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    idf = written(idf, "idf")
    unseen = F.log(F.lit(1.0 + total)) + 1.0
    shards, blocks = max(1, -(-total // shard)), max(1, -(-n_asked // block))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["name", "identifier"], na_position="first")  # equal scores go by place
        of = np.repeat(np.arange(len(f)), f["grams"].map(len))
        index = Index(f["id"].to_numpy(), of, np.concatenate([*f["grams"], np.zeros(0, dtype=np.int64)]).astype(np.int64), np.concatenate([*f["weights"], np.zeros(0)]))
        return pd.DataFrame({"shard": [f["shard"].iloc[0]], "payload": [index.dump()]})

    vectors = _vectors(counted, idf, "id", unseen).join(known.select("id", "name", F.col("identifier").cast("string")), "id").withColumn("shard", F.pmod("id", F.lit(shards)).cast("int"))
    index = written(vectors.groupBy("shard").applyInPandas(build, "shard int, payload binary"), "index")
    asks = _vectors(_counted(asked, "q", "surface", "entity_type"), idf, "q", unseen).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    asks = written(asks, "asks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(held):
            index = Index.load(held["payload"].iloc[0])
            for q, g, w in zip(some["q"], some["grams"], some["weights"], strict=True):
                out += [(q, i, s) for i, s in index.search(np.asarray(g, dtype=np.int64), np.asarray(w, dtype=float), k, least)]
        return pd.DataFrame(out, columns=["q", "id", "score"]).astype({"q": "int64", "id": "int64", "score": float})

    found = asks.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(answer, "q long, id long, score double")
    found = found.join(known.select("id", "identifier", "name"), "id")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "name", "identifier"))), 1, k)
    best = found.groupBy("q").agg(best.alias("best")).select("q", F.posexplode("best").alias("pos", "b"))
    return best.join(asked, "q").select("surface", "entity_type", "b.identifier", "b.name", (-F.col("b.minus")).alias("score"), (F.col("pos") + 1).cast("int").alias("rank"))


def rerank(mentions: DataFrame, found: DataFrame, profiles: DataFrame, weight: float = 0.3) -> DataFrame:
    """mentions (surface, entity_type, context and others) with the identifier and score of their best candidate: its cosine
    plus `weight` times the share of its profile's words that stand in the mention's context.

    profiles (identifier, description): of several rows of an identifier all words count; without any the share is 0. Words are
    runs of letters and numbers in lower case. Equal scores go to the smaller identifier. Mentions without candidates keep
    null. Each mention meets its few candidates only.
    """
    def words(text) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))

    known = profiles.groupBy("identifier").agg(words(F.concat_ws(" ", F.collect_list("description"))).alias("_words"))
    options = found.groupBy("surface", "entity_type", "identifier").agg(F.max("score").alias("_score")).join(known, "identifier", "left")
    options = options.groupBy("surface", "entity_type").agg(F.collect_list(F.struct("identifier", "_score", "_words")).alias("_options"))
    out = mentions.join(options, ["surface", "entity_type"], "left").withColumn("_own", words(F.col("context")))
    # one array a mention, folded in place: mentions aren't multiplied
    scored = F.transform("_options", lambda o: F.struct(F.round(-(o["_score"] + weight * F.coalesce(F.try_divide(F.size(F.array_intersect(F.col("_own"), o["_words"])), F.size(o["_words"])), F.lit(0.0))), DIGITS).alias("minus"), o["identifier"].alias("identifier")))
    return out.withColumn("_best", F.array_min(scored)).select(*(F.col(f"`{c}`") for c in mentions.columns), F.col("_best.identifier").alias("identifier"), (-F.col("_best.minus")).alias("score"))


def link(surfaces: DataFrame, names: DataFrame, mode: str = "full", short: int = 3, least: float = 0.5, **options) -> DataFrame:
    """(surface, entity_type, identifier, linker_status) of distinct surfaces, by their best name. Mode short links surfaces of
    at most `short` characters, none no one. Status ok or no_id."""
    todo = surfaces.select("surface", "entity_type").distinct()
    todo = todo.filter(F.length("surface") <= short) if mode == "short" else todo.limit(0) if mode == "none" else todo
    best = candidates(todo, names, 1, least, **options).select(F.col("surface").alias("_s"), F.col("entity_type").alias("_t"), "identifier")
    out = todo.join(best, F.col("surface").eqNullSafe(F.col("_s")) & F.col("entity_type").eqNullSafe(F.col("_t")), "left")
    return out.select("surface", "entity_type", "identifier", F.when(F.col("identifier").isNull(), "no_id").otherwise("ok").alias("linker_status"))
