"""Comparisons with external annotations and catalogs."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.places import written

# Greek letters by name.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "ω": "omega"}
# End of fixed values.
_DASHES = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")


def _normal(s: str | None) -> str | None:
    if s is None:
        return None
    s = unicodedata.normalize("NFKC", s).lower().translate(_DASHES)
    for a, b in GREEK.items():
        s = s.replace(a, b)
    return " ".join(s.strip(" .,;:()[]{}\"'").split())


def normal_surface(surface):
    """NFKC, lower case, Greek letters by name, one kind of dash, no punctuation at the ends, single spaces. NFKC isn't built in."""

    @F.pandas_udf("string")
    def normal(surfaces: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in surfaces:
            yield batch.map(_normal)

    return normal(surface)


def first_id(column):
    """The first of several ids, without a prefix."""
    return F.regexp_replace(F.trim(F.regexp_extract(column, r"^([^,;|]*)", 1)), r"^[^:]*:", "")


#: Surfaces of a document and type that are compared where they are gathered.
SMALL = 32


def match_surfaces(ours: DataFrame, theirs: DataFrame, shortest: int = 3) -> DataFrame:
    """One-to-one matches (doc_id, entity_type, ours, theirs, kind) of surfaces of a document and type.

    Equal ones are exact. Of what is left, pairs where one contains the other (at least `shortest` characters) are taken
    greedily, in the order of our and then their surface, so the result doesn't depend on the order of rows. Null surfaces
    match nothing.

    Most documents have few surfaces of a type; those that one side only has, at most SMALL in all, are compared where they are
    gathered, by document and type, with one move. In larger groups a surface is joined by n-grams, as it can only stand in
    those that have all of its own: by that one which the fewest surfaces of the other side have, and not at all if none has
    it; so work follows the pairs that exist, not the square of a document's surfaces. Only these pairs are gathered.
    """
    keys = ["doc_id", "entity_type"]
    sides = [df.select(*keys, F.col("surface").alias("s"), F.lit(k).alias("side")) for k, df in enumerate((ours, theirs))]
    both = sides[0].unionByName(sides[1]).filter("s is not null").groupBy(*keys, "s").agg(F.min("side").alias("side"), F.max("side").alias("other"))
    both = written(both, "surfaces")
    exact = both.filter("side <> other").select(*keys, F.col("s").alias("ours"), F.col("s").alias("theirs"), F.lit("exact").alias("kind"))

    n = max(1, min(3, shortest))
    left = both.filter("side = other").filter(F.length("s") >= n).select(F.struct(*keys).alias("group"), "s", "side")
    large = written(left.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select("group"), "large")

    mine, others = (F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("s")))).alias(x) for k, x in ((0, "mine"), (1, "others")))
    small = left.join(large, "group", "left_anti").groupBy("group").agg(mine, others).filter((F.size("mine") > 0) & (F.size("others") > 0))

    def inside(x, y):
        return (F.length(y) >= shortest) & F.contains(x, y)

    met = F.flatten(F.transform("mine", lambda x: F.transform(F.filter("others", lambda y: inside(x, y) | inside(y, x)), lambda y: F.struct(x.alias("ours"), y.alias("theirs")))))
    # in order within a group, and a group's rows one after the other
    few = small.select("group", F.explode(met).alias("pair")).select("group.*", "pair.*")

    left = left.join(large, "group", "left_semi")
    grams = left.select("group", "side", "s", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - (n - 1)), lambda i: F.substr("s", i, F.lit(n))))).alias("gram"))
    grams = written(grams, "grams")
    numbers = grams.groupBy("group", "side", "gram").agg(F.count(F.lit(1)).alias("n")).select("group", (1 - F.col("side")).alias("side"), "gram", "n")
    asked = grams.filter(F.length("s") >= shortest).join(numbers, ["group", "side", "gram"], "left").groupBy("group", "side", "s").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("absent")).filter("absent = 0")
    asked = asked.select("group", (1 - F.col("side")).alias("side"), "gram", F.col("s").alias("short"))
    pairs = grams.join(asked, ["group", "side", "gram"]).filter(F.contains("s", "short"))
    # side is that of the longer surface
    pairs = pairs.select("group.*", F.when(F.col("side") == 0, F.col("s")).otherwise(F.col("short")).alias("ours"), F.when(F.col("side") == 0, F.col("short")).otherwise(F.col("s")).alias("theirs"))

    def choose(batches):
        group, mine, taken = None, set(), set()
        for b in batches:
            keep = []
            for k, (doc, kind, x, y) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if (doc, kind) != group:
                    group, mine, taken = (doc, kind), set(), set()
                if x not in mine and y not in taken:
                    mine.add(x)
                    taken.add(y)
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64()))

    # a stream of sorted pairs, as a call for each of very many small groups would cost more than their pairs
    pairs = pairs.repartition(*keys).sortWithinPartitions(*keys, "ours", "theirs")
    partial = [p.mapInArrow(choose, pairs.schema).withColumn("kind", F.lit("partial")) for p in (few, pairs)]
    return exact.unionByName(partial[0]).unionByName(partial[1])


def match_scores(ours: DataFrame, theirs: DataFrame, matches: DataFrame) -> DataFrame:
    """Recall and precision of the matches by type, and over all (entity_type null)."""
    def count(df, name):
        return df.rollup("entity_type").agg(F.count(F.lit(1)).alias(name)).withColumn("_t", F.coalesce("entity_type", F.lit("*"))).drop("entity_type")

    o, t = (x.select("doc_id", "entity_type", "surface").distinct() for x in (ours, theirs))
    out = count(t, "n_theirs").join(count(o, "n_ours"), "_t", "full").join(count(matches, "n_matched"), "_t", "left").na.fill(0)
    return out.select(F.nullif(F.col("_t"), F.lit("*")).alias("entity_type"), "n_ours", "n_theirs", "n_matched", F.coalesce(F.try_divide("n_matched", "n_theirs"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("n_matched", "n_ours"), F.lit(0.0)).alias("precision"))


def id_agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Of surfaces and types that both sides have an id for: how many agree on the first id, by type."""
    a = ours.filter("identifier is not null").select("doc_id", "surface", "entity_type", first_id(F.col("identifier")).alias("_a")).distinct()
    b = theirs.filter("identifier is not null").select("doc_id", "surface", "entity_type", first_id(F.col("identifier")).alias("_b")).distinct()
    return a.join(b, ["doc_id", "surface", "entity_type"]).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("n_agree"))


def strict_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """By document: sizes of both sets of (surface, type), in lower case and trimmed, and of what they share."""
    key = F.lower(F.trim(F.col("surface"))).alias("s")
    # both sides in one aggregation, without a join of the two: a task holds one table of what it was dealt, and sorts nothing
    a, b = (x.select("doc_id", key, "entity_type", F.lit(n == "a").alias("_a"), F.lit(n == "b").alias("_b")) for x, n in ((ours, "a"), (theirs, "b")))
    met = a.unionByName(b).groupBy("doc_id", "s", "entity_type").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    # nulls equal nothing
    return met.groupBy("doc_id").agg(F.count_if("_a").alias("n_ours"), F.count_if("_b").alias("n_theirs"), F.count_if(F.expr("_a and _b and doc_id is not null and s is not null and entity_type is not null")).alias("n_both"))


def align_catalogs(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Datasets (dataset, tokens) and external databases (db, token, name): side overlap, ours_only or theirs_only. An external
    database meets by its mapped token, else by its name."""
    o = ours.select("dataset", F.explode("tokens").alias("token")).distinct()
    t = theirs.select("db", X.db_key(F.coalesce("token", "name")).alias("token")).distinct()
    hit = o.join(t, "token").select("dataset", "db").distinct()
    a = ours.select(F.col("dataset").alias("name")).distinct().join(hit.select(F.col("dataset").alias("name"), F.lit(True).alias("_h")).distinct(), "name", "left").select("name", F.lit("ours").alias("side"), F.coalesce("_h", F.lit(False)).alias("overlap"))
    b = theirs.select(F.col("db").alias("name")).distinct().join(hit.select(F.col("db").alias("name"), F.lit(True).alias("_h")).distinct(), "name", "left").select("name", F.lit("theirs").alias("side"), F.coalesce("_h", F.lit(False)).alias("overlap"))
    return a.unionByName(b)


def _letters(column):
    """The characters of a string as a set: each with its number among equal ones, so that common letters count as often as
    both sides have them."""
    chars = F.split(column, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def nearest_label(names: DataFrame, labels: DataFrame, least: float = 0.6) -> DataFrame:
    """Each distinct name (name) with `nearest`, the most alike label (label), and `ratio`, twice the length of matching blocks by
    both lengths, of at least `least`; of equally alike ones the last in order; null if there is none. Null and empty names
    and labels are like nothing.

    A similarity join without comparing all pairs: matching blocks hold no more characters than both strings share, so a
    pair must share least / 2 of both lengths. Then its lengths are alike, and of each string's characters, the rarest first,
    one among the first few must be common. What meets there and shares enough is compared exactly.
    """
    n = names.select("name").distinct()
    sides = [df.select(F.col(c).cast("string").alias("s")).filter("s <> ''").distinct().withColumn("letters", _letters(F.col("s"))) for c, df in (("name", names), ("label", labels))]
    rows = written(sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1))), "letters")
    tokens = rows.select("side", "s", F.explode("letters").alias("token"))
    numbers = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    share = least / (2.0 - least)  # of its own characters, at least, for any length of the other
    ordered = F.array_sort(F.collect_list(F.struct("n", "token")))
    size = F.size("order")
    first = tokens.join(numbers, "token").groupBy("side", "s").agg(ordered.alias("order")).withColumn("first", F.slice("order", F.lit(1), size - F.ceil(size * share - 1e-9).cast("int") + 1))
    first = written(first.select("side", "s", F.col("first.token").alias("first"), F.col("order.token").alias("all")), "prefixes")
    a, b = (first.filter(F.col("side") == k).select(F.col("s").alias(x), F.col("first").alias(f"f{k}"), F.col("all").alias(f"l{k}"), F.explode("first").alias("token")) for k, x in ((0, "name"), (1, "label")))
    met = a.join(b, "token").filter(F.array_max(F.array_intersect("f0", "f1")) == F.col("token"))  # a pair at one of its tokens
    enough = 2 * F.size(F.array_intersect("l0", "l1")) >= least * (F.size("l0") + F.size("l1")) - 1e-9
    met = met.filter(enough).select("name", "label")

    @F.pandas_udf("double")
    def ratio(name: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(name, label, strict=True)], dtype=float)

    best = met.withColumn("ratio", ratio("name", "label")).filter(F.col("ratio") >= least).groupBy("name").agg(F.max(F.struct("ratio", "label")).alias("best"))
    return n.join(best.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left").select("name", F.col("best.label").alias("nearest"), F.col("best.ratio").alias("ratio"))


def class_matrix(sides: DataFrame) -> DataFrame:
    """(class, bucket) rows as counts of source_only, overlap and target_only by class."""
    return sides.groupBy("class").pivot("bucket", ["source_only", "overlap", "target_only"]).count().na.fill(0)


def dataset_class(dataset, classes: dict[str, str], overrides: dict[str, str], default: str = "other"):
    """A dataset's coarse class: an override's, else its class's, else the default; and whether it was overridden."""
    def lookup(m):
        return F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), dataset) if m else F.lit(None).cast("string")

    return F.struct(F.coalesce(lookup(overrides), lookup(classes), F.lit(default)).alias("class"), lookup(overrides).isNotNull().alias("overridden"))


def first_group(title, groups: dict[str, list[str]], default: str = "other"):
    """The first group one of whose keywords a title contains."""
    out = None
    for name, words in groups.items():
        for w in words:
            test = F.contains(F.lower(title), F.lit(w))
            out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def crosswalk(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (pmid) with the doi of the last pair (pmid, doi, position) of their pmid; others go."""
    last = pairs.groupBy("pmid").agg(F.max_by("doi", "position").alias("doi"))
    return rows.join(last, "pmid")


def raw_surfaces(normal: DataFrame, raw: DataFrame) -> DataFrame:
    """normal (doc_id, norm) with the surface as written, of the last row (doc_id, norm, surface, position) that has it."""
    return normal.join(raw.groupBy("doc_id", "norm").agg(F.max_by("surface", "position").alias("surface")), ["doc_id", "norm"], "left")
