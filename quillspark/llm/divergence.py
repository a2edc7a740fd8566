"""Source divergence audit: distances of sources by inclusion-exclusion over the terms that each of them has."""

from __future__ import annotations

import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import table, written

_SMALL = {a: b for a, b in zip(string.ascii_uppercase.encode(), string.ascii_lowercase.encode(), strict=True)}
#: UTF-8 bytes: A-Z in lower case, what stands between terms to spaces. Bytes above 0x7F belong to terms.
TO_TERMS = bytes(_SMALL.get(b, b) if b >= 0x80 or chr(b) in string.ascii_letters else 0x20 for b in range(256))
#: Terms, and bytes of unusually long ones, that a task holds before it sends its counts on.
HELD_TERMS, HELD_BYTES = 300_000, 64 << 20
BATCH = 50_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

PARTS = "lang string, source string, term binary, n long, docs long"


def pieces(text: bytes, most: int = PIECE):
    """Parts of a text whose terms are parted by spaces, cut at spaces."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(b" ", at, at + most)
        end = end if end >= 0 else text.find(b" ", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held_terms: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted within tasks, so a term comes once for each group
    and task (or part of one), however often it occurs. Each (lang, source) also has rows of the empty term and no counts."""

    def batches_of(found):
        rows = [(key, term, n, seen[term]) for key, (counts, seen) in found.items() for term, n in counts.items()]
        rows += [(key, b"", 0, 0) for key in found]
        for a in range(0, len(rows), BATCH):
            some = rows[a : a + BATCH]
            yield pa.record_batch([pa.array([r[0][0] for r in some], pa.string()), pa.array([r[0][1] for r in some], pa.string()), pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.int64()), pa.array([r[3] for r in some], pa.int64())], names=[x.split()[0] for x in PARTS.split(", ")])

    def run(batches):
        found: dict = {}
        terms = size = 0
        for b in batches:
            for key0, key1, value in zip(*(b.column(i) for i in range(3)), strict=True):
                whole, own = value.as_py().translate(TO_TERMS), Counter()
                for piece in pieces(whole):
                    own.update(piece.split())
                counts, seen = found.setdefault((key0.as_py(), key1.as_py()), (Counter(), Counter()))
                terms -= len(counts)
                counts.update(own)
                seen.update(own.keys())
                terms += len(counts)
                if len(whole) > 64 * len(own):
                    size += sum(map(len, own))
                if terms > held_terms or size > HELD_BYTES:
                    yield from batches_of(found)
                    found, terms, size = {}, 0, 0
        yield from batches_of(found)

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("text")).mapInArrow(run, PARTS)


def price(count, size, terms) -> Column:
    """1 + floor(10^9 * (count + 2) / (size + 2 * terms)), exact for any counts; null without terms."""
    whole = f"cast(nullif({size} + 2 * {terms}, 0) as decimal(20,0))"
    return F.expr(f"1 + (cast({count} + 2 as decimal(20,0)) * cast(1000000000 as decimal(10,0))) div {whole}")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) as SQL."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def priced_postings(docs: DataFrame, least_docs: int = 10, **columns) -> tuple[DataFrame, DataFrame]:
    """(groups, postings), both written. groups: lang, source, terms (kept in the lang), zero (the price of a count of 0).
    postings: lang, term, source, p, q, zero for each kept term that a source has; q is the price in the whole lang."""
    counts = written(term_counts(docs, **columns).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    lists = counts.filter(F.octet_length("term") > 0).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    lists = written(lists.filter(F.col("docs") >= least_docs).drop("docs"), "lists")
    of_lang = lists.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    of_group = lists.select("lang", F.inline("posts")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.filter(F.octet_length("term") == 0).select("lang", "source").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0)
    groups = written(groups.withColumn("zero", price("0", "size", "terms")), "groups")
    posts = lists.select("lang", "term", "total", F.inline("posts")).join(groups, ["lang", "source"])
    posts = posts.select("lang", "term", "source", price("n", "size", "terms").alias("p"), price("total", "lang_size", "terms").alias("q"), "zero")
    return groups.select("lang", "source", "terms", "zero"), written(posts, "postings")


def pair_values(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a lang, both ways: the sum of their gaps over all kept terms.

    A term that neither has adds a constant, so all kept terms are taken to be such terms first. What a source's own terms
    change against another's price of 0 depends on their price alone: a histogram of prices, one row for each price and
    other source, adds these up for both sides. Only terms that both have need the postings of both: their join adds what
    the two one-sided sums got wrong.
    """
    g, h = (groups.select("lang", F.col("source").alias(s), "terms", F.col("zero").alias(z)) for s, z in (("source", "zero"), ("item", "other")))
    pairs = g.join(h.drop("terms"), "lang").filter("source <> item")
    both_zero = pairs.select("lang", "source", "item", F.expr(f"coalesce(terms * {gap('zero', 'other')}, 0)").alias("value"))
    prices = posts.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    one_sided = prices.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"k * ({gap('p', 'other')} - {gap('zero', 'other')})")).alias("value"))
    x = posts.select("lang", "term", "source", "p", "zero")
    y = posts.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("zero").alias("other"))
    wrong = F.expr(f"{gap('p', 'r')} - {gap('p', 'other')} - {gap('zero', 'r')} + {gap('zero', 'other')}")
    common = x.join(y, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(wrong).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b")))).alias("w")
    rest = one_sided.unionByName(common).select("lang", ways, "value").select("lang", F.col("w.a").alias("source"), F.col("w.b").alias("item"), "value")
    return both_zero.unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source). Part `pair`: each other source of the lang and how far
    it is; part `term`: the `top` terms that the source has more of than its lang, by how much.

    Terms are runs of letters A-Z (in lower case) and of all code points above 0x7F; a lang keeps those that `least_docs` of
    its rows have. Null text, lang and source are empty strings, and empty is a lang or source like others; rows without an
    id, repeated ones and ones with the same id each count as a document. A lang with one source has no pairs; without kept
    terms its pairs have the value 0. No rows give none. Texts are read once, in pieces, whatever their length. Names of
    columns: text, lang, source; other columns are ignored.
    """
    groups, posts = priced_postings(docs, least_docs, **columns)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, posts).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = posts.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    return pairs.unionByName(terms)


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
