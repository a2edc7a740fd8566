"""Concept layer: unique surfaces, identifier injection, dictionaries and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Where an identifier came from.
FROM_TAGGER, FROM_DICTIONARY, UNLINKED = "phase1_short_linker", "phase3b_contextfree_linker", "unlinked"
# End of fixed values.


def explode_documents(docs: DataFrame) -> DataFrame:
    """Nested documents to annotation rows: the first identifier or null, ids as they are."""
    p = docs.select(F.col("id").alias("doc_id"), "pmid", F.posexplode("passages").alias("passage_idx", "p"))
    a = p.select("doc_id", "pmid", "passage_idx", F.element_at("p.infon", F.lit("section_type")).alias("passage_type"), F.explode("p.annotations").alias("a"))
    return a.select("doc_id", "pmid", "passage_idx", "passage_type", F.col("a.id").alias("ann_id"), F.col("a.text").alias("surface"), F.col("a.entity_type").alias("entity_type"), F.col("a.offset").alias("offset"), F.col("a.length").alias("length"), F.col("a.score").alias("score"), F.get("a.identifiers", F.lit(0)).alias("identifier"), F.col("a.source").alias("source"))


def document_rows(docs: DataFrame) -> DataFrame:
    """One row a document: total characters, numbers of passages and annotations, whether there is a body, sections."""
    return docs.select(
        F.col("id").alias("doc_id"), "pmid", "doi",
        F.aggregate("passages", F.lit(0).cast("long"), lambda s, p: s + F.length(p["text"])).alias("total_chars"),
        F.size("passages").alias("n_passages"),
        F.aggregate("passages", F.lit(0), lambda s, p: s + F.size(p["annotations"])).alias("n_annotations"),
        F.exists("passages", lambda p: ~F.element_at(p["infon"], F.lit("section_type")).isin("title", "abstract", "fig_caption", "table_caption")).alias("has_body"),
        F.transform("passages", lambda p: F.element_at(p["infon"], F.lit("section_type"))).alias("sections"),
    )


def with_offsets(passages: DataFrame, doc: str = "doc_id", order: str = "passage_idx", text: str = "text") -> DataFrame:
    """Passages with their document-wide code point offset: each is followed by one separator."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return passages.withColumn("offset", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("long"))


def full_text(passages: DataFrame) -> DataFrame:
    """(doc_id, full_text): passages by offset, gaps filled with spaces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "text")))
    filled = F.aggregate(parts, F.lit(""), lambda s, p: F.concat(F.rpad(s, F.greatest(p["offset"].cast("int"), F.length(s)), F.lit(" ")), p["text"]))
    return passages.groupBy("doc_id").agg(filled.alias("full_text"))


def unique_surfaces(annotations: DataFrame, drop_types=("cell_line",)) -> DataFrame:
    """Distinct (surface, entity_type) with counts and averages: the compression step before any lookup. identifier_known
    is the smallest of the known identifiers, so it doesn't depend on the order of rows."""
    a = annotations.filter(~F.col("entity_type").isin(*drop_types)) if drop_types else annotations
    return a.groupBy("surface", "entity_type").agg(
        F.count(F.lit(1)).alias("frequency"), F.count_distinct("doc_id").alias("n_docs"), F.avg("score").alias("avg_score"),
        F.avg("length").alias("avg_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.min("identifier").alias("identifier_known"), F.count_if(F.col("identifier").isNull()).alias("n_missing_id"), F.count("identifier").alias("n_with_id"),
    )


def corpus_counts(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count(F.lit(1)).alias("n_annotations"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("surface", "entity_type").alias("n_unique")).withColumn("compression_ratio", F.when(F.col("n_annotations") > 0, F.col("n_unique") / F.col("n_annotations")).otherwise(0.0))


def type_stats(surfaces: DataFrame) -> DataFrame:
    return surfaces.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("frequency").alias("n_total"), F.avg("frequency").alias("avg_frequency"), F.max("frequency").alias("max_frequency"))


def length_buckets(surfaces: DataFrame) -> DataFrame:
    return surfaces.groupBy(X.length_bucket(F.length("surface")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_unique"), F.sum("frequency").alias("n_total"))


def top_surfaces(surfaces: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent; equal ones by surface and type."""
    return surfaces.orderBy(F.desc("frequency"), "surface", "entity_type").limit(n)


def merge_dictionaries(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def inject_ids(annotations: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Annotations with the dictionary's identifier where they had none, and where it came from. The dictionary has one row
    for each (surface, entity_type); the optimizer picks the join, as the dictionary grows with the corpus."""
    d = dictionary.select("surface", "entity_type", F.col("identifier").alias("_found"))
    out = annotations.join(d, ["surface", "entity_type"], "left")
    source = F.when(F.col("identifier").isNotNull(), FROM_TAGGER).when(F.col("_found").isNotNull(), FROM_DICTIONARY).otherwise(UNLINKED)
    return out.withColumn("identifier_source", source).withColumn("identifier", F.coalesce("identifier", "_found")).select(*annotations.columns, "identifier_source")


def injection_summary(injected: DataFrame) -> DataFrame:
    return injected.groupBy("identifier_source").agg(F.count(F.lit(1)).alias("n"), F.count("identifier").alias("n_with_id"))


def id_kinds(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("entity_type", X.id_kind(F.col("identifier")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def clean_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with cleaned surfaces; offsets move by what is cut at the left, lengths shrink by both cuts."""
    c = annotations.withColumn("_c", X.clean_surface(F.col("surface")))
    return c.withColumns({"surface": F.col("_c.surface"), "offset": F.col("offset") + F.col("_c.left"), "length": F.col("length") - F.col("_c.left") - F.col("_c.right"), "clean_rule": F.col("_c.rule")}).drop("_c")


def clean_report(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("clean_rule").agg(F.count(F.lit(1)).alias("n"))


def gene_report(surfaces: DataFrame) -> DataFrame:
    """(surface, norm, identifier) rows by what the surface looks like: counts, shares and up to 15 examples."""
    g = surfaces.groupBy(X.gene_class(F.col("surface"), F.col("norm")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count("identifier").alias("n_with_id"), F.slice(F.array_sort(F.collect_set("surface")), 1, 15).alias("examples"))
    from pyspark.sql import Window

    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def compare_linkers(context: DataFrame, free: DataFrame) -> DataFrame:
    """(surface, entity_type, context_id) against the ids without context: one of five exclusive flags for each row."""
    f = free.select("surface", "entity_type", F.col("identifier").alias("free_id"))
    c, r = F.col("context_id"), F.col("free_id")
    flag = F.when(c.isNull() & r.isNull(), "both_none").when(c.isNotNull() & r.isNull(), "ctx_only").when(c.isNull(), "free_only").when(c == r, "agree").otherwise("differ")
    return context.join(f, ["surface", "entity_type"], "left").withColumn("flag", flag)


def offset_round_trip(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """How many annotations have their surface at their offset of the document's full text, and how many don't."""
    hit = F.substr("full_text", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")) == F.col("surface")
    return annotations.join(texts, "doc_id").agg(F.count_if(hit).alias("ok"), F.count_if(~hit).alias("ng"))


def overlapping(tokens: DataFrame, annotations: DataFrame) -> DataFrame:
    """Pairs of a token (t_start, t_end) and an annotation (a_start, a_end) of the same document (doc_id) whose code points
    overlap: a_start < t_end and a_end > t_start. Rows with a null bound, or without a document, overlap nothing.

    An interval join by sizes: of a pair, the longer one lies in at most two buckets of the power of two above its length,
    and the shorter one looks for it in the at most two buckets of that width that it touches itself. So intervals meet only
    where they are near by the longer one's measure, however many a document has and however long some are; a document
    spreads over as many tasks as it has buckets. Each pair is given by the bucket of its later start.
    """
    def sized(df, start, end):
        low, high = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
        df = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col("doc_id").isNotNull())
        return df.withColumns({"_low": low, "_high": high}).withColumn("_size", F.length(F.bin(F.col("_high") - F.col("_low"))))

    t, a = sized(tokens, "t_start", "t_end"), sized(annotations, "a_start", "a_end")
    # at most 64 sizes on each side
    t_sizes, a_sizes = (sorted(r["_size"] for r in df.select("_size").distinct().collect()) for df in (t, a))

    def in_buckets(df, sizes, low):
        df = df.withColumn("_at", F.explode(sizes)).select("*", F.explode(F.expr("sequence(shiftright(_low, _at), shiftright(_high, _at))")).alias("_bucket"))
        return df.drop("_size", "_high").withColumnRenamed("_low", low)

    def larger(sizes):
        return F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda x: x > F.col("_size"))

    own = F.array("_size")
    # annotations that are the longer ones, or as long, and then tokens that are
    parts = ((in_buckets(a, own, "_a"), in_buckets(t, F.concat(own, larger(a_sizes)), "_t")), (in_buckets(a, larger(t_sizes), "_a"), in_buckets(t, own, "_t")))
    out = None
    for x, y in parts:
        met = y.join(x, ["doc_id", "_at", "_bucket"]).filter("a_start < t_end and a_end > t_start and _bucket = shiftright(greatest(_a, _t), _at)").drop("_at", "_bucket", "_a", "_t")
        out = met if out is None else out.unionByName(met)
    return out


def kept_tokens(before: DataFrame, after: DataFrame, pattern: str = r"(\w+_\w+)") -> DataFrame:
    """By document, the tokens of a kind that a step lost or made: (doc_id, token, n_before, n_after) where the counts differ."""
    def count(df, name):
        return df.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias(name))

    return count(before, "n_before").join(count(after, "n_after"), ["doc_id", "token"], "full").na.fill(0, ["n_before", "n_after"]).filter("n_before <> n_after")


def long_enough(docs: DataFrame, least: int = 500, text: str = "text") -> DataFrame:
    return docs.filter(F.length(text) >= least)


def of_top_documents(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Rows of the first n distinct documents in order."""
    return rows.join(rows.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def linker_impact(compared: DataFrame, by) -> DataFrame:
    """Counts of the five flags by a bucket (a column, such as the type or a length bucket), and the share that agrees."""
    flags = ("agree", "both_none", "ctx_only", "free_only", "differ")
    out = compared.groupBy(by.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("flag") == f).alias(f) for f in flags))
    return out.withColumn("share", (F.col("agree") + F.col("both_none")) / F.col("n"))
