"""Line dedup by built-in functions: hashes of lines in ranges with a secondary sort, and run-length keep bitmaps of documents."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import fresh, table, written
from .components import join_one

#: What is stripped from a line's ends; lines hold no newline.
ENDS = "\x20\x09\x0b\x0c\x0d"


def lowered(text: Column) -> Column:
    """A-Z in lower case. Where each character is one byte, that is what lower() does, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_rows(docs: DataFrame, id_column: str, text: str, least_chars: int) -> DataFrame:
    """(doc, row, pos, h): each line whose key has at least so many code points. row tells texts of the same id apart, pos
    counts from 0, h is the key's 128-bit hash."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_column).alias("doc"), F.xxhash64(t).alias("row"), F.posexplode(F.split(lowered(t), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(ENDS))
    return lines.withColumn("line", key).filter(F.length("line") >= least_chars).select("doc", "row", "pos", F.unhex(F.md5("line")).alias("h"))


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h, keeper, n_docs, n): hashes in at least so many documents, the largest document, and their numbers of documents and lines.

    Lines lie in ranges of (h, doc), sorted by place within: a hash that many documents share spreads over several ranges.
    The stream of a range gives the first line of each document with a hash; a range then sends one row a hash, so what
    meets in one task are ranges, not lines.
    """
    ranged = lines.repartitionByRange(F.col("h"), F.col("doc").desc()).sortWithinPartitions(F.col("h"), F.col("doc").desc(), "pos")
    run = Window.partitionBy("h", "doc").orderBy("pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ranged.select("h", "doc", F.row_number().over(run).alias("_k"), F.count(F.lit(1)).over(whole).alias("_n")).filter("_k = 1")
    return firsts.groupBy("h").agg(F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("n_docs"), F.sum("_n").alias("n")).filter(F.col("n_docs") >= least_docs)


def runs(places: Column) -> Column:
    """Sorted distinct places to run lengths: how many stay, how many go, how many stay, … up to the last one that goes."""
    last = F.transform(F.sequence(F.lit(1), F.size(places)), lambda i: F.get(places, i - 2))
    pairs = F.arrays_zip(places.alias("p"), last.alias("b"))
    opens = F.filter(pairs, lambda z: z["b"].isNull() | (z["p"] > z["b"] + 1))
    closes = F.array_append(F.transform(F.slice(opens, 2, F.size(opens)), lambda z: z["b"]), F.element_at(places, -1))
    return F.flatten(F.transform(F.arrays_zip(opens.alias("o"), closes.alias("c")), lambda z: F.array(z["o"]["p"] - F.coalesce(z["o"]["b"] + 1, F.lit(0)), z["c"] - z["o"]["p"] + 1)))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, keep_runs): for each text that loses lines, its bitmap of lines as run lengths (staying, going, staying, …;
    all behind the last run stay). row is the text's 64-bit hash, so that texts of the same id have their own bitmaps.

    A line's key is the line without white space at its ends, in lower case (A-Z only). Lines whose key has at least
    `least_chars` code points and is found in at least `least_docs` documents go, but for those of the largest id that
    holds it. Rows with the same id are one document there, null ids one document too, smaller than all others. Null and
    empty texts are one empty line. Texts are read once; from there on only hashes and places move.
    """
    lines = written(line_rows(docs, id_column, text, least_chars), "lines")
    total = lines.count()  # of the written table
    repeated = written(repeated_keys(lines, least_docs), "keys")
    # a key of very many lines goes to where these are; that is a bounded number of keys by their size
    gone = join_one(lines, repeated.select("h", "keeper", "n"), "h", total).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    places = gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    return places.select("doc", "row", runs(F.col("places")).alias("keep_runs"))


def apply_bitmap(text: Column, keep_runs: Column) -> Column:
    """The lines that stay, as an array."""
    lines = F.split(text, "\n")
    told = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    mask = F.concat(told, F.array_repeat(F.lit(True), F.size(lines) - F.size(told)))
    return F.transform(F.filter(F.arrays_zip(lines.alias("line"), mask.alias("stays")), lambda z: z["stays"]), lambda z: z["line"])


def drop_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a last column `lines` (or `lines_`, …: a name that docs doesn't have), the struct of n_lines, n_dropped and
    kept, the text that is left. The rules are those of keep_bitmaps; the bitmaps are joined to the texts by id and hash,
    always by a shuffle of both, as there can be a bitmap for every text."""
    out, doc, row, bits, t, kept = fresh(docs, "lines", "doc", "row", "bits", "t", "kept")
    marks = written(keep_bitmaps(docs, least_chars, least_docs, id_column, text), "bitmaps").select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("keep_runs").alias(bits)).hint("shuffle_hash")
    own = docs.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    met = own.join(marks, F.col(id_column).eqNullSafe(F.col(doc)) & (F.xxhash64(t) == F.col(row)), "left")
    n_gone = F.aggregate(bits, F.lit(0), lambda s, x: s + x) - F.aggregate(F.filter(bits, lambda x, i: i % 2 == 0), F.lit(0), lambda s, x: s + x)
    left = F.when(F.col(bits).isNull(), F.col(t)).otherwise(F.array_join(apply_bitmap(F.col(t), F.col(bits)), "\n"))
    parts = F.struct((F.length(t) - F.length(F.replace(F.col(t), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.coalesce(n_gone, F.lit(0)).cast("long").alias("n_dropped"), left.alias("kept"))
    return met.withColumn(kept, parts).select(*(F.col(f"`{c}`") for c in docs.columns), F.col(kept).alias(out))


def op13(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256"))
