"""Existence against very many known ids: a Bloom filter ahead of the exact join, so that most absent candidates never move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.places import written

#: Bits of the filter for each known id, how many of them an id sets, and bits of a block. An id's bits lie in one block.
BITS, HASHES, BLOCK = 12, 7, 1 << 15


def _places(df: DataFrame, blocks: int) -> DataFrame:
    """df (db, id) with _block, and _bits, the places in the block that the id sets."""
    low = F.lit(BLOCK - 1)
    out = df.withColumn("_h", F.xxhash64("db", "id")).withColumn("_g", F.xxhash64("id", "db", F.lit(1)))
    start, step = F.col("_h").bitwiseAND(low), F.col("_g").bitwiseAND(low).bitwiseOR(F.lit(1))
    bits = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: (start + i * step).bitwiseAND(low).cast("int"))
    # the block is chosen by another hash than the places in it
    return out.withColumn("_block", F.pmod(F.xxhash64("_g", "_h"), F.lit(blocks)).cast("int")).withColumn("_bits", bits).drop("_h", "_g")


def build_filter(known: DataFrame) -> tuple[DataFrame, int]:
    """(filter, blocks): the bits of known (db, id) as one row a block, 4 KB each, sized from their number, and written. Rows
    with a null are left out, as they equal nothing."""
    ids = known.select("db", "id").filter("db is not null and id is not null")
    n = ids.agg(F.approx_count_distinct(F.struct("db", "id")).alias("n")).first()["n"]
    blocks = max(1, -(-n * BITS // BLOCK))
    bits = _places(ids, blocks).select("_block", F.explode("_bits").alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_set"))
    return written(bits, "filter"), blocks


def may_be_known(candidates: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """candidates (db, id, …) with `_maybe`: false for ids that are surely not known. The filter goes to all tasks where its
    size, which the optimizer sees, allows that; a larger one is joined by block."""
    met = _places(candidates, blocks).join(bits.withColumnRenamed("_block", "_of"), F.col("_block") == F.col("_of"), "left")

    def is_set(p):
        byte = F.conv(F.hex(F.substring(F.col("_set"), F.shiftright(p, 3) + 1, 1)), 16, 10).cast("int")
        return F.call_function("getbit", byte, p.bitwiseAND(F.lit(7))) == 1

    return met.withColumn("_maybe", F.coalesce(F.forall("_bits", is_set), F.lit(False))).drop("_block", "_of", "_set", "_bits")


def look_up_many(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(db, id, answer) of each distinct candidate by a table (db, id) of any size: confirmed where it is known, else absent;
    the same as an exact join, as what the filter lets through is joined exactly. Nulls are known nowhere."""
    bits, blocks = build_filter(known)
    asked = written(may_be_known(candidates.select("db", "id").distinct(), bits, blocks), "asked")
    there = known.select(F.col("db").alias("_db"), F.col("id").alias("_id")).distinct()
    # few absent ids are left here: both sides are about as large as what they share
    sure = asked.filter("_maybe").join(there, (F.col("db") == F.col("_db")) & (F.col("id") == F.col("_id")), "left")
    sure = sure.select("db", "id", F.when(F.col("_db").isNotNull(), "confirmed").otherwise("absent").alias("answer"))
    return sure.unionByName(asked.filter("not _maybe").select("db", "id", F.lit("absent").alias("answer")))
