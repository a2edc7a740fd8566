"""Packing does not depend on how finely its input is dealt out."""

from pyspark.sql import functions as F

from quillspark.llm import packed_ids
from quillspark.llm.base import written


def test_small_partitions_are_packed_together(rows):
    docs = rows([(i, "some words of a short text " * (i % 9)) for i in range(120)] + [(200, None)])
    shards = written(packed_ids.pack_ids(docs.repartition(60)), "p")
    ids = packed_ids.unpack_ids(shards)
    n = ids.agg(F.sum("length")).first()[0]
    assert shards.agg(F.sum("n_rows")).first()[0] <= -(-n // 1024) + 1
    assert {r.doc_id for r in ids.collect()} == {*range(120), 200}
    assert packed_ids.pack_ids(docs.limit(0)).count() == 0
