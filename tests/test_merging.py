"""Sketches that merge, the filter of known ids and draws, held to exact versions."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluate, known, sketches


def usage(spark, n, shards=4):
    return spark.range(n).selectExpr(f"CAST(id % {shards} AS INT) AS shard_id", "CASE id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS dataset", "'x' AS class", "IF(id % 97 = 0, NULL, concat('D', id DIV 3)) AS doc_id", "concat('E', id % 1000) AS id")


def exact(df, *by):
    return {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in df.groupBy(*by).agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.count_distinct(F.concat_ws("\0", "dataset", "id"))).collect()}


@pytest.mark.parametrize("n", [300, 20_000, 400_000])
def test_sketches(spark, n, tmp_path):
    base = usage(spark, n)
    s = sketches.shard_sketches(base, size=12)
    for by in (("dataset",), ("class",), ()):
        want = exact(base, *by)
        for r in sketches.usage_counts(s, *by, size=12).collect():
            mentions, docs, entries = want[tuple(r)[: len(by)]]
            assert r.n_mentions == mentions
            if r.exact:
                assert (r.n_docs, r.n_entries) == (docs, entries)
            assert abs(r.n_docs - docs) <= 5 * docs / 2**6 and abs(r.n_entries - entries) <= 5 * entries / 2**6
            assert r.exact == (max(r.n_docs, r.n_entries) < 2**12)
    again = sketches.merged(sketches.merged(s, "class", "dataset", size=12), "dataset", size=12)
    assert {r.dataset: r.n for r in again.select("dataset", sketches._number(F.col("docs")).alias("n")).collect()} == {r.dataset: r.n_docs for r in sketches.usage_counts(s, "dataset", size=12).collect()}


def test_new_shards_need_no_rescan(spark, tmp_path):
    base, folder = usage(spark, 3_000), f"file://{tmp_path}/sketches"
    first = sketches.add_shards(spark, base.filter("shard_id < 3"), folder)
    assert {r.shard for r in first.select("shard").distinct().collect()} == {"0", "1", "2"}
    # rows of old shards aren't counted again, even where they changed
    changed = base.withColumn("doc_id", F.when(F.col("shard_id") < 3, F.concat(F.lit("other"), F.col("doc_id"))).otherwise(F.col("doc_id")))
    for _ in range(2):
        got = {r.dataset: (r.n_mentions, r.n_docs, r.n_entries) for r in sketches.usage_counts(sketches.add_shards(spark, changed, folder), "dataset").collect()}
        assert got == {k[0]: v for k, v in exact(base, "dataset").items()}


def test_documents_of_two_datasets(spark):
    base = usage(spark, 5_000).filter("dataset is not null")
    of = {}
    for r in base.select("dataset", "doc_id").distinct().collect():
        if r.doc_id:
            of.setdefault(r.dataset, set()).add(r.doc_id)
    got = {(r.dataset, r.other): (r.n_both, r.n_either, r.n_only) for r in sketches.shared_documents(sketches.shard_sketches(base)).collect()}
    assert got == {(x, y): (len(of[x] & of[y]), len(of[x] | of[y]), len(of[x] - of[y])) for x in of for y in of if x < y}


def test_known_ids(spark):
    there = spark.range(60_000).selectExpr("concat('d', id % 3) AS db", "concat('A', id) AS id").unionByName(spark.createDataFrame([("d0", None), (None, "A0"), ("d0", "A0"), ("é", "日本")], "db string, id string"))
    asked = spark.range(120_000).selectExpr("concat('d', id % 3) AS db", "concat('A', id) AS id", "1 AS _block").unionByName(spark.createDataFrame([("d0", None, 1), (None, "A0", 1), ("d1", "A0", 1), ("é", "日本", 1), ("d0", "A0", 2)], "db string, id string, _block int"))
    got = {(r.db, r.id): r.answer for r in known.look_up_many(asked, there).collect()}
    assert len(got) == 120_004
    assert all(a == ("confirmed" if (d, i) == ("é", "日本") or (i and d and i.startswith("A") and int(i[1:]) < 60_000 and d == f"d{int(i[1:]) % 3}") else "absent") for (d, i), a in got.items())
    bits, blocks = known.build_filter(there)
    maybe = known.may_be_known(asked.select("db", "id").distinct(), bits, blocks)
    through = maybe.filter("_maybe").count()
    assert 60_001 <= through <= 60_001 + 0.02 * 60_000, through
    empty = there.limit(0)
    assert {r.answer for r in known.look_up_many(asked, empty).collect()} == {"absent"} and known.look_up_many(asked.limit(0), there).count() == 0


def test_draws_take_the_smallest_tickets(spark):
    r = random.Random(3)
    rows = [(f"k{i}" if i % 50 else None, r.choice(["big", "big", "big", "small", None]), "mine") for i in range(3_000)]
    df = spark.createDataFrame(rows, "key string, stratum string, _k string")
    sizes = Counter(x[1] for x in rows)
    plan = spark.createDataFrame([("big", 40), ("small", 10_000), (None, 3), ("none", 5)], "stratum string, n_draw long")
    got = Counter(x.stratum for x in evaluate.draw(df, plan, "key").collect())
    assert got == {"big": 40, "small": sizes["small"], None: 3}

    def ticket(key):
        return hashlib.md5(f"{key or ''}:42".encode()).hexdigest()

    want = sorted(ticket(k) for k, s, _ in rows if s == "big")[:40]
    assert sorted(ticket(x.key) for x in evaluate.draw(df, plan, "key").filter("stratum = 'big'").collect()) == want
    assert evaluate.draw(df, plan.limit(0), "key").count() == 0
