"""Stages over tables with clashing columns, repeated and null ids; even buckets; hubs; sources near their targets."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import components, fingerprints, mixing, near_dedup, pattern_packing, substring_dedup, warc
from quillspark.llm.base import table

CLASHES = ["__id", "__kept", "__gone", "_source", "_copy", "__q", "__q_t", "__q_w", "quality_counts", "size", "rate", "copies", "target", "mix", "goal", "key", "kept_id", "blank", "row", "block", "bin", "n_removed", "kept", "digest", "_salt", "length", "sequence_id"]
PASSAGE = " ".join(f"repeated{i}" for i in range(40))


def odd(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(r.choices(words, k=r.randrange(12, 120))) for _ in range(24)]
    data = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    data += [(30, PASSAGE + " " + texts[0], "s1"), (31, "x y " + PASSAGE, "s1"), (31, "other " + texts[2], "s2"), (31, "other " + texts[2], "s2"), (None, texts[3] + " tail", "s3"), (None, PASSAGE, None), (None, None, "s0"), (40, "", "s0"), (41, " \n ", "s0"), (42, "wort " * 30_000, "s2")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHES)), data


def test_every_stage_keeps_rows_and_columns(spark, sf):
    docs, data = odd(spark)
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(r[c] == f"mine {c}" for r in rows for c in CLASHES) and rows, name
        if name == "repeated_spans":
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in data)
            assert all(r.n_chars == len(r.text or "") for r in rows) and sum(r.text is None for r in rows) == 1
        elif name != "mixing":
            assert not Counter((r.doc_id, r.text) for r in rows) - given
        assert stage(spark, docs.limit(0), sf).count() == 0
    packed = corpus_pipeline.packing(spark, docs, sf)
    assert packed.select("doc_id", "piece").filter("piece = 0").count() == len(data)
    assert corpus_pipeline.packing(spark, docs.limit(0), sf).count() == 0


def test_repeats_come_back_once_a_row(spark, rows):
    got = sorted((r.doc_id, r.text) for r in substring_dedup.remove_repeats(rows([(3, PASSAGE), (3, "own words"), (4, PASSAGE + " end")])).collect())
    assert got == sorted([(3, PASSAGE), (3, "own words"), (4, "end")])


def test_an_outlier_leaves_buckets_even(spark, rows, monkeypatch):
    text = "words of a text that is long enough for a few grams "
    docs = rows([(i, text * (i % 7 + 1)) for i in range(400)] + [(10**15, text)])
    out = fingerprints.compare_neighbours(docs, bucket_bytes=10_000)
    plain = {r.doc_id: tuple(r)[1:7] for r in fingerprints.compare_neighbours(docs, bucket_bytes=1 << 30).collect()}
    assert {r.doc_id: tuple(r)[1:7] for r in out.collect()} == plain and len(plain) == 401
    monkeypatch.setattr(fingerprints, "MOST_BUCKETS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = fingerprints.compare_neighbours(docs, bucket_bytes=10_000)
        sizes = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 300


def test_hubs_are_joined_where_they_stand(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_SENT", 2)
    edges = [(0, i) for i in range(1, 6_000)] + [(10_000 + i, 10_001 + i) for i in range(30)] + [(5, 10_000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(1, 6_000), *range(10_000, 10_031)]}
    rows = spark.createDataFrame([(i % 3, i) for i in range(6_000)] + [(7, 1)], "u long, v long")
    one = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, components.join_one(rows, one, "u", 6_001).collect())) == sorted((r.u, r.v, 1 if r.u == 7 else r.u) for r in rows.collect())


def slow_near(data, words=5, num=80):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets, gone = [(i, shingles(t)) for i, t, _ in data], set()
    root = {i: i for i, _ in sets if i is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i for i in root if find(i) != i} - gone


def test_near_duplicates_of_repeated_ids(spark):
    docs, data = odd(spark)
    extra = [(5, data[7][1], "s"), (50, data[7][1] + " end", "s")]
    more = docs.unionByName(spark.createDataFrame([(i, t, s) for i, t, s in extra], "doc_id long, text string, source string").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").alias("n_chars"), *(F.lit("x").alias(c) for c in CLASHES)))
    data = data + extra
    want = slow_near(data)
    assert 7 in want and 50 in want
    assert Counter(r.doc_id for r in near_dedup.keep_first(more).collect()) == Counter(i for i, _, _ in data if i not in want)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf, scale):
    docs = table(spark, sf.replace("sf0.001", scale), "documents").select("doc_id", "text", "source")
    for some in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        plan, part = mixing.plan_mix(some), F.col("rate") - F.floor("rate")
        plan = plan.groupBy("source", "doc_id", "text").agg(F.sum("size").alias("size"), *(F.first(c).alias(c) for c in ("rate", "target", "copies")))  # equal rows are drawn alike
        by = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum(F.col("size") * F.col("size") * part * (1 - part)).alias("spread"), F.max("size").alias("largest")).collect()
        for r in by:  # a sum of independent draws; near a whole rate, one rare draw of a large text
            assert abs(r.taken - r.target) <= 3.5 * r.spread**0.5 + r.largest, r
        assert abs(sum(r.taken for r in by) - sum(r.target for r in by)) <= 3.5 * sum(r.spread for r in by) ** 0.5


def test_mix_draws_differ_between_texts_of_one_id(spark):
    docs = spark.createDataFrame([(None, f"text number {i} of a source", "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    copies = {r.source: r.n for r in mixing.plan_mix(docs, weights=(1.0, 2.0)).groupBy("source").agg(F.count_distinct("copies").alias("n")).collect()}
    assert set(copies.values()) == {2}


def test_patterns_place_most_pieces():
    r = np.random.default_rng(3)
    lengths = np.minimum(1023, r.lognormal(6.0, 0.5, 20_000).astype(int) + 1)
    histogram = Counter(lengths.tolist())
    seen = []
    rest = pattern_packing.pack_rest
    try:
        pattern_packing.pack_rest = lambda left, capacity: (seen.append(sum(left.values())), rest(left, capacity))[1]
        plan = pattern_packing.plan(histogram)
    finally:
        pattern_packing.pack_rest = rest
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += n
    assert used == histogram and min(seen) < 0.2 * len(lengths)
    assert sum(n for _, n in plan) <= 1.01 * lengths.sum() / 1024 + 1


def test_fit_is_least_squares_and_not_negative():
    rows = np.array([[6, 4, 0, 0], [5, 5, 0, 0], [4, 3, 3, 0], [7, 3, 0, 0], [3, 3, 4, 0]])
    h = np.zeros(11, dtype=int)
    h[[3, 4, 5, 6, 7]] = [20, 9, 8, 4, 6]
    x = pattern_packing.fit(rows, h, 10)
    left = h.astype(float)
    for k, row in enumerate(rows):
        for v in row[row > 0]:
            left[v] -= x[k]
    gradient = np.array([left[row[row > 0]].sum() for row in rows])
    assert (x >= 0).all() and (gradient < 0.05).all() and (abs(gradient[x > 1e-6]) < 0.05).all()


def test_the_chance_of_a_copy_is_the_fraction(spark):
    """One large document beside small ones: each is drawn as often as the rate says, whatever it weighs."""
    seeds = 1_000
    data = [(0, "w " * 1_000, "a")] + [(i, "w " * 50, "a") for i in range(1, 11)] + [(i, f"x{i} " * 30, "b") for i in range(11, 31)]
    docs = spark.createDataFrame([(s * 100 + i, t, f"{g}{s}") for s in range(seeds) for i, t, g in data], "doc_id long, text string, source string")
    # sources of one pair share their words by weight: 3 of 10 of a's words are taken when b weighs as its words do
    taken = Counter()
    rates = {}
    for r in mixing.plan_mix(docs, weights=(1.0,), cap=0.3, total=1.0).collect():
        taken[r.doc_id % 100] += r.copies
        rates[r.doc_id % 100] = r.rate
    for i, rate in rates.items():
        part = rate - int(rate)
        assert abs(taken[i] / seeds - rate) <= 3.5 * (part * (1 - part) / seeds) ** 0.5 + 1e-9, (i, rate, taken[i])
    assert abs(rates[0] - 0.3) < 1e-9


def test_texts_are_not_shuffled_to_be_mixed(spark, sf):
    plan = mixing.mix_sources(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_pages_of_one_id_are_records_of_their_own(spark, tmp_path):
    def check(rows, want):
        folder = tmp_path / str(len(rows))
        folder.mkdir()
        df = spark.createDataFrame([(i, f"http://h/{i}", p, "mine", "mine") for i, p in rows], "page_id long, url string, html string, d string, refers_to string")
        assert warc.write_archives(df.repartition(3), f"file://{folder}") == len(rows)
        got = Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{folder}").collect())
        assert got == Counter((i, warc.digest(p.encode()), "response" if f is None else "revisit", f) for i, p, f in want)

    check([(1, "A"), (2, "B"), (3, "A"), (3, "B"), (4, "A"), (4, "C")], [(1, "A", None), (2, "B", None), (3, "A", 1), (3, "B", 2), (4, "A", 1), (4, "C", None)])
    check([(5, "A"), (5, "A"), (7, "A"), (7, "A"), (None, "A"), (None, "A"), (None, "B"), (6, "")], [(5, "A", None), (5, "A", None), (7, "A", 5), (7, "A", 5), (None, "A", None), (None, "A", None), (None, "B", None), (6, "", None)])
    check([(1, "x" * 3_000_000), (2, "x" * 3_000_000), (3, "é" * 1_000_000)], [(1, "x" * 3_000_000, None), (2, "x" * 3_000_000, 1), (3, "é" * 1_000_000, None)])
