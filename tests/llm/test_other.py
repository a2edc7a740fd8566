import gzip
import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import fingerprints, mixing, packed_ids, pattern_packing, quality, tokens, url_filter, warc
from quillspark.llm.base import table, written

from . import brute

TEXTS = ["plain words, it's 12 o'clock", "  lead\n\n trail  \t", "", "日本語 テキスト", "a<|endoftext|>b", "emoji 😀😀 \u200b \u0600", "x" * 3000, "don't we'll '' ''s  1234  $$$ ", "é" * 50]


# ---- tokens and packing ----


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.Encoder()
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choices("ab '\n\t1é.,!?s  t", k=40)) for _ in range(300)]
    texts += ["".join(r.choices(["ab", " c", "'s", "\n", " d.", "\t", "\xa0", " 12", ",", "É", " "], k=30)) for _ in range(600)]
    for x in texts:
        assert np.frombuffer(e.ids(x), dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert e.ids(None) == b""


def test_cut():
    assert tokens.cut(10, 10) == [(0, 10)] and tokens.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and tokens.cut(20, 10) == [(0, 10), (10, 10)]


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_places_every_piece(spark, rows):
    e = tokens.Encoder()
    data = list(enumerate([*TEXTS, None, *(" ".join(["word"] * k) for k in range(5, 3000, 171))]))
    got = pattern_packing.pack(rows(data), keep_ids=True).collect()
    n = check_sequences(got, 1024)
    for i, t in data:
        ids = e.ids(t) + np.array([2], dtype="<u4").tobytes()
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == ids and [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.start * 4 == ids.index(bytes(r.ids), r.start * 4) for r in mine)
        assert all(r.length == 1024 for r in mine[1:])
    total = sum(r.length for r in got)
    assert n <= len(packed_ids.best_fit_decreasing([r.length for r in got], 1024)) and n >= -(-total // 1024)
    assert pattern_packing.pack(rows([])).count() == 0
    assert pattern_packing.pack(rows([(1, "a"), (1, "a")])).count() == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_uses_each_length(lengths):
    chosen = pattern_packing.plan(dict(Counter(lengths)), 64)
    used = Counter()
    for p, n in chosen:
        assert sum(p) <= 64 and n > 0
        for x in p:
            used[x] += n
    assert used == Counter(lengths)
    bins = packed_ids.best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert sum(n for _, n in chosen) <= len(bins) + 1 + len(bins) // 10


def test_patterns_fit_a_large_histogram():
    r = random.Random(4)
    h = Counter(r.randrange(1, 1024) for _ in range(60_000))
    n = sum(k for _, k in pattern_packing.plan(dict(h)))
    assert n <= 1.002 * sum(k * v for k, v in h.items()) / 1024


def test_segment_tree_finds_the_least_room():
    r, t, have = random.Random(6), packed_ids.Capacities(50), Counter()
    for _ in range(400):
        c = r.randrange(51)
        d = 1 if not have[c] or r.random() < 0.6 else -1
        have[c] += d
        t.add(c, d)
        q = r.randrange(51)
        assert t.least(q) == min((k for k in have if have[k] and k >= q), default=None)


def test_packed_ids_round_trip(spark, rows):
    data = list(enumerate([*TEXTS, None, "long " * 2500]))
    shards = written(packed_ids.pack_ids(rows(data)), "p")
    e, got = tokens.Encoder(), packed_ids.unpack_ids(shards).collect()
    for i, t in data:
        ids = np.frombuffer(e.ids(t) + np.array([2], dtype="<u4").tobytes(), dtype="<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    for s in shards.collect():
        m, cu, resets = np.frombuffer(s.ids, dtype="<u4").reshape(s.n_rows, 1024), np.frombuffer(s.cu_seqlens, dtype="<i4"), np.frombuffer(s.position_resets, dtype="<i4")
        assert len(m) == len(s.n_segments) and len(resets) == sum(s.n_segments) == len(s.doc_ids) and len(cu) == len(resets) + s.n_rows
    assert packed_ids.pack_ids(rows([])).count() == 0


# ---- archives ----


def test_archives(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "x\ny", "日本 other" * 50), (0, "http://z", "é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    for least, refers in ((0, {2: 1, 4: 3}), (1, {2: 1})):
        folder = tmp_path / f"w{least}"
        folder.mkdir()
        assert warc.write_archives(df, f"file://{folder}", least, file_bytes=300) == 6
        got = {r.page_id: r for r in warc.read_archives(spark, f"file://{folder}").collect()}
        assert len(got) == 6
        for i, u, h in pages:
            p = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(p), warc.digest(p), "revisit" if i in refers else "response", refers.get(i))
            assert i in refers or bytes(got[i].payload) == p
    empty = tmp_path / "none"
    empty.mkdir()
    assert warc.write_archives(df.limit(0), f"file://{empty}") == 0


def parts(n=6):
    return [warc.record("response", str(i), f"http://h/{i}", f"payload {i} ".encode() * 20) for i in range(n)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_goes_on_behind_damage(zipped):
    whole = [warc.member(x) if zipped else x for x in parts()]
    bad = bytearray(whole[2])
    bad[len(bad) // 2] ^= 0x55
    data = b"junk" + whole[0] + whole[1] + bytes(bad) + whole[3] + whole[4][: len(whole[4]) - 9] + whole[5]
    found = list(warc.salvage(data))
    ids = [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    gaps = [(x.start, x.end) for x in found if isinstance(x, warc.Gap)]
    a = 4 + len(whole[0]) + len(whole[1])
    b = a + len(bad) + len(whole[3])
    assert gaps == [(0, 4), (a, a + len(bad)), (b, b + len(whole[4]) - 9)]
    assert list(warc.salvage(b"")) == [] and isinstance(next(warc.salvage(b"\x1f\x8b\x08")), warc.Gap)
    assert [type(x) for x in warc.salvage(gzip.compress(b"no record") + whole[0])] == [warc.Gap, warc.Record]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 255), st.booleans())
def test_salvage_loses_one_record_at_most(at, value, zipped):
    data = bytearray(b"".join(warc.member(x) if zipped else x for x in parts()))
    data[at % len(data)] = value
    found = list(warc.salvage(bytes(data)))
    assert sum(isinstance(x, warc.Record) for x in found) >= 5
    end = 0
    for x in found:
        if isinstance(x, warc.Gap):
            assert x.start >= end and x.end > x.start
            end = x.end


# ---- fingerprints ----


def slow_winnow(text, gram=fingerprints.GRAM, width=fingerprints.WIDTH):
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    gram = min(gram, len(points))
    h = [int(fingerprints.grams(points[i : i + gram], gram)[0]) for i in range(len(points) - gram + 1)] if len(points) else []
    width = min(width, len(h))
    at = sorted({max(range(i, i + width), key=lambda j: (-h[j], j)) for i in range(len(h) - width + 1)}) if h else []
    return [h[i] >> 32 for i in at], at


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab😀", max_size=150))
def test_winnow_against_brute_force(text):
    h, at = fingerprints.winnow(text)
    assert (h.tolist(), at.tolist()) == slow_winnow(text)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40), st.text(min_size=47, max_size=47), st.text(max_size=40), st.text(max_size=40))
def test_shared_text_shares_a_hash(a, common, b, c):
    one, two = fingerprints.winnow((a + common).replace("\ud800", "")), fingerprints.winnow(common + b + c)
    assert set(one[0].tolist()) & set(two[0].tolist())


def test_neighbours(spark, rows):
    r = random.Random(9)
    data = [(k, "".join(r.choices("abcdef gh", k=r.randrange(0, 400)))) for k in r.sample(range(-50, 10**6), 40)] + [(10**9, None), (10**9 + 1, "日本" * 30), (10**9 + 2, "日本" * 30)]
    got = {x.doc_id: x for x in fingerprints.compare_neighbours(rows(data)).collect()}
    order = sorted((i, t or "") for i, t in data)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, other = fingerprints.winnow(t)[0], fingerprints.winnow(edited)[0]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.as_text(own) and got[i].edited_fingerprint == fingerprints.as_text(other)
        assert got[i].near_edited == fingerprints.likeness(own, other) and got[i].near_next == fingerprints.likeness(own, fingerprints.winnow(after)[0])
    assert fingerprints.compare_neighbours(rows([])).count() == 0
    alone = fingerprints.compare_neighbours(rows([(5, "abcdefgh")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    twice = fingerprints.compare_neighbours(rows([(5, "x"), (5, "x"), (None, "y"), (6, "z")])).collect()
    assert len(twice) == 4
    assert fingerprints.fingerprints(rows(data)).count() == len(data)


# ---- quality ----


def test_counts_against_brute_force(spark, rows):
    r = random.Random(3)
    data = [(i, "".join(r.choices(["a", "b", "cd", " ", "  ", "\n", "\t", "#", "$", "é", "x y z w v ", "\x0b", "\u00a0"], k=r.randrange(0, 200)))) for i in range(150)] + [(900, None), (901, ""), (902, "w " * 20_000), (903, "one two three four five"), (904, "A\nA\n\n \nA")]
    got = {x.doc_id: tuple(x.q)[:2] + (x.q.n_symbols, x.q.n_dup_lines, x.q.n_repeat_words) for x in quality.with_stats(rows(data)).select("doc_id", F.col("__q").alias("q")).collect()}
    assert got == {i: brute.text_counts(t) for i, t in data}


def test_rules_learn_and_generalise():
    r = random.Random(11)

    def one():
        bad = r.random() < 0.3
        row = {f: r.random() for f in quality.FEATURES}
        if bad:
            row["symbols_per_word"], row["capitals_per_char"] = 0.5 + r.random() / 2, 0.5 + r.random() / 2
        elif r.random() < 0.5:
            row["symbols_per_word"] = r.random() / 2
        else:
            row["capitals_per_char"] = r.random() / 2
        return row, bad

    rules = quality.learn_rules([one() for _ in range(900)])
    test = [one() for _ in range(500)]
    wrong = sum(any(quality._covers(x, rule.conditions) for rule in rules) != bad for x, bad in test)
    assert rules and wrong < 25
    assert quality.learn_rules([]) == [] and quality.learn_rules([({f: 0.0 for f in quality.FEATURES}, False)] * 9) == []


def test_quality_query(spark, sf, rows):
    out = quality.op5(spark, sf)
    assert out.count() == table(spark, sf, "documents").count()
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    clean = out.join(table(spark, sf, "labels"), "doc_id").filter("quality = 1 and not base_failed")
    assert clean.filter("kept").count() >= 0.98 * clean.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.keep_good(rows([(1, "ten words " * 1), (2, " ".join(map(str, range(30)))), (3, None)]), none)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == rows([]).columns


# ---- URLs ----


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.NET/en/1?x#y", "http://example.net", "http://net/x", "http://a.example.com/de/", "http://aexample.com/de/", "https://x.org/fr/a", "https://x.org/FR/a", "no scheme", None, "", "a://b://c/d", "http://H?q/p", "http://h#f", "://Only/Path"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = [tuple(r) for r in url_filter.judge_urls(df, url_filter.UrlModel(np.zeros(8), -1.0)).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    want = [("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("net", "/x", "net/", "block"), ("a.example.com", "/de/", "example.com/de/", "block"), ("aexample.com", "/de/", None, "allow"), ("x.org", "/fr/a", "org/fr/", "allow"), ("x.org", "/FR/a", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("h", "", None, "allow"), ("h", "", None, "allow"), ("only", "/Path", None, "allow")]
    assert got == want


def test_url_model_on_held_out_urls(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    bad = ["http://mega-casino.example/slots/free-spins", "https://porn-videos.example/xxx", "http://buy-cheap-pills.example/order", "http://adserver2.example/click"]
    good = ["https://blog.cooking.example/posts/soup", "http://www.example.org/en/4711", "https://university.example/courses/history", "http://library.example/books/novels"]
    parts = spark.createDataFrame([(u,) for u in bad + good], "url string").select(*url_filter.host_and_path(F.col("url"))).collect()
    s = model.scores([p[0] for p in parts], [p[1] for p in parts])
    assert (s[:4] > 0).sum() >= 3 and (s[4:] < 0).sum() >= 3
    assert url_filter.train(url_filter.labelled_urls(spark).limit(0)).bias < 0
    rows, cells = url_filter.url_grams(["ab"], ["/C"], (3,), 1 << 20)
    assert len(rows) == len("^ab|/c$") - 2 and len(set(cells.tolist())) == 5


# ---- mixing ----


def slow_targets(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not full:
            goal |= {s: share * w[s] for s in open_}
            break
        for s in full:
            goal[s] = cap * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


@settings(max_examples=25, deadline=None)
@given(sizes=st.dictionaries(st.one_of(st.none(), st.text(alphabet="abZé", max_size=3)), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets_against_rounds(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix(spark, sf, rows):
    docs = table(spark, sf, "documents")
    plan = mixing.plan_mix(docs)
    again = {r.doc_id: r.copies for r in mixing.plan_mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.copies for r in plan.collect()} == again and max(again.values()) <= 3
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(again.values())
    by = plan.groupBy().agg(F.sum(F.col("size") * F.col("copies")).alias("a"), F.sum("size").alias("b")).first()
    assert abs(by.a - by.b) < 0.2 * by.b
    assert mixing.plan_mix(rows([])).count() == 0
    odd = mixing.plan_mix(rows([(1, None), (2, "")])).collect()
    assert all(r.size == 0 and r.copies == 0 and r.target == 0 for r in odd)


# ---- the pipeline ----


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = source = table(spark, sf, "documents")
    assert [s for s, _ in P.STAGES] == ["quality_rules", "near_duplicates", "repeated_spans", "mixing", "packing"]
    kept = []
    for name, stage in P.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), name)
        kept.append(docs)
        if name != "packing":
            assert docs.columns == source.columns and docs.dtypes == source.dtypes
        if name == "near_duplicates":
            want = {d for d, v in brute.near_dedup([(r.doc_id, r.text) for r in before.collect()], 5, 80).items() if v[2]}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "repeated_spans":
            want = brute.word_dedup([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: hashlib.sha256(" ".join(brute.words(r.text)).encode()).hexdigest() for r in docs.collect()} == {d: v[0][2] for d, v in want.items()}
            assert docs.filter("n_chars <> length(text)").count() == 0
    whole = P.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, kept[-1].select("doc_id", "piece", "length", "ids_crc32").collect()))
    check_sequences(whole.collect(), 1024)
    empty = source.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_sql_of_operators(spark, sf):
    import duckdb

    from quillspark.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, sf)
        r = c.sql(sql)
        assert sorted(r.columns) == sorted(df.columns)
        cut = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(json.dumps([cut(x[k]) for k in df.columns]) for x in df.collect()) == sorted(json.dumps([cut(dict(zip(r.columns, x, strict=True))[k]) for k in df.columns]) for x in r.fetchall())
