"""Centroid clustering, source divergence and line dedup against plain versions, and over odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import centroids, components, divergence, line_dedup
from quillspark.llm import queries as Q
from quillspark.llm.base import table

# ---- clustering ----


def slow_lloyd(rows, k=16, rounds=3, dims=64, scale=64.0, seed=1):
    bound = (1 << 25) - 1
    kept = [(i, [max(-bound, min(bound, math.floor(max(-1e300, min(1e300, x * scale))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1]))
    c = [list(v) for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            c[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    got = [(i, *reversed(near(v))) for i, v in kept]
    spread = Counter()
    for _, j, d in got:
        spread[j] += d
    return sorted((str(i), j, d, spread[j], sum(spread.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", 5, "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance int, id string")


def clustered(df, **options):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in centroids.cluster(df, **options).collect())


def test_lloyd_against_a_plain_version(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(i % 5, 1.0) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # a group of copies
    rows += [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (2**60 + 1, rows[3][1])]  # repeated, null and large ids
    rows += [(400, None), (401, []), (402, rows[0][1][:7]), (403, [*rows[0][1], 0.0]), (404, [*rows[0][1][:7], None]), (405, [*rows[0][1][:7], float("nan")]), (406, [*rows[0][1][:7], float("-inf")])]
    rows += [(407, [1e300, -1e300, *rows[0][1][:6]]), (408, [-0.0] * 8)]
    df = vectors(spark, rows)
    want = slow_lloyd(rows, 6, 3, 8)
    assert clustered(df, k=6, components=8) == want and len(want) == 347
    assert clustered(df.repartition(7), k=6, components=8) == want
    assert centroids.cluster(df, k=6, components=8).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_lloyd_with_few_or_equal_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    assert clustered(vectors(spark, same)) == slow_lloyd(same)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(vectors(spark, few)) == slow_lloyd(few)
    one = [(i, [float(i)] * 64) for i in range(30)]
    assert clustered(vectors(spark, one), rounds=0) == slow_lloyd(one, rounds=0)
    assert clustered(vectors(spark, [(1, None)])) == [] == clustered(vectors(spark, []))
    huge = [(i, [1e30 * (-1) ** i] * 64) for i in range(200)]
    got = centroids.cluster(vectors(spark, huge), k=1).collect()
    assert len(got) == 200 and {r.inertia for r in got} == {2**63 - 1}
    with pytest.raises(ValueError):
        centroids.cluster(vectors(spark, one), k=10**6)


def test_ties_go_to_the_smaller_number():
    import numpy as np

    cluster, distance = centroids.nearest(np.array([[0, 0], [4, 0]], dtype=np.int64), np.array([[1, 0], [-1, 0], [3, 0], [5, 0]], dtype=np.int64))
    assert cluster.tolist() == [0, 2] and distance.tolist() == [1, 1]


def test_lloyd_on_the_tables(spark, sf):
    df = table(spark, sf, "embeddings")
    got = sorted((str(r.vec_id), *tuple(r)[1:]) for r in Q.QUERIES["op11_centroids"](spark, sf).collect())
    assert got == slow_lloyd([(r.vec_id, r.embedding) for r in df.collect()])


# ---- divergence ----

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow_audit(rows, least=10, top=10):
    langs = {}
    for lang, source, text in rows:
        words = TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        langs.setdefault(lang or "", []).append((source or "", Counter(words)))
    out = set()
    for lang, docs in langs.items():
        df = Counter(t for _, c in docs for t in c)
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {}
        for s, c in docs:
            counts.setdefault(s, Counter()).update({t: n for t, n in c.items() if df[t] >= least})
        whole = sum(counts.values(), Counter())

        def prices(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + (10**9 * (c[t] + 2)) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in counts.items()}, prices(whole)
        for s in counts:
            parts = {"pair": [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in counts if o != s], "term": [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[: top if part == "term" else None])}
    return out


def audited(spark, rows, **options):
    df = spark.createDataFrame([(i, t, la, s, "x", 1, "y") for i, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, value string")
    got = [tuple(r) for r in divergence.audit(df, **options).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_audit_against_a_plain_version(spark):
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("Wort", "naïve", "É", "日本", "x") for b in ("a", "bb", "ccc", "Dd", "é")]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", "d", None]), " ".join(r.choices(vocabulary, weights=range(1, 26), k=r.randrange(0, 40)))) for _ in range(300)]
    rows += [("en", "a", "hot_hot1hot " * 400)] * 60  # one group of copies holds much
    rows += [("fr", "alone", "rare words"), ("xx", "p", None), ("xx", "q", ""), ("xx", "q", "once"), ("en", "empty", None), ("en", "e2", "\x00\x01 [[]] 123")]
    want = slow_audit(rows)
    assert audited(spark, rows) == want and any(x[2] == "term" for x in want)
    assert ("xx", "p", "pair", "q", 0, 1) in want
    assert audited(spark, rows, least_docs=1, top=3) == slow_audit(rows, 1, 3)
    assert audited(spark, []) == set()


def test_audit_cuts_nothing_from_long_texts(spark, monkeypatch):
    r = random.Random(5)
    text = " ".join("".join(r.choices("abcÄ", k=r.randrange(1, 6))) for _ in range(60_000))
    rows = [("en", s, text[k:]) for k, s in enumerate("ababcabcabab")] + [("en", "a", "z" * 200_000)] * 10
    assert audited(spark, rows) == slow_audit(rows)
    whole = b"ab cde f" * 50
    assert b" ".join(divergence.pieces(whole, 7)) == whole and b"".join(divergence.pieces(b"x" * 50, 7)) == b"x" * 50


def test_counts_that_are_sent_early_are_the_same(spark):
    rows = [(s, "en", f"w{chr(97 + i % 26)} v{chr(97 + i % 7)} common") for i, s in enumerate("abc" * 60)]
    df = spark.createDataFrame([(t, la, s) for s, la, t in rows], "text string, lang string, source string").coalesce(1)
    counts = divergence.term_counts(df, held_terms=20)
    assert counts.count() > 100
    got = {(r.source, bytes(r.term)): (r.n, r.docs) for r in counts.groupBy("source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    want = {(s, b""): (0, 0) for s in "abc"}
    for s, _, t in rows:
        c = Counter(t.split())
        for w, n in c.items():
            a, b = want.get((s, w.encode()), (0, 0))
            want[s, w.encode()] = (a + n, b + 1)
    assert got == want


def test_prices_are_exact_for_large_counts(spark):
    n, size, terms = 3 * 10**13 + 7, 9 * 10**13 + 1, 12_345_678
    row = spark.createDataFrame([(n, size, terms)], "n long, size long, terms long").select(divergence.price("n", "size", "terms").alias("p"), F.expr(divergence.gap("1000000001L", "1L")).alias("g")).first()
    assert row.p == 1 + (10**9 * (n + 2)) // (size + 2 * terms) and row.g == 10**18 // (10**9 + 2)


def test_audit_on_the_tables(spark, sf):
    docs = table(spark, sf, "documents").collect()
    assert {tuple(r) for r in Q.QUERIES["op12_divergence"](spark, sf).collect()} == slow_audit([(r.lang, r.source, r.text) for r in docs])


# ---- lines ----


def slow_lines(rows, chars=20, least=3):
    def key(line):
        k = re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
        return k if len(k) >= chars else None

    def order(i):
        return (i is not None, i or 0)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < least or max(holders[key(x)], key=order) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


COMMON = ["This line is common in many documents", "\t Été à la plage, encore une fois … \r", "x" * 20, "ÀÉÎ" * 7, "short line"]


def line_rows(seed=6, n=200):
    r = random.Random(seed)
    return [(i, "\n".join(r.choice([r.choice(COMMON), r.choice(COMMON).upper(), f"  line {r.randrange(60)} of some text here", "", " ", f"own words {i} {r.random()}"]) for _ in range(r.randrange(0, 12)))) for i in range(n)]


def dropped(df, **options):
    out = line_dedup.drop_lines(df, **options)
    assert out.columns[: len(df.columns)] == df.columns
    (c,) = set(out.columns) - set(df.columns)
    return sorted((str(r.doc_id), *r) for r in out.select("doc_id", f"{c}.n_lines", f"{c}.n_dropped", F.sha2(f"{c}.kept", 256).alias("h")).collect() for r in [type("R", (tuple,), {"doc_id": r.doc_id})(tuple(r)[1:])])


def test_lines_against_a_plain_version(spark, rows):
    data = line_rows()
    data += [(None, COMMON[0]), (None, COMMON[0] + "\n" + "only of null ids, in three"), (None, "only of null ids, in three"), (None, "only of null ids, in three")]
    data += [(5, COMMON[0] + "\nsecond text of an id"), (5, COMMON[0] + "\nsecond text of an id"), (700, None), (701, ""), (702, "\n"), (703, "\n\n" + COMMON[0] + "\n"), (704, COMMON[0] + "\n" + COMMON[0] + "\nends"), (705, COMMON[0] + "\n" + COMMON[0])]
    want = slow_lines(data)
    assert sum(x[2] for x in want) > 100
    assert dropped(rows(data)) == want
    assert dropped(rows(data).repartition(9), least_chars=1, least_docs=2) == slow_lines(data, 1, 2)
    assert dropped(rows([])) == []


def test_lines_of_clashing_columns(spark):
    data = line_rows(8, 40)
    names = ["lines", "Row", "doc", "bits", "t", "kept", "pos", "h", "n"]
    df = spark.createDataFrame([(i, t, *("mine" for _ in names)) for i, t in data], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    assert dropped(df) == slow_lines(data)
    assert all(r[c] == "mine" for r in line_dedup.drop_lines(df).collect() for c in names)


def test_a_line_of_every_document_lies_in_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(components, "MOST_SENT", 2)
    data = [(i, f"{COMMON[0]}\n{COMMON[1]} {i % 900}") for i in range(4_000)]
    assert dropped(rows(data)) == slow_lines(data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = line_dedup.line_rows(rows(data), "doc_id", "text", 20)
        plan = line_dedup.repeated_keys(lines, 3)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange rangepartitioning") == 1 and physical.count("Exchange hashpartitioning") == 1


def test_a_document_of_many_lines(spark, rows):
    many = "\n".join(COMMON[k % 3] + (str(k) if k % 5 == 0 else "") for k in range(100_000))
    data = [(1, many), (2, COMMON[0]), (3, COMMON[0] + "\n" + COMMON[1] + "\n" + COMMON[2]), (4, COMMON[1]), (5, COMMON[2])]
    assert dropped(rows(data)) == slow_lines(data)


def test_bitmaps(spark):
    sets = [[0], [3], [0, 1, 2], [1, 2, 5, 9, 10], [0, 2, 4]]
    df = spark.createDataFrame([(s, "\n".join(str(i) for i in range(12))) for s in sets], "p array<int>, text string").withColumn("r", line_dedup.runs(F.col("p"))).withColumn("left", line_dedup.apply_bitmap(F.col("text"), F.col("r")))
    for r in df.collect():
        assert r.left == [str(i) for i in range(12) if i not in r.p]
        assert len(r.r) % 2 == 0 and sum(r.r) == r.p[-1] + 1 and all(x > 0 for x in r.r[1:])
    assert df.filter("p = array(1, 2, 5, 9, 10)").first().r == [1, 2, 2, 1, 3, 2]


def test_lines_on_the_tables(spark, sf):
    docs = table(spark, sf, "documents").collect()
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in Q.QUERIES["op13_line_dedup"](spark, sf).collect())
    want = slow_lines([(r.doc_id, r.text) for r in docs])
    assert got == want and sum(x[2] for x in want)


def test_line_dedup_runs_no_python(spark, sf):
    plan = Q.QUERIES["op13_line_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
