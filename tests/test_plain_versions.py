"""Queries that SQL can't express, held to plain versions over the whole of their tables."""

import difflib
import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from quillspark.operators import compare, concept, evaluate, windows
from quillspark.plans import catalog
from quillspark.plans.inputs import rows


@pytest.fixture(scope="module")
def result(spark, sf):
    return lambda name: entry.queries()[name](spark, sf).collect()


def test_surface_match(spark, sf, result):
    ours, theirs = defaultdict(set), defaultdict(set)
    for side, sql in ((ours, catalog.SOME_SURFACES.format(30, "<= 3")), (theirs, catalog.SOME_SURFACES.format(7, ">= 2"))):
        for doc, surface, kind in rows(spark, sf, sql).select("doc_id", "surface", "entity_type").collect():
            side[doc, kind].add(surface)
    want = set()
    for key, mine in ours.items():
        equal = mine & theirs[key]
        want |= {(*key, s, s, "exact") for s in equal}
        free = sorted(theirs[key] - equal)
        for s in sorted(mine - equal):
            hit = next((t for t in free if s in t or t in s), None)
            if hit:
                free.remove(hit)
                want.add((*key, s, hit, "partial"))
    got = [tuple(r[c] for c in ("doc_id", "entity_type", "ours", "theirs", "kind")) for r in result("surface_match")]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[4] for r in got} == {"exact", "partial"}


def alike(names, labels, least=0.6):
    out = {}
    for n in set(names):
        scored = [(difflib.SequenceMatcher(None, x, n).ratio(), x) for x in set(labels) if x and n]
        best = max((s for s in scored if s[0] >= least), default=(None, None))
        out[n] = best[::-1]
    return out


def test_nearest_label(spark, sf, result):
    names = [r[0] for r in rows(spark, sf, "SELECT p_name FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation").collect()]
    labels = [r[0] for r in rows(spark, sf, "SELECT DISTINCT concat(p_name, CASE p_size % 5 WHEN 0 THEN ' s' WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE p_brand END) FROM part").collect()]
    got = {r["name"]: (r["nearest"], r["ratio"]) for r in result("nearest_label")}
    want = alike(names, labels)
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {v[0] for v in want.values()} - {None} and None in {v[0] for v in want.values()}


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 1.0])
def test_nearest_labels_of_random_names(spark, least):
    r = random.Random(8)
    names = ["".join(r.choices("abcé d", k=r.randrange(0, 14))) for _ in range(150)] + [None, "", "x" * 300, "same", "ab" * 110]
    labels = ["".join(r.choices("abcé d", k=r.randrange(1, 14))) for _ in range(120)] + [None, "", "same", "Same", "x" * 290 + "y", "ba" * 110]
    out = compare.nearest_label(spark.createDataFrame([(n, 1) for n in names], "name string, ratio int"), spark.createDataFrame([(x, 2) for x in labels], "label string, name int"), least)
    got = {x["name"]: x["nearest"] for x in out.collect()}
    want = alike([n for n in names if n is not None], [x for x in labels if x], least)
    assert got == {k: v[0] for k, v in want.items()} | {None: None}
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical


def greedy(ours, theirs, shortest=3):
    equal = ours & theirs
    out, free = {(s, s, "exact") for s in equal}, sorted(theirs - equal)
    for s in sorted(ours - equal):
        hit = next((t for t in free if min(len(s), len(t)) >= shortest and (s in t or t in s)), None)
        if hit is not None:
            free.remove(hit)
            out.add((s, hit, "partial"))
    return out


@pytest.mark.parametrize("shortest", [1, 2, 3, 5])
def test_surfaces_of_random_documents(spark, shortest):
    r = random.Random(9)
    sides = [[(d, k, "".join(r.choices("abé ", k=r.randrange(0, 9)))) for _ in range(500) for d in [r.choice([1, 2, None])] for k in [r.choice(["g", None])]] + [(1, "g", None), (3, "g", "alone"), (4, "g", "abab"), (4, "g", "abab")] for _ in range(2)]
    got = compare.match_surfaces(*(spark.createDataFrame(x, "doc_id int, entity_type string, surface string") for x in sides), shortest=shortest).collect()
    want = set()
    for key in {x[:2] for side in sides for x in side}:
        a, b = ({x[2] for x in side if x[:2] == key and x[2] is not None} for side in sides)
        want |= {(*key, *m) for m in greedy(a, b, shortest)}
    plain = {tuple(x) for x in got}
    assert len(got) == len(plain)
    assert {x for x in plain if None not in x[:2]} == {x for x in want if None not in x[:2]}


def test_twenty_thousand_surfaces_of_one_document(spark):
    names = [f"protein {i * 7919 % 99_991} kinase" for i in range(20_000)]
    ours = spark.createDataFrame([(1, "g", x) for x in names], "doc_id int, entity_type string, surface string")
    theirs = spark.createDataFrame([(1, "g", x[3:-3]) for x in names], "doc_id int, entity_type string, surface string")
    out = compare.match_surfaces(ours, theirs)
    assert out.count() >= 19_000


@pytest.mark.parametrize("kind", ["short", "mixed", "odd"])
def test_intervals(spark, kind):
    r = random.Random(10)

    def spans(n):
        for _ in range(n):
            a = r.randrange(-50, 2_000)
            size = r.choice([1, 2, 3, 9]) if kind == "short" else r.choice([0, 1, 3, 8, 40, 1_000]) if kind == "mixed" else r.randrange(-20, 60)
            yield r.choice([1, 2, None]), a, a + size

    t, a = [*spans(400), (1, None, 3), (1, 0, 1)], [*spans(300), (1, 5, None), (1, 0, 1)]
    out = concept.overlapping(spark.createDataFrame([(*x, "m") for x in t], "doc_id int, t_start long, t_end long, _note string"), spark.createDataFrame(a, "doc_id int, a_start int, a_end int"))
    assert out.columns == ["doc_id", "t_start", "t_end", "_note", "a_start", "a_end"]
    got = sorted((x.doc_id, x.t_start, x.t_end, x.a_start, x.a_end) for x in out.collect())
    want = sorted((d, s, e, b, f) for d, s, e in t for c, b, f in a if d is not None and d == c and None not in (s, e, b, f) and b < e and f > s)
    assert got == want and len(want) > 50


def test_a_document_of_very_many_spans(spark):
    n = 200_000
    t = spark.range(n).selectExpr("1 AS doc_id", "id * 6 AS t_start", "id * 6 + 5 AS t_end")
    a = spark.range(n).selectExpr("1 AS doc_id", "id * 6 + 2 AS a_start", "id * 6 + IF(id % 50000 = 0, 60000, 7) AS a_end")
    out = concept.overlapping(t, a)
    want = 2 * (n - 4) - 1 + 4 * 10_000 + 0  # each short one meets its own token and the next; the four long ones 10,000 each
    assert abs(out.count() - want) <= 4


def test_overlap_resolve(spark, sf, result):
    hits = defaultdict(list)
    for k in rows(spark, sf, "SELECT l_orderkey, l_partkey % 100 AS at, CAST(l_quantity AS INT) AS n, l_returnflag <> 'A' AS low, l_suppkey * 10 + l_linenumber AS no FROM lineitem").collect():
        hits[k[0]].append((k[1], -k[2], k[3], k[4]))
    want = []
    for doc, some in hits.items():
        end = -1
        for at, minus, _, no in sorted(some):
            if at >= end:
                end = at - minus
                want.append((doc, at, -minus, no))
    assert sorted((r["doc_id"], r["offset"], r["length"], r["pattern_no"]) for r in result("overlap_resolve")) == sorted(want)


def test_context_windows(spark, sf, result):
    texts = {r["doc_id"]: r["text"] for r in rows(spark, sf, "SELECT doc_id, text FROM documents").collect()}
    got = result("context_windows")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text, shown = texts[r["doc_id"]], r["window_text"]
        if text is None:
            assert shown is None and not r["matched"]
            continue
        at = len(text) // 2
        parts = shown.split(windows.BETWEEN)
        marked = [p for p in parts if "«" in p and "»" in p]
        assert r["matched"] and marked
        assert f"«{text[at:at + 5]}»" in marked[-1]
        # every part stands in the text; the marked one around its place
        for p in parts:
            assert p.replace("«", "").replace("»", "") in text
        before = marked[-1].partition("«")[0]
        assert text[at - len(before) : at] == before
        assert len(marked[-1]) <= 700 + 2 or r["list_item"]


def slow_heldout(rows, floors, quotas, caps):
    """Class by class and dataset by dataset over lists, with the counts recomputed from what was chosen."""
    chosen = []

    def n(field, value):
        return sum(r[field] == value for r in chosen)

    for dataset, floor in floors.items():
        for r in (r for r in rows if r[2] == dataset):
            if n(2, dataset) >= floor or (dataset in caps and n(2, dataset) >= caps[dataset]):
                break
            if n(1, r[1]) < quotas.get(r[1], 0):
                chosen.append(r)
    for stratum, quota in quotas.items():
        pool, later = [r for r in rows if r[1] == stratum and r not in chosen and caps.get(r[2]) != 0], []
        for r in pool:
            if r[2] in caps and n(2, r[2]) >= caps[r[2]]:
                later.append(r)
            elif n(1, stratum) < quota:
                chosen.append(r)
        for r in later:
            if n(1, stratum) < quota:
                chosen.append(r)
    return sorted(chosen)


@pytest.mark.parametrize("seed", range(6))
def test_quota_sampler(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abcd"), r.choice(["d0", "d1", "d2", "d3"])) for i in range(120)]
    floors = {d: r.randrange(12) for d in ("d1", "d0")}
    quotas = {s: r.randrange(25) for s in "bac"}
    caps = {d: r.randrange(9) for d in ("d2", "d1")}
    if caps["d1"] == 0:
        floors.pop("d1")
    got = evaluate.heldout(spark.createDataFrame(rows, "key int, stratum string, dataset string"), floors, quotas, caps).collect()
    want = slow_heldout(rows, floors, quotas, caps)
    assert sorted(map(tuple, got)) == want and all(sum(x[1] == s for x in want) <= q for s, q in quotas.items()) and not any(x[1] == "d" for x in want)


@pytest.mark.parametrize("small", [0, 5, 32])
def test_small_and_large_groups_of_surfaces(spark, monkeypatch, small):
    monkeypatch.setattr(compare, "SMALL", small)
    r = random.Random(3)
    sides = [[(d, "g", "".join(r.choices("ab ", k=r.randrange(2, 9)))) for d in range(60) for _ in range(d)] for _ in range(2)]
    got = {tuple(x) for x in compare.match_surfaces(*(spark.createDataFrame(x, "doc_id int, entity_type string, surface string") for x in sides)).collect()}
    assert got == {(d, "g", *m) for d in range(60) for m in greedy(*({x[2] for x in side if x[0] == d} for side in sides))}


def test_surfaces_of_small_documents_move_twice(spark):
    def moved():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    sides = [spark.createDataFrame([(d, "g", f"{a}name {d} of {k}") for d in range(1_000) for k in range(6)], "doc_id int, entity_type string, surface string") for a in ("", "sur")]
    before = moved()
    assert compare.match_surfaces(*sides).count() == 6_000
    assert moved() - before < 3 * 12_000  # once to be told apart, once to their document; not with each of their n-grams


def test_strict_compare_joins_nothing(spark):
    r = random.Random(5)
    sides = [[(r.choice([1, 2, 3, None]), r.choice([" A", "a", "b", "C ", None]), r.choice(["g", "d", None])) for _ in range(n)] for n in (25, 40)]
    out = compare.strict_compare(*(spark.createDataFrame(x, "doc_id int, surface string, entity_type string") for x in sides))
    a, b = ({(d, s and s.strip().lower(), t) for d, s, t in side} for side in sides)
    want = {d: tuple(sum(x[0] == d for x in some) for some in (a, b, {x for x in a & b if None not in x})) for d in {x[0] for x in a | b}}
    assert {x.doc_id: (x.n_ours, x.n_theirs, x.n_both) for x in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # a join sorts both sides in one task
