"""Linking by character n-grams, held to comparing all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.operators import linking


def gram_list(name):
    s = "^" + re.sub(r"\s+", " ", name.lower()).strip() + "$"
    return [s[i : i + 3] for i in range(max(1, len(s) - 2))]


def all_pairs(surfaces, names, k, least):
    names = sorted({(i, t, n) for i, t, n in names if n and n.strip() and t is not None}, key=lambda x: (x[1], x[2], x[0] or ""))
    df = Counter((t, g) for _, t, n in names for g in set(gram_list(n)))

    def vector(name, kind):
        w = {g: c * (math.log((1 + len(names)) / (1 + df[kind, g])) + 1) for g, c in Counter(gram_list(name)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    vectors = [vector(n, t) for _, t, n in names]
    out = []
    for s, kind in {(s, t) for s, t in surfaces if s and s.strip() and t is not None}:
        q = vector(s, kind)
        scored = []
        for (i, t, n), v in zip(names, vectors, strict=True):
            if t == kind:
                x = round(sum(w * v.get(g, 0.0) for g, w in q.items()), 9)
                if x >= least:
                    scored.append((-x, n, i))
        out += [(s, kind, i, n, -x, r + 1) for r, (x, n, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or ""))[:k])]
    return out


def some_names(r, n):
    words = ["".join(r.choices("abcdeimnorstu", k=r.randrange(3, 9))) for _ in range(n // 2)]
    return [(f"N:{i}", r.choice(["gene", "drug"]), " ".join(r.choices(words, k=r.randrange(1, 4)))) for i in range(n)]


def misspelt(r, name):
    k = r.randrange(len(name))
    return r.choice([name[:k] + name[k + 1 :], name[:k] + "x" + name[k:], name.upper(), name + " "])


def key(row):
    return tuple("" if x is None else f"{x:.7f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize(("shard", "block"), [(1_000, 1_000), (40, 25)])
def test_against_all_pairs(spark, shard, block):
    r = random.Random(5)
    names = some_names(r, 250) + [("N:0", "gene", "same"), ("N:1", "gene", "same"), ("N:1", "gene", "same"), ("N:2", "drug", "same"), (None, "gene", "naïve  T cell"), ("N:3", None, "same"), ("N:4", "gene", None), ("N:5", "gene", "  "), ("N:6", "gene", "日本語"), ("N:7", "gene", "a")]
    surfaces = [(misspelt(r, n), t) for _, t, n in names[:150]] + [("same", "gene"), ("same", "drug"), ("Naïve t CELL", "gene"), ("", "gene"), (None, "gene"), ("same", None), ("日本語", "gene"), ("zzzz", "gene"), ("a", "gene"), ("a", "drug")]
    table = spark.createDataFrame([(i, t, n, "x") for i, t, n in names], "identifier string, entity_type string, name string, id string")
    asked = spark.createDataFrame([(s, t, 1, "y") for s, t in surfaces * 2], "surface string, entity_type string, q int, shard string")
    got = linking.candidates(asked, table, 3, 0.3, shard, block).collect()
    assert sorted(map(key, got)) == sorted(map(key, all_pairs(surfaces, names, 3, 0.3)))
    best = {(x.surface, x.entity_type): x.identifier for x in got if x.rank == 1}
    right = sum(best.get((s, t)) == i for (s, t), (i, _, _) in zip(surfaces[:150], names[:150], strict=True))
    assert right >= 140, right  # planted names
    assert linking.candidates(asked.limit(0), table).count() == 0 == linking.candidates(asked, table.limit(0)).count()


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(6)
    n = 4_000
    of = np.repeat(np.arange(n), 12)
    grams = np.concatenate([r.choice(3_000, 12, replace=False, p=P) for _ in range(n)]).astype(np.int64)
    weights = r.random(len(of))
    index = linking.Index.load(linking.Index(np.arange(n) * 7, of, grams, weights).dump())
    for _ in range(200):
        q = np.sort(r.choice(3_200, 15, replace=False)).astype(np.int64)
        w = r.random(15)
        full = np.zeros(n)
        for g, x in zip(q, w, strict=True):
            at = grams == g
            np.add.at(full, of[at], x * weights[at])
        full = np.round(full, linking.DIGITS)
        for k, least in ((1, 0.1), (5, 0.1), (20, 0.6)):
            want = sorted((-s, i * 7) for i, s in enumerate(full) if s >= least)[:k]
            got = index.search(q, w, k, least)
            assert [i for i, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [-s for s, _ in want])
        assert not index.scores.any()


P = 1 / np.arange(1, 3_001)
P /= P.sum()


def test_context_decides_between_candidates(spark):
    names = spark.createDataFrame([("G:1", "gene", "CAT"), ("G:2", "gene", "CAT"), ("G:3", "gene", "CATS")], "identifier string, entity_type string, name string")
    profiles = spark.createDataFrame([("G:1", "catalase breaks down peroxide"), ("G:2", "chloramphenicol resistance"), ("G:2", "plasmid"), ("G:9", "none")], "identifier string, description string")
    mentions = spark.createDataFrame([(1, "cat", "gene", "A plasmid with Chloramphenicol, and"), (2, "cat", "gene", "peroxide catalase"), (3, "cat", "gene", None), (4, "dog", "gene", "plasmid"), (5, None, "gene", "x")], "m int, surface string, entity_type string, context string")
    found = linking.candidates(mentions, names, 3, 0.2)
    got = {r.m: (r.identifier, r.score) for r in linking.rerank(mentions, found, profiles).collect()}
    assert got[1][0] == "G:2" and abs(got[1][1] - 1.2) < 1e-6 and got[2][0] == "G:1" and got[3] == ("G:1", 1.0) and got[4] == (None, None) == got[5]


def test_modes(spark):
    names = spark.createDataFrame([("G:1", "gene", "cat"), ("G:2", "gene", "catalase")], "identifier string, entity_type string, name string")
    surfaces = spark.createDataFrame([("cat", "gene"), ("catalase", "gene"), ("xyz", "gene"), (None, "gene"), ("cat", "gene")], "surface string, entity_type string")

    def got(mode):
        return {(r.surface, r.identifier, r.linker_status) for r in linking.link(surfaces, names, mode).collect()}

    assert got("full") == {("cat", "G:1", "ok"), ("catalase", "G:2", "ok"), ("xyz", None, "no_id"), (None, None, "no_id")}
    assert got("short") == {("cat", "G:1", "ok"), ("xyz", None, "no_id")} and got("none") == set()
