"""Ids that repeat with different texts: every text is compared, and an id is linked through any of them."""

import random

from quillspark.llm import near_dedup


def plain(data, words, num):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in data]
    root = {i: i for i, _ in data}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_every_text_of_an_id_counts(rows):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choices(vocabulary, k=100) for _ in range(6)]

    def near(k):
        w = list(base[k])
        w[r.randrange(100)] = "other"
        return " ".join(w)

    data = [(10, near(0)), (10, near(1)), (10, near(2)), (11, near(0)), (12, near(1)), (13, near(2)), (20, near(3)), (21, near(3)), (21, near(4)), (22, near(4)), (22, None), (30, near(5)), (31, near(5)), (30, near(5)), (40, None), (40, "")]
    same = " ".join(base[5])
    data += [(50, same), (51, same), (51, near(0)), (5, ""), (5, near(3))]
    data += [(60 + k, " ".join(r.choices(vocabulary, k=60))) for k in range(5)]
    for group in (4096, 4):
        got = near_dedup.classes(rows(data), near_dedup.Likeness(words=3, num=85), group)
        assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got.collect()) == plain(data, 3, 85)
