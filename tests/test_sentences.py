"""Learned sentence ends: scores against plain versions, boundaries against labelled texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sentences, windows

STARTERS = "The These We Our However Samples Results In".split()
WORDS = "reads were mapped to genome with care and then cells grew under light before data came from several donors of each group".split()
#: None of these is in the list of the rules.
SHORT = ["Prof", "conc", "temp", "resp", "Univ", "dept", "incl", "p.o", "i.v"]
NAMES = "Miller Tanaka Basel Oslo Peters Wagner".split()


def labelled(seed, n):
    """Texts, each with the starts of its sentences."""
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        text, starts = "", []
        for _ in range(pick.randint(3, 12)):
            body = [pick.choice(STARTERS), *pick.choices(WORDS, k=pick.randint(3, 10))]
            for _ in range(pick.randint(0, 2)):
                body.insert(pick.randint(1, len(body)), f"{pick.choice(SHORT)}. {pick.choice(NAMES)}")
            end = pick.choice(["."] * 8 + ["?", '."'])
            if pick.random() < 0.15:
                body.append(pick.choice(SHORT) + "." * (end == "?"))
            starts.append(len(text) + bool(text))
            text += (" " if text else "") + " ".join(body) + end
        out.append((text, starts))
    return out


def f1(split, texts):
    hit = told = true = 0
    for text, starts in texts:
        got = {a for a, _ in split(text)} - {0}
        hit, told, true = hit + len(got & set(starts)), told + len(got), true + len(set(starts) - {0})
    return 2 * hit / (told + true)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(t,) for t, _ in labelled(1, 300)] + [(None,), ("",), ("  \n",), ("...",), ("one",)], "text string").cache()


def test_better_than_the_rules(corpus):
    model = sentences.learn(corpus)
    held_out = labelled(2, 200)
    learned, rules = f1(lambda t: sentences.spans(t, model), held_out), f1(windows.sentence_spans, held_out)
    assert learned > 0.97 and learned > rules + 0.1
    assert {x.lower() for x in SHORT} <= model.abbreviations and {x.lower() for x in NAMES}.isdisjoint(model.starters)
    assert {"the", "we", "however"} <= model.starters


def counted(texts):
    n, final = Counter(), Counter()
    for t in texts:
        for w in re.findall(sentences.WORD, t or ""):
            w = re.sub(r"""["')\],;:!?]+$""", "", re.sub(r"""^["'(\[]+""", "", w))
            k = w.lower().removesuffix(".")
            k = k if re.fullmatch(r"[^\W\d_][^\W\d_.]*(?:[^\W\d_]|\.)*", k) else None
            n[k] += 1
            final[k] += w.endswith(".")
    return n, final


def test_counts_and_scores(spark, corpus):
    n, final = counted(r["text"] for r in corpus.collect())
    counts = sentences.word_counts(corpus)
    assert {r["kind"]: (r["n"], r["n_period"]) for r in counts.collect()} == {k: (n[k], final[k]) for k in n}
    c = sum(final.values()) / sum(n.values())
    want = {}
    for k in n:
        if k is not None and final[k]:
            a, b, size = final[k], n[k] - final[k], len(k.replace(".", ""))
            ratio = -2 * (a * math.log(c) + b * math.log(1 - c) - a * math.log(0.99) - b * math.log(0.01))
            want[k] = ratio * math.exp(-size) * (k.count(".") + 1) * size**-b
    got = {r["kind"]: r["score"] for r in sentences.abbreviations(counts).collect()}
    assert set(got) == {k for k, s in want.items() if s >= 0.3}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_odd_corpora(spark):
    for texts in ([], [None], [""], ["a"], ["End."], ["A. B. C."], ["x " * 60_000 + "End. Now"]):
        model = sentences.learn(spark.createDataFrame([(t, 1) for t in texts], "text string, n int"))
        for t in texts:
            if t:
                got = sentences.spans(t, model)
                assert got[0][0] == 0 and got[-1][1] == len(t) and all(a < b for a, b in got)
    with pytest.raises(ValueError, match="raise it"):
        sentences._few(spark.range(5).select(F.col("id").cast("string").alias("kind")), 4)


def test_windows_by_a_model(spark):
    text = "Filler here. " * 20 + "Cells of Prof. Miller gave GSE1 now. " + "More words. " * 20
    at = text.index("GSE1")
    located = spark.createDataFrame([("D", text, at, 4)], "doc_id string, text string, within int, length int")
    model = sentences.Model(frozenset({"prof"}), frozenset())
    by_rule, by_model = (windows.build_windows(located, 0, **o).first()["window_text"] for o in ({}, {"split": lambda t: sentences.spans(t, model)}))
    assert by_model == "Cells of Prof. Miller gave «GSE1» now." and by_rule == "Miller gave «GSE1» now."
