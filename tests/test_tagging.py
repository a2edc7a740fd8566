"""Dictionary tagging, held to plain versions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import tagging


def by_pattern(text, names):
    """One alternation, the longest names first."""
    if not names:
        return []
    p = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")(?!\w)")
    return [(m.start(), m.end(), names[m[0]]) for m in p.finditer(text)]


def by_tokens(text, names, longest):
    """Each stretch of tokens from each place."""
    spots = [m.span() for m in re.finditer(r"\w+|\W", text)]
    out, behind = [], 0
    for i, (a, _) in enumerate(spots):
        if a < behind or (a and re.match(r"\w", text[a - 1])):
            continue
        for j in range(min(len(spots), i + longest) - 1, i - 1, -1):
            z = spots[j][1]
            if text[a:z] in names and not re.match(r"\w", text[z : z + 1]):
                out.append((a, z, names[text[a:z]]))
                behind = z
                break
    return out


NAMES = {"TP53": "gene", "p53": "gene", "IL-2": "gene", "IL-2 receptor": "gene", "IL": "x", "(+)-menthol": "drug", "heart attack": "disease", "heart": "organ", "β": "letter", "-": "dash", "a b c": "abc", "b": "b", "c d": "cd", "naïve T": "cell", "日本 語": "ja", "x\ny": "lines", " lead": "space", "m²": "unit"}


def test_against_one_pattern():
    r = random.Random(2)
    pieces = [*NAMES, *"IL 2 receptor heart attack a b c d - ( ) + menthol β m ² _ é 日本 語 naïve T 53 p TP".split(), " ", "\n", "\0", ". "]
    v = tagging.Vocabulary(list(NAMES.items()))
    texts = ["".join(r.choice(["", " ", " ", "-"]) + r.choice(pieces) for _ in range(r.randrange(0, 30))) for _ in range(1_500)]
    want = [by_pattern(t, NAMES) for t in texts]
    assert v.find(texts) == want and sum(map(len, want)) > 3_000
    assert [v.find([t])[0] for t in texts[:50]] == want[:50]


@settings(max_examples=150, deadline=None)
@given(names=st.lists(st.text(alphabet="ab -é_", min_size=1, max_size=5), max_size=8), texts=st.lists(st.text(alphabet="ab -é_\0", max_size=30), max_size=4))
def test_any_names(names, texts):
    names = {n: f"k{i}" for i, n in enumerate(names)}
    assert tagging.Vocabulary(list(names.items())).find(texts) == [by_pattern(t, names) for t in texts]


def test_a_million_names():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 7))) for _ in range(60_000)]
    names = {}
    while len(names) < 1_000_000:
        names[" ".join(r.choices(words, k=r.randrange(1, 4)))] = "k"
    some = list(names)
    v = tagging.Vocabulary(list(names.items()))
    assert len(v.names) == 1_000_000 and v.keys.nbytes + v.marks.nbytes + v.seen.nbytes < 60 << 20
    texts = [" ".join(r.choices(words, k=200) + r.choices(some, k=50)) for _ in range(60)] + [" ".join(r.choices(some, k=30_000))]
    assert v.find(texts) == [by_tokens(t, names, 5) for t in texts]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_in_tables(spark, most):
    """Sent to all tasks and joined to the texts: the same rows."""
    r = random.Random(4)
    pieces = [*NAMES, "heart", "some", "words", "IL-2", "attack"]
    texts = [" ".join(r.choices(pieces, k=r.randrange(0, 40))) for _ in range(120)]
    texts += ["word " * 60_000 + "heart attack", None, "", "p53"] + ["TP53 copy"] * 40
    passages = spark.createDataFrame([(i, t, "mine", 1, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, surface string, start int, key string, token string")
    names = spark.createDataFrame([*NAMES.items(), ("TP53", "zz"), (None, "n"), ("", "e"), ("never seen", "t"), ("copy", None)], "name string, entity_type string")
    known = NAMES | {"never seen": "t", "copy": ""}
    out = tagging.tag_names(passages.drop("surface", "start"), names, most_sent=most)
    got = sorted((x.doc_id, x.start, x.end, x.entity_type, x.surface, x.key) for x in out.collect())
    want = sorted((i, a, z, k, t[a:z], "x") for i, t in enumerate(texts) if t for a, z, k in by_pattern(t, known))
    assert got == want and (120, 300_000, 300_012, "disease", "heart attack", "x") in got
    assert tagging.tag_names(passages.select("doc_id", "text"), names.limit(0), most_sent=most).count() == 0
    assert tagging.tag_names(passages.select("doc_id", "text").limit(0), names, most_sent=most).count() == 0


def test_batches_are_tagged_in_pieces():
    import pyarrow as pa

    texts = ["x" * 400_000, None, "", "é" * 400_000, "y" * 3_000_000, "z", None]
    parts = [p.to_pylist() for p in tagging.slices(pa.array(texts, pa.string()))]
    assert sum(parts, []) == texts and len(parts) == 4 and list(tagging.slices(pa.array([], pa.string()))) == []
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= tagging.CHARS for p in parts)
