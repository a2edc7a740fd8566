"""Queries whose SQL keeps to a part of the table, held to plain versions over all of it."""

import random
import re

import pytest
import regex

import __spark_entry__ as entry
from quillspark.functions import text as X

BITS = "été Été 日本 😀 ß SS İ i ı K k ſ S Σ σ ς 1 ١ 2 Then The These gene foo A . , ; : - _ ² Ⅷ नमस्ते Cox cox . ..".split()
DOCS = [(1, "Größe été. cox.cox", "de"), (2, "日本;　Été.été 😀1Then", None), (3, "niño,\nniño NIÑO.niño\tΣΑΣ.σασ", "es"), (4, None, "en"), (5, "plain Words.", "en"), (6, "--été; gene١These", "fr")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, root = random.Random(1), tmp_path_factory.mktemp("tables")
    docs = DOCS + [(k, " ".join("".join(r.choices(BITS, k=r.randrange(1, 6))) for _ in range(40)), r.choice(["en", "de", "fr", "es", None])) for k in range(10, 60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"file://{root}/documents.parquet")
    return f"file://{root}", docs


def clean(s):
    m = re.match(r"^(\w+)[.\s]+\1$", s, re.IGNORECASE)
    if m:
        return (s, m[1], 0, len(s) - len(m[1]), "dup_word") if len(m[1]) >= 2 else (s, s, 0, 0, "none")
    part, rule = s, "none"
    if m := re.search(r"\d([A-Z][a-z])", s):
        part, rule = s[: m.start(1)], "num_upper_split"
    elif (m := re.search(r"[a-z]{3,}([A-Z][a-z]{2,})", s)) and m[1].startswith(tuple(X.GLUED_TAILS)):
        part, rule = s[: m.start(1)], "lower_upper_split"
    tail = part.rstrip(".,;:")
    both = tail.lstrip(".,;:-")
    if len(both.strip()) <= 1 or both == s:
        return s, s, 0, 0, "none"
    if rule == "none":
        rule = "trailing_punct" if tail != part else "leading_punct"
    return s, both, len(tail) - len(both), len(s) - len(tail), rule


def test_clean_surface_takes_all_tokens(spark, folder):
    root, docs = folder
    fixed = "cox.cox|Cox cox|a.a|abc1Then|geneThese|fooBarbaz|.x,|--gene.;|p53|.a".split("|")
    tokens = {w for _, t, _ in docs for w in (t or "").split()} | set(fixed)
    got = entry.queries()["clean_surface"](spark, root).collect()
    assert sorted((r.surface, r.clean, r.cut_left, r.cut_right, r.rule) for r in got) == sorted(map(clean, tokens))


def test_dictionary_merge_takes_all_types(spark, folder):
    root, docs = folder
    pairs = {(w, lang) for _, t, lang in docs for w in regex.findall(r"\p{L}{3,}", (t or "").lower())}
    got = entry.queries()["dictionary_merge"](spark, root).collect()
    want = [(w, lang, f"D:{w}" if len(w) % 2 == 0 else None, "ok" if len(w) % 2 == 0 else "no_id") for w, lang in pairs]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {None, "de", "es"} < {x[1] for x in want}
