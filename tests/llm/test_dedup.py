import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import blocks, components, near_dedup, substring_dedup, suffix_dedup
from quillspark.llm.base import table

from . import brute

PASSAGE = "the quick brown fox jumps over the lazy dog while five wizards box and twenty-two more words follow here to make it long enough okay then"


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "日本語", "\x00", "x" * 40]
    out = []
    for i in range(n):
        parts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 90)))]
        if i % 3 == 0:
            parts.insert(r.randrange(2), PASSAGE)
        if i % 10 == 0:
            parts += [PASSAGE, PASSAGE]
        out.append((i * 7 - 20, r.choice([" ", "\n", "\t "]).join(parts)))
    out += [(1000, None), (1001, ""), (1002, "short"), (1003, out[3][1]), (1004, out[3][1]), (1005, "a " * 400), (1006, "a" * 300), (1007, "ab" * 150), (2000, "z" * 120), (2000, "z" * 120), (1008, " \n\t ")]
    return out


def compare(df, columns, want):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def run_bytes(docs, hot=blocks.HOT, most=suffix_dedup.MOST, alone=suffix_dedup.MOST_ALONE, **o):
    return blocks.find_repeats(docs, 50, False, suffix_dedup.matcher(50, most, alone), suffix_dedup.finish(False), suffix_dedup.RESULT, bin_bytes=4096, hot=hot, block_bytes=3000, **o)


def test_bytes_against_brute_force(rows):
    data = corpus()
    want = brute.suffix_dedup(data)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    compare(suffix_dedup.dedup_substrings(rows(data)), columns, want)
    for hot, most, alone in ((0, 400_000, 1 << 20), (4, 900, 2000), (10**9, 200, 300)):
        compare(run_bytes(rows(data), hot, most, alone), columns, want)


def test_words_against_brute_force(rows):
    data = corpus(8)
    want = brute.word_dedup(data)
    columns = ("n_words", "n_removed", "kept_sha256")
    compare(substring_dedup.dedup_spans(rows(data)), columns, want)
    for hot in (0, 4):
        compare(blocks.find_repeats(rows(data), 20, True, substring_dedup.matcher(20), substring_dedup.finish(False), substring_dedup.RESULT, bin_bytes=4096, hot=hot, block_bytes=3000), columns, want)


def test_spans_rebuild_the_text(rows):
    data = [d for d in corpus() if d[0] != 2000]
    for r in suffix_dedup.dedup_substrings(rows(data)).collect():
        text = (dict(data)[r.doc_id] or "").encode()
        left = b"".join(text[a:b] for a, b in zip([0, *r.ends], [*r.starts, len(text)], strict=True))
        assert left == bytes(r.kept)


def test_empty_and_null_ids(spark, rows):
    assert suffix_dedup.dedup_substrings(rows([])).count() == 0
    assert substring_dedup.dedup_spans(rows([])).count() == 0
    assert near_dedup.classes(rows([]), near_dedup.Likeness()).count() == 0
    data = [(None, PASSAGE), (1, PASSAGE), (2, None)]
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(rows(data)).collect()} == {None: 0, 1: len(PASSAGE), 2: 0}
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_spans(rows(data)).collect()} == {None: 0, 1: len(PASSAGE.split()), 2: 0}
    assert near_dedup.classes(rows(data), near_dedup.Likeness()).filter("doc_id is null").first().kept


def test_pipeline_form_keeps_columns(rows):
    data = [(1, PASSAGE + "  tail one"), (2, "head two\n" + PASSAGE), (3, "untouched  text")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(rows(data)).collect()}
    assert got[2].text == "head two" and got[3].text == "untouched  text" and got[1].text == data[0][1] and got[1].n_words == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=4, max_size=40), min_size=1, max_size=12))
def test_prefix_groups(strings):
    text = np.frombuffer(b"\xff".join([*(s.encode() for s in strings), b""]), dtype=np.uint8)
    order, first = suffix_dedup.prefix_groups(text, 4)
    group = np.empty(len(text), dtype=int)
    group[order] = np.cumsum(first)
    data = bytes(text)
    seen = {}
    for i in range(len(data) - 3):
        w = data[i : i + 4]
        if b"\xff" not in w:
            assert seen.setdefault(w, group[i]) == group[i]
    assert len(set(seen.values())) == len(seen)


def near_corpus():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    base = r.choices(vocabulary, k=120)
    out = [(i, " ".join(r.choices(vocabulary, k=r.randrange(20, 100)))) for i in range(40)]
    for i in range(40, 120):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    return [*out, (200, None), (201, ""), (202, "one two"), (203, "One  TWO"), (204, out[0][1]), (205, " ")]


def test_near_duplicates_against_brute_force(rows):
    data = near_corpus()
    for words, num in ((3, 85), (5, 80)):
        want = brute.near_dedup(data, words, num)
        for group, size in ((4096, 10**6), (16, 10**6), (4096, 900)):  # whole groups, and groups dealt out in tiles
            got = near_dedup.classes(rows(data), near_dedup.Likeness(words=words, num=num), group, size)
            assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want
    kept = near_dedup.keep_first(rows(data))
    assert kept.columns == rows(data).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, v in brute.near_dedup(data, 5, 80).items() if v[2]}


def test_bands_and_posterior():
    for t in (80, 85):
        like = near_dedup.Likeness(num=t)
        assert (1 - (t / 100) ** like.rows) ** like.bands <= 1e-6 and like.rows * like.bands <= near_dedup.HASHES
        assert like.least_matches == sorted(like.least_matches) and 0 < like.least_matches[-1] < t / 100 * near_dedup.HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (102, 101), (7, 7), (100, 101)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100}


def test_whole_small_tables(spark, sf):
    docs = table(spark, sf, "documents")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    compare(suffix_dedup.op1(spark, sf), ("n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.suffix_dedup(data))
    compare(substring_dedup.op10(spark, sf), ("n_words", "n_removed", "kept_sha256"), brute.word_dedup(data))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op7(spark, sf).collect()} == brute.near_dedup(data, 3, 85)
