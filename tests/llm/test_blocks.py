"""Repeated windows: every mark comes from an answer, hot hashes at the usual threshold, sizes that grow in step, repeated ids."""

import math
import random

import numpy as np

from quillspark.llm import blocks, substring_dedup, suffix_dedup

from . import brute
from .test_dedup import compare, corpus


def silent(matcher):
    def run(strings, sub, string, doc, at):
        bits, n = matcher(strings, sub, string, doc, at)
        return np.zeros_like(bits), n

    return run


def test_nothing_is_marked_but_by_an_answer(rows):
    for words, matcher, module in ((False, suffix_dedup.matcher(), suffix_dedup), (True, substring_dedup.matcher(), substring_dedup)):
        for answer, gone in ((silent(matcher), False), (matcher, True)):
            out = blocks.find_repeats(rows(corpus()), 20 if words else 50, words, answer, module.finish(False), module.RESULT)
            assert (out.filter("n_removed > 0").count() > 0) == gone


def test_a_hot_hash_at_the_usual_threshold(rows):
    assert blocks.HOT == 30_000
    r = random.Random(1)
    common = "a phrase that very many documents hold"
    data = [(i, f"{r.randrange(10**9):x} {common} {r.randrange(10**9):x} and so on, {i}") for i in range(31_000)]
    data += [(31_000 + i, data[r.randrange(31_000)][1]) for i in range(300)]
    want = brute.suffix_dedup(data)
    assert sum(v[0][1] > 0 for v in want.values()) >= 300
    compare(suffix_dedup.dedup_substrings(rows(data), keep_texts=False), ("n_bytes", "n_removed", "n_spans", "kept_sha256"), want)
    cut = blocks.cut_bytes([t.encode() for _, t in data], 50)
    _, counts = np.unique(cut.key, return_counts=True)
    assert counts.max() > blocks.HOT  # the phrase's hash did go on by single windows


def test_counts_beyond_a_byte_are_kept(rows):
    import pyarrow as pa

    plan = blocks.Plan.of(1, 50, False, hot=1_000)
    text = "the same fifty bytes and a few more of them, in each document"
    tables = [blocks.ask(plan)(pa.table({"block": pa.array([b] * 600, pa.int32()), "doc_id": pa.array(range(600), pa.int64()), "text": pa.array([text.encode()] * 600, pa.binary())})) for b in range(2)]
    told = blocks.tell(plan)(pa.concat_tables(tables))
    assert all(told.column("hot").to_pylist())


def test_rows_between_stages_grow_in_proportion():
    for size in (10**5, 10**8, 5 * 10**8, 3 * 10**10, 10**14):
        plan = blocks.Plan.of(size, 50, False)
        assert plan.blocks * plan.bins <= 2 * size / blocks.BLOB + 4 * math.sqrt(size)
        assert abs(plan.blocks - math.sqrt(size / blocks.BLOB)) <= 2


def test_ids_that_repeat(rows):
    base = corpus(3, 30)
    data = [(i % 9, t) for i, t in base] + [(None, base[3][1]), (None, base[6][1]), (None, None), (None, base[3][1])] + [(4, base[3][1])] * 3
    key = [(-(2**62) if i is None else i, t) for i, t in data]
    got = sorted(((-(2**62) if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup_substrings(rows(data), block_bytes=700).collect())
    assert got == sorted((i, *x) for i, t in key for x in [plain_bytes(i, t, key)])
    got = sorted(((-(2**62) if r.doc_id is None else r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup_spans(rows(data), block_bytes=700).collect())
    assert got == sorted((i, *x) for i, t in key for x in [plain_words(i, t, key)])


def plain_bytes(i, t, key):
    import hashlib

    t = (t or "").encode()
    seen = {u[k : k + 50] for j, u in ((j, (u or "").encode()) for j, u in key) if j < i for k in range(len(u) - 49)}
    gone = set()
    for k in range(len(t) - 49):
        if t[k : k + 50] in seen:
            gone.update(range(k, k + 50))
    return len(t), len(gone), hashlib.sha256(bytes(c for k, c in enumerate(t) if k not in gone)).hexdigest()


def plain_words(i, t, key):
    first = {}
    for j, u in key:
        w = (u or "").split()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            first[x] = min(first.get(x, (j, k)), (j, k))
    w, gone = (t or "").split(), set()
    for k in range(len(w) - 19):
        if first[tuple(w[k : k + 20])] < (i, k):
            gone.update(range(k, k + 20))
    return len(w), len(gone)
