"""Quality rules: text statistics by built-in functions, and a learned decision list over them."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, fresh, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Name and Spark expression of each feature that a rule may test. All are ratios or sizes of one text.
FEATURES = {
    "n_words": "cast({q}.n_words as double)",
    "mean_word_chars": "cast({q}.word_chars as double) / {q}.n_words",
    "symbols_per_word": "cast({q}.n_symbols as double) / {q}.n_words",
    "dup_line_share": "cast({q}.n_dup_lines as double) / greatest({q}.n_lines, 1)",
    "repeat_word_share": "cast({q}.n_repeat_words as double) / {q}.n_words",
    "capitals_per_char": "cast({q}.n_capitals as double) / greatest({q}.word_chars, 1)",
    "marks_per_word": "cast({q}.n_marks as double) / {q}.n_words",
    "digits_per_char": "cast({q}.n_digits as double) / greatest({q}.word_chars, 1)",
    "words_per_line": "cast({q}.n_words as double) / greatest({q}.n_lines, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_stats(docs: DataFrame, text: str = "text", into: str = "__q") -> DataFrame:
    """docs with one struct of counts for each text; null counts as the empty text, whose counts are all 0.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines (equal to an earlier line,
    lines with a word only), n_repeat_words (words in five-word windows that the text has twice or more), n_capitals,
    n_marks (``!`` and ``?``), n_digits. Whole texts, whatever their length: nothing is exploded, so a text costs its
    own size in one row.
    """
    t, w, g, hashes, sorted_grams, places, kept_lines = fresh(docs, *(f"{into}_{x}" for x in "twghrpl"))
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    # Each array is a column of its own with two uses or more, so that Catalyst doesn't inline it into a lambda and
    # build it again for each element.
    out = out.withColumn(w, F.filter(F.split(F.col(t), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    # slice() copies its array, so windows are built by shifting the whole array of word hashes, not by a slice for each.
    out = out.withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
    shifted = [F.slice(hashes, k, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))).alias(f"w{k}") for k in range(1, WINDOW + 1)]
    out = out.withColumn(g, F.when(F.size(w) >= WINDOW, F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*(z[f"w{k}"] for k in range(1, WINDOW + 1))))))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    twice = F.size(F.array_distinct(g)) < F.size(g)
    out = out.withColumn(sorted_grams, F.when(twice, F.sort_array(F.transform(F.col(g), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    r = F.col(sorted_grams)
    # neighbours in hash order with the same hash are windows that occur again
    pairs = F.flatten(F.filter(F.zip_with(r, F.slice(r, 2, F.size(r)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    out = out.withColumn(places, F.when(r.isNotNull(), F.sort_array(F.array_distinct(pairs))))
    p = F.col(places)
    covered = F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    out = out.withColumn(kept_lines, lines)
    lines = F.col(kept_lines)
    counts = {
        "n_words": F.size(w), "word_chars": F.length(F.translate(t, SPACES, "")), "n_symbols": _without(F.col(t), SYMBOLS), "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": F.when(p.isNotNull() & (F.size(p) > 0), covered).otherwise(0),
        "n_capitals": F.length(t) - F.length(F.regexp_replace(F.col(t), r"\p{Lu}+", "")), "n_marks": _without(F.col(t), "!?"), "n_digits": _without(F.col(t), "0123456789"),
    }
    # partition ids are never negative; the test marks the counts as not to be inlined, else a filter on them is pushed
    # below and computes every count again for each use
    out = out.withColumn(into, F.when(F.spark_partition_id() >= 0, F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))))
    return out.drop(t, w, g, hashes, sorted_grams, places, kept_lines)


def base_failed(q: str = "__q") -> Column:
    return F.expr(f"{q}.n_words < 10 or 100 * {q}.n_repeat_words > 20 * {q}.n_words")


@dataclass(frozen=True)
class Rule:
    """All of the conditions (feature, '<=' or '>', threshold) hold: the verdict is reject."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def sql(self, q: str) -> str:
        return " and ".join(f"({FEATURES[f].format(q=q)}) {op} {x!r}D" for f, op, x in self.conditions)


def _covers(row: dict, conditions) -> bool:
    return all((row[f] > x) if op == ">" else (row[f] <= x) for f, op, x in conditions)


def _cuts(values: list[float], most: int) -> list[float]:
    """Midpoints between neighbouring values, at most so many, at even steps through the rows."""
    v = sorted(values)
    mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False) if b > a]
    return mids if len(mids) <= most else sorted({mids[(2 * i + 1) * len(mids) // (2 * most)] for i in range(most)})


def _grow(rows: list[tuple[dict, bool]], cuts: int) -> list[tuple[str, str, float]]:
    """Adds the condition of the highest information gain, until only bad rows are covered or nothing gains."""
    conditions: list[tuple[str, str, float]] = []
    while len(conditions) < 4:
        p = sum(bad for _, bad in rows)
        n = len(rows) - p
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for f in FEATURES:
            cut_at = _cuts([x[f] for x, _ in rows], cuts)
            tally = [[0, 0] for _ in range(len(cut_at) + 1)]
            for x, bad in rows:
                tally[bisect.bisect_left(cut_at, x[f])][bad] += 1
            low = [0, 0]
            for cut, (good_n, bad_n) in zip(cut_at, tally, strict=False):
                low[0] += good_n
                low[1] += bad_n
                for op, pp, nn in (("<=", low[1], low[0]), (">", p - low[1], n - low[0])):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - before)
                        if gain > best[0]:
                            best = (gain, (f, op, cut))
        if best[1] is None:
            break
        conditions.append(best[1])
        rows = [r for r in rows if _covers(r[0], conditions[-1:])]
    return conditions


def _prune(rows: list[tuple[dict, bool]], conditions):
    """Drops final conditions while that doesn't lower (p - n) / (p + n) on rows that didn't grow the rule."""

    def worth(c) -> tuple[float, int, int]:
        hit = [bad for x, bad in rows if _covers(x, c)]
        p = sum(hit)
        return ((2 * p - len(hit)) / len(hit) if hit else -1.0, p, len(hit))

    best = conditions
    for k in range(len(conditions) - 1, 0, -1):
        if worth(conditions[:k])[0] >= worth(best)[0]:
            best = conditions[:k]
    return best, worth(best)


def learn_rules(rows: list[tuple[dict, bool]], least_precision: float = 0.9, least_covered: int = 3, most_rules: int = 16, cuts: int = 64) -> list[Rule]:
    """Sequential covering. rows: features, and True for a bad document. Rules grow on two thirds of the rows, are pruned
    and judged on the rest; what a rule covers is taken away before the next one. No labels give no rules."""
    rules: list[Rule] = []
    grow, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    while len(rules) < most_rules and any(bad for _, bad in grow):
        conditions = _grow(grow, cuts)
        if not conditions:
            break
        conditions, (_, p, hit) = _prune(held, conditions)
        both = [bad for x, bad in grow + held if _covers(x, conditions)]
        if len(both) < least_covered or sum(both) < least_precision * len(both) or (hit and p < least_precision * hit):
            break
        rules.append(Rule(tuple(conditions), len(both), sum(both) / len(both)))
        grow, held = ([r for r in part if not _covers(r[0], conditions)] for part in (grow, held))
    return rules


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labels: int = 20_000) -> list[tuple[dict, bool]]:
    """Features and labels of at most `most_labels` labelled documents (those of the smallest hash), in a fixed order."""
    some = labels.select("doc_id", F.col(label).cast("int").alias("__y")).filter("doc_id is not null and __y is not null").groupBy("doc_id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    found = with_stats(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))  # at most most_labels rows are sent
    found = found.filter(~base_failed()).select("doc_id", "__y", *(F.expr(e.format(q="__q")).alias(f) for f, e in FEATURES.items()))
    rows = sorted((tuple(r) for r in found.collect()), key=lambda r: (hash((r[0], 7)), r))
    return [(dict(zip(FEATURES, r[2:], strict=True)), r[1] == 0) for r in rows]


def verdict(rules: list[Rule], q: str = "__q") -> Column:
    """The decision list as one conditional expression: the first rule that holds rejects; a document that none covers stays."""
    out = F.when(base_failed(q), F.lit(False))
    for rule in rules:
        out = out.when(F.expr(rule.sql(q)), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """docs with a last column `quality_counts` (or `quality_counts_`, …: a name that docs doesn't have), the struct of counts
    with base_failed and kept. Documents with less than ten words or many repeats fail whatever the rules say. Rows are
    judged one by one, so repeated rows get the same verdict."""
    rules = learn_rules(labelled_stats(docs, labels, most_labels=most_labels))
    (q,) = fresh(docs, "quality_counts")
    out = with_stats(docs, into=q)
    return out.withColumn(q, F.col(q).withField("base_failed", base_failed(q)).withField("kept", verdict(rules, q)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs and no others, whatever they are called."""
    rules = learn_rules(labelled_stats(docs, labels))
    (q,) = fresh(docs, "quality_counts")
    return with_stats(docs, into=q).filter(verdict(rules, q)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(f"quality_counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
