"""Sentence ends by what the corpus itself shows: abbreviations and words that start sentences, after Kiss and Strunk (2006).

An abbreviation is a word that is nearly always followed by a period, is short, and has periods within; a starter is a word that
comes behind sentence ends much more often than chance has it. Both are log-likelihood ratios over counts of the whole corpus, from
built-in aggregates: distinct words and pairs move, texts don't.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.places import written

# Limits of the published method.
LEAST_ABBREVIATION, LEAST_STARTER, ALWAYS = 0.3, 30.0, 0.99
# End of fixed values.
#: Words of each kind that may be sent to all tasks.
MOST_WORDS = 100_000

WORD = r"[^\x20\x09-\x0D]+"
_OPENS, _CLOSES = r"""^["'(\[]+""", r"""["')\],;:!?]+$"""
_CANDIDATE = re.compile(r"(?<=[.!?])[\"')\]]*[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])")


def bare(word: Column) -> Column:
    """A word without opening and closing marks; its period stays."""
    return F.regexp_replace(F.regexp_replace(word, _OPENS, ""), _CLOSES, "")


def kind(bare_word: Column) -> Column:
    """What is counted as one word: lower case, without the last period. Null unless it is of letters and periods."""
    low = F.regexp_replace(F.lower(bare_word), r"\.$", "")
    return F.when(low.rlike(r"^\p{L}[\p{L}.]*$"), low)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, n, n_period): how often each word occurs, and how often with a period at its end. Words of other characters than
    letters and periods are one row, of the null kind. Null and empty texts have no words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("w", bare(F.col("w")))
    return words.groupBy(kind(F.col("w")).alias("kind")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.endswith("w", F.lit(".")), F.col("n"))), F.lit(0)).alias("n_period"))


def _log(k: Column, x: Column) -> Column:
    """k * ln(x), and 0 for k = 0 whatever x is."""
    return F.when(k == 0, F.lit(0.0)).otherwise(k * F.ln(x))


def abbreviations(counts: DataFrame, least: float = LEAST_ABBREVIATION) -> DataFrame:
    """(kind, n, n_period, score) of the words whose score reaches `least`. counts: as word_counts gives them.

    The score is the likelihood ratio of "a period nearly always follows" against "as often as after any word", less for
    each letter, more for each period within, and much less for each time that it stands without one.
    """
    k, n = F.col("n_period"), F.col("n")
    totals = counts.agg(F.struct(F.sum("n").cast("double").alias("words"), F.sum("n_period").cast("double").alias("periods"))).scalar()
    rows = counts.filter("kind IS NOT NULL AND n_period > 0").withColumn("_t", totals)
    chance = F.col("_t.periods") / F.col("_t.words")
    ratio = -2 * (_log(k, chance) + _log(n - k, 1 - chance) - _log(k, F.lit(ALWAYS)) - _log(n - k, F.lit(1 - ALWAYS)))
    letters = F.length(F.replace("kind", F.lit("."), F.lit("")))
    score = ratio * F.exp(-letters) * (F.length("kind") - letters + 1) * F.pow(letters, k - n)
    return rows.select("kind", "n", "n_period", score.alias("score")).filter(F.col("score") >= least)


def sentence_starters(docs: DataFrame, counts: DataFrame, known: DataFrame, least: float = LEAST_STARTER, text: str = "text") -> DataFrame:
    """(kind, n, n_start, score) of words with a capital behind an end mark, where these come together more often than chance has
    it, with a likelihood ratio of at least `least`. known: abbreviations; periods behind these and behind single letters are no end marks."""
    words = docs.select(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("w"))
    both = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
    may_end = F.filter(both, lambda p: F.substr(p["a"], F.lit(-1)).isin(*".!?\"')]"))  # most pairs go before they become rows
    pairs = words.select(F.explode(may_end).alias("p")).select("p.a", "p.b")
    pairs = pairs.filter(F.col("a").rlike(r"""[.!?]["')\]]*$""")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.select(F.when(~F.col("a").rlike(r"""[!?]["')\]]*$"""), kind(bare(F.col("a")))).alias("before"), bare(F.col("b")).alias("b"), "n")
    pairs = pairs.filter("before IS NULL OR length(before) > 1").join(known.select(F.col("kind").alias("before")), "before", "left_anti")
    breaks = pairs.groupBy(F.when(F.col("b").rlike(r"^\p{Lu}"), kind(F.col("b"))).alias("kind")).agg(F.sum("n").alias("n_start"))
    breaks = written(breaks, "breaks")  # a row a word; its total is needed beside it
    words, ends = counts.agg(F.sum("n").cast("double")).scalar(), breaks.agg(F.sum("n_start").cast("double")).scalar()
    rows = breaks.filter("kind IS NOT NULL").join(counts.select("kind", "n"), "kind").withColumns({"_words": words, "_ends": ends})
    k, n, c, total = F.col("n_start"), F.col("n"), F.col("_ends"), F.col("_words")

    def likelihood(x: Column, y: Column) -> Column:
        return _log(k, x) + _log(c - k, 1 - x) + _log(n - k, y) + _log(total - c - n + k, 1 - y)

    score = -2 * (likelihood(n / total, n / total) - likelihood(k / c, F.try_divide(n - k, total - c)))
    return rows.select("kind", "n", "n_start", score.alias("score"), (k * total > n * c).alias("_more")).filter((F.col("score") >= least) & F.col("_more")).drop("_more")


@dataclass(frozen=True)
class Model:
    abbreviations: frozenset[str]
    starters: frozenset[str]


def _few(df: DataFrame, most: int) -> frozenset[str]:
    kinds = df.select("kind").limit(most + 1).collect()
    if len(kinds) > most:
        raise ValueError(f"more than {most} words reach the least score: raise it")
    return frozenset(r["kind"] for r in kinds)


def learn(docs: DataFrame, text: str = "text", least_abbreviation: float = LEAST_ABBREVIATION, least_starter: float = LEAST_STARTER, most: int = MOST_WORDS) -> Model:
    """The model of a corpus. It is sent to tasks, so more than `most` words of a kind are an error, not cut off. An empty corpus
    gives an empty model, with which every end mark before a capital or digit ends a sentence, but behind single letters."""
    counts = written(word_counts(docs, text), "words")
    known = written(abbreviations(counts, least_abbreviation), "abbreviations")
    return Model(_few(known, most), _few(sentence_starters(docs, counts, known, least_starter, text), most))


def _kind(word: str) -> str:
    return re.sub(_CLOSES, "", re.sub(_OPENS, "", word)).lower().removesuffix(".")


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """Starts and ends of sentences: cut behind end marks before a capital, digit or opening mark. Behind an abbreviation or a single
    letter only where the next word is a starter with a capital."""
    out, at = [], 0
    for m in _CANDIDATE.finditer(text):
        end, nxt = m.start(), m.end()
        if not (text[nxt].isupper() or text[nxt].isdigit() or text[nxt] in "(\"'["):
            continue
        if text[end - 1] == ".":
            first = end - 1
            while first > at and not text[first - 1].isspace():
                first -= 1
            before = _kind(text[first:end])
            if before in model.abbreviations or len(before) == 1 and before.isalpha():
                after = re.match(WORD, text[nxt : nxt + 80])[0]
                if not (re.sub(_OPENS, "", after)[:1].isupper() and _kind(after) in model.starters):
                    continue
        out.append((at, end))
        at = nxt
    if at < len(text):
        out.append((at, len(text)))
    return out or [(0, len(text))]
