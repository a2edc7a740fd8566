"""URL filters: longest matching host and path rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import eights, mix, table

#: (action, rule): a host, then the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of the labelled table that the model is trained on by default: what hosts and paths to block are named after, what
#: others are named after, and harmless words that hold or begin like a word of the first kind.
BLOCKED_WORDS = """
casino poker slots slot roulette blackjack jackpot bingo lottery lotto bet bets betting sportsbet gamble gambling odds bonus win winner
prize giveaway claim pills pill pharma viagra cialis meds steroids diet-pill porn porno xxx sex sexy nude naked adult escort cams hookup
dating-now loan loans payday cash fast-cash credit-fix debt refinance forex bitcoin-doubler crypto-profit get-rich earn-money warez crack
cracked keygen serial torrent nulled cheat hacks replica rolex fake-watch cheap discount free deals clearance seo backlinks traffic clicks
click ads ad adserver banner popup track tracker tracking redirect affiliate referral spam bulk-mail phish login-verify account-update malware
"""
OTHER_WORDS = """
garden library museum school history music science weather travel recipe kitchen health clinic forum news journal archive atlas map
river mountain forest island harbor village city county council parish church temple university college institute academy research
lecture course lesson student teacher reading writing grammar poetry novel author press gazette herald tribune courier review essay
painting gallery theatre opera cinema film camera photo design studio craft pottery weaving knitting sewing cooking baking bread cheese
wine coffee tea farm orchard meadow flower botany bird whale horse dog cat animal planet star moon ocean climate energy solar bridge
railway tram bus cycle walking hiking climbing sailing rowing football tennis chess puzzle game toy model engine motor tool wood metal
stone glass paper ink code software kernel compiler network server data method theory proof number logic physics chemistry biology
medicine nurse doctor law justice statute history family house home street market trade museum bank post office service support manual
"""
HARMLESS_LOOKALIKES = """
winter window windmill wind winery alphabet better betony cashmere cashew crackers essex sussex middlesex sextant sexton freedom freeway
freezer adapter address advice admiral adventure tracks trackway loam serials cereal pillow pillar pilgrim claims-court creditable
accredit slotted-spoon dealer ideals bonsai prizewinner camshaft camera replicate hacksaw seoul traffic-lights popular pornic
"""
#: Placed around those words in both kinds of URL alike, so that none of it tells them apart.
_SUBDOMAINS = ("", "", "www.", "m.", "blog.", "shop.", "my.", "go.")
_ENDS = ("com", "org", "net", "info", "biz", "co", "site", "online", "eu", "io")
_PATHS = ("/", "", "/index.html", "/{n}", "/{n}.html", "/p/{n}/", "/page/{n}?ref=x", "/{y}/{m}/{n}", "/view?id={n}", "/a/{n}#top", "/category/{n}", "/{l}/{n}.html", "/{l}/{n}")
_LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl")


def labelled_table(seed: int = 5, each: int = 24) -> list[tuple[str, int]]:
    """(url, label) of an invented labelled table, 1 for those to block: some thousand rows, made by rule.

    Hosts to block hold a word of the first list, alone or beside another word or invented name; the others hold words
    of the other lists, or are invented names only. A quarter of the URLs to block have the word in the path of such a host
    instead. Subdomains, ends and the rest of the paths are dealt to both alike.
    """
    r = random.Random(seed)
    bad, good, near = BLOCKED_WORDS.split(), OTHER_WORDS.split(), HARMLESS_LOOKALIKES.split()

    def name():
        return "".join(r.choice(("", *"bcdfghjklmnprstvwz", "th", "st", "ch", "sh", "tr", "gr")) + r.choice(("a", "e", "i", "o", "u", "ea", "ou", "in", "on", "er", "an", "es", "al")) for _ in range(r.randrange(2, 5)))

    def harmless():
        return r.choice((r.choice(good), r.choice(good), r.choice(near), name(), name()))

    def host(first, second):
        parts = [first, second] if r.random() < 0.5 else [second, first]
        return r.choice(_SUBDOMAINS) + r.choice(("-", "-", "")).join(x for x in parts if x) + str(r.choice(("", "", "", r.randrange(1, 999)))) + "." + r.choice(_ENDS)

    def path():
        return r.choice(_PATHS).format(n=r.randrange(1, 99999), y=r.randrange(1998, 2025), m=r.randrange(1, 13), l=r.choice(_LANGUAGES))

    def rows():
        for word in bad:
            for k in range(each):
                if k % 4 == 3:
                    yield host(harmless(), ""), f"/{word}{r.choice(('', '-', '/'))}{r.choice(bad)}{path()}", 1
                else:
                    yield host(word, r.choice((r.choice(bad), harmless(), harmless(), ""))), path(), 1
        for word in good + near + [name() for _ in range(8 * len(good))]:
            for k in range(max(1, each // 4)):
                yield host(word, r.choice((harmless(), ""))), f"/{harmless()}-{harmless()}{path()}" if k % 2 else path(), 0

    return [(f"{r.choice(('http', 'https'))}://{h}{p}", y) for h, p, y in rows()]


def labelled_urls(spark) -> DataFrame:
    return spark.createDataFrame(labelled_table(), "url string, label int")


def split_by_host(labelled: DataFrame, held: float = 0.2, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two parts of a labelled table, so that all URLs of a host are in the same one; about `held` of the hosts in the second."""
    there = F.pmod(F.xxhash64(host_and_path(F.col("url"))[0], F.lit(seed)), F.lit(1000)) < round(1000 * held)
    return labelled.filter(~there), labelled.filter(there)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. The path: from there up to
    ``?``, ``#`` or the end. Both are empty where the url is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or a parent of it, and whose path starts the url's."""
    name = action = None
    for act, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


@dataclass(frozen=True)
class UrlModel:
    """Weights of hashed n-grams of 3 to 5 bytes of ``^host|path$``, host and path in lower case, each gram counted once for each place and scaled by the URL's length."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Log odds of blocking."""
        rows, cells = url_grams(hosts, paths, self.sizes, len(self.weights))
        n = np.bincount(rows, minlength=len(hosts))
        return np.bincount(rows, self.weights[cells], len(hosts)) / np.sqrt(np.maximum(n, 1)) + self.bias


def url_grams(hosts: list[str], paths: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(url, bucket) of each n-gram."""
    texts = [f"^{h}|{p.lower()}$".encode("utf-8", "replace") for h, p in zip(hosts, paths, strict=True)]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.cumsum(size)
    view = eights(np.frombuffer(b"".join(texts) + b"\0" * 8, dtype=np.uint8))[: int(end[-1]) if len(end) else 0]
    url, left = np.repeat(np.arange(len(texts)), size), np.repeat(end, size) - np.arange(len(view))
    rows, cells = [], []
    for n in sizes:
        ok = left >= n
        rows.append(url[ok])
        cells.append((mix((view[ok] & np.uint64((1 << (8 * n)) - 1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cells)


def train(labelled: DataFrame, buckets: int = 1 << 16, most_rows: int = 50_000, steps: int = 200, rate: float = 1.0, decay: float = 1e-4, momentum: float = 0.9) -> UrlModel:
    """Logistic regression by full-batch gradient descent with momentum. labelled: url, label (1: block); at most `most_rows` rows are
    taken, those of the smallest hash. Rows without a label are left out; with no rows, nothing is ever blocked."""
    host, path = host_and_path(F.col("url"))
    found = labelled.filter("label is not null").select(host.alias("h"), path.alias("p"), F.col("label").cast("int").alias("y")).orderBy(F.xxhash64("h", "p"), "h", "p", "y").limit(most_rows).collect()
    weights = np.zeros(buckets)
    if not found:
        return UrlModel(weights, -1.0)
    model, y = UrlModel(weights, 0.0), np.array([r["y"] for r in found], dtype=float)
    rows, cells = url_grams([r["h"] for r in found], [r["p"] for r in found], model.sizes, buckets)
    scale, bias = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1)), 0.0
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels count alike
    step, step_bias = np.zeros(buckets), 0.0
    for _ in range(steps):
        z = np.bincount(rows, weights[cells], len(y)) * scale + bias
        pull = (1 / (1 + np.exp(-z)) - y) * share
        step = momentum * step - rate * (np.bincount(cells, (pull * scale)[rows], buckets) * 8 + decay * weights)
        step_bias = momentum * step_bias - rate * pull.sum()
        weights += step
        bias += step_bias
    return UrlModel(weights, bias)


def report(model: UrlModel, labelled: DataFrame) -> dict[str, float]:
    """Precision and recall of blocking, and rows, on labelled URLs, by the model alone; a ratio of nothing is 0."""
    judged = judge_urls(labelled.filter("label is not null"), model, rules=())
    said, true = F.col("verdict") == "block", F.col("label") == 1
    r = judged.agg(F.count_if(said & true).alias("both"), F.count_if(said).alias("said"), F.count_if(true).alias("true"), F.count(F.lit(1)).alias("rows")).first()
    return {"precision": r["both"] / max(1, r["said"]), "recall": r["both"] / max(1, r["true"]), "rows": r["rows"]}


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (log odds of blocking). A rule decides where one fits, else the model:
    block where the score is above 0. Null and empty URLs have empty parts and are scored as such; columns of those names are replaced."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, action = rule_for(F.col("host"), F.col("path"), rules)

    @F.pandas_udf("double")
    def score(h, p):
        import pandas as pd

        return pd.Series(model.scores(h.tolist(), p.tolist()))

    return out.withColumns({"rule": rule, "score": score("host", "path")}).withColumn("verdict", F.coalesce(action, F.when(F.col("score") > 0, "block").otherwise("allow")))


def op8(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
