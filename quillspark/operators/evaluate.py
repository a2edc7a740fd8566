"""Sampling and evaluation: stratified draws, confusion matrices, precision and recall."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import number_rows, written
from .roles import ROLES


def allocate(strata: DataFrame, n: int, least: int = 0, most: int = 0) -> DataFrame:
    """strata (stratum, stock) with the number to draw: the floor of the share, one more for the largest remainders (ties by
    stratum), at least `least` while there is stock, at most `most` if that isn't 0. One row a stratum: a small table."""
    every = Window.partitionBy()
    a = strata.withColumn("_raw", n * F.col("stock") / F.sum("stock").over(every)).withColumn("_base", F.floor("_raw"))
    a = a.withColumn("_left", F.lit(n) - F.sum("_base").over(every)).withColumn("_k", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("_raw") - F.col("_base")), "stratum")))
    drawn = F.least("stock", F.greatest(F.col("_base") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0), F.lit(least)))
    return a.select("stratum", "stock", (F.least(drawn, F.lit(most)) if most > 0 else drawn).cast("long").alias("n_draw"))


def ticket(*keys, seed: int = 42):
    """A row's place in a draw: a hash of its keys and the seed, which SQL engines agree on."""
    return F.md5(F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed))))


def draw(rows: DataFrame, plan: DataFrame, key: str, stratum: str = "stratum", seed: int = 42) -> DataFrame:
    """The planned number of rows of each stratum, those of the smallest ticket of key and seed, then key: reruns agree.

    The plan, one row a stratum, is written, so the optimizer sees its size and sends it to the rows. The smallest tickets
    are taken in two steps, within 256 parts of each stratum and then of what these leave, so that no task sorts a large
    stratum, however many of the rows it has.
    """
    drawn = written(plan.filter("n_draw > 0").select(F.col(stratum).alias("_stratum"), "n_draw"), "plan")
    out = rows.join(drawn, F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn("_ticket", ticket(key, seed=seed)).withColumn("_part", F.substring("_ticket", 31, 2))
    for by in ((stratum, "_part"), (stratum,)):
        w = Window.partitionBy(*by).orderBy("_ticket", key)
        out = out.withColumn("_k", F.row_number().over(w)).filter("_k <= n_draw")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns))


def numbered(rows: DataFrame, letter: str, *order) -> DataFrame:
    """rows with sample_id: the letter and four digits from 0001, in order."""
    return number_rows(rows, "sample_id", *order).withColumn("sample_id", F.format_string(f"{letter}%04d", F.col("sample_id") + 1))


def heldout(rows: DataFrame, floors: dict[str, int], quotas: dict[str, int], caps: dict[str, int], order: str = "key") -> DataFrame:
    """Quota sampler over rows (dataset, stratum, …). First the floors: each dataset, in the order given, gets rows until it has
    its floor, from classes that have a quota left, and never beyond its cap. Then each class, in the order given, is filled up to
    its quota, by datasets below their caps first; rows held back by a cap fill what is still open. Every row counts against
    the quota of its class; classes without a quota give none, and a cap of 0 shuts a dataset out.

    Rows of the same dataset and class are taken in order, and never more of them than the class's quota, so only so many of
    each are looked at, however many there are; that list is one small group.
    """

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        rows = [r for r in f.itertuples() if caps.get(r.dataset) != 0]
        left, used, taken = dict(quotas), {}, set()

        def capped(dataset) -> bool:
            return dataset in caps and used.get(dataset, 0) >= caps[dataset]

        def take(r) -> None:
            taken.add(r.Index)
            used[r.dataset] = used.get(r.dataset, 0) + 1
            left[r.stratum] -= 1

        for dataset, floor in floors.items():
            for r in rows:
                if r.dataset == dataset and used.get(dataset, 0) < floor and not capped(dataset) and left.get(r.stratum, 0) > 0:
                    take(r)
        for stratum in quotas:
            for over in (False, True):
                for r in rows:
                    if r.stratum == stratum and r.Index not in taken and left[stratum] > 0 and (over or not capped(r.dataset)):
                        take(r)
        return f.loc[[i for i in f.index if i in taken]].drop(columns=["__all", "__k"])

    most = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("stratum")), F.lit(0)) if quotas else F.lit(0)
    w = Window.partitionBy("dataset", "stratum").orderBy(order)
    some = rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most)
    return some.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(pick, rows.schema)


def agreement_subset(rows: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """A share of the rows, rounded half to even, at least one."""
    n = rows.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share)).cast("int").alias("n")).scalar()
    return number_rows(rows, "_k", ticket(key, seed=seed), F.col(key)).filter(F.col("_k") < n).drop("_k")


def without_gold(rows: DataFrame, gold: DataFrame, keys=("doc_id",)) -> DataFrame:
    return rows.join(gold.select(*keys).distinct(), list(keys), "left_anti")


def join_gold(gold: DataFrame, key: DataFrame) -> DataFrame:
    """gold with the model's answer and why it can't be scored, if it can't: no_key, unlabeled, unsure, badlabel, in this order."""
    k = key.select("sample_id", "role_source", "model_role", "role_confidence").withColumn("_k", F.lit(True))
    out = gold.join(k, "sample_id", "left")
    g = F.lower(F.trim(F.coalesce("gold_role", F.lit(""))))
    reason = F.when(F.col("_k").isNull(), "no_key").when(g == "", "unlabeled").when(g == "unsure", "unsure").when(~g.isin(*ROLES), "badlabel")
    return out.withColumn("gold_role", g).withColumn("reason", reason).drop("_k")


def confusion(pairs: DataFrame, labels=ROLES) -> DataFrame:
    """(gold, one column a label, total) with a last row `total`."""
    cells = [F.count_if(F.col("pred") == r).alias(r) for r in labels]
    known = pairs.filter(F.col("gold").isin(*labels) & F.col("pred").isin(*labels))
    return known.rollup("gold").agg(*cells, F.count(F.lit(1)).alias("total")).withColumn("gold", F.coalesce("gold", F.lit("total")))


def scores(pairs: DataFrame, labels=ROLES) -> DataFrame:
    """(role, precision, recall, f1, support) of each label, 0 where undefined, and accuracy and macro_f1 beside each. The
    labels stand for themselves: one without rows counts in the macro average."""
    counts = pairs.agg(*[F.count_if((F.col("gold") == r) & (F.col("pred") == r)).alias(f"tp_{i}") for i, r in enumerate(labels)], *[F.count_if(F.col("gold") == r).alias(f"g_{i}") for i, r in enumerate(labels)], *[F.count_if(F.col("pred") == r).alias(f"p_{i}") for i, r in enumerate(labels)], F.count_if(F.col("gold") == F.col("pred")).alias("ok"), F.count(F.lit(1)).alias("n"))
    rows = counts.select("ok", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"tp_{i}").alias("tp"), F.col(f"g_{i}").alias("g"), F.col(f"p_{i}").alias("p")) for i, r in enumerate(labels)))).alias("x")).select("ok", "n", "x.*")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = rows.withColumns({"precision": ratio(F.col("tp"), F.col("p")), "recall": ratio(F.col("tp"), F.col("g"))})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("role", "precision", "recall", "f1", F.col("g").alias("support"), ratio(F.col("ok"), F.col("n")).alias("accuracy"), F.avg("f1").over(Window.partitionBy()).alias("macro_f1"))


def accuracy_by(pairs: DataFrame, *keys: str, small: int = 10) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count_if(F.col("gold") == F.col("pred")).alias("n_ok"), F.count(F.lit(1)).alias("n")).withColumn("small", F.col("n") < small)


def swaps(pairs: DataFrame) -> DataFrame:
    """How often generated and used were taken for one another."""
    return pairs.agg(F.count_if(((F.col("gold") == "generated") & (F.col("pred") == "used")) | ((F.col("gold") == "used") & (F.col("pred") == "generated"))).alias("n_swaps"))


def confidence_bins(pairs: DataFrame, bounds=(0.8, 0.9, 1.0)) -> DataFrame:
    """Accuracy of answers with a numeric confidence, by bins below each bound and from the last on."""
    c = F.expr("try_cast(confidence as double)")
    name = None
    for b in bounds:
        name = F.when(c < b, f"<{b}") if name is None else name.when(c < b, f"<{b}")
    return accuracy_by(pairs.filter(c.isNotNull()).withColumn("bin", name.otherwise(f">={bounds[-1]}")), "bin")


def scoped(found: DataFrame, truth: DataFrame, keys=("doc_id", "id")) -> DataFrame:
    """Precision and recall by group, over the documents that both sides have; found and truth: (doc_id, id, grp)."""
    docs = found.select("doc_id").intersect(truth.select("doc_id"))
    f, t = (x.join(docs, "doc_id", "left_semi").select(*keys, "grp").distinct() for x in (found, truth))
    both = f.withColumn("_f", F.lit(1)).join(t.withColumn("_t", F.lit(1)), [*keys, "grp"], "full")
    out = both.groupBy("grp").agg(F.count("_f").alias("n_found"), F.count("_t").alias("n_truth"), F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("n_both"))
    return out.withColumns({"precision": F.coalesce(F.try_divide("n_both", "n_found"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("n_both", "n_truth"), F.lit(0.0))})


def missed(found: DataFrame, truth: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The groups with the most entries of truth that aren't found."""
    return truth.join(found.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("worker").agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_annotations", "elapsed")), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "skipped").alias("n_skipped"))


def throughput(runs: DataFrame, measure: str) -> DataFrame:
    return runs.agg(F.avg(measure).alias("mean"), F.median(measure).alias("median"), F.min(measure).alias("min"), F.max(measure).alias("max"))


def corpus_hours(chars_per_second: float, workers: int, corpus_chars: float = 1.8e11) -> float:
    """Hours that a corpus of so many characters takes."""
    return corpus_chars / (chars_per_second * workers) / 3600


def stratum(role, prior):
    """What a pre-pass row is sampled as: its role, else what its prior says, else mentioned."""
    r, p = F.trim(F.coalesce(role, F.lit(""))), F.trim(F.coalesce(prior, F.lit("")))
    return F.when(r.isin("used", "mentioned"), r).when(p == "generated", "generated").when(p.isin("used", "use"), "used").otherwise("mentioned")


def sample_distinct(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n distinct keys, those of the smallest ticket: reruns agree. Each task sends its own n at most."""
    return rows.select(*keys).distinct().orderBy(ticket(*keys, seed=seed), *keys).limit(n)


def sorted_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def markdown(rows: DataFrame) -> str:
    """A small report table as Markdown."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in rows.collect()])
