"""Usage tables by delivery against the batch tables over all documents."""

import time

from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators import usage
from quillspark.streaming import usage_stream

HITS = "array<struct<dataset:string,id:string,oracle:string,confidence:string,offset:bigint>>"
SCHEMA = f"doc_id string, hits {HITS}, class string"


def references(docs):
    return docs.drop("class").select("doc_id", F.inline("hits")).join(rules.db_classes(docs.sparkSession), "dataset", "left").withColumn("class", F.coalesce("class", F.lit(rules.OUT_OF_SCOPE)))


def doc(k, n=3):
    return (f"D{k}", [(("geo_series", "pfam", "strange")[(k + j) % 3], f"I{(k * j) % 5}", "o", "high", j) for j in range(n)], "an extra column")


def run(spark, base, **options):
    q = usage_stream.count_new(spark, f"{base}/in", SCHEMA, references, f"{base}/usage", f"{base}/state", **options)
    q.awaitTermination()
    return q


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(spark, base, docs):
    batch = references(spark.createDataFrame(docs, SCHEMA)) if docs else references(spark.createDataFrame([], SCHEMA))
    for name in ("by_entry", "by_db", "by_class"):
        assert rows_of(getattr(usage_stream, name)(spark, f"{base}/usage")) == rows_of(getattr(usage, name)(batch)), name


def deliver(spark, base, docs):
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_three_deliveries(spark, tmp_path):
    base = f"file://{tmp_path}"
    deliver(spark, base, [])
    run(spark, base)
    same(spark, base, [])
    first = [doc(k) for k in range(10, 20)]
    deliver(spark, base, [*first, first[0], (None, doc(1)[1], "x"), ("D99", None, None), ("D98", [], "")])  # a repeat, no id, no hits
    run(spark, base)
    same(spark, base, first)
    late = [doc(k) for k in range(10)]
    deliver(spark, base, [*late, *first[:3], (first[4][0], doc(70)[1], "another version")])
    run(spark, base)
    same(spark, base, first + late)
    last = [doc(k, 5) for k in range(20, 40)]
    deliver(spark, base, [*last[:10], *late])
    deliver(spark, base, [*last[5:], *first])
    run(spark, base)
    run(spark, base)  # nothing new
    same(spark, base, first + late + last)


def test_versions_in_one_batch(spark, tmp_path):
    got = set()
    for n, order in enumerate((1, -1)):
        base = f"file://{tmp_path}/{n}"
        deliver(spark, base, [("D1", doc(1)[1], "a"), ("D1", doc(2)[1], "b")][::order])
        run(spark, base)
        got.add(tuple(rows_of(usage_stream.by_entry(spark, f"{base}/usage"))))
    assert len(got) == 1


def test_a_batch_again(spark, tmp_path):
    """A batch that is called twice, or broken off before its last part, counts once or not at all."""
    base = f"file://{tmp_path}"
    deliver(spark, base, [doc(k) for k in range(4)])
    run(spark, base)
    more = spark.createDataFrame([doc(3), doc(7)], SCHEMA).withColumn("_print", F.xxhash64("doc_id"))
    usage_stream.merge(more, 5, references, f"{base}/usage")
    usage_stream.merge(more, 5, references, f"{base}/usage")
    same(spark, base, [doc(k) for k in (0, 1, 2, 3, 7)])
    spark.createDataFrame([("geo_series", "I0", "c", "o", 9, 9)], usage_stream._SUMS["entries"]).write.parquet(f"{base}/usage/entries/batch=6")
    same(spark, base, [doc(k) for k in (0, 1, 2, 3, 7)])


def test_state_is_bounded(spark, tmp_path):
    """State forgets what is older than `within`; a document that comes back after that still counts once."""
    base, sent, sizes = f"file://{tmp_path}", [], []
    for n in range(4):
        some = [doc(k) for k in range(n * 50, n * 50 + 50)]
        sent += some
        deliver(spark, base, [*some, *sent[:5]])
        q = run(spark, base, within="1 second")
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(1.5)
    assert sizes[-1] < 150 < len(sent)
    same(spark, base, sent)
