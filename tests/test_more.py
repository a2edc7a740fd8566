"""Broken articles, indexes with fallbacks, commands, stage clock, numbering by ranges."""

import gzip
import urllib.error

import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as cli
from quillspark.operators import verify
from quillspark.plans import jobs
from quillspark.sources import articles, connectors, places

GOOD = '<article><front><article-meta><article-id pub-id-type="pmc">7</article-id><title-group><article-title>A title &amp; more</article-title></title-group></article-meta></front><body><sec><title>Methods</title><p>First part.</p><p>Second part.</p></sec></body></article>'


def texts(xml):
    d = articles.parse_article(xml if isinstance(xml, bytes) else xml.encode(), "x")
    return d and (d["id"], [(p["text"], p["infon"]["section_type"]) for p in d["passages"]])


def test_broken_articles_are_read_as_far_as_they_go():
    whole = texts(GOOD)
    assert whole == ("PMC7", [("A title & more", "title"), ("First part. Second part.", "methods")])
    assert texts(GOOD.replace("</article>", "")) == whole and texts(GOOD.replace("</p></sec>", "</sec>")) == whole
    assert texts(GOOD.replace("First", "First &nbsp;&nobody; <")) == ("PMC7", [whole[1][0], ("First &nobody; < part. Second part.", "methods")])
    assert texts(GOOD.replace("</p><p>", "</i></p><p>")) == whole and texts(GOOD + "<tail>no</tail>") == whole
    assert texts(GOOD[: GOOD.index("Second")]) == ("PMC7", [whole[1][0], ("First part.", "methods")])
    assert texts(GOOD.replace("First", "<![CDATA[1 < 2]]><!-- gone --> First").replace("</article>", "")) == ("PMC7", [whole[1][0], ("1 < 2 First part. Second part.", "methods")])
    for nothing in ("", "no markup", "<article>", "<", "</p>"):
        assert texts(nothing) is None
    assert articles.recover(GOOD.encode()).find(".//article-id").get("pub-id-type") == "pmc"
    assert texts(b"<?xml version='1.0' encoding='no-such'?>" + GOOD.encode()) == whole


def test_index_falls_back():
    pages = {"http://a/x": (404, b""), "ftp://b/d/": (200, b'<a href="README.txt">r</a> <a href="list.csv.gz">l</a>'), "ftp://b/d/list.csv.gz": (200, gzip.compress(b"id;name\n1;one\n2;two\n"))}

    def send(url, data=None, headers=None):
        if url == "http://down/":
            raise urllib.error.URLError("down")
        return pages[url]

    assert connectors.read_index(["http://down/", "http://a/x", "ftp://b/d/"], send, tries=1, wait=0) == [{"id": "1", "name": "one"}, {"id": "2", "name": "two"}]
    with pytest.raises(OSError, match="404"):
        connectors.fetch_first(["http://a/x"], send, tries=1, wait=0)


def test_numbering_by_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k long").repartition(5)
    assert all(r.n == r.k for r in places.number_rows(df, "n", "k").collect())
    assert places.number_rows(df.limit(0), "n", "k").count() == 0


def test_known_ids_by_a_join(spark):
    c = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1")], "db string, id string")
    got = verify.look_up_known(c, spark.createDataFrame([("a", "1"), ("a", "1")], "db string, id string")).collect()
    assert sorted(map(tuple, got)) == [("a", "1", "confirmed"), ("a", "2", "absent"), ("b", "1", "absent")]


def test_concept_commands_and_clock(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    spark.createDataFrame([("D1", 0, 0, "title", "insulin and glucose"), ("D1", 1, 20, "body", "insulin again")], "doc_id string, passage_idx int, offset long, passage_type string, text string").write.parquet(f"{out}/passages")
    (tmp_path / "names.tsv").write_text("insulin\tgene\nglucose\tchemical\n")
    (tmp_path / "known.tsv").write_text("gene\tinsulin\tNCBIGene:3630\n")
    cli.main(["annotate", "--out", out, "--names", f"file://{tmp_path}/names.tsv"])
    cli.main(["aggregate", "--out", out])
    cli.main(["link", "--out", out, "--dictionary", f"file://{tmp_path}/known.tsv"])
    cli.main(["inject", "--out", out])
    got = sorted((r.surface, r.identifier, r.identifier_source) for r in spark.read.parquet(f"{out}/injected").collect())
    assert got == [("glucose", None, "unlinked")] + [("insulin", "NCBIGene:3630", "phase3b_contextfree_linker")] * 2
    cli.main(["sample", "--input", f"{out}/injected", "--out", out, "--size", "2", "--key", "ann_id", "--stratum", "entity_type"])
    assert spark.read.parquet(f"{out}/sample").count() == 2
    clock = jobs.StageClock()
    clock.write("twice", spark.range(5).withColumn("x", F.lit(1)), f"{out}/five")
    (r,) = clock.report(spark).collect()
    assert (r.stage, r.n_rows, r.share) == ("twice", 5, 1.0) and r.seconds > 0
