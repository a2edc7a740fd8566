"""Data sources against a local HTTP server that gives recorded answers."""

import gzip
import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.sources import formats


class Service(ThreadingHTTPServer):
    """Recorded: subjects of a graph, accessions of records, pages by path. `asked` are the ids of each question."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.subjects, self.records, self.pages, self.asked = set(), set(), {}, []
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, code, body):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
        if "query" in form:
            ids = re.findall(r"<http://x/([^>]+)>", form["query"])
            body = json.dumps({"results": {"bindings": [{"s": {"value": f"http://x/{i}"}} for i in ids if i in self.server.subjects]}})
        elif "term" in form:
            ids = [form["term"].removesuffix("[ACCN]")]
            body = json.dumps({"esearchresult": {"count": str(int(ids[0] in self.server.records))}})
        else:
            ids = form["id"].split(",")
            body = "\n".join(f"{i}.1" for i in ids if i in self.server.records)
        self.server.asked.append(ids)
        self.answer(200, body.encode())

    def do_GET(self):
        page = self.server.pages.get(urllib.parse.unquote(self.path))
        self.answer(404 if page is None else 200, page or b"")


@pytest.fixture
def service(spark):
    formats.register(spark)
    s = Service()
    yield s
    s.shutdown()


def read(spark, service, kind, ids, **options):
    return spark.read.format(kind).options(endpoint=service.url, ids=ids, db="x", **options).load()


def test_lookups_of_all_parts(spark, sf, service, tmp_path):
    ids = f"file://{tmp_path}/ids"
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("A"), "p_partkey").alias("id"), "p_name")
    parts.repartition(3).write.parquet(ids)
    every = {r["id"] for r in parts.collect()}
    service.subjects = service.records = {r["id"] for r in parts.filter("p_name LIKE '%red%' OR p_name LIKE 'small%'").collect()}
    assert 0 < len(service.subjects) < len(every)
    for kind, other, options in (("sparql", "pending", {"namespace": "http://x/", "graph": "http://g"}), ("records", "absent", {}), ("search", "absent", {"batch": 7})):
        service.asked.clear()
        df = read(spark, service, kind, ids, **options)
        assert df.rdd.getNumPartitions() == 3
        got = [tuple(r) for r in df.collect()]
        assert sorted(got) == sorted(("x", i, "confirmed" if i in service.subjects else other) for i in every)
        assert max(map(len, service.asked)) <= 200
    service.pages = {f"/P:{i}": b"{}" for i in service.records}
    assert {r["id"] for r in read(spark, service, "genes", ids, prefix="P:").filter("answer = 'confirmed'").collect()} == service.records


def test_filters_keep_ids_from_being_asked(spark, service, tmp_path):
    ids = f"file://{tmp_path}/ids"
    spark.createDataFrame([(f"A{i % 50}", 1) for i in range(100)] + [(None, 2)], "id string, id_of int").coalesce(1).write.parquet(ids)
    service.subjects = {"A1", "A3"}
    df = read(spark, service, "sparql", ids, namespace="http://x/")
    assert df.count() == 50
    service.asked.clear()
    got = df.filter("id IN ('A1', 'A2', 'B') AND id <> 'A9' AND answer = 'confirmed'").collect()
    assert [r["id"] for r in got] == ["A1"] and sorted(sum(service.asked, [])) == ["A1", "A2"]
    service.asked.clear()
    assert df.filter("id = 'A1' AND id IN ('A2', 'A3')").collect() == [] and service.asked == []
    spark.createDataFrame([], "id string").coalesce(1).write.parquet(f"{ids}-none")
    assert read(spark, service, "sparql", f"{ids}-none", namespace="http://x/").collect() == []


def test_index_as_batch_and_stream(spark, service, tmp_path):
    page = lambda *files: "".join(f'<a href="{f}">' for f in ("README.txt", "../", *files)).encode()
    service.pages = {"/d/": page("a.csv", "b.tsv.gz"), "/d/a.csv": b"id,name\n1,one\n2,two\n", "/d/b.tsv.gz": gzip.compress(b"name\tid\nthree\t3\n"), "/d/c.txt": b"id;more\n4;x\n", "/d/e.csv": b""}
    place = f"{service.url}/none/ {service.url}/d/"
    index = lambda r: r.format("index").schema("id string, name string").option("wait", "0").load(place)
    df = index(spark.read)
    assert df.rdd.getNumPartitions() == 2 and sorted(map(tuple, df.collect())) == [("1", "one"), ("2", "two"), ("3", "three")]

    def run():
        q = index(spark.readStream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.schema("id string, name string").parquet(f"file://{tmp_path}/out").collect()))

    assert run() == [("1", "one"), ("2", "two"), ("3", "three")]
    service.pages["/d/"] = page("c.txt", "b.tsv.gz", "e.csv", "a.csv")
    service.pages["/d/a.csv"] = None  # read before, so not asked for again
    assert run() == [("1", "one"), ("2", "two"), ("3", "three"), ("4", None)]
    assert run() == [("1", "one"), ("2", "two"), ("3", "three"), ("4", None)]
    service.pages["/d/"] = page()
    assert index(spark.read).collect() == []
