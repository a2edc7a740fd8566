"""The jobs end to end over a few articles, through the command line."""

import http.server
import json
import threading

import pytest

from quillspark.__main__ import main
from quillspark.operators import concept, evaluate, extract, verify
from quillspark.plans import jobs
from quillspark.sources import tables

ARTICLE = """<article><front><article-meta><article-id pub-id-type="pmc">{n}</article-id><title-group><article-title>Study {n}</article-title></title-group></article-meta></front>
<body><sec sec-type="methods"><p>Reads were deposited under GSE{n}00. Others were aligned to the reference genome NM_00000{n}.1 of the set.</p></sec></body></article>"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    for n in range(1, 6):
        (root / "xml").mkdir(exist_ok=True)
        (root / f"xml/a{n}.xml").write_text(ARTICLE.format(n=n))
    (root / "xml/broken.xml").write_text("<article>")
    return root


def test_articles_to_roles(spark, folder):
    out = f"file://{folder}/out"
    main(["plan", "--input", f"file://{folder}/xml", "--out", out, "--shard-size", "2"])
    assert spark.read.parquet(f"{out}/shards").select("shard_id").distinct().count() == 3
    main(["preprocess", "--input", f"file://{folder}/xml", "--out", out, "--shard-size", "2"])
    assert spark.read.parquet(f"{out}/documents").count() == 5
    main(["extract", "--out", out])
    hits = spark.read.parquet(f"{out}/accessions")
    assert {(r.doc_id, r.surface) for r in hits.collect()} == {(f"PMC{n}", s) for n in range(1, 6) for s in (f"GSE{n}00", f"NM_00000{n}.1")}
    texts = concept.full_text(spark.read.parquet(f"{out}/passages"))
    assert tuple(concept.offset_round_trip(hits, texts).first()) == (10, 0)
    main(["candidates", "--out", out])
    main(["inspect", "--out", out])
    spark.createDataFrame([("geo_series", f"GSE{n}00") for n in range(1, 5)] + [("refseq_rna", "NM_000001.1")], "db string, id string").write.parquet(f"{out}/known")
    main(["verify", "--out", out, "--known", f"{out}/known"])
    (folder / "years.tsv").write_text("".join(f"PMC{n}\t20{n}0\n" for n in range(1, 5)) + "PMC5\tNA\n")
    main(["metrics", "--out", out, "--verified", f"{out}/verified", "--doc-year", f"file://{folder}/years.tsv"])
    entries = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/usage_by_entry")
    assert entries.count() == 5 and entries.filter("class = 'deposited_research_record'").count() == 4
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{out}/usage_by_year").count() == 4
    main(["roles", "--out", out])
    got = {(r.doc_id, r.dataset): (r.role, r.prior, r.note) for r in spark.read.parquet(f"{out}/role_prelim").collect()}
    assert got[("PMC1", "refseq_rna")] == ("used", "", "ref_resource_use")
    assert got[("PMC2", "geo_series")][1:] == ("generated", "gen_dep")


def test_concept_phases(spark, folder):
    out = f"file://{folder}/concept"
    jobs.preprocess(spark, f"file://{folder}/xml", out)
    steps = {
        "annotate": lambda: jobs.annotate(spark, out, extract.DictionaryTagger({"genome": "thing", "Reads": "thing"})),
        "aggregate": lambda: jobs.aggregate(spark, out),
        "link": lambda: jobs.link(spark, out, lambda kind, names: [f"X:{n}" if n == "genome" else None for n in names]),
        "inject": lambda: jobs.inject(spark, out),
    }
    assert jobs.run(steps, first="aggregate", plan_only=True, n_shards=571) == ["aggregate", "link", "inject", "about 10.0 hours"]
    assert jobs.run(steps) == ["annotate", "aggregate", "link", "inject"]
    n = {r.identifier_source: r.n for r in concept.injection_summary(spark.read.parquet(f"{out}/injected")).collect()}
    assert n == {"phase3b_contextfree_linker": 5, "unlinked": 5}
    assert tables.first_readable(spark, f"{out}/nothing", f"{out}/injected").count() == 10


def test_tagging_by_a_vocabulary(spark, folder):
    out = f"file://{folder}/tagged"
    jobs.preprocess(spark, f"file://{folder}/xml", out)
    (folder / "names.tsv").write_text("name\tentity_type\ngenome\tthing\nReads\tthing\n")
    main(["annotate", "--out", out, "--names", f"file://{folder}/names.tsv"])
    got = spark.read.parquet(f"{out}/annotations")
    jobs.annotate(spark, f"{out}", extract.DictionaryTagger({"genome": "thing", "Reads": "thing"}))
    columns = ["doc_id", "passage_idx", "ann_id", "surface", "entity_type", "offset", "length", "score"]
    again = spark.read.parquet(f"{out}/annotations")
    assert sorted(map(tuple, again.select(columns).collect())) and got.columns  # the first table was replaced
    one = sorted(map(tuple, again.select(columns).collect()))
    jobs.annotate_names(spark, out, spark.createDataFrame([("genome", "thing"), ("Reads", "thing")], "name string, entity_type string"))
    assert sorted(map(tuple, spark.read.parquet(f"{out}/annotations").select(columns).collect())) == one


class Chat(http.server.BaseHTTPRequestHandler):
    """Recorded answers by the first id of a payload; one payload breaks the first time it is asked."""

    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        ids = body["messages"][1]["content"].rpartition("ids: ")[2].split(", ")
        Chat.asked.append(ids)
        if ids[0] == "E2" and Chat.asked.count(ids) == 1:
            self.send_response(503)
            self.end_headers()
            return
        content = "no json" if ids[0] == "E9" else json.dumps({"results": [{"id": i, "role": "used", "confidence": "0.9", "evidence_span": "s"} for i in ids]})
        data = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def test_asking_a_model(spark, tmp_path):
    out = f"file://{tmp_path}"
    docs = [(f"D{i}", 0, [f"E{i}", f"F{i}"]) for i in (1, 2, 9)]
    spark.createDataFrame([(d, c, 2, ids, f"x\n\nids: {', '.join(ids)}", "lower", 240, 5, "sys") for d, c, ids in docs], "doc_id string, chunk int, n_entities int, expected_ids array<string>, user_text string, tier string, max_tokens int, n_tokens int, system_text string").write.parquet(f"{out}/payloads")
    spark.createDataFrame([(d, "geo", i, "c", "", "none", "", True) for d, _, ids in docs for i in ids] + [("D1", "pfam", "R", "c", "generated", "", "rule", False)], "doc_id string, dataset string, id string, class string, role string, prior string, note string, to_llm boolean").write.parquet(f"{out}/role_prelim")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        for _ in range(2):
            main(["ask", "--out", out, "--url", url, "--url", url, "--model", "m", "--tries", "2"])
            got = {(r.doc_id, r.id): (r.role, r.role_source) for r in spark.read.parquet(f"{out}/roles").collect()}
            assert got == {("D1", "E1"): ("used", "llm"), ("D1", "F1"): ("used", "llm"), ("D2", "E2"): ("used", "llm"), ("D2", "F2"): ("used", "llm"), ("D9", "E9"): ("error", "llm"), ("D9", "F9"): ("error", "llm"), ("D1", "R"): ("generated", "rule")}
    finally:
        server.shutdown()
    # answered documents are asked once, the one that breaks once more, the one without an answer each time
    assert sorted(x[0] for x in Chat.asked) == ["E1", "E2", "E2", "E9", "E9", "E9", "E9"]


def test_small_helpers(spark):
    assert verify.scrape_routes("ROUTER = {'a': 'b', \"c\": \"d-e\"}") == [("a", "b"), ("c", "d-e")]
    hits = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "db string, surface string")
    assert [(r.db, r.n, r.covered) for r in verify.probe_databases(hits, lambda db: db == "x" or 1 / 0).collect()] == [("x", 2, True), ("y", 1, False)]
    present = spark.createDataFrame([("g", "n", "1", "subject"), ("h", "n", "2", "subject"), ("g", "n", "3", "object"), ("g", "m", "4", "subject")], "graph string, ns string, id string, place string")
    want = spark.createDataFrame([("d", "g", "n", str(i)) for i in range(1, 6)], "db string, graph string, ns string, id string")
    assert {r.id: r.reason for r in verify.diagnose(present, want).collect()} == {"1": "found", "2": "graph_mismatch", "3": "object_only", "4": "wrong_namespace", "5": "missing"}
    a, b = spark.createDataFrame([("1", "x_y z_w x_y")], "doc_id string, text string"), spark.createDataFrame([("1", "x_y z w")], "doc_id string, text string")
    assert {(r.token, r.n_before, r.n_after) for r in concept.kept_tokens(a, b).collect()} == {("x_y", 2, 1), ("z_w", 1, 0)}
    assert round(evaluate.corpus_hours(1e6, 4), 1) == 12.5
    assert concept.of_top_documents(a.union(b), 1).count() == 2 and concept.long_enough(a, 500).count() == 0
