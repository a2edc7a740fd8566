"""Small goldens of the operators."""

import gzip
import json

from pyspark.sql import functions as F

from quillspark.functions import compiler, rules
from quillspark.functions import text as X
from quillspark.operators import compare, concept, evaluate, extract, roles, verify, windows
from quillspark.sources import articles, connectors, registry, shards, tables
from quillspark.streaming import incremental


def test_injection_keeps_known_ids(spark):
    ann = spark.createDataFrame([("PMC1", "TP53", "gene", None), ("PMC1", "p53", "gene", "NCBIGene:7157"), ("PMC1", "cancer", "disease", None), ("PMC2", "HeLa", "cell_line", None), ("PMC2", "TP53", "gene", None)], "doc_id string, surface string, entity_type string, identifier string")
    d = concept.merge_dictionaries([spark.createDataFrame([("TP53", "gene", "NCBIGene:7157"), ("p53", "gene", "x")], "surface string, entity_type string, identifier string"), spark.createDataFrame([("cancer", "disease", "MESH:D009369")], "surface string, entity_type string, identifier string")])
    got = {(r.doc_id, r.surface): (r.identifier, r.identifier_source) for r in concept.inject_ids(ann, d).collect()}
    assert got[("PMC1", "TP53")] == ("NCBIGene:7157", "phase3b_contextfree_linker")
    assert got[("PMC1", "p53")] == ("NCBIGene:7157", "phase1_short_linker")
    assert got[("PMC2", "HeLa")] == (None, "unlinked")
    assert got[("PMC1", "cancer")][0] == "MESH:D009369"


FALSE = "dbsnp:rs1 dbsnp:rs2 dbsnp:rs3 dbsnp:rs6 dbsnp:rs24 dbsnp:rs48 dbsnp:rs120 dbsnp:rs168 biosample:SAMDC1 biosample:SAME40 biosample:SAMD4 biosample:SAMD9 sra_project:SRP1001 sra_project:ERP2518 sra_project:ERP0206 sra_run:ERR9555 sra_experiment:ERX13412 sra_experiment:SRX07711 sra_sample:SRS30216 sra_accession:DRA0277 sra_accession:DRA0311".split()
TRUE = "dbsnp:rs1339067 dbsnp:rs1048771 sra_project:SRP000031 sra_project:SRP000799 sra_run:SRR003196 sra_run:ERR001087 sra_experiment:SRX007710 sra_experiment:SRX001455 sra_sample:SRS003157 sra_accession:DRA030922 geo_series:GSE1073 geo_series:GSE1407 geo_sample:GSM10917 geo_sample:GSM1654 pdb:1CPC pdb:2CHS pdb:3ERE ena:AF011567 ena:AY057379 ena:AB020640".split()


def test_gate_audit(spark):
    rows = [(x.split(":")[0], x, x in TRUE) for x in FALSE + TRUE]
    t = spark.createDataFrame(rows, "db string, identifier string, ok boolean").withColumn("g", X.gate(F.col("db"), F.col("identifier")))
    assert len(rows) == 41 and t.filter("g.gate_pass <> ok").count() == 0
    more = spark.createDataFrame([("ena", "A1"), ("pfam", None), ("togovar", "tgv1"), ("zzz", "a"), ("pdb", "ABCD"), ("geo_series", "GSE1\n"), (None, "x")], "db string, identifier string").select(X.gate(F.col("db"), F.col("identifier")).alias("g")).select("g.gate_reason").collect()
    assert [r[0] for r in more] == ["floor<None", "empty", "excluded", "no-rule", "structure", "pass-structure", "no-rule"]


def test_extraction_shadowing_and_ties():
    find = extract.Extractor(extract.catalog_patterns())
    hits = lambda t: [(h[1], h[0]) for h in find(t)]
    assert hits("PRJNA1 CHEMBL25 HP:0000001 MGI:12345 R-HSA-1 LRG_1 WBGene00000001") == [("bioproject", "PRJNA1"), ("chembl_compound", "CHEMBL25"), ("hp_inheritance", "HP:0000001"), ("mgi_allele", "MGI:12345"), ("reactome_pathway", "R-HSA-1"), ("ensembl_gene", "LRG_1"), ("ensembl_gene", "WBGene00000001")]
    assert hits("nothing here") == [] and hits("") == [] and find(None) == []
    assert hits("LRG_12t3") == [("ensembl_transcript", "LRG_12t3")]
    assert len(rules.CATALOG_PATTERNS) == 88 and len(rules.CLASS_OF) == 53
    hand = extract.Extractor(extract.hand_patterns(), longest_first=False)
    assert [h[0] for h in hand("pdb" + " " * 77 + "1abc")] == ["1abc"]
    assert [h[0] for h in hand("pdb" + " " * 78 + "1abc")] == []
    assert [h[:1] for h in hand("PDB 1234")] == []


def test_extraction_equals_plain_scans():
    import random
    import re

    r = random.Random(7)
    bits = ["GSE12", "AT1G12345", "AT G12345", "EC 1.2.3.4", "EC:1.1.1.1", "10.1234/ab.c", "PDB", "1abc", "uniprot", "P12345", "P12345-2", "MGI:123456", "CVCL:ABCD", "ORDO:XY", "tA:AGC)B", "x_at", "123_at", "word", "(", ")", ".", ",", "-", "Ensembl", "ENSG00000000001.2", "é"]
    for patterns, longest in ((extract.catalog_patterns(), True), (extract.hand_patterns(), False)):
        fast, slow = extract.Extractor(patterns, longest), extract.Extractor(patterns, longest)
        slow.scanner.matches = lambda text, patterns=patterns: ((k, *m.span()) for k, p in enumerate(patterns) for m in re.finditer(p.regex, text))
        assert fast("x") == []
        for _ in range(400):
            t = "".join(r.choice(bits) + r.choice([" ", "\n", "", "; "]) for _ in range(25))
            assert fast(t) == slow(t), t


def test_resolution_matches_python(spark):
    import random

    r = random.Random(3)
    rows = [(k, r.randrange(60), r.randrange(1, 9), r.choice(["high", "context"]), n) for k in range(20) for n in range(12)]
    got = extract.resolve_native(spark.createDataFrame(rows, "doc_id int, offset int, length int, confidence string, pattern_no int"), ["doc_id"]).collect()
    want = set()
    for k in range(20):
        end = 0
        for _, o, n, c, p in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], -x[2], x[3] != "high", x[4])):
            if o >= end:
                want.add((k, o, n, c, p))
                end = o + n
    assert {(x.doc_id, x.offset, x.length, x.confidence, x.pattern_no) for x in got} == want


XML = b"""<article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><article-id pub-id-type="pmc">9999999</article-id><article-id pub-id-type="pmid">99999999</article-id><article-id pub-id-type="doi">10.1000/test.2024</article-id>
<title-group><article-title>A <b>title</b></article-title></title-group><pub-date><year>2024</year></pub-date><abstract><title>Abstract</title><p>Short   text.</p></abstract></article-meta></front>
<body><p>lost</p><sec><title>Materials used</title><p>Outer<!-- c -->.</p><sec><title>In</title><p>Inner.</p><fig id="f2"><caption><p>Two</p></caption></fig></sec><fig id="f1"><caption><p>One</p></caption></fig></sec><table-wrap id="t1"><caption>Tab</caption></table-wrap></body></article>"""


def test_article(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.xml").write_bytes(XML)
    (tmp_path / "a/bad.nxml").write_bytes(b"<article>")
    d = articles.read_articles(spark, f"file://{tmp_path}").collect()
    assert len(d) == 1 and d[0].id == "PMC9999999" and d[0].doi == "10.1000/test.2024" and d[0].infon["year"] == "2024"
    p = d[0].passages
    assert [x.text for x in p] == ["A title", "Short text.", "Outer. InInner.Two", "One" if p[3].infon.get("fig_id") == "f1" else "Two", p[4].text, "Tab"]
    assert [x.infon["section_type"] for x in p] == ["title", "abstract", "methods", "fig_caption", "fig_caption", "table_caption"]
    assert all(b.offset == a.offset + len(a.text) + 1 for a, b in zip(p, p[1:]))
    docs = articles.read_articles(spark, f"file://{tmp_path}")
    again = articles.from_bioc(articles.to_bioc(docs)).collect()[0]
    import json

    one = {"id": "T1", "text": "TP53", "entity_type": "gene", "offset": 3, "length": 4, "score": 0.5, "identifiers": ["N:1", "U:2"], "source": "rule"}
    two = {"id": "T2", "text": "é", "entity_type": "x", "offset": 9, "length": 1, "score": None, "identifiers": [], "source": None}
    passages = [(0, "t", {"section_type": "title"}, [one, two]), (2, "u", {"section_type": "body"}, None)]
    form = spark.createDataFrame([("D", "", None, {"year": "2024"}, passages)], "id string, pmid string, doi string, infon map<string,string>, passages array<struct<offset:bigint,text:string,infon:map<string,string>,annotations:array<struct<id:string,text:string,entity_type:string,offset:bigint,length:bigint,score:double,identifiers:array<string>,source:string>>>>")
    assert json.loads(articles.to_bioc(form).first().value) == {
        "id": "D", "infons": {"year": "2024"}, "relations": [],
        "passages": [
            {"offset": 0, "text": "t", "infons": {"section_type": "title"}, "relations": [], "annotations": [
                {"id": "T1", "infons": {"type": "gene", "source": "rule", "identifier": "N:1;U:2", "score": "0.5"}, "text": "TP53", "locations": [{"offset": 3, "length": 4}]},
                {"id": "T2", "infons": {"type": "x", "source": ""}, "text": "é", "locations": [{"offset": 9, "length": 1}]}]},
            {"offset": 2, "text": "u", "infons": {"section_type": "body"}, "relations": [], "annotations": []},
        ],
    }
    assert again.id == "PMC9999999" and again.pmid == "99999999" and again.infon["pmid"] == "99999999" and len(again.passages) == 6


def test_shards(spark):
    p = shards.plan(spark.createDataFrame([(f"f{i}",) for i in range(5)], "path string"), 2)
    assert p.select("shard_id").distinct().count() == 3
    assert shards.pending(p, p.filter("shard_id = '000000'")).count() == 3
    assert shards.select(p, low=1, high=2).count() == 2 and shards.select(p, ids=["000002"]).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("dataset\tid\tstatus\toracle\ngo\tGO:1\tconfirmed\tx\npfam\tPF1\n")
    assert [tuple(r) for r in tables.read_verified(spark, f"file://{tmp_path}/v.tsv").collect()] == [("go", "GO:1", "confirmed", "x"), ("pfam", "PF1", "-", "-")]
    (tmp_path / "g.md").write_text("| id | text |\n|---|---|\n| 1 | a \\| b |\n")
    assert [tuple(r) for r in tables.read_markdown_table(spark, f"file://{tmp_path}/g.md", ["id", "text"]).collect()] == [("1", "a | b")]
    (tmp_path / "e.jsonl").write_text('{"doc_id": "1", "repository": {"title": "GEO"}, "id": "a"}\n\n{"doc_id": "2", "repository": "SRA", "id": "b"}\n')
    assert {r.repository for r in tables.read_external_corpus(spark, f"file://{tmp_path}/e.jsonl").collect()} == {"GEO", "SRA"}
    (tmp_path / "p.tsv").write_text("# c\n\na\tb\tc\na\tb\n")
    assert tables.read_pairs(spark, f"file://{tmp_path}/p.tsv").count() == 1
    t = spark.createDataFrame([("a",)], "k string")
    assert tables.only_targets(t, t.limit(0), "k").count() == 1 and tables.only_targets(t, t.filter("k = 'b'"), "k").count() == 1


def test_registry(spark):
    files = [("x/db1/prefix.yaml", "ex: <http://e/>\n"), ("x/db1/endpoint.yaml", "endpoint:\n - https://h/sparql\n graph:\n  - http://g/1\n"), ("x/db1/model.yaml", "- Gene ex:123:\n"), ("x/db2/endpoint.yaml", "https://sparql-dev.h/sparql # not yet loaded")]
    got = {r.db: r for r in registry.build_registry(spark.createDataFrame(files, "path string, value string")).collect()}
    assert (got["db1"].endpoint, got["db1"].graph, got["db1"].subj_uri_ns, got["db1"].example, got["db1"].queryable) == ("https://h/sparql", "http://g/1", "http://e/", "123", True)
    assert not got["db2"].queryable and got["db2"].needs_review and not got["db2"].loaded


def test_connectors():
    assert verify.bisect_lookup(lambda ids: None if "bad" in ids else set(ids) - {"c"}, ["a", "bad", "c", "d"]) == {"a": "confirmed", "bad": "absent", "c": "absent", "d": "confirmed"}
    calls = []

    def send(url, data, headers):
        calls.append(url)
        return (503, b"") if len(calls) < 3 else (200, b'{"boolean": true}')

    assert connectors.fetch("u", send=send, wait=0)[0] == 200 and len(calls) == 3
    down = lambda *a: (_ for _ in ()).throw(OSError("x"))
    import unittest.mock as m

    with m.patch("time.sleep"):
        assert connectors.SequenceLookup("u", down)("refseq", ["NM_1"]) == {"NM_1": "error"}
    assert connectors.SearchLookup("u", lambda *a: (200, b'{"esearchresult": {"count": "0"}}'))("geo", ["x"]) == {"x": "absent"}
    g = connectors.GeneLookup("u", {"mgi": "MGI:"}, lambda u, d, h: (400, b"No gene found") if u.endswith("2") else (200, b""))
    assert g("mgi", ["1", "MGI:2"]) == {"1": "confirmed", "MGI:2": "absent"}
    s = connectors.SparqlLookup("e", "http://n/", lambda u, d, h: (200, json.dumps({"results": {"bindings": [{"s": {"value": "http://n/a"}}]}}).encode()))
    assert s("x", ["a", "b", "c d"]) == {"a": "confirmed", "b": "pending", "c d": "skipped_unsafe"}
    assert connectors.annotation_documents(b'{"PubTator3": [{"id": 1}]}') == [{"id": 1}] and len(connectors.annotation_documents(b'{"id": 1}\n{"id": 2}')) == 2
    assert connectors.index_links('<a href="a.csv"><a href="README.txt"><a href="a.csv">') == ["a.csv"]
    assert connectors.maybe_gzip(gzip.compress(b"x")) == "x" and connectors.sniff_delimiter("a;b;c") == ";"


def test_compiler():
    got, gone = compiler.compile_pattern(r"^(?:GSE)?(?<id>\d+)$", ["in 2004 we"], ["word"])
    assert got == r"\b(?:GSE)(?:\d+)\b" and gone == 0
    assert compiler.compile_pattern(r"^(?:\d+|AB\d{3})$", ["in 2004 we"], []) == (r"\bAB\d{3}\b", 1)
    assert compiler.alternatives(r"a\|b|c(d|e)|[|]") == [r"a\|b", "c(d|e)", "[|]"]
    out = compiler.assemble({"t": {"regex": "^(?:ENST\\d{3}|FBtr\\d{3})$"}}, [], [], {"t": ("FBtr", "fly")})
    assert out["safe"]["t"]["pattern"] == r"\bENST\d{3}\b" and out["safe"]["fly"]["pattern"] == r"\bFBtr\d{3}\b"
    assert compiler.clean_noise(["GSE12", "foo"], [r"GSE\d+"]) == ["foo"]


def test_windows(spark):
    text = "Data were deposited. " + "Filler words here. " * 3 + "See GSE1 now. The end."
    spans = windows.sentence_spans(text)
    assert all(text[a:b].strip() == text[a:b] for a, b in spans) and len(spans) == 6
    assert windows.sentence_spans("In Fig. 2 we see. Next") == [(0, 17), (18, 22)]
    soup = "A1" * 60
    long = "x " * 400 + "GSE1 " + "y " * 100
    lead = "Reads were deposited. "
    many = "Some filler words stand here. " * 40 + "See GSE1 now. " + "More of the same follows. " * 40
    cases = {
        "lead": (text, text.index("GSE1"), "Data were deposited. […] Filler words here. See «GSE1» now. The end.", False, False),
        "all": ("One GSE1 here. Two.", 4, "One «GSE1» here. Two.", False, False),
        "flat": (soup, 70, soup[10:70] + "«" + soup[70:74] + "»" + soup[74:], True, True),
        "long": (long, 800, "x " * 110 + "[…] " + long[560:800] + "«GSE1»" + long[804:], True, False),
        "long at its head": (long, 100, long[:100] + "«" + long[100:104] + "»" + long[104:344], True, False),
        "lead of a long one": (lead + "X" + long, 822 + 1, lead + "[…] " + ("X" + long)[:220].strip() + " […] " + (lead + "X" + long)[583:823] + "«GSE1»" + (lead + "X" + long)[827:], True, False),
        "between sentences": ("One two.   Three GSE1.", 9, "One two. «  Th»ree GSE1.", False, False),
        "null": (None, 3, None, None, None),
        "nowhere": ("One GSE1 here.", None, None, None, None),
        "beyond": ("One GSE1 here.", 400, "One GSE1 here.", False, False),
        "empty": ("", 0, "", False, False),
    }
    p = spark.createDataFrame([(k, t, at, 4) for k, (t, at, *_) in cases.items()], "k string, text string, within int, length int")
    got = {r.k: (r.window_text, r.list_item, r.flat_table) for r in windows.build_windows(p).collect()}
    assert got == {k: tuple(v[2:]) for k, v in cases.items()}
    at = many.index("GSE1")
    (r,) = windows.build_windows(spark.createDataFrame([(many, at, 4)], "text string, within int, length int"), reach=30).collect()
    assert r.window_text == many[at - 348 : at] + "«GSE1»" + many[at + 4 : at + 352] and not r.list_item and r.matched
    (r,) = windows.build_windows(p.filter("k = 'lead'"), lead_in=False).collect()
    assert r.window_text == "Filler words here. See «GSE1» now. The end." and not r.gen_cue
    w = spark.createDataFrame([("a", 1, "plain but long", True), ("a", 2, "«x»", True), ("a", 3, "«xy»", True), ("a", 4, "«yx»", True), ("b", 1, None, False), ("c", 1, "one", True), ("c", 0, "longer", True)], "k string, position int, window_text string, matched boolean")
    assert sorted((r.k, r.position) for r in windows.longest_marked(w, ("k",)).collect()) == [("a", 3), ("c", 0)]
    p = spark.createDataFrame([(0, 10, 4, "GSE1"), (0, 0, 4, "GSE1"), (1, 0, 4, "none"), (9, 0, 4, "none"), (0, 0, 4, "later")], "i int, o long, n int, s string")
    ps = F.array(F.struct(F.lit(7).cast("long").alias("offset"), F.lit("in GSE1 x").alias("text")), F.struct(F.lit(17).cast("long").alias("offset"), F.lit("is later").alias("text")))
    got = [tuple(r[0]) for r in p.select(windows.locate(ps, F.col("i"), F.col("o"), F.col("n"), F.col("s"))).collect()]
    assert got == [(0, 3, True), (0, 3, False), (1, 0, False), (None, None, False), (1, 3, False)]


def test_roles(spark):
    rows = [("D1", "uniprot", "a", "used", "", "rule", False, "ref_resource_use", "derived_curated"), ("D1", "geo", "b", "", "generated", "llm_pending", True, "gen_dep", "x"), ("D2", "geo", "c", "", "none", "llm_pending", True, "no_cue", "x"), ("D3", "geo", "d", "", "", "skip", False, "out_of_scope", "x"), ("D1", "geo", "e", "", "none", "llm_pending", True, "no_cue", "x")]
    r = spark.createDataFrame(rows, "doc_id string, dataset string, id string, role string, prior string, role_source string, to_llm boolean, note string, class string")

    def model(body):
        if json.loads(body)["messages"][1]["content"] == "bad":
            raise OSError("busy")
        return json.dumps({"results": [{"id": "b", "role": "generated", "confidence": "0.9"}, {"id": "z"}]})

    q = spark.createDataFrame([("D1", "s", "good", 10), ("D2", "s", "bad", 10)], "doc_id string, system_text string, user_text string, max_tokens int").select("doc_id", roles.request_body("m").alias("body"))
    got = {(x.doc_id, x.id): (x.role, x.role_source, x.note) for x in roles.merge_roles(r, roles.classify(q, model, tries=1)).collect()}
    assert got == {("D1", "a"): ("used", "rule", "ref_resource_use"), ("D1", "b"): ("generated", "llm", "generated"), ("D2", "c"): ("error", "llm", "busy"), ("D1", "e"): ("missing", "llm", "id_not_in_output")}


def test_scores_golden(spark):
    cells = {("generated", "generated"): 31, ("generated", "used"): 1, ("generated", "mentioned"): 3, ("used", "generated"): 2, ("used", "used"): 95, ("used", "mentioned"): 5, ("mentioned", "used"): 6, ("mentioned", "mentioned"): 60}
    pairs = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "gold string, pred string")
    got = {r.role: r for r in evaluate.scores(pairs).collect()}
    assert [round(got["generated"][k], 3) for k in ("precision", "recall", "f1")] == [0.939, 0.886, 0.912]
    assert [round(got["mentioned"][k], 3) for k in ("precision", "recall", "f1")] == [0.882, 0.909, 0.896]
    assert round(got["used"].macro_f1, 3) == 0.913 and round(got["used"].accuracy, 3) == 0.916
    gold = spark.createDataFrame([("1", "used"), ("2", ""), ("3", "unsure"), ("4", "odd"), ("5", "used")], "sample_id string, gold_role string")
    key = spark.createDataFrame([(str(i), "llm", "used", "1") for i in range(1, 5)], "sample_id string, role_source string, model_role string, role_confidence string")
    assert {r.sample_id: r.reason for r in evaluate.join_gold(gold, key).collect()} == {"1": None, "2": "unlabeled", "3": "unsure", "4": "badlabel", "5": "no_key"}


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", f"d{i % 4}") for i in range(40)], "key int, stratum string, dataset string")
    held = evaluate.heldout(rows, {"d0": 2}, {"a": 5, "b": 3}, {"d1": 0, "d2": 1}).collect()
    assert sum(r.stratum == "a" for r in held) == 5 and not any(r.dataset == "d1" for r in held) and sum(r.dataset == "d0" for r in held) >= 2
    assert evaluate.agreement_subset(rows, 0.0625, "key").count() == 2  # 2.5 to the even number
    p = evaluate.allocate(spark.createDataFrame([("a", 50), ("b", 3)], "stratum string, stock long"), 10, least=2, most=8)
    assert {r.stratum: r.n_draw for r in p.collect()} == {"a": 8, "b": 2}
    assert evaluate.numbered(rows, "G", "key").first().sample_id == "G0001"


def test_compare(spark):
    s = "doc_id string, entity_type string, surface string"
    ours, theirs = spark.createDataFrame([("1", "g", "tp53"), ("1", "g", "brca1 gene"), ("1", "g", "xy")], s), spark.createDataFrame([("1", "g", "tp53"), ("1", "g", "brca1"), ("1", "g", "x")], s)
    m = compare.match_surfaces(ours, theirs)
    assert {(r.ours, r.theirs, r.kind) for r in m.collect()} == {("tp53", "tp53", "exact"), ("brca1 gene", "brca1", "partial")}
    top = {r.entity_type: (r.n_matched, round(r.recall, 2)) for r in compare.match_scores(ours, theirs, m).collect()}
    assert top == {"g": (2, 0.67), None: (2, 0.67)}
    n = spark.createDataFrame([("ＴＰ53–α ",), (None,)], "s string").select(compare.normal_surface("s")).collect()
    assert [r[0] for r in n] == ["tp53-alpha", None]
    assert compare.nearest_label(spark.createDataFrame([("uniprt",), ("zzz",)], "name string"), spark.createDataFrame([("uniprot",), ("pfam",)], "label string")).filter("name = 'uniprt'").select("nearest").first()[0] == "uniprot"


def test_tagging(spark):
    p = spark.createDataFrame([("D", 0, 5, "TP53 and p53"), ("D", 1, 30, None)], "doc_id string, passage_idx int, offset long, text string")
    got = extract.tag(p, extract.DictionaryTagger({"TP53": "gene", "p53": "gene"})).collect()
    assert [(r.ann_id, r.surface, r.offset, r.length) for r in got] == [("T1", "TP53", 5, 4), ("T2", "p53", 14, 3)]
    assert "".join(c for _, c in extract.chunks_of("ab. cd\nef gh" * 5, 10)) == "ab. cd\nef gh" * 5
    linked = extract.link_surfaces(spark.createDataFrame([("a", "gene"), ("b", "bad"), ("a", "gene")], "surface string, entity_type string"), lambda kind, names: [f"X:{n}" for n in names] if kind == "gene" else 1 / 0)
    assert {(r.surface, r.identifier, r.linker_status) for r in linked.collect()} == {("a", "X:a", "ok"), ("b", None, "predict_error")}


def test_cached_lookup(spark):
    c = spark.createDataFrame([("go", "1"), ("go", "2"), ("go", "3")], "db string, id string")
    cache = spark.createDataFrame([("go", "1", "absent"), ("go", "2", "error")], "db string, id string, answer string")
    got = verify.look_up(c, connectors.TableLookup({("go", "1"), ("go", "2")}), cache=cache).collect()
    assert {r.id: r.answer for r in got} == {"1": "absent", "2": "confirmed", "3": "absent"}


def test_incremental(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("src", "out", "ck"))
    run = lambda: incremental.run_new(spark, src, "doc_id string, text string", lambda d: d.select("doc_id"), out, ck).awaitTermination()
    spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, text string").write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("b", "2"), ("c", "3")], "doc_id string, text string").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_loaded_catalog():
    from quillspark.sources.patterns import load_catalog

    text = "safe:\n  a: {pattern: '\\bA\\d+\\b', uri: 'http://x/', category: C}\n  bad: {pattern: '('}\ncontext_required:\n  b: {pattern: '\\bB\\d\\b'}\n"
    got, skipped = load_catalog(text)
    assert [p.db for p in got] == ["a"] and skipped == ["bad"]
    assert extract.Extractor(got)("see A12")[0][:5] == ("A12", "a", "C", "a:A12", "http://x/A12")
    got, _ = load_catalog(text, True, {"b": ["beta"]})
    assert [h[0] for h in extract.Extractor(got)("beta B1")] == ["B1"] and extract.Extractor(got)("B1") == []


def test_endpoints():
    assert connectors.backend_url("https://p.org/geo/sparql", r"p\.org/([a-z]+)/sparql", "https://b/{group}") == "https://b/geo"
    assert connectors.backend_url(None, "x(y)", "") is None
    send = lambda url, data, headers: (200, b'{"boolean": true}') if url == "up" else (404, b"")
    assert connectors.smoke({"a": "up", "b": None, "c": "down"}, send) == {"a": "OK", "b": "skip", "c": "NG"}


def test_reports(spark):
    assert evaluate.markdown(spark.createDataFrame([("a|b", 1)], "x string, n int")) == "| x | n |\n|---|---|\n| a\\|b | 1 |"


def test_nested_documents(spark):
    ann = "array<struct<id:string,text:string,offset:bigint,length:int,entity_type:string,identifiers:array<string>,score:double,source:string>>"
    docs = spark.createDataFrame(
        [("PMC1", "1", None, {"year": "2001"}, [(0, "TP53 é", {"section_type": "title"}, [("T1", "TP53", 0, 4, "gene", ["a", "b"], 0.5, "x"), ("T2", "é", 5, 1, "gene", [], None, "x")]), (7, "body text", {"section_type": "methods"}, [])]), ("PMC2", None, None, {}, [])],
        f"id string, pmid string, doi string, infon map<string,string>, passages array<struct<offset:bigint,text:string,infon:map<string,string>,annotations:{ann}>>",
    )
    got = concept.explode_documents(docs).collect()
    assert [(r.ann_id, r.identifier, r.passage_type) for r in got] == [("T1", "a", "title"), ("T2", None, "title")]
    rows = {r.doc_id: r for r in concept.document_rows(docs).collect()}
    assert (rows["PMC1"].total_chars, rows["PMC1"].n_passages, rows["PMC1"].n_annotations, rows["PMC1"].has_body) == (15, 2, 2, True)
    assert (rows["PMC2"].total_chars, rows["PMC2"].n_annotations, rows["PMC2"].has_body) == (0, 0, False)
    assert articles.to_bioc(docs).count() == 2


def test_scope_and_paths(spark):
    e = spark.createDataFrame([("d", "geo_series", "a", "deposited_research_record"), ("d", "go", "b", "out_of_scope"), ("d", "pfam", "c", "derived_curated")], "doc_id string, dataset string, id string, class string")
    assert [r.id for r in windows.in_scope(e, classes=["derived_curated"]).collect()] == ["c"]
    assert [r.id for r in windows.in_scope(e, datasets=["geo"]).collect()] == ["a"]
    m = spark.createDataFrame([("d", "pfam", "x", None, "c"), ("d", "pfam", "x", "y", None), ("d", "go", "b", "b", "b")], "doc_id string, db string, surface string, curie string, identifier string")
    assert [(r.dataset, r.id) for r in windows.member_mentions(m, e.filter("dataset = 'pfam'")).collect()] == [("pfam", "c")]
    p = spark.createDataFrame([("PMC1234567",), ("PMC12",), ("x",)], "d string").select(windows.article_path(F.col("d"))).collect()
    assert [r[0] for r in p] == ["PMC001xxxxxx/PMC1234567.xml", "PMC000xxxxxx/PMC12.xml", None]


def test_catalog_sides(spark):
    n = spark.createDataFrame([("a", "x"), ("b", None)], "dataset string, other string")
    got = {r.dataset: tuple(r.c) for r in n.select("dataset", compare.dataset_class(F.col("dataset"), {"a": "data"}, {"b": "ontology"}).alias("c")).collect()}
    assert got == {"a": ("data", False), "b": ("ontology", True)}
    pairs = spark.createDataFrame([("1", "d1", 1), ("1", "d2", 2)], "pmid string, doi string, position int")
    assert [tuple(r) for r in compare.crosswalk(spark.createDataFrame([("1",), ("2",)], "pmid string"), pairs).collect()] == [("1", "d2")]
    raw = spark.createDataFrame([("d", "x", "X", 1), ("d", "x", "x!", 2)], "doc_id string, norm string, surface string, position int")
    assert compare.raw_surfaces(spark.createDataFrame([("d", "x"), ("d", "z")], "doc_id string, norm string"), raw).filter("norm = 'x'").first().surface == "x!"
    f = spark.createDataFrame([("s3://b/uniprot.part1.csv.gz",), ("s3://b/uniprot_2.csv",), ("s3://b/pdb.csv",)], "path string")
    assert sorted(r.db for r in tables.source_databases(f).collect()) == ["pdb", "uniprot"]
    assert tables.source_databases(spark.createDataFrame([("a",), ("a",)], "DB string"), "db").count() == 1
