"""Article XML to documents with offset-preserving passages."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

PASSAGE = "struct<offset:bigint,text:string,infon:map<string,string>>"
DOCUMENT = f"struct<id:string,pmid:string,doi:string,infon:map<string,string>,passages:array<{PASSAGE}>>"
#: Children of a section whose text isn't part of it; captions are passages of their own.
APART = {"fig", "table-wrap", "supplementary-material"}


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _joined(e: ET.Element, skip: set[str]) -> str:
    return " ".join(t for t in (_text(c) for c in e if c.tag not in skip) if t)


def _label(sec: ET.Element) -> str:
    known = rules.SECTION_TYPES.get(sec.get("sec-type", "").lower())
    title = _text(sec.find("title")).lower()
    return known or next((label for word, label in rules.SECTION_TITLES if word in title), "body")


def _top_sections(e: ET.Element, inside: bool = False) -> Iterator[ET.Element]:
    """Sections whose parent isn't a section, in document order."""
    for c in e:
        if c.tag == "sec" and not inside:
            yield c
        yield from _top_sections(c, c.tag == "sec")


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z][^>]*>?|<(?P<close>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def recover(xml: bytes) -> ET.Element | None:
    """The tree of an article that isn't well-formed, as far as it goes: what isn't markup is text, entities that nobody
    knows stay as they are, an end tag closes what is open inside its element, one without a start is passed over, and
    what is open at the end is closed. None where there is no element."""
    declared = re.search(rb"encoding=[\"']([A-Za-z0-9._-]+)", xml[:200])
    try:
        text = xml.decode(declared[1].decode() if declared else "utf-8", "replace")
    except LookupError:
        text = xml.decode("utf-8", "replace")
    tree, open_, at, begun = ET.TreeBuilder(), [], 0, False
    for m in _MARKUP.finditer(text):
        if open_:
            tree.data(html.unescape(text[at : m.start()]) + (m["data"] or ""))
        at, name = m.end(), m["name"]
        if not name or (begun and not open_):  # not an element, or behind the root
            continue
        if not m["close"]:
            begun = True
            tree.start(name, {k: html.unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m["rest"])})
            open_.append(name)
            if not m["rest"].endswith("/"):
                continue
        elif name not in open_:
            continue
        while open_:
            last = open_.pop()
            tree.end(last)
            if last == name:
                break
    if not begun:
        return None
    if open_:
        tree.data(html.unescape(text[at:]))
    for name in reversed(open_):
        tree.end(name)
    return tree.close()


def parse_article(xml: bytes, stem: str) -> dict | None:
    """The document of one article. XML that isn't well-formed is read as far as it can be; None where that gives no text.

    Passages in order: title, abstracts, top sections of the body (without titles, figures and tables right below them),
    figure captions, table captions; empty ones are left out. Offsets are code points in the whole document, with one
    between passages. Comments and processing instructions have no text.
    """
    whole = True
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError, LookupError):  # the last two: an encoding that nobody knows
        root, whole = recover(xml), False
    if root is None:
        return None

    def article_id(kind: str) -> str | None:
        return next(((e.text or "").strip() for e in root.iterfind(".//article-id") if e.get("pub-id-type") == kind), None)

    name = article_id("pmc") or stem
    parts: list[tuple[str, dict[str, str]]] = [(_text(root.find(".//article-meta/title-group/article-title")), {"section_type": "title"})]
    parts += [(_joined(a, {"title"}), {"section_type": "abstract"}) for a in root.iterfind(".//abstract")]
    body = root.find(".//body")
    if body is not None:
        parts += [(_joined(s, APART | {"title"}), {"section_type": _label(s)}) for s in _top_sections(body)]
        for tag, label, key in (("fig", "fig_caption", "fig_id"), ("table-wrap", "table_caption", "table_id")):
            parts += [(_text(e.find(".//caption")), {"section_type": label, key: e.get("id", "")}) for e in body.iter(tag)]
    passages, at = [], 0
    for text, infon in parts:
        if text:
            passages.append({"offset": at, "text": text, "infon": infon})
            at += len(text) + 1
    if not (whole or passages):
        return None
    return {"id": f"PMC{name}" if re.fullmatch(r"\d+", name) else name, "pmid": article_id("pmid"), "doi": article_id("doi"), "infon": {"journal": _text(root.find(".//journal-title")), "year": _text(root.find(".//pub-date/year"))}, "passages": passages}


def parse_articles(files: DataFrame) -> DataFrame:
    """files (path, content) with the document of each article; those without any text that can be read give no row."""

    @F.pandas_udf(DOCUMENT)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for stems, contents in batches:
            got = [parse_article(bytes(c), s) or {"id": None, "pmid": None, "doi": None, "infon": None, "passages": None} for s, c in zip(stems, contents, strict=True)]
            yield pd.DataFrame(got, columns=["id", "pmid", "doi", "infon", "passages"])

    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(parse(stem, "content").alias("d")).filter("d.id is not null").select("d.*")


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all .xml and .nxml files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,nxml}").load(folder)
    return parse_articles(files.select("path", "content"))


def passage_rows(docs: DataFrame) -> DataFrame:
    p = docs.select(F.col("id").alias("doc_id"), F.posexplode("passages").alias("passage_idx", "p"))
    return p.select("doc_id", "passage_idx", F.element_at("p.infon", F.lit("section_type")).alias("passage_type"), F.col("p.offset").alias("offset"), F.col("p.text").alias("text"))


def _annotation(a) -> Column:
    """An annotation in the exchange form: what isn't known (no identifiers, no score) has no info of its own."""
    none = F.lit(None).cast("string")
    infons = F.create_map(F.lit("type"), a["entity_type"], F.lit("source"), F.coalesce(a["source"], F.lit("")), F.lit("identifier"), F.when(F.size(a["identifiers"]) > 0, F.array_join(a["identifiers"], ";")).otherwise(none), F.lit("score"), a["score"].cast("string"))
    place = F.struct(a["offset"].alias("offset"), a["length"].alias("length"))
    return F.struct(a["id"].alias("id"), F.map_filter(infons, lambda k, v: v.isNotNull()).alias("infons"), a["text"].alias("text"), F.array(place).alias("locations"))


def to_bioc(docs: DataFrame) -> DataFrame:
    """One JSON string a document, in the exchange form: ids among the infons; annotations, where passages have them, with
    scores as text and identifiers joined by semicolons; no relations. Null annotations are an empty list."""
    infons = F.map_filter(F.map_concat("infon", F.create_map(F.lit("pmid"), F.coalesce("pmid", F.lit("")), F.lit("doi"), F.coalesce("doi", F.lit("")))), lambda k, v: v != "")
    one = docs.schema["passages"].dataType.elementType
    none = F.array().cast("array<string>")

    def passage(p) -> Column:
        found = none
        if "annotations" in one.names:
            found = F.transform(F.coalesce(p["annotations"], F.from_json(F.lit("[]"), one["annotations"].dataType.simpleString())), _annotation)
        return F.struct(p["offset"].alias("offset"), p["text"].alias("text"), p["infon"].alias("infons"), found.alias("annotations"), none.alias("relations"))

    return docs.select(F.to_json(F.struct("id", infons.alias("infons"), F.transform("passages", passage).alias("passages"), none.alias("relations"))).alias("value"))


def from_bioc(lines: DataFrame) -> DataFrame:
    """Documents of exchange lines (value); pmid and doi come out of the infons, which keep them; annotations are not read back."""
    d = F.from_json("value", "id string, infons map<string,string>, passages array<struct<offset:bigint,text:string,infons:map<string,string>>>")
    out = lines.filter(F.trim("value") != "").select(d.alias("d"))
    return out.select("d.id", F.try_element_at("d.infons", F.lit("pmid")).alias("pmid"), F.try_element_at("d.infons", F.lit("doi")).alias("doi"), F.col("d.infons").alias("infon"), F.transform("d.passages", lambda p: F.struct(p["offset"].alias("offset"), p["text"].alias("text"), p["infons"].alias("infon"))).alias("passages"))
