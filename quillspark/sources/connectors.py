"""Connectors to outside services. Each takes its transport, so that tests and air-gapped clusters use a table or a stub."""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.verify import bisect_lookup, with_retry

#: (url, form data or None, headers) -> (status code, body); raises OSError where the service can't be reached.
Transport = Callable[[str, dict | None, dict], tuple[int, bytes]]
AGAIN = {429, 500, 502, 503}


def http(url: str, data: dict | None = None, headers: dict | None = None, timeout: float = 60.0) -> tuple[int, bytes]:
    body = urllib.parse.urlencode(data).encode() if data is not None else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers or {}), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def fetch(url: str, data: dict | None = None, headers: dict | None = None, send: Transport = http, tries: int = 4, wait: float = 1.0) -> tuple[int, bytes]:
    """Status and body; busy answers and transport errors are tried again, other codes are returned at once."""

    def once():
        code, body = send(url, data, headers or {})
        if code in AGAIN:
            raise OSError(f"status {code}")
        return code, body

    return with_retry(once, tries, wait)


@dataclass
class TableLookup:
    """Answers from a set of known (db, id): the offline stand-in of every connector."""

    known: set[tuple[str, str]] = field(default_factory=set)

    def __call__(self, db: str, ids: list[str]) -> dict[str, str]:
        return {i: "confirmed" if (db, i) in self.known else "absent" for i in ids}


@dataclass
class SparqlLookup:
    """Which ids have a subject in a graph: VALUES batches by POST. Not found is pending, never absent."""

    endpoint: str
    namespace: str
    send: Transport = http
    graph: str | None = None

    def query(self, ids: list[str]) -> str:
        values = " ".join(f"<{self.namespace}{i}>" for i in ids)
        inner = f"VALUES ?s {{ {values} }} ?s ?p ?o ."
        return f"SELECT DISTINCT ?s WHERE {{ {f'GRAPH <{self.graph}> {{ {inner} }}' if self.graph else inner} }}"

    def ask(self) -> bool:
        """Whether the graph has anything at all."""
        inner = "?s ?p ?o ."
        code, body = fetch(self.endpoint, {"query": f"ASK {{ {f'GRAPH <{self.graph}> {{ {inner} }}' if self.graph else inner} }}", "format": "json"}, {"Accept": "application/sparql-results+json"}, self.send)
        return code == 200 and bool(json.loads(body).get("boolean"))

    def __call__(self, db: str, ids: list[str]) -> dict[str, str]:
        safe = [i for i in ids if re.fullmatch(r"[A-Za-z0-9_.\-:]+", i)]
        try:
            code, body = fetch(self.endpoint, {"query": self.query(safe), "format": "json"}, {"Accept": "application/sparql-results+json"}, self.send)
            rows = json.loads(body)["results"]["bindings"] if code == 200 else []
        except (OSError, ValueError, KeyError):
            rows = []
        found = {r["s"]["value"].removeprefix(self.namespace) for r in rows}
        return {i: "skipped_unsafe" if i not in safe else "confirmed" if i in found else "pending" for i in ids}


@dataclass
class SequenceLookup:
    """Sequence records by batch, versions apart; a refused batch is halved. A service out of reach gives errors, not absence."""

    url: str
    send: Transport = http

    def __call__(self, db: str, ids: list[str]) -> dict[str, str]:
        def ask(some: list[str]) -> set[str] | None:
            code, body = fetch(self.url, {"db": db, "id": ",".join(some), "rettype": "acc", "retmode": "text"}, None, self.send)
            if code != 200:
                return None
            got = {x.split(".")[0] for x in body.decode("utf-8", "replace").split()}
            return {i for i in some if i.split(".")[0] in got}

        return bisect_lookup(ask, ids)


@dataclass
class SearchLookup:
    """One search for each id: a count above 0 confirms, 0 is absent, anything else an error."""

    url: str
    send: Transport = http

    def __call__(self, db: str, ids: list[str]) -> dict[str, str]:
        out = {}
        for i in ids:
            try:
                code, body = fetch(self.url, {"db": db, "term": f"{i}[ACCN]", "retmode": "json"}, None, self.send)
                n = int(json.loads(body)["esearchresult"]["count"]) if code == 200 else None
                out[i] = "error" if n is None else "confirmed" if n else "absent"
            except (OSError, ValueError, KeyError):
                out[i] = "error"
        return out


@dataclass
class GeneLookup:
    """One GET for each CURIE, rebuilt with the database's prefix: 200 exists; 404, or 400 with a no-gene message, doesn't."""

    url: str
    prefixes: dict[str, str]
    send: Transport = http

    def __call__(self, db: str, ids: list[str]) -> dict[str, str]:
        if db not in self.prefixes:
            raise KeyError(db)
        out = {}
        for i in ids:
            curie = self.prefixes[db] + i.rpartition(":")[2]
            try:
                code, body = fetch(f"{self.url}/{urllib.parse.quote(curie)}", None, None, self.send, tries=2)
                gone = code == 404 or code == 400 and b"No gene found" in body
                out[i] = "confirmed" if code == 200 else "absent" if gone else "error"
            except OSError:
                out[i] = "error"
        return out


def annotation_documents(body: bytes) -> list[dict]:
    """Documents of an annotation service's answer: a list, an object that holds one, or JSON lines."""
    text = body.decode("utf-8", "replace").strip()
    try:
        whole = json.loads(text)
    except ValueError:
        return [json.loads(x) for x in text.splitlines() if x.strip()]
    if isinstance(whole, dict):
        return next((whole[k] for k in ("PubTator3", "documents") if isinstance(whole.get(k), list)), [whole])
    return whole


def chat(url: str, key: str | None = None, send: Callable[[str, bytes, dict], tuple[int, bytes]] | None = None) -> Callable[[str], str]:
    """A model for roles.classify: body -> the content of the first choice."""

    def post(target: str, body: bytes, headers: dict) -> tuple[int, bytes]:
        with urllib.request.urlopen(urllib.request.Request(target, body, headers), timeout=300) as r:
            return r.status, r.read()

    def ask(body: str) -> str:
        code, answer = (send or post)(f"{url}/chat/completions", body.encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}", "api-key": key} if key else {}))
        if code != 200:
            raise OSError(f"status {code}")
        return json.loads(answer)["choices"][0]["message"]["content"]

    return ask


def rotating(models: list[Callable[[str], str]]) -> Callable[[str], str]:
    """Calls go to the models in turn, so a failed one is tried again elsewhere."""
    state = {"k": 0}

    def ask(body: str) -> str:
        state["k"] += 1
        return models[(state["k"] - 1) % len(models)](body)

    return ask


def index_links(page: str, pattern: str = r"\.(?:csv|tsv|txt)(?:\.gz)?$") -> list[str]:
    """Data files that a directory page links to, in order, once."""
    return list(dict.fromkeys(x for x in re.findall(r'href="([^"?/]+)"', page) if re.search(pattern, x, re.I) and not re.search(r"readme|license|changelog|md5|checksum", x, re.I)))


def maybe_gzip(body: bytes) -> str:
    return (gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body).decode("utf-8", "replace")


def sniff_delimiter(line: str, among: str = "\t,;|") -> str:
    """The delimiter that a line has most of; the first of equals."""
    return max(among, key=lambda d: (line.count(d), -among.index(d)))


def fetch_first(urls: list[str], send: Transport = http, tries: int = 4, wait: float = 1.0) -> tuple[str, bytes]:
    """The first of some addresses (http, https or ftp) of the same file that gives it, and its bytes; OSError names what each
    of them said."""
    said = []
    for url in urls:
        try:
            status, body = fetch(url, None, None, send, tries, wait)
        except OSError as e:
            said.append(f"{url}: {e}")
            continue
        if status is None or status < 400:  # ftp has no status
            return url, body
        said.append(f"{url}: {status}")
    raise OSError("; ".join(said) or "no address")


def read_index(urls: list[str], send: Transport = http, tries: int = 4, wait: float = 1.0) -> list[dict[str, str]]:
    """The rows of an index file, from the first address that gives it, or from the first data file that it links to where it
    is a directory page; unpacked, with the delimiter of its header line. Empty files have no rows."""
    url, body = fetch_first(urls, send, tries, wait)
    text = maybe_gzip(body)
    if "href=" in text:
        links = index_links(text)
        if not links:
            return []
        text = maybe_gzip(fetch_first([urllib.parse.urljoin(url, x) for x in links], send, tries, wait)[1])
    head = text.partition("\n")[0]
    return list(csv.DictReader(io.StringIO(text), delimiter=sniff_delimiter(head))) if head else []


def known_table(df: DataFrame, most: int = 1_000_000) -> TableLookup:
    """A table (db, id) as a lookup. It travels with each task, so tables of more than `most` rows are refused: join those."""
    rows = df.select("db", "id").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} known ids: join them instead")
    return TableLookup({(r["db"], r["id"]) for r in rows})


def backend_url(endpoint: str | None, rule: str, target: str) -> str | None:
    """The endpoint behind a portal: where the rule (a regex with one group) matches, the target with the group in it."""
    m = re.search(rule, endpoint or "")
    return target.format(group=m[1]) if m else endpoint


def smoke(endpoints: dict[str, str | None], send: Transport = http) -> dict[str, str]:
    """OK, NG or skip for each endpoint: one question each; no endpoint is skipped."""
    out = {}
    for db, url in endpoints.items():
        try:
            out[db] = "skip" if not url else "OK" if SparqlLookup(url, "", send).ask() else "NG"
        except (OSError, ValueError):
            out[db] = "NG"
    return out
