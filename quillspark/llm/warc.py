"""WARC archives: a writer of one gzip member a record, and a salvage reader that goes on behind damaged bytes."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shared_dir, table

FILE_BYTES = 32 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record. A revisit has the HTTP header of its payload, with the payload's length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", "", url)))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes start to end of the archive hold no record that passes its checks."""

    start: int
    end: int
    reason: str


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at `at`, and where it ends. ValueError says which check failed."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("no end of header")
    fields = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        raise ValueError("no content length")
    start, end = stop + 4, stop + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end of record")
    block = data[start:end]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest(block):
        raise ValueError("block digest differs")
    return Record(fields, block), end + 4


_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, and the gaps between them. After a failed check the next gzip member or version
    line is looked for, and taken where a whole record passes from there; the bytes up to it are the gap.

    The content of a gzip member is searched in the same way, also what a broken member gives before its damage. A member
    that lost some records gives those that pass, then one gap over its bytes, whose reason has the places in the content.
    """
    at, view = 0, memoryview(data)
    gap: int | None = None
    reason = ""
    rescued: list[Record] = []  # of a broken member that was read up to `reach`: its bytes are searched for more
    reach = 0
    while at < len(data):
        try:
            lost = None
            if data[at : at + 3] == MAGIC:
                found, end, lost, broken = _member(view, at)
                if broken:
                    if found:
                        if gap is not None:
                            yield Gap(gap, at, reason)
                        yield from found
                        gap, reason, rescued, reach = at, lost, found, end
                    raise ValueError(lost)
                if lost and not found:
                    raise ValueError(lost)
            else:
                one, end = parse(data, at)
                found = [one]
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            later = _NEXT.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        for one in found:
            if at < reach and one in rescued:  # it stands in the open, in a stored block of that member
                rescued.remove(one)
            else:
                yield one
        if lost:
            yield Gap(at, end, lost)
        at = end
    if gap is not None:
        yield Gap(gap, len(data), reason)


def _member(view: memoryview, at: int) -> tuple[list[Record], int, str | None, bool]:
    """The records of the gzip member at `at`, where it ends, what was lost in it, and whether the member itself is broken;
    then the end is how far it was read. It is read in steps, so that it costs its own size and not that of the whole archive."""
    z, inside, k, broken = zlib.decompressobj(31), [], at, None
    try:
        while not z.eof and k < len(view):
            step = view[k : k + 65536]
            inside.append(z.decompress(step))
            k += len(step)
    except zlib.error as e:
        broken, z = f"gzip: {e}", zlib.decompressobj(31)
        for j in range(at, k, 65536):
            z.decompress(view[j : j + 65536])
        with contextlib.suppress(zlib.error):  # what the step has before its damage
            while k < len(view):
                inside.append(z.decompress(view[k : k + 1]))
                k += 1
        found, gaps = _inside(b"".join(inside), sure=True)
    else:
        broken = None if z.eof else "gzip: cut short"
        found, gaps = _inside(b"".join(inside))
    if broken and len(found) == 1 and not gaps:  # one record alone in its member stands or falls with it
        found = []
    lost = [broken] if broken else []
    lost += [f"{why} (bytes {a} to {b} of the member's content)" for a, b, why in gaps]
    return found, k - len(z.unused_data), "; ".join(lost) or None, broken is not None


def _inside(whole: bytes, sure: bool = False) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The records of a member's content that pass, and the gaps. sure: only those with a digest, where bytes may be wrong."""
    found, gaps, at, gap, reason = [], [], 0, None, ""
    while at < len(whole):
        try:
            one, end = parse(whole, at)
            if sure and not one.fields.get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError("no digest to check in a damaged member")
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            later = VERSION.search(whole, at + 1)
            at = later.start() if later else len(whole)
            continue
        if gap is not None:
            gaps.append((gap, at, reason))
            gap = None
        found.append(one)
        at = end
    if gap is not None:
        gaps.append((gap, len(whole), reason))
    return found, gaps


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the pages whose payload a page of a smaller id has too, of at least so many bytes. Digests
    are counted before they meet, so a payload that very many pages have costs one row a task there. Pages without an id
    refer to none and none refers to them."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select("page_id", F.sha1(html.cast("binary")).alias("d"), F.octet_length(html).alias("n")).filter(F.col("n") >= least_bytes)
    first = keyed.groupBy("d", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last")
    return keyed.join(first, ["d", "n"]).filter("page_id > refers_to").select(F.col("page_id").alias("__id"), F.col("d").alias("__d"), "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> int:
    """Writes a record for each row (page_id, url, html) into gzip archives in the folder, and returns how many there are.

    folder: a URI that pyarrow can open on every executor. A task writes under a name of its own attempt and renames the
    file when it is whole; a task that runs again writes the same records under the same names. Null html is an empty
    payload; rows with the same id are separate records, each a response or revisit by its own payload, and equal rows of
    the smallest id are all responses; rows without an id are responses; an empty table gives no archive.
    """
    again = revisits(pages, least_bytes)
    rows = pages.select("page_id", F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("d", F.sha1("html"))
    rows = rows.join(again, (rows["page_id"] == again["__id"]) & (rows["d"] == again["__d"]), "left").drop("__id", "__d")
    rows = rows.repartition("page_id", "d").drop("d").sortWithinPartitions("page_id", "url", "html")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, held, size, n, rows = task.partitionId(), [], 0, 0, 0

        def close():
            temp = f"{root}/_{part:06d}-{n:06d}-{task.taskAttemptId()}"
            with store.open_output_stream(temp, compression=None) as f:
                for x in held:
                    f.write(x)
            store.move(temp, f"{root}/{part:06d}-{n:06d}.warc.gz")

        for b in batches:
            for page, url, html, ref in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(member(record("response" if ref is None else "revisit", str(page), url, html, None if ref is None else str(ref))))
                size += len(held[-1])
                rows += 1
                if size >= file_bytes:
                    close()
                    held, size, n = [], 0, n + 1
        if held:
            close()
        yield pa.record_batch([pa.array([rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


RECORDS = "path string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, gap_start long, gap_end long, gap_reason string"


def read_archives(spark, folder: str, keep_payloads: bool = True) -> DataFrame:
    """One row for each record that can be read, and one with gap_start, gap_end and gap_reason for each run of bytes that
    can't. payload_bytes and payload_digest are those of the full payload; a revisit has no payload of its own."""

    def page(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = []
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        out.append((path, *[None] * 7, x.start, x.end, x.reason))
                        continue
                    head, _, payload = x.block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
                    kind, said = x.fields.get("warc-type"), x.fields.get("warc-payload-digest", "")[5:]
                    n = len(payload) if kind == "response" else int(length[1]) if length else None
                    if kind == "response" and said != digest(payload):
                        said = digest(payload)
                    out.append((path, page(x.fields.get("warc-record-id")), kind, page(x.fields.get("warc-refers-to")), x.fields.get("warc-target-uri"), n, said, payload if keep_payloads and kind == "response" else None, None, None, None))
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 11, types, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def op3(spark, sf_dir: str) -> DataFrame:
    from pyarrow import fs

    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, keep_payloads=False).filter("gap_start is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
