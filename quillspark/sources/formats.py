"""Outside services as data sources: spark.read.format("sparql" | "records" | "search" | "genes" | "index"), after register(spark).

The first four ask a service about ids in Parquet files, a task for each row group, so the driver sees file footers only. "index"
reads the data files that a directory page links to, a task for each file, as a batch or as a stream that goes on where it ended.
"""

from __future__ import annotations

import csv
import io
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import connectors as C

ANSWERS = "db string, id string, answer string"


@dataclass
class Ids(InputPartition):
    path: str
    group: int


@dataclass
class File(InputPartition):
    url: str


class LookupReader(DataSourceReader):
    """Answers about the ids of a column of Parquet files. Null ids and repeats within a batch aren't asked. Filters on the id with
    = or IN are kept here, so that other ids are never asked; all others are left to Spark."""

    def __init__(self, options: dict, service):
        self.service, self.db, self.column = service, options["db"], options.get("column", "id")
        self.folder, self.size, self.wanted = options["ids"], int(options.get("batch", 200)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def _open(self, path: str | None = None):
        place, root = fs.FileSystem.from_uri(self.folder)
        return place, path or root

    def partitions(self) -> list[Ids]:
        place, root = self._open()
        files = sorted(f.path for f in place.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".parquet"))
        return [Ids(p, g) for p in files for g in range(pq.ParquetFile(place.open_input_file(p)).num_row_groups)] or [Ids("", 0)]

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        place, path = self._open(partition.path)
        ids = pq.ParquetFile(place.open_input_file(path)).read_row_group(partition.group, [self.column])[self.column].cast(pa.string()).drop_null().unique()
        if self.wanted is not None:
            ids = ids.filter(pc.is_in(ids, pa.array(sorted(x for x in self.wanted if x is not None), pa.string())))
        for a in range(0, len(ids), self.size):
            some = ids.slice(a, self.size).to_pylist()
            answers = self.service(self.db, some)
            yield pa.RecordBatch.from_arrays([pa.array([self.db] * len(some)), pa.array(some), pa.array([answers.get(i) for i in some], pa.string())], names=["db", "id", "answer"])


class LookupSource(DataSource):
    """Options: endpoint; ids, the folder of Parquet files; db; column (id) and batch (200), ids asked at a time."""

    def schema(self) -> str:
        return ANSWERS

    def service(self, o: dict):
        raise NotImplementedError

    def reader(self, schema) -> LookupReader:
        return LookupReader(self.options, self.service(self.options))


class SparqlSource(LookupSource):
    """Further options: namespace and graph."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def service(self, o: dict):
        return C.SparqlLookup(o["endpoint"], o["namespace"], graph=o.get("graph"))


class RecordSource(LookupSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def service(self, o: dict):
        return C.SequenceLookup(o["endpoint"])


class SearchSource(LookupSource):
    @classmethod
    def name(cls) -> str:
        return "search"

    def service(self, o: dict):
        return C.SearchLookup(o["endpoint"])


class GeneSource(LookupSource):
    """Further option: prefix, that of the database's compact ids."""

    @classmethod
    def name(cls) -> str:
        return "genes"

    def service(self, o: dict):
        return C.GeneLookup(o["endpoint"], {o["db"]: o.get("prefix", "")})


def _links(options: dict) -> list[str]:
    """Addresses of the data files of a directory page, or its own where the page is a data file; the first of the `path`
    addresses (parted by blanks) that answers."""
    url, body = C.fetch_first(options["path"].split(), tries=int(options.get("tries", 4)), wait=float(options.get("wait", 1)))
    text = C.maybe_gzip(body)
    return [urllib.parse.urljoin(url, x) for x in C.index_links(text)] if "href=" in text else [url]


def _rows(url: str, names: list[str], options: dict) -> Iterator[tuple]:
    """Rows of a file by the names in its header line; columns that it doesn't have are null."""
    text = C.maybe_gzip(C.fetch_first([url], tries=int(options.get("tries", 4)), wait=float(options.get("wait", 1)))[1])
    head = text.partition("\n")[0]
    for row in csv.DictReader(io.StringIO(text), delimiter=C.sniff_delimiter(head)) if head else ():
        yield tuple(row.get(n) for n in names)


class IndexReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = dict(options), names

    def partitions(self) -> list[File]:
        return [File(u) for u in _links(self.options)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        return _rows(partition.url, self.names, self.options) if partition.url else iter(())


class IndexStream(DataSourceStreamReader):
    """Each data file once, when the page first links to it. An offset is the list of files seen, no longer than the page."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = dict(options), names

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": sorted(_links(self.options))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        seen = set(start["files"])
        return [File(u) for u in end["files"] if u not in seen]

    def read(self, partition: File) -> Iterator[tuple]:
        return _rows(partition.url, self.names, self.options)


class IndexSource(DataSource):
    """load() takes one or several addresses of the same page, parted by blanks. The schema has to be given: string columns by
    the names in the files' header lines."""

    @classmethod
    def name(cls) -> str:
        return "index"

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options, schema.names)

    def streamReader(self, schema) -> IndexStream:
        return IndexStream(self.options, schema.names)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets Spark hand them filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SparqlSource, RecordSource, SearchSource, GeneSource, IndexSource):
        spark.dataSource.register(source)
