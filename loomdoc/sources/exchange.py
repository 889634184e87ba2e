"""Change feed pages and requests as data sources: read in parallel, streamed by sequence, written with commits.

`loomdoc_changes` reads a folder of change feed pages.  Each stretch of about STRETCH_BYTES of a page file has a range of sequences: `index_pages` finds the
ranges of all files as a Spark job and keeps them in the folder; a file that is not in that index yet is looked at once by the reader that meets it.  Stretches
whose ranges overlap make a cluster, in which a result that several pages list is taken once; partitions are neighbouring clusters, and a task holds
one of them at a time, however large files and partitions are.  Conditions
on `number` (the number that a sequence starts with), on `_id` and on `deleted` reach the source: clusters out of the range are not opened.

`loomdoc_requests` writes requests of the protocol, a row's `value` being one document, one document's diff, or one checkpoint.
Tasks write files of their own; only those of the attempts that Spark commits are named by a commit file, which appears whole, once for each write or
batch, and readers read named files alone.  A batch that runs again finds its commit file and adds nothing.
"""

from __future__ import annotations

import codecs
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..plans.errors import QueryError

CHANGES = "seq string, _id string, revids array<string>, deleted boolean, number bigint, json string"
#: The file with the ranges of the pages, and the folder of commits.
INDEX, COMMITS = "_pages.json", "_commits"
#: Bytes of the pages that one partition reads at most, if they are not one cluster, and the least and the number of partitions that fewer bytes are dealt to.
PARTITION_BYTES, LEAST_BYTES, PARTITIONS = 32 << 20, 1 << 16, 16
#: Bytes of neighbouring pages of a file that are found and read together, if each goes on behind the one before.
STRETCH_BYTES = 1 << 20
KINDS = ("bulk", "diff", "checkpoint")


def number_of(seq) -> int:
    """The number that a sequence starts with: 12, "12" and "12-abc" are 12."""
    return int(str(seq).partition("-")[0])


def _files(path: str):
    """A file system and the path there."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)


def _read(path: str) -> str | None:
    at, where = _files(path)
    try:
        with at.open_input_file(where) as source:
            return source.read().decode()
    except FileNotFoundError:
        return None


def _write(path: str, text: str, new: bool = False) -> bool:
    """A file that appears whole; with new, False if it is there already."""
    from pyarrow import fs

    at, where = _files(path)
    if new and at.get_file_info(where).type != fs.FileType.NotFound:
        return False
    at.create_dir(where.rpartition("/")[0], recursive=True)
    part = f"{where.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
    with at.open_output_stream(part) as out:
        out.write(text.encode())
    at.move(part, where)
    return True


def _delete(path: str) -> None:
    at, where = _files(path)
    try:
        at.delete_file(where)
    except FileNotFoundError:
        pass


def objects(text: str) -> Iterator[dict]:
    """The JSON objects of a page file, one after the other, however they are spaced: a file is one object, or one on each line, or both."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return
        found, at = decoder.raw_decode(text, at)
        yield found


def results(text: str) -> Iterator[tuple[int, tuple]]:
    """(number, row) of a page file's results."""
    for page in objects(text):
        for r in page["results"]:
            number = number_of(r["seq"])
            doc = r.get("doc")
            yield number, (str(r["seq"]), r["id"], [c["rev"] for c in r["changes"]], bool(r.get("deleted")), number, None if doc is None else json.dumps(doc))


def placed(path: str) -> Iterator[tuple[int, int, dict]]:
    """(first byte, byte behind the last, object) of a file's JSON objects; in memory are a block of the file and the objects that end in it."""
    at, where = _files(path)
    decoder, begin, held, last = json.JSONDecoder(), 0, b"", False
    try:
        source = at.open_input_stream(where, compression=None)
    except FileNotFoundError:
        return
    with source:
        while not last:
            # An object that has not ended is tried again when twice as much of it is there.
            block = source.read(max(STRETCH_BYTES, len(held)))
            held, last = held + block, not block
            text, end, done = codecs.getincrementaldecoder("utf-8")().decode(held, last), 0, 0
            while True:
                start = end
                while start < len(text) and text[start].isspace():
                    start += 1
                if start == len(text):
                    break
                try:
                    found, stop = decoder.raw_decode(text, start)
                except json.JSONDecodeError:
                    if last:
                        raise
                    break
                first = done + len(text[end:start].encode())
                done, end = first + len(text[start:stop].encode()), stop
                yield begin + first, begin + done, found
            held, begin = held[done:], begin + done


@dataclass(frozen=True)
class Page:
    """Pages that stand together in a file: its name and size, the range of their sequences (low > high: none), the number of their results, and their bytes; without these, the whole file."""

    name: str
    size: int
    low: int
    high: int
    count: int
    start: int = 0
    stop: int | None = None

    @property
    def bytes(self) -> int:
        return (self.size if self.stop is None else self.stop) - self.start

    def text(self, folder: str) -> str:
        if self.bytes == self.size:
            return _read(f"{folder}/{self.name}") or ""
        at, where = _files(f"{folder}/{self.name}")
        with at.open_input_file(where) as source:
            source.seek(self.start)
            return source.read(self.bytes).decode()


def pages_of(folder: str, name: str, size: int) -> list[Page]:
    """The stretches of a page file."""
    out = [Page(name, size, 0, -1, 0, 0, 0)]
    for start, stop, page in placed(f"{folder}/{name}"):
        numbers = [number_of(r["seq"]) for r in page["results"]]
        own, last = Page(name, size, min(numbers, default=0), max(numbers, default=-1), len(numbers), start, stop), out[-1]
        if not last.count:
            out[-1] = replace(own, start=last.start)
        elif not own.count or stop - last.start <= STRETCH_BYTES and last.high < own.low:
            out[-1] = replace(last, high=max(last.high, own.high), count=last.count + own.count, stop=stop)
        else:
            out.append(own)
    return [*out[:-1], replace(out[-1], stop=size)]


#: Columns of the index.
PAGE = [x.name for x in fields(Page)]


def index_pages(spark: SparkSession, path: str) -> int:
    """Writes the index of a folder's pages, reading those that it does not have yet as a Spark job; the number of page files."""
    known, missing = _listed(path)
    if missing:
        names = spark.createDataFrame(missing, "name string, size bigint").repartition(max(1, min(len(missing), spark.sparkContext.defaultParallelism)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    pages = pages_of(path, n, s)
                    yield pa.RecordBatch.from_arrays([pa.array([getattr(p, x) for p in pages], pa.string() if x == "name" else pa.int64()) for x in PAGE], PAGE)

        # One row for each stretch of a page file comes to the driver.
        known += [Page(*r) for r in names.mapInArrow(run, ", ".join(f"{x} {'string' if x == 'name' else 'bigint'}" for x in PAGE)).collect()]
        _write(f"{path}/{INDEX}", json.dumps([[getattr(p, x) for x in PAGE] for p in sorted(known, key=lambda p: (p.name, p.start))]))
    return len({p.name for p in known})


def _listed(path: str) -> tuple[list[Page], list[tuple[str, int]]]:
    """Pages that the index has as they are now, and (name, size) of the other files."""
    from pyarrow import fs

    at, where = _files(path)
    index: dict[tuple[str, int], list[Page]] = {}
    for x in json.loads(_read(f"{path}/{INDEX}") or "[]"):
        index.setdefault((x[0], x[1]), []).append(Page(*x))
    known, missing = [], []
    for info in at.get_file_info(fs.FileSelector(where, recursive=False)):
        if info.is_file and not info.base_name.startswith((".", "_")):
            key = info.base_name, info.size
            known.extend(index[key]) if key in index else missing.append(key)
    return known, sorted(missing)


@dataclass
class Pages:
    """The pages of a folder; what is not in its index is read once by this object."""

    path: str
    partition_bytes: int | None = None
    seen: dict[tuple[str, int], list[Page]] = field(default_factory=dict)

    def all(self) -> list[Page]:
        known, missing = _listed(self.path)
        for key in missing:
            if key not in self.seen:
                self.seen[key] = pages_of(self.path, *key)
        return sorted([*known, *(p for k in missing for p in self.seen[k])], key=lambda p: (p.low, p.high, p.name, p.start))

    def clusters(self, above: int, upto: int | None) -> list[list[Page]]:
        """Pages with a sequence in (above, upto], those whose ranges overlap together, by sequence."""
        out: list[list[Page]] = []
        end = None
        for page in self.all():
            if page.high > above and (upto is None or page.low <= upto) and page.low <= page.high:
                if out and page.low <= end:
                    out[-1].append(page)
                    end = max(end, page.high)
                else:
                    out.append([page])
                    end = page.high
        return out


@dataclass
class Cluster(InputPartition):
    """Neighbouring clusters of pages, and which of their results are wanted."""

    clusters: tuple[tuple[Page, ...], ...]
    above: int
    upto: int | None
    ids: frozenset[str] | None = None
    deleted: bool | None = None

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(p.name for pages in self.clusters for p in pages))


def read_cluster(path: str, part: Cluster) -> Iterator[tuple[int, tuple]]:
    """Results by sequence, each once; no two clusters share a sequence, so one of them is in memory."""
    for pages in part.clusters:
        found = {}
        for page in pages:
            for number, row in results(page.text(path)):
                if number > part.above and (part.upto is None or number <= part.upto) and (part.ids is None or row[1] in part.ids) and (part.deleted is None or row[3] == part.deleted):
                    found[number, row[1]] = row
        for key in sorted(found):
            yield key[0], found[key]


def _end(pages: Pages, above: int, upto: int | None, limit: int) -> int | None:
    """The sequence of the limit-th result after above; None if there are fewer.  Only clusters that the index cannot count for sure are read."""
    left = limit
    for cluster in pages.clusters(above, upto):
        if len(cluster) == 1 and cluster[0].low > above and (upto is None or cluster[0].high <= upto) and cluster[0].count < left:
            left -= cluster[0].count
            continue
        rows = list(read_cluster(pages.path, Cluster((tuple(cluster),), above, upto)))
        if len(rows) >= left:
            return rows[left - 1][0]
        left -= len(rows)
    return None


def _partitions(pages: Pages, above: int, upto: int | None, **wanted) -> list[Cluster]:
    """Neighbouring clusters together, as long as they are small."""
    out: list[list[tuple[Page, ...]]] = []
    clusters = pages.clusters(above, upto)
    most = pages.partition_bytes or max(LEAST_BYTES, min(PARTITION_BYTES, sum(p.bytes for x in clusters for p in x) // PARTITIONS))
    size = 0
    for cluster in clusters:
        own = sum(p.bytes for p in cluster)
        if out and size + own <= most:
            out[-1].append(tuple(cluster))
            size += own
        else:
            out.append([tuple(cluster)])
            size = own
    return [Cluster(tuple(x), above, upto, **wanted) for x in out]


class ChangesReader(DataSourceReader):
    def __init__(self, pages: Pages, since: int, limit: int | None):
        self.pages, self.above, self.limit = pages, since, limit
        self.upto: int | None = None
        self.ids: frozenset[str] | None = None
        self.deleted: bool | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (names of the interface)
        for f in filters:
            if self.limit is not None or not self._taken(f):  # a limit counts what is there before filters
                yield f

    def _taken(self, f: Filter) -> bool:
        name = getattr(f, "attribute", None)
        if name == ("number",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.above = max(self.above, f.value - (not isinstance(f, GreaterThan)))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.upto = most if self.upto is None else min(self.upto, most)
            return True
        if name == ("_id",) and isinstance(f, (EqualTo, In)):
            own = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.ids = own if self.ids is None else self.ids & own
            return True
        if name == ("deleted",) and isinstance(f, EqualTo) and self.deleted in (None, f.value):
            self.deleted = f.value
            return True
        return False

    def partitions(self) -> list[Cluster]:
        if self.limit is not None:
            end = _end(self.pages, self.above, None, self.limit)
            found = _partitions(self.pages, self.above, end)
        else:
            found = _partitions(self.pages, self.above, self.upto, ids=self.ids, deleted=self.deleted)
        return found or [Cluster((), 0, None)]

    def read(self, partition: Cluster) -> Iterator[tuple]:
        yield from (row for _, row in read_cluster(self.pages.path, partition))


class ChangesStream(DataSourceStreamReader):
    """Offsets are sequences; a batch ends with the last one that is there, or the limit-th result."""

    def __init__(self, pages: Pages, since: int, limit: int | None):
        self.pages, self.since, self.limit, self.last = pages, since, limit, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        start = self.since if self.last is None else self.last
        end = max([start, *(p.high for p in self.pages.all())])
        if self.limit is not None and (nearer := _end(self.pages, start, end, self.limit)) is not None:
            end = nearer
        self.last = end
        return {"seq": end}

    def partitions(self, start: dict, end: dict) -> list[Cluster]:
        self.last = end["seq"] if self.last is None else max(self.last, end["seq"])
        return _partitions(self.pages, start["seq"], end["seq"])

    def read(self, partition: Cluster) -> Iterator[tuple]:
        yield from (row for _, row in read_cluster(self.pages.path, partition))


class ChangesSource(DataSource):
    """A folder of change feed pages: options path, since (0), limit, the most results of a read or of a batch of a stream, and partition_bytes, the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "loomdoc_changes"

    def schema(self) -> str:
        return CHANGES

    def _options(self) -> tuple[Pages, int, int | None]:
        limit, size = (None if self.options.get(x) is None else int(self.options[x]) for x in ("limit", "partition_bytes"))
        return Pages(self.options["path"].rstrip("/"), size), number_of(self.options.get("since", 0)), limit

    def reader(self, schema) -> DataSourceReader:
        return ChangesReader(*self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangesStream(*self._options())


# Requests


def wrapped(kind: str, values: list[str]) -> str:
    """One request of the values: bulk documents, diffs {id: [revisions]} of several documents, or a checkpoint."""
    if kind == "bulk":
        return '{"new_edits":false,"docs":[' + ",".join(values) + "]}"
    if kind == "diff":
        merged: dict[str, list] = {}
        for value in values:
            for name, revs in json.loads(value).items():
                merged[name] = sorted({*merged.get(name, []), *revs})
        return json.dumps(merged, ensure_ascii=False)
    return values[0]


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, None without rows, and its number of requests."""

    name: str | None
    requests: int


class RequestsWriter(DataSourceWriter, DataSourceStreamWriter):
    """Requests of at most `size` rows of one task each, one on a line."""

    def __init__(self, path: str, kind: str, size: int, column: int, overwrite: bool):
        self.path, self.kind, self.size, self.column, self.overwrite, self.run = path, kind, 1 if kind == "checkpoint" else size, column, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        name = f"{self.kind}-{uuid.uuid4().hex}.jsonl"  # an attempt's own: one that fails or comes second is never named
        at, where = _files(f"{self.path}/{name}")
        waiting: list[str] = []
        out, n = None, 0

        def flush() -> None:
            nonlocal out, n
            if out is None:
                at.create_dir(where.rpartition("/")[0], recursive=True)
                out = at.open_output_stream(where)
            out.write((wrapped(self.kind, waiting).replace("\n", " ") + "\n").encode())
            n += 1
            waiting.clear()

        try:
            for row in iterator:
                if row[self.column] is not None:
                    waiting.append(row[self.column])
                if len(waiting) >= self.size:
                    flush()
            if waiting:
                flush()
        finally:
            if out is not None:
                out.close()
        return Written(name if n else None, n)

    def _commit(self, messages: list, key: str) -> None:
        named = [[m.name, m.requests] for m in messages if m is not None and m.name]
        old = committed(self.path) if self.overwrite else []
        text = json.dumps({"kind": self.kind, "files": named, "replaces": [x[0] for x in old]})
        if not _write(f"{self.path}/{COMMITS}/{key}.json", text, new=True):
            self._drop(messages)  # the batch was committed by an earlier run

    def _drop(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.name:
                _delete(f"{self.path}/{m.name}")

    def commit(self, messages: list, batchId: int | None = None) -> None:  # noqa: N803
        self._commit(messages, f"write-{self.run}" if batchId is None else f"batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int | None = None) -> None:  # noqa: N803
        self._drop(messages)


def committed(path: str) -> list[tuple[str, int, str]]:
    """(file, number of requests, kind) of all commits, without what later ones replace."""
    from pyarrow import fs

    at, where = _files(f"{path}/{COMMITS}")
    infos = at.get_file_info(fs.FileSelector(where, recursive=False, allow_not_found=True))
    commits = [json.loads(_read(f"{path}/{COMMITS}/{x.base_name}")) for x in sorted(infos, key=lambda x: x.base_name) if not x.base_name.startswith(".")]
    gone = {name for c in commits for name in c["replaces"]}
    return [(name, n, c["kind"]) for c in commits for name, n in c["files"] if name not in gone]


@dataclass
class Requested(InputPartition):
    name: str
    kind: str


class RequestsReader(DataSourceReader):
    def __init__(self, path: str, kind: str | None):
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        return [Requested(name, kind) for name, _, kind in committed(self.path) if self.kind in (None, kind)] or [Requested("", "")]

    def read(self, partition: Requested) -> Iterator[tuple]:
        if partition.name:
            at, where = _files(f"{self.path}/{partition.name}")
            with at.open_input_stream(where) as source:
                rest = b""
                while chunk := source.read(1 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    yield from ((partition.kind, x.decode()) for x in lines)
                if rest:
                    yield partition.kind, rest.decode()


class RequestsSource(DataSource):
    """A folder of requests: options path, kind (bulk, diff or checkpoint; all kinds where it is read without) and size (10 documents of a bulk request, 500 of a diff)."""

    @classmethod
    def name(cls) -> str:
        return "loomdoc_requests"

    def schema(self) -> str:
        return "kind string, value string"

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> DataSourceReader:
        return RequestsReader(self._path(), self.options.get("kind"))

    def _writer(self, schema, overwrite: bool) -> RequestsWriter:
        kind = self.options.get("kind", "bulk")
        if kind not in KINDS:
            raise QueryError(f"kinds of requests are {KINDS}")
        if "value" not in schema.names:
            raise QueryError("requests are written from a column value")
        size = int(self.options.get("size", 500 if kind == "diff" else 10))
        if size < 1:
            raise QueryError("a request has at least one document")
        return RequestsWriter(self._path(), kind, size, schema.names.index("value"), overwrite)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return self._writer(schema, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return self._writer(schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    spark.dataSource.register(ChangesSource)
    spark.dataSource.register(RequestsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def selected(changes: DataFrame, selector: dict | None = None, doc_ids: list[str] | None = None) -> DataFrame:
    """Results whose document matches: ids go to the source, a selector is compiled to columns over the documents that the pages carry."""
    from ..operators.predicates import predicate

    if doc_ids is not None:
        changes = changes.where(F.col("_id").isin(list(doc_ids)))
    if selector is None:
        return changes
    docs = changes.withColumn("body", F.parse_json(F.coalesce("json", F.lit("{}"))))
    return docs.where(F.col("json").isNotNull() & predicate(docs, selector)).drop("body")
