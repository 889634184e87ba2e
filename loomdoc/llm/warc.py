"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members into archive files of about
ARCHIVE_BYTES.  Of pages with equal payloads of at least LEAST_REVISIT bytes, the one with the
largest page_id is a response and the others are revisits of it, which keep the HTTP
header but not the payload and name the response's record (WARC-Refers-To), URL and date.  Each archive starts with a
warcinfo record.

Index: every record has a line with its key, the URL with its host reversed
(`com,example)/path`), and its place.  Lines are range-partitioned by key; each part is
a file of compressed blocks of BLOCK_LINES sorted lines, followed by a sparse
directory with the first key and the place of each block.  A small table has the least key of
each part.

Look-ups go to the parts that may hold their key; there a binary search in the
directory finds the block, one range read fetches it, a binary search in the block finds the
lines, and one range read per line fetches the record.  `digest` takes the payload's length and digest of a revisit from the
response that it refers to, and fails if that is missing or its digest differs from the one that the revisit states.

All files are in the shared folder.  A task that runs again writes the same names
with the same bytes.

Defined results: a null html is an empty payload; a null URL has the key `-`; a malformed URL is its own key; pages with a
null page_id are responses and are never referred to; rows with one page_id and
one payload are all the response or all revisits; an empty table gives no rows; a page_id that is no integer is refused (TypeError).
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 300
PART_LINES = 100_000
RECORDS_AT_ONCE = 500
WRITTEN_AT = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def escaped(key: str) -> str:
    """A key without the signs that part index lines and their fields."""
    return key.replace("\n", "%0A").replace("\x00", "%00")


def url_key(url: str | None) -> str:
    """The URL with its host reversed and in lower case, without scheme, user and fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return escaped(url)
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return escaped(key + (f"?{parts.query}" if parts.query else ""))


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    """A name-based UUID, so that a rewritten archive has the same bytes."""
    h = hashlib.sha1(json.dumps([page_id, digest, url]).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) & 3]}{h[17:20]}-{h[20:32]}>"


def target_uri(url: str | None) -> str:
    """The URL without the signs that would end its header line."""
    return "".join(c for c in url or "-" if c not in "\r\n")


def info_record(name: str) -> bytes:
    """The warcinfo record that an archive starts with, as a gzip member."""
    block = b"software: loomdoc\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, None)), ("WARC-Date", WRITTEN_AT), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record, as a gzip member; a revisit refers to the response of page refers_to with refers_url and an equal payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, url)),
        ("WARC-Date", WRITTEN_AT),
        ("WARC-Target-URI", target_uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, refers_url)), ("WARC-Refers-To-Target-URI", target_uri(refers_url)), ("WARC-Refers-To-Date", WRITTEN_AT), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def read_record(member: bytes) -> dict:
    """Fields of a record, its HTTP header fields and its payload (None in a revisit); digests and lengths are checked."""
    raw = gzip.decompress(member)
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("damaged block")
    http, payload = block.split(b"\r\n\r\n", 1)
    answer = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "revisit":
        payload = None
    elif fields["WARC-Payload-Digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
        raise ValueError("damaged payload")
    return {"fields": fields, "http": answer, "payload": payload}


def referred(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages with refers_to and refers_url: the page whose response holds an equal payload (of several rows of that page_id the greatest URL), null in responses.

    Only digests are grouped; of a payload that many pages have, partial
    aggregates are shuffled, and only its revisits are joined back.
    """
    payload = F.coalesce("html", F.lit(""))
    known = pages.where("page_id is not null").select("page_id", "url", F.octet_length(payload).alias("_bytes"), F.sha2(payload, 256).alias("_digest")).where(F.col("_bytes") >= least)
    first = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    chosen = known.groupBy("_digest").agg(first.alias("_first"), F.min("page_id").alias("_low")).where("_low < _first.page_id").select("_digest", F.col("_first.page_id").alias("_refers"), F.nullif(F.col("_first.url"), F.lit("")).alias("_refers_url"))
    revisits = known.select("page_id", "_digest").join(chosen, "_digest").where("page_id < _refers").select(F.col("page_id").alias("_page"), "_digest", "_refers", "_refers_url").distinct()
    # The digest tells pages apart that share a page_id.
    keyed = pages.withColumn("_own", F.when(F.octet_length(payload) >= least, F.sha2(payload, 256)))
    return keyed.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("_own") == F.col("_digest")), "left").select("page_id", "url", "html", F.col("_refers").alias("refers_to"), F.col("_refers_url").alias("refers_url"))


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of pages (page_id, url, html, refers_to, refers_url); one index line (key, page_id, archive, offset, length) per record."""
    path = shared.fresh(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        lines: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal number, held, size, lines
            shared.put(f"{path}/part-{part:05d}-{number:05d}.warc.gz", b"".join(held))
            columns = list(zip(*lines, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "archive", "offset", "length"])
            number, held, size, lines = number + 1, [], 0, []
            return out

        for batch in batches:
            for page_id, url, html, refers_to, refers_url in zip(*(batch.column(x) for x in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                if not held:
                    held.append(info_record(f"part-{part:05d}-{number:05d}.warc.gz"))
                    size = len(held[0])
                member = make_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), refers_url.as_py())
                lines.append((url_key(url.as_py()), page_id.as_py(), f"{path}/part-{part:05d}-{number:05d}.warc.gz", size, len(member)))
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield close()
        if lines:
            yield close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("refers_to").cast("long").alias("refers_to"), "refers_url")
    # A task that runs again must write the same bytes, whatever order its rows come in.
    return rows.sortWithinPartitions("page_id", "url", "html").mapInArrow(run, "key string, page_id bigint, archive string, offset bigint, length bigint")


def index(lines: DataFrame, part_lines: int = PART_LINES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes index files of lines(); a table of their (part, path, low, directory_offset), one row per part."""
    spark = lines.sparkSession
    # lines must be a written table: index files point to the archives of one run, whatever tasks are repeated.
    parts = max(1, -(-lines.count() // part_lines))
    path = shared.fresh(spark, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks, directory, at, held = [], [], 0, []

        def close() -> None:
            nonlocal at, held
            block = zlib.compress("\n".join(f"{k}\0{json.dumps(x)}" for k, x in held).encode(), 6)
            directory.append((held[0][0], at, len(block)))
            blocks.append(block)
            at, held = at + len(block), []

        for batch in batches:
            for key, *x in zip(*(batch.column(x).to_pylist() for x in ("key", "page_id", "archive", "offset", "length")), strict=True):
                held.append((key, x))
                if len(held) >= block_lines:
                    close()
        if held:
            close()
        if blocks:
            part = TaskContext.get().partitionId()
            name = f"{path}/part-{part:05d}.idx"
            shared.put(name, b"".join(blocks) + zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([directory[0][0]]), pa.array([at], pa.int64())], ["part", "path", "low", "directory_offset"])

    order = ["key", "page_id", "archive", "offset"]
    made = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "part bigint, path string, low string, directory_offset bigint")
    return shared.written(made, "parts")


def lookup(spark: SparkSession, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines (key, page_id, archive, offset, length) of each key in wanted (key), found through the index.

    The top table has a row per part of the index.  A key is sent to each part
    that may hold it: those from the last whose least key is below it up to the last
    whose least key is not above it; keys of one part are dealt to several tasks.
    """
    top = sorted((r.low, r.part, r.path, r.directory_offset) for r in parts.toLocalIterator())
    sent, parts_n = shared.Sent(spark, top), len(top)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = [x[0] for x in sent()]
        for batch in batches:
            keys, found = [], []
            for key in batch.column("key").to_pylist():
                for i in range(max(0, bisect.bisect_left(lows, key) - 1), bisect.bisect_right(lows, key)):
                    keys.append(key)
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.int64())], ["key", "at"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, current, block_at, lines, keys = sent(), None, None, [], []
        for batch in batches:
            out: list[tuple] = []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                _, _, path, directory_offset = top[at]
                if at != current:
                    directory = json.loads(zlib.decompress(shared.get(path, directory_offset)))
                    firsts, current, block_at = [x[0] for x in directory], at, None
                for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    if i != block_at:
                        lines = [x.split("\0", 1) for x in zlib.decompress(shared.get(path, *directory[i][1:])).decode().split("\n")]
                        keys, block_at = [x[0] for x in lines], i
                    out += [(key, *json.loads(lines[k][1])) for k in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "archive", "offset", "length"])

    routed = wanted.select("key").distinct().mapInArrow(route, "key string, at bigint")
    dealt = routed.repartitionByRange(max(parts_n, spark.sparkContext.defaultParallelism), "at", "key").sortWithinPartitions("at", "key")
    return dealt.mapInArrow(search, "key string, page_id bigint, archive string, offset bigint, length bigint")


def fetch(lines: DataFrame) -> DataFrame:
    """Records of index lines, by range reads: record_id, page_id, url, record_type, payload, payload_digest (as stated), payload_bytes (null in revisits), refers_to (page), refers_id (record)."""
    schema = "record_id string, page_id bigint, url string, record_type string, payload binary, payload_digest string, payload_bytes bigint, refers_to bigint, refers_id string"
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, RECORDS_AT_ONCE):
                rows = []
                for archive, offset, length in zip(*(whole.column(x).slice(at, RECORDS_AT_ONCE).to_pylist() for x in ("archive", "offset", "length")), strict=True):
                    record = read_record(shared.get(archive, offset, length))
                    fields, payload = record["fields"], record["payload"]
                    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
                    own = (payload, fields["WARC-Payload-Digest"].removeprefix("sha1:"), None if payload is None else len(payload))
                    rows.append((fields["WARC-Record-ID"], page and int(page), fields["WARC-Target-URI"], fields["WARC-Type"], *own, refers and int(refers), fields.get("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return lines.select("archive", "offset", "length").mapInArrow(run, schema)


RESULT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def digest(pages: DataFrame) -> DataFrame:
    """One row per page, as read back through the index."""
    spark = pages.sparkSession
    shared.integer_ids(pages, "page_id")
    pages = pages.select("page_id", "url", "html")
    lines = shared.written(write(referred(pages)), "records")
    parts = index(lines)
    found = shared.written(lookup(spark, parts, lines.select("key")), "found")
    if (n := found.count()) != (written := lines.count()):
        raise RuntimeError(f"the index finds {n} of {written} records")
    records = shared.written(fetch(found).drop("payload", "url"), "fetched")
    # Of a payload that many pages have, one response is joined to all its revisits: both sides hold numbers only.
    answers = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    joined = records.where("record_type = 'revisit'").join(answers, "refers_id", "left")
    same = F.when(F.col("_digest") == F.col("payload_digest"), F.col("_bytes")).otherwise(F.raise_error(F.lit("a revisit without its response")).cast("bigint"))
    revisits = joined.withColumn("payload_bytes", same).select(*RESULT)
    return records.where("record_type = 'response'").select(*RESULT).unionByName(revisits)
