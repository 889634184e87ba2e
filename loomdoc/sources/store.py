"""A document store: immutable Parquet parts, and a manifest that names the current ones.

Revisions are only appended.  A commit writes a part, then a new manifest
version; a reader holds one version and so sees one snapshot.  Of two writers that start from one
version, the first to publish wins and the other gets a ConflictError.  Publishing is a rename to a name
that must not exist: atomic on HDFS and local disks; an object store without such a rename needs one writer at a time.

Two notions of a current revision: the winner is a function of the tree
(`mvcc.winners`); the store also keeps a pointer, which single writes follow. A local
delete moves the pointer to the tombstone if the deleted revision was current; merged
histories and resolved conflicts point to the winner again.
"""

from __future__ import annotations

import hashlib
import json
import operator
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import revisions as rv
from ..functions.tokens import Tokenizer
from ..operators import mvcc
from ..operators.find import find
from ..plans.errors import ConflictError, NotFoundError, QueryError
from ..plans.selector import And, Text, parse, texts
from ..plans.selector import fields as fields_of
from . import attachments as att
from . import events as ev
from . import folders
from .indexes import JSON, TEXT, Catalog, Index, MaterialisedIndex, bounded_fields
from .postings import StoredTextIndex

SCHEMAS = {
    "revs": mvcc.SCHEMA,
    "current": "_id string, sequence bigint, commit bigint",
    "local": "docid string, json string, commit bigint",
    "attachments": "sequence bigint, filename string, key string, type string, encoding string, length bigint, revpos int",
    "blobs": "key string, content binary",
}

#: Ranges of sequences, one for each part, that are filtered one by one.
MOST_RANGES = 64
#: Versions between whole manifests; hashes that a part's ids are told apart by; revisions in a bucket of a compacted part, and most buckets.
CHECKPOINT, ID_BITS, BUCKET_ROWS, MOST_BUCKETS = 16, 61, 100_000, 1024


def _empty(key: str | None) -> dict:
    return {"parts": {k: [] for k in SCHEMAS}, "facts": {}, "last_sequence": -1, "indexes": [], "key": key}


def _applied(manifest: dict, change: dict) -> dict:
    """The manifest after a change."""
    parts = {k: [*([] if k in change["replaced"] else v), *change["added"].get(k, [])] for k, v in manifest["parts"].items()}
    named = {x for own in parts.values() for x in own}
    facts = {k: v for k, v in (manifest["facts"] | change["facts"]).items() if k in named}
    return {"parts": parts, "facts": facts, **{k: change[k] for k in ("last_sequence", "indexes", "key")}}


class Files:
    """Small files through Hadoop, so a store can be wherever Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._utils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes a file that must not exist, whole or not at all."""
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(path) or not self.fs.rename(part, self._path(path)):
            raise ConflictError("another writer has published this version")

    def names(self, path: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class DocumentStore:
    """Create, read, update, delete, query, history and conflicts of JSON documents in a folder."""

    def __init__(self, spark: SparkSession, path: str, bus: ev.EventBus | None = None, key: bytes | None = None):
        """A key (16, 24 or 32 bytes) encrypts attachment contents; a store is opened with the key that it was made with, or none."""
        self.spark, self.path, self.bus, self.key = spark, path.rstrip("/"), bus or ev.EventBus(), key
        if key is not None and len(key) not in (16, 24, 32):
            raise QueryError("a key has 16, 24 or 32 bytes")
        self.files = Files(spark, self.path)
        self.manifest = _empty(self._key_check())
        self.version = 0
        self.refresh()
        if self.manifest.get("key") != self._key_check():
            raise QueryError("the store was made with another key")
        if not self.version:
            self.bus.post(ev.StoreCreated(self.path))
        self.bus.post(ev.StoreOpened(self.path))

    def _key_check(self) -> str | None:
        return None if self.key is None else hashlib.sha256(b"loomdoc key check" + self.key).hexdigest()[:16]

    def close(self) -> None:
        self.bus.post(ev.StoreClosed(self.path))

    def delete_store(self) -> None:
        self.files.delete(self.path)
        self.bus.post(ev.StoreDeleted(self.path))

    # Tables and commits

    def table(self, name: str) -> DataFrame:
        """All rows of a table in this version."""
        return self._read(name, self.manifest["parts"][name])

    def _read(self, name: str, parts: Sequence[str], bucket: int | None = None) -> DataFrame:
        """Rows of parts; with a bucket only the files of ids that fall in it, where a part has such files."""
        paths = []
        for part in parts:
            path, buckets = f"{self.path}/{name}/{part}", self._facts(part).get("buckets")
            if bucket is None or not buckets:
                paths.append(path)
            elif self.files.exists(path := f"{path}/_b={bucket % buckets}"):
                paths.append(path)
        if not paths:
            # A relation that is known to be empty: the planner drops joins with it.
            return self.spark.range(0).where("false").select(*(F.lit(None).cast(kind).alias(column) for column, kind in (x.split(" ") for x in SCHEMAS[name].split(", "))))
        # Folders of buckets are no columns.
        return self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(*paths)

    def _facts(self, part: str) -> dict:
        return self.manifest["facts"].get(part, {})

    def _parts(self, low: int, high: int) -> list[str]:
        """Parts of revs that can have a sequence from low to high."""
        ranges = ((x, self._facts(x).get("sequences")) for x in self.manifest["parts"]["revs"])
        return [x for x, r in ranges if r is None or r[0] <= high and r[1] >= low]

    def _of_id(self, name: str, doc_id: str) -> DataFrame:
        """A table's rows of one document, from the parts, and of bucketed parts the files, that can have them."""
        bucket = zlib.crc32(doc_id.encode())
        known = ((x, self._facts(x).get("ids")) for x in self.manifest["parts"][name])
        parts = [x for x, f in known if f is None or f[0] is not None and f[0] <= doc_id <= f[1] and f[2] >> bucket % ID_BITS & 1]
        return self._read(name, parts, bucket).where(F.col("_id") == doc_id)

    def revisions(self, low: int, high: int) -> DataFrame:
        """Revisions with a sequence from low to high, from the parts that can have them."""
        return self._read("revs", self._parts(low, high)).where((F.col("sequence") >= low) & (F.col("sequence") <= high))

    def _facts_of(self, name: str, rows: DataFrame | list) -> dict:
        """What a part is chosen by: the range of its sequences, the number of its revisions that follow another, the range of its ids and a bit for each of the ID_BITS hashes that they have."""
        if name not in ("revs", "current"):
            return {}
        if isinstance(rows, list):
            ids, sequences = [r[1 if name == "revs" else 0] for r in rows], [r[0] for r in rows]
            bits = reduce(operator.or_, (1 << zlib.crc32(x.encode()) % ID_BITS for x in ids), 0)
            children = sum(r[2] is not None for r in rows) if name == "revs" else 0
            found = (min(ids, default=None), max(ids, default=None), bits, min(sequences, default=None), max(sequences, default=None), children)
        else:
            bit = F.bit_or(F.expr(f"shiftleft(1L, cast(crc32(cast(_id as binary)) % {ID_BITS} as int))"))
            children = F.count("parent" if name == "revs" else F.lit(None))
            found = rows.agg(F.min("_id"), F.max("_id"), bit, F.min("sequence"), F.max("sequence"), children).first()
        facts = {"ids": [found[0], found[1], found[2] or 0]}
        return {**facts, "sequences": [0, -1] if found[3] is None else [found[3], found[4]], "children": found[5]} if name == "revs" else facts

    def commit(self, added: dict[str, DataFrame | list], replaced: Iterable[str] = (), ready: dict[str, tuple[str, dict]] | None = None, buckets: int = 0) -> None:
        """Publishes a version with more rows; the parts of replaced tables are dropped from it, and ready ones (table -> part, its facts) are there already.
        With buckets, tables of documents are written in so many folders by id.

        A version is a line of a log: the parts that it adds, or every CHECKPOINT versions all parts.  If another writer was first, this handle takes
        that writer's state and nothing of its own stays visible: its parts are in no manifest.
        """
        new, facts = {name: [part] for name, (part, _) in (ready or {}).items()}, dict((ready or {}).values())
        for name, rows in added.items():
            df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1)  # lists are of single writes
            part = f"part-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            path = f"{self.path}/{name}/{part}"
            if buckets and name in ("revs", "current"):
                dealt = df.withColumn("_b", (F.crc32(F.col("_id").cast("binary")) % buckets).cast("int")).repartition("_b").sortWithinPartitions("_b", "sequence")
                dealt.write.option("parquet.bloom.filter.enabled#_id", "true").partitionBy("_b").parquet(path)
                facts[part] = {"buckets": buckets}
            else:
                df.write.option("parquet.bloom.filter.enabled#_id", "true").parquet(path)
            new[name] = [*new.get(name, []), part]
            facts[part] = facts.get(part, {}) | self._facts_of(name, rows if isinstance(rows, list) else self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(path))
        # A part without rows has no folder for a bucket to be read from.
        facts = {k: {x: y for x, y in v.items() if x != "buckets" or v["ids"][0] is not None} for k, v in facts.items() if v}
        last = max([self.manifest["last_sequence"], *(x["sequences"][1] for x in facts.values() if "sequences" in x)])
        indexes = [{"name": x.name, "fields": x.fields, "type": x.type, "tokenizer": [x.tokenizer.name, x.tokenizer.arguments] if x.tokenizer else None} for x in self.indexes.indexes.values()]
        change = json.loads(json.dumps({"added": new, "replaced": list(replaced), "facts": facts, "last_sequence": last, "indexes": indexes, "key": self._key_check()}))
        manifest = _applied(self.manifest, change)
        whole = replaced or (self.version + 1) % CHECKPOINT == 0
        try:
            self.files.publish(f"{self.path}/manifest/{self.version + 1:012d}.json", json.dumps({"whole": manifest} if whole else change))
        except ConflictError:
            self.refresh()
            raise
        self.version, self.manifest = self.version + 1, manifest

    def _versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files.names(f"{self.path}/manifest") if x.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        """The state of a version: the last whole one and the changes since."""
        changes = []
        while version:
            line = json.loads(self.files.read(f"{self.path}/manifest/{version:012d}.json"))
            if "whole" in line:
                return reduce(_applied, reversed(changes), line["whole"])
            changes.append(line)
            version -= 1
        return reduce(_applied, reversed(changes), _empty(self._key_check()))

    def refresh(self) -> None:
        """Takes the newest published version."""
        newest = max(self._versions(), default=0)
        if newest:
            self.version, self.manifest = newest, self._manifest(newest)
        self.indexes = Catalog([Index(x["name"], tuple(x["fields"]), x["type"], Tokenizer(*x["tokenizer"]) if x["tokenizer"] else None) for x in self.manifest["indexes"]])

    # Versions that are held, and what nobody reads any more

    def hold(self, seconds: float = 3600) -> str:
        """Keeps this version's files until released, or for some seconds if the holder is lost; the name of the lease."""
        until = int((time.time() + seconds) * 1000)
        name = f"{self.version:012d}-{until:015d}-{uuid.uuid4().hex}"
        self.files.publish(f"{self.path}/leases/{name}", "")
        return name

    def release(self, lease: str) -> None:
        self.files.delete(f"{self.path}/leases/{lease}")

    def expire(self) -> int:
        """Deletes what neither this version nor a held one names: parts, manifests, leases that have run out; the number of deleted parts.

        Parts that writers have begun for a later version stay.  Readers of older versions that hold no lease may find their files gone.
        """
        self.refresh()
        held = {self.version}
        for lease in self.files.names(f"{self.path}/leases"):
            version, until, _ = lease.split("-")
            if int(until) < time.time() * 1000:
                self.files.delete(f"{self.path}/leases/{lease}")
            else:
                held.add(int(version))
        named = {name: set() for name in SCHEMAS}
        for version in held:
            for name, parts in self._manifest(version)["parts"].items() if version else ():
                named[name] |= set(parts)
        gone = 0
        for name in SCHEMAS:
            for part in self.files.names(f"{self.path}/{name}"):
                if part not in named[name] and int(part.split("-")[1]) <= self.version:
                    self.files.delete(f"{self.path}/{name}/{part}")
                    gone += 1
        # Of the log stays what the oldest held version is made from.
        versions, floor = self._versions(), min(held)
        while floor and "whole" not in json.loads(self.files.read(f"{self.path}/manifest/{floor:012d}.json")):
            floor -= 1
        for version in versions:
            if version < floor:
                self.files.delete(f"{self.path}/manifest/{version:012d}.json")
        return gone

    @property
    def revs(self) -> DataFrame:
        return self.table("revs")

    @property
    def last_sequence(self) -> int:
        return self.manifest["last_sequence"]

    def pointers(self) -> DataFrame:
        """_id and sequence of each document's current revision; the last commit wins."""
        rows = self.table("current")
        # A commit has one pointer of a document.
        return rows.select("_id", "sequence") if len(self.manifest["parts"]["current"]) == 1 else rows.groupBy("_id").agg(F.max_by("sequence", "commit").alias("sequence"))

    def current(self) -> DataFrame:
        """The revision that each document's pointer names, deleted ones included."""
        return self.revs.join(self.pointers(), ["_id", "sequence"], "left_semi")

    def documents(self) -> DataFrame:
        """Current documents that are not deleted: _id, _rev, sequence and body (VARIANT)."""
        rows = self.current().where(~F.col("deleted"))
        return rows.select("_id", F.col("revid").alias("_rev"), "sequence", F.parse_json(F.coalesce("json", F.lit("{}"))).alias("body"))

    def documents_of(self, sequences: DataFrame) -> DataFrame:
        """`documents` whose current revision is among sequences.

        Only parts of revs that can have them are opened, within the least and greatest sequence of each part; only rows that
        are left after the joins are parsed.
        """
        asked = sequences.select("sequence")
        lows = sorted((self._facts(x)["sequences"][0], x) for x in self.manifest["parts"]["revs"])
        if not lows:
            rows = self.revs
        else:
            # One row for each part, not for each sequence, comes to the driver.
            of = F.size(F.filter(F.array(*[F.lit(low).cast("bigint") for low, _ in lows]), lambda x: x <= F.col("sequence")))
            held = asked.groupBy(of.alias("part")).agg(F.min("sequence").alias("low"), F.max("sequence").alias("high")).where("part > 0").collect()
            rows = self._read("revs", [lows[r.part - 1][1] for r in held])
            if held:
                within = [(r.low, r.high) for r in held] if len(held) <= MOST_RANGES else [(min(r.low for r in held), max(r.high for r in held))]
                rows = rows.where(reduce(operator.or_, (F.col("sequence").between(low, high) for low, high in within)))
        rows = rows.where(~F.col("deleted")).join(asked, "sequence", "left_semi").join(self.pointers(), ["_id", "sequence"], "left_semi")
        # A filter on what a generator gives is not moved below it, and so not below the joins.
        rows = rows.select("_id", F.col("revid").alias("_rev"), "sequence", F.explode(F.array(F.coalesce("json", F.lit("{}")))).alias("json"))
        return rows.select("_id", "_rev", "sequence", F.parse_json("json").alias("body"))

    # Reads

    def _own(self, doc_id: str) -> list[Row]:
        """A document's revisions; its tree is read as a whole, in order of sequence."""
        return sorted(self._of_id("revs", doc_id).collect(), key=lambda r: r.sequence)

    def _pointer(self, doc_id: str) -> int | None:
        rows = self._of_id("current", doc_id).collect()
        return max(rows, key=lambda r: (r.commit, r.sequence)).sequence if rows else None

    def read(self, doc_id: str, revid: str | None = None) -> Row:
        """The current revision, deleted or not, or a given one (of equal ones the first)."""
        if doc_id.startswith("_local/"):
            return self.read_local(doc_id, revid)
        at = self._pointer(doc_id) if revid is None else None
        for row in self._own(doc_id):
            if row.revid == revid or revid is None and row.sequence == at:
                return row
        raise NotFoundError(f"{doc_id} {revid or ''}")

    def contains(self, doc_id: str, revid: str | None = None) -> bool:
        try:
            self.read(doc_id, revid)
        except NotFoundError:
            return False
        return True

    def read_many(self, ids: Sequence[str]) -> DataFrame:
        """Current revisions in the order of ids; unknown ids are skipped, repeated ones returned once."""
        if not ids:
            raise QueryError("a list of ids is not empty")
        order = self.spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], "_id string, _pos int")
        return self.current().join(order, "_id").orderBy("_pos").drop("_pos")

    def read_sequences(self, sequences: Sequence[int], deleted: bool = True) -> DataFrame:
        """Current revisions of the documents that these sequences belong to, in order of sequence; without deleted ones if so asked."""
        asked = self.spark.createDataFrame([(int(x),) for x in dict.fromkeys(sequences)], "sequence bigint")
        names = self.revs.join(asked, "sequence", "left_semi").select("_id").distinct()
        rows = self.current().join(names, "_id", "left_semi")
        return (rows if deleted else rows.where(~F.col("deleted"))).orderBy("sequence")

    def has_conflicts(self, doc_id: str) -> bool:
        """Whether more than one leaf of a document is not deleted."""
        return mvcc.conflicted(self._of_id("revs", doc_id)).limit(1).count() > 0

    def read_all(self, offset: int = 0, limit: int = 0, descending: bool = False) -> DataFrame:
        """Current documents that are not deleted, in order of their creation."""
        if offset < 0 or limit < 0:
            raise QueryError("offset and limit are not negative")
        first = self.revs.groupBy("_id").agg(F.min("sequence").alias("_created"))
        rows = self.current().where(~F.col("deleted")).join(first, "_id").orderBy(F.col("_created").desc() if descending else "_created")
        rows = rows.offset(offset) if offset else rows
        return (rows.limit(limit) if limit else rows).drop("_created")

    def ids(self) -> DataFrame:
        return self.current().where(~F.col("deleted")).select("_id")

    def document_count(self) -> int:
        return self.current().where(~F.col("deleted")).count()

    def changes(self, since: int, limit: int) -> tuple[int, DataFrame]:
        """The greatest sequence of the window and the current revisions of documents changed in it."""
        rows = mvcc.changes(self.revs, since, limit, self.current())
        top = self.revs.where((F.col("sequence") > max(since, 0)) & (F.col("sequence") <= max(since, 0) + limit)).agg(F.max("sequence")).first()[0]
        return (max(since, 0) if top is None else top), rows

    # Single writes

    def _append(self, doc_id: str, parent: Row | None, revid: str, body: dict | None, *, moves: bool, deleted: bool = False, kept: Sequence[str] | None = None, blobs: dict | None = None) -> Row:
        sequence = self.last_sequence + 1 if self.last_sequence >= 0 else 1
        row = (sequence, doc_id, parent.sequence if parent else None, revid, deleted, True, "{}" if deleted else json.dumps(body))
        added: dict[str, Any] = {"revs": [row]}
        if moves:
            added["current"] = [(doc_id, sequence, self.version + 1)]
        lines, contents = [], []
        if parent is not None and not deleted:
            for a in self.table("attachments").where(F.col("sequence") == parent.sequence).collect():
                if a.filename not in (blobs or {}) and (kept is None or a.filename in kept):
                    lines.append((sequence, a.filename, a.key, a.type, a.encoding, a.length, a.revpos))
        for name, (content, kind, *encoding) in (blobs or {}).items():
            encoding = encoding[0] if encoding else att.PLAIN
            coded = att.coded(content, encoding)
            lines.append((sequence, name, key := hashlib.sha1(coded).hexdigest(), kind, encoding, len(content), rv.split_revid(revid)[0]))
            contents.append((key, bytearray(coded)))
        if lines:
            added["attachments"] = lines
        if contents:
            known = {r.key for r in self.table("blobs").where(F.col("key").isin([k for k, _ in contents])).select("key").collect()}
            if new := [c for c in dict(contents).items() if c[0] not in known]:
                added["blobs"] = self.sealed(self.spark.createDataFrame(new, SCHEMAS["blobs"]))
        self.commit(added)
        return self.read(doc_id, revid)

    def create(self, body: dict, doc_id: str | None = None, attachments: dict[str, tuple] | None = None) -> Row:
        """A new document, or a child of the tombstone of a deleted one.  attachments: name -> (content, type[, encoding: plain or gzip])."""
        rv.check_body(body)
        doc_id = rv.check_id(doc_id if doc_id is not None else rv.new_id())
        if doc_id.startswith("_local/"):
            return self.put_local(doc_id, body)
        parent = None
        if (at := self._pointer(doc_id)) is not None:
            parent = next(r for r in self._own(doc_id) if r.sequence == at)
            if not parent.deleted:
                raise ConflictError(f"{doc_id} exists")
        row = self._append(doc_id, parent, rv.next_revid(parent.revid) if parent else rv.first_revid(), body, moves=True, kept=(), blobs=attachments)
        self.bus.post(ev.DocumentCreated(doc_id, parent and parent.revid, row.revid))
        return row

    def save(self, row: Row, body: dict | None = None, deleted: bool = False) -> Row:
        """Updates a document from a revision as it was read or found, with a new body or its own.  A projection does not hold the whole revision and is refused."""
        known = row.asDict()
        if "sequence" not in known or not known.keys() & {"json", "body"}:
            raise QueryError("a projected revision is not saved; full_revisions() gives the whole one")
        own = known.get("json") if "json" in known else known["body"].toJson()
        return self.update(known["_id"], known.get("revid") or known["_rev"], json.loads(own or "{}") if body is None else body, deleted=deleted)

    def update(self, doc_id: str, previous: str, body: dict, attachments: dict[str, tuple] | None = None, kept: Sequence[str] | None = None, deleted: bool = False) -> Row:
        """A child of previous, which must be current; attachments of previous stay unless kept leaves them out.  With deleted it is previous's tombstone."""
        if deleted and not doc_id.startswith("_local/"):
            return self.delete(doc_id, previous)[0]
        rv.check_body(body)
        if doc_id.startswith("_local/"):
            return self.put_local(doc_id, body)
        parent = self.read(doc_id)
        if parent.revid != previous:
            raise ConflictError(f"{previous} of {doc_id} is not current")
        row = self._append(doc_id, parent, rv.next_revid(previous), body, moves=True, kept=kept, blobs=attachments)
        self.bus.post(ev.DocumentUpdated(doc_id, previous, row.revid))
        return row

    def delete(self, doc_id: str, revid: str | None = None) -> list[Row]:
        """A tombstone for a leaf, or for every leaf that is not deleted."""
        if doc_id.startswith("_local/"):
            return self.delete_local(doc_id)
        own = self._own(doc_id)
        if not own:
            raise NotFoundError(doc_id)
        parents = {r.parent for r in own}
        if revid is None:
            chosen = [r for r in own if r.sequence not in parents and not r.deleted]
        else:
            chosen = [r for r in own if r.revid == revid][:1]
            if not chosen:
                raise NotFoundError(f"{doc_id} {revid}")
            if chosen[0].sequence in parents:
                raise ConflictError(f"{revid} of {doc_id} is not a leaf")
            if chosen[0].deleted:
                raise NotFoundError(f"{revid} of {doc_id} is deleted")
        out = []
        for row in chosen:
            out.append(self._append(doc_id, row, rv.next_revid(row.revid), None, moves=self._pointer(doc_id) == row.sequence, deleted=True))
            self.bus.post(ev.DocumentDeleted(doc_id, row.revid, out[-1].revid))
        return out

    # Local documents: not versioned, not replicated

    def put_local(self, doc_id: str, body: dict) -> Row:
        name = doc_id.removeprefix("_local/")
        self.commit({"local": [(name, json.dumps(body), self.version + 1)]})
        return self.read_local(name)

    def read_local(self, doc_id: str, revid: str | None = None) -> Row:
        if revid is not None:
            raise QueryError("local documents have no revisions")
        rows = self.table("local").where(F.col("docid") == doc_id.removeprefix("_local/")).collect()
        row = max(rows, key=lambda r: r.commit, default=None)
        if row is None or row.json is None:
            raise NotFoundError(doc_id)
        return row

    def delete_local(self, doc_id: str) -> list[Row]:
        self.read_local(doc_id)
        self.commit({"local": [(doc_id.removeprefix("_local/"), None, self.version + 1)]})
        return []

    # Many documents at a time

    def create_many(self, docs: DataFrame) -> DataFrame:
        """Creates docs (_id, json) in one commit; a live document among them is a conflict, and nothing is written."""
        current = self.current()
        if docs.join(current.where(~F.col("deleted")), "_id", "left_semi").limit(1).count() or docs.groupBy("_id").count().where("count > 1").limit(1).count():
            raise ConflictError("some of the documents exist, or are there twice")
        parent = current.select("_id", F.col("sequence").alias("parent"), rv.generation().alias("_gen"))
        rows = docs.select("_id", "json").join(parent, "_id", "left")
        # The suffix is a hash of what is written, so a task that runs again writes the same rows.
        revid = F.concat((F.coalesce("_gen", F.lit(0)) + 1).cast("string"), F.lit("-"), F.md5(F.concat_ws("\0", F.lit(str(self.version)), "_id", "json")))
        rows = rows.select("_id", "parent", revid.alias("revid"), F.lit(False).alias("deleted"), F.lit(True).alias("available"), "json")
        self._merge(mvcc.numbered(rows, ["_id"], F.lit(max(self.last_sequence, 0)).cast("bigint"), "sequence").select("sequence", "_id", "parent", "revid", "deleted", "available", "json"))
        return docs

    def force_insert(self, incoming: DataFrame) -> int:
        """Merges histories (_id, history oldest first, deleted, json); the number of new revisions."""
        before = self.last_sequence
        self._merge(mvcc.merge_history(self.revs, incoming, max(before, 0)))
        return max(self.last_sequence, 0) - max(before, 0)  # new ones are numbered without a gap

    def create_with_history(self, doc_id: str, body: dict, start: int, ids: Sequence[str], deleted: bool = False) -> Row:
        """A revision with its history, ids from it to its root."""
        if start < len(ids) or not ids:
            raise QueryError("a history has an id per generation at most, and at least one")
        history = [f"{start - i}-{x}" for i, x in enumerate(ids)][::-1]
        self.force_insert(self.spark.createDataFrame([(doc_id, history, deleted, json.dumps(rv.check_body(body)))], "_id string, history array<string>, deleted boolean, json string"))
        return self.read(doc_id, history[-1])

    def _merge(self, new: DataFrame, pointers: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Appends revisions and points their documents to the winners.  Where the caller knows these, pointers(appended) gives their _id and
        sequence; then revisions that are not deleted have their parents' attachments."""
        part = f"part-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(f"{self.path}/revs/{part}")
        written = self.spark.read.schema(SCHEMAS["revs"]).parquet(f"{self.path}/revs/{part}")
        facts = self._facts_of("revs", written)
        if facts["ids"][0] is None:
            return
        if pointers is None:
            every = self.revs.join(written.select("_id").distinct(), "_id", "left_semi").select(*written.columns).unionByName(written)
            current = mvcc.best(mvcc.leaves(every) if facts["children"] or self._parents() else every)
        else:
            current = pointers(written)
        added = {"current": current.select("_id", "sequence", F.lit(self.version + 1).cast("bigint").alias("commit"))}
        if pointers is not None and self.manifest["parts"]["attachments"]:
            own = written.where(~F.col("deleted")).select(F.col("sequence").alias("_child"), F.col("parent").alias("sequence"))
            added["attachments"] = self.table("attachments").join(own, "sequence").select(F.col("_child").alias("sequence"), "filename", "key", "type", "encoding", "length", "revpos")
        self.commit(added, ready={"revs": (part, facts)})

    def _parents(self) -> list[str]:
        """Parts of revs that can have a revision that follows another."""
        return [x for x in self.manifest["parts"]["revs"] if self._facts(x).get("children") != 0]

    # Conflicts

    def conflicted_ids(self) -> DataFrame:
        return mvcc.conflicted(self.revs).select("_id")

    def resolve_conflicts(self, resolver: Callable[[str, Any], Any]) -> int:
        """Resolves all conflicted documents in one commit; the number of new revisions.

        resolver(id, its live leaves) returns the revision id that stays, a new body to go under the winner, or (revision id, new body).  The other
        leaves get tombstones, a body becomes a child of the leaf that stays, with that leaf's attachments.  None or an error leaves a conflict.
        """
        parts = self._parents()
        return self._resolve(mvcc.leaves(self.revs, self._read("revs", parts)) if parts else self.revs, resolver)

    def _resolve(self, leaves: DataFrame, resolver: Callable[[str, Any], Any]) -> int:
        decided = folders.written(mvcc.decided(leaves, resolver), "resolved")
        ends = F.explode(F.arrays_zip(F.col("losers").alias("revid"), F.col("gone").alias("parent"))).alias("_end")
        lost = decided.select("_id", ends).select("_id", "_end.revid", "_end.parent", F.lit(True).alias("deleted"), F.lit("{}").alias("json"))
        merged = decided.where("body is not null").select("_id", F.col("kept").alias("revid"), F.col("at").alias("parent"), F.lit(False).alias("deleted"), F.col("body").alias("json"))
        rows = lost.unionByName(merged)
        hashed = F.md5(F.concat_ws("\0", "_id", "revid", F.when(~F.col("deleted"), F.col("json"))))
        child = F.concat((rv.generation() + 1).cast("string"), F.lit("-"), hashed)
        rows = rows.select("_id", "parent", child.alias("revid"), "deleted", F.lit(True).alias("available"), "json")
        before = self.last_sequence
        # Of a resolved document one leaf is not deleted, and so wins: the new body, or else what stays.
        stays = decided.where("body is null and size(losers) > 0").select("_id", F.col("at").alias("sequence"))
        numbered = mvcc.numbered(rows, ["_id", "revid"], F.lit(before).cast("bigint"), "sequence").select("sequence", "_id", "parent", "revid", "deleted", "available", "json")
        self._merge(numbered, lambda new: new.where(~F.col("deleted")).select("_id", "sequence").unionByName(stays))
        folders.discard(decided)
        return self.last_sequence - before

    def resolve_with(self, doc_id: str, resolver: Callable[[str, list[Row]], Any]) -> bool:
        """One document: the resolver returns the leaf that stays, or a new body to go under the winner; None or an error changes nothing."""
        own = self._own(doc_id)
        parents = {r.parent for r in own}
        leaves = [r for r in own if r.sequence not in parents and not r.deleted]
        if len(leaves) < 2:
            return False
        try:
            kept = resolver(doc_id, leaves)
        except Exception:  # by contract a resolver that fails leaves the conflict
            kept = None
        if kept is None:
            return False
        decision = rv.check_body(kept) if isinstance(kept, dict) else kept.revid
        if decision is None:
            raise QueryError("the revision that stays has no id")
        self._resolve(mvcc.leaves(self._of_id("revs", doc_id)), lambda name, _: decision)
        if isinstance(kept, dict):
            row = self.read(doc_id)
            self.bus.post(ev.DocumentUpdated(doc_id, max((r.revid for r in leaves), key=rv.split_revid), row.revid))
        return True

    # Attachments

    def attachment(self, doc_id: str, name: str, revid: str | None = None) -> bytes:
        row = self.read(doc_id, revid)
        found = self.table("attachments").where((F.col("sequence") == row.sequence) & (F.col("filename") == name)).join(self.blobs(), "key").select("content", "encoding").first()
        if found is None:
            raise NotFoundError(f"{doc_id} {name}")
        return att.plain(bytes(found.content), found.encoding)

    def blobs(self) -> DataFrame:
        """Attachment contents (key, content), decrypted; still gzipped where their attachment's encoding says so."""
        rows = self.table("blobs")
        return rows if self.key is None else rows.withColumn("content", att.decrypted("content", F.lit(self.key)))

    def sealed(self, blobs: DataFrame) -> DataFrame:
        """blobs as they are stored: encrypted if the store has a key, with a vector that depends on key and content, so a task that runs again writes the same."""
        if self.key is None:
            return blobs
        vector = F.unhex(F.substring(F.sha2(F.concat(F.lit(self.key), "content"), 256), 1, 2 * att.VECTOR_BYTES))
        return blobs.withColumn("content", att.encrypted("content", F.lit(self.key), vector))

    # Maintenance and queries

    def compact(self) -> None:
        """Drops bodies and attachments of revisions that others follow, then blobs that nobody has, and merges the parts of every table, dealt to buckets by id.

        What was dropped is out of this version; `expire` deletes its files once no held version names them.
        """
        kept = mvcc.compact(self.revs)
        lines = self.table("attachments").join(mvcc.leaves(self.revs).select("sequence"), "sequence", "left_semi")
        blobs = self.table("blobs").join(lines.select("key").distinct(), "key", "left_semi")
        pointers = self.table("current").groupBy("_id").agg(F.max_by(F.struct("sequence", "commit"), F.struct("commit", "sequence")).alias("_last")).select("_id", "_last.*")
        local = self.table("local").groupBy("docid").agg(F.max_by(F.struct("json", "commit"), "commit").alias("_last")).select("docid", "_last.*").where("json is not null")
        buckets = min(MOST_BUCKETS, 1 + self.revs.count() // BUCKET_ROWS)
        self.commit({"revs": kept, "attachments": lines, "blobs": blobs, "current": pointers, "local": local}, replaced=tuple(SCHEMAS), buckets=buckets if buckets > 1 else 0)
        for index in self.list_indexes():
            if index.type == TEXT:
                StoredTextIndex(self, index).clean()

    def create_json_index(self, fields: Sequence, name: str | None = None) -> Index:
        return self._indexed(fields, name, JSON, None)

    def create_text_index(self, fields: Sequence, name: str | None = None, tokenizer: Tokenizer | None = None) -> Index:
        return self._indexed(fields, name, TEXT, tokenizer)

    def _indexed(self, fields: Sequence, name: str | None, type: str, tokenizer: Tokenizer | None) -> Index:
        before = dict(self.indexes.indexes)
        index = self.indexes.ensure(fields, name, type, tokenizer)
        if self.indexes.indexes != before:
            self.commit({})
        return index

    def _stored(self, index: Index) -> MaterialisedIndex | StoredTextIndex:
        return (MaterialisedIndex if index.type == JSON else StoredTextIndex)(self, index)

    def delete_index(self, name: str) -> None:
        index = self.indexes.indexes.get(name)
        self.indexes.delete(name)
        self.commit({})
        self.files.delete(self._stored(index).folder)

    def list_indexes(self) -> list[Index]:
        return list(self.indexes.indexes.values())

    def refresh_all_indexes(self) -> None:
        """Brings the tables of all indexes up to this version; `find` does so for those that it reads."""
        for index in self.list_indexes():
            self._stored(index).refresh()

    def _best(self, tree: Any) -> Index | None:
        """The JSON index with most fields that the selector bounds."""
        best, fields = None, 0
        for index in self.list_indexes():
            if index.type == JSON and len(own := bounded_fields(tree, index)) > fields:
                best, fields = index, len(own)
        return best

    def _covering(self, tree: Any, fields: Sequence[str] | None, sort: Sequence | None) -> Index | None:
        """A JSON index that has all fields of a find."""
        if not fields or any(isinstance(x, Text) for x in texts(tree)):
            return None
        needed = {*fields, *fields_of(tree), *_sorted_fields(sort)}
        return next((x for x in self.list_indexes() if x.type == JSON and needed <= set(x.fields)), None)

    def is_text_search_enabled(self) -> bool:
        return True

    def find(self, selector: dict, skip: int = 0, limit: int = 0, fields: Sequence[str] | None = None, sort: Sequence | None = None, strict: bool = False) -> DataFrame:
        """Documents that match.  With strict, fields of a text query and of a sort must be indexed.

        A text search is answered by the stored postings.  A JSON index that has all fields of selector, sort and projection answers alone, without
        opening the revisions.  Another one that bounds the selector is read first, with the bounds as Parquet filters; only documents that
        both let through are read, parsed and matched.  Indexes are caught up with before they are read.
        """
        tree, searched, marked = parse(selector), None, None
        found = [x for x in texts(tree) if isinstance(x, Text)]
        if found:
            index = self.indexes.text()
            if index is None:
                raise QueryError("a text search needs a text index")
        if strict:
            self._check(tree, sort, bool(found))
        if (covering := self._covering(tree, fields, sort)) is not None:
            view = MaterialisedIndex(self, covering)
            view.refresh()
            return find(view.documents(tree), selector, skip, limit, fields, sort)
        if found:
            stored = StoredTextIndex(self, index)
            stored.refresh()
            searched = folders.written(stored.matches(found[0].search), "searched")  # it is read for its ranges, then joined
            if not (isinstance(tree, Text) or isinstance(tree, And) and found[0] in tree.children):
                marked, searched = searched, None  # the search is one of several ways to match
        candidates = searched
        if (best := self._best(tree)) is not None:
            view = MaterialisedIndex(self, best)
            view.refresh()
            if view.parts:
                bounded = view.candidates(tree)
                candidates = bounded if candidates is None else candidates.join(bounded, "sequence", "left_semi")
        docs = self.documents() if candidates is None else self.documents_of(candidates)
        if marked is None:
            return find(docs, selector, skip, limit, fields, sort, text=lambda _: F.lit(True))
        docs = docs.join(marked.select("sequence", F.lit(True).alias("_searched")), "sequence", "left").select(*docs.columns, "_searched")
        out = find(docs, selector, skip, limit, fields, sort, text=lambda _: F.coalesce("_searched", F.lit(False)))
        return out.drop("_searched")

    def full_revisions(self, projected: DataFrame) -> DataFrame:
        """The whole revisions of projected rows (_id, _rev)."""
        whole = self.revs.select("_id", F.col("revid").alias("_rev"), "sequence", F.parse_json(F.coalesce("json", F.lit("{}"))).alias("body"))
        return whole.join(projected.select("_id", "_rev"), ["_id", "_rev"], "left_semi")

    def _check(self, tree: Any, sort: Sequence | None, searched: bool) -> None:
        json_indexes = [set(x.fields) for x in self.list_indexes() if x.type == JSON]
        if searched and not all(any(f in x for x in json_indexes) for f in fields_of(tree)):
            raise QueryError("a text query has fields without an index")
        wanted = _sorted_fields(sort)
        if wanted and not any(wanted <= set(x.fields) for x in self.list_indexes()):
            raise QueryError("no index has all fields of the sort")


def _sorted_fields(sort: Sequence | None) -> set[str]:
    return {x[0] if isinstance(x, (tuple, list)) else next(iter(x)) if isinstance(x, dict) else x for x in sort or ()}
