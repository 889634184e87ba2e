"""Line dedup: documents probe arrays behind sharded minimal perfect hashes.

A line's key is the line without spaces (`[\\x20\\x09-\\x0D]`) at its ends, A-Z in
lower case.  One aggregation by the key's 128-bit hash counts the documents of
each distinct line of at least `least_chars` code points.  The hashes of repeated
lines (in at least `least_docs` documents) are cut into shards by their high
bits; each shard is a file in the shared folder with a minimal perfect hash and,
in its order, arrays of 64-bit fingerprints, document counts and largest
document ids.  Documents are then scanned once more, and their lines probe the arrays: without a
shuffle as long as a worker can keep all shards (CACHED_SHARDS, 160 MB), beyond that the hashes of the lines go to the
tasks that hold their shards (several a shard, dealt by text, so a line of many documents is not one task's) and only
those to drop come back.

The perfect hash has levels: a key takes its place in the first level where it
collides with no other key, and its rank among all places is its number.
Hash and fingerprint are the two halves of BLAKE2b-128, so a line that is in no
array passes for one with probability below 2**-64.

Memory: a task holds the lines of PROBE_ROWS rows and at most CACHED_SHARDS shards of at
most about SHARD_KEYS keys (20 bytes each).  Every shard has a file, an empty one too; one that is missing is an error.

Defined results: a null or empty text is one empty line; equal rows are one
document if their doc_id is equal; a row with a null doc_id counts as a document of its own
text, and never holds the kept copy unless no other row does; an empty table gives no
rows; a doc_id that is no integer is refused (TypeError); columns of docs are kept whatever their names, and the added ones get
underscores where docs has theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, shared
from .neardup import text_key

LEAST_CHARS = 40
LEAST_DOCS = 5
SHARD_KEYS = 1_000_000
CACHED_SHARDS = 8
SPACES = b" \t\n\x0b\x0c\r"
ROOM = 2.0
#: Rows whose lines are looked up together.
PROBE_ROWS = 2000
#: Tasks that the lines of one shard are dealt to, where lines go to shards.
SALTS = 4

_U = np.uint64
_NO_ID = -(1 << 63)


def keys_of(text: bytes, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of each line, None for shorter keys."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(SPACES).lower()
        # Code points are at most as many as bytes.
        out.append(key if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars) else None)
    return out


def hash_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by levels of bits with ranks."""

    def __init__(self, keys: np.ndarray, levels: list[np.ndarray] | None = None):
        self.levels: list[np.ndarray] = levels if levels is not None else []
        if levels is None:
            while len(keys):
                size = max(64, -(-int(len(keys) * ROOM) // 64) * 64)
                place = self._place(keys, len(self.levels), size)
                counts = np.bincount(place, minlength=size)
                self.levels.append(np.packbits(counts == 1, bitorder="little").view(np.uint64))
                keys = keys[counts[place] != 1]
        ones = [np.bitwise_count(x).astype(np.int64) for x in self.levels]
        self.ranks = []
        total = 0
        for x in ones:
            sums = np.cumsum(x)
            self.ranks.append(total + sums - x)
            total += int(sums[-1])
        self.size = total

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (bytescan.mix(keys + _U((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % _U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; of a key outside the set any number, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = self._place(keys[left], level, len(bits) * 64)
            word, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            there = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[left[there]] = (ranks[place >> 6] + below)[there]
            left = left[~there]
            if not len(left):
                break
        return out


#: Counts are kept in 32 bits; higher ones as this one.
MOST_DOCS = (1 << 32) - 1


class Shard:
    """The perfect hash of a shard's keys and arrays in its order."""

    def __init__(self, high: np.ndarray, low: np.ndarray, docs: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(high)
        order = np.empty(len(high), dtype=np.int64)
        order[self.hash(high)] = np.arange(len(high))
        self.low, self.last = low[order], last[order]
        # A count beyond 32 bits stays beyond every bound that is asked for.
        self.docs = np.minimum(docs[order], MOST_DOCS).astype(np.uint32)

    def to_bytes(self) -> bytes:
        heads = np.array([len(self.low), len(self.hash.levels), *(len(x) for x in self.hash.levels)], dtype=np.int64)
        return b"".join(x.tobytes() for x in (heads, *self.hash.levels, self.low, self.last, self.docs))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        n, count = np.frombuffer(data, np.int64, 2)
        lengths, at, levels = np.frombuffer(data, np.int64, count, 16), 16 + 8 * int(count), []
        for k in lengths:
            levels.append(np.frombuffer(data, np.uint64, k, at))
            at += 8 * int(k)
        out, n = cls.__new__(cls), int(n)
        out.hash = PerfectHash(np.zeros(0, np.uint64), levels)
        out.low, out.last = np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n)
        out.docs = np.frombuffer(data, np.uint32, n, at + 16 * n)
        return out

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document counts and largest ids; a count of 0 for keys that are not in the shard."""
        number = self.hash(high) if len(self.low) else np.full(len(high), -1)
        known = number >= 0
        known[known] = self.low[number[known]] == low[known]
        docs, last = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        docs[known], last[known] = self.docs[number[known]], self.last[number[known]]
        return docs, last


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """high, low (halves of the line hash), docs and last (largest doc_id) of lines in enough documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = [], []
            for piece in bytescan.pieces(batch.column("text")):
                for row in range(piece.rows):
                    own = {hash_of(k) for k in keys_of(piece.text(row), least_chars) if k is not None}
                    hashes += own
                    ids += [piece.first + row] * len(own)
            high, low = _halves(hashes)
            of = batch.column("doc_id").take(pa.array(ids, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), of], ["high", "low", "doc_id"])

    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "high bigint, low bigint, doc_id bigint")
    # Documents are counted by distinct ids only where rows say that an id may be there twice.
    repeated_ids = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0
    if repeated_ids:
        lines = lines.where("doc_id is not null").distinct().unionByName(lines.where("doc_id is null"))
    return lines.groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.max("doc_id"), F.lit(_NO_ID)).alias("last")).where(F.col("docs") >= least_docs)


def build(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Writes the shards of repeated_lines() to the shared folder; their path and number."""
    spark = lines.sparkSession
    lines = shared.written(lines, "lines")
    n_shards = max(1, -(-lines.count() // shard_keys))
    path = shared.fresh(spark, "line-arrays")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = lambda x: table.column(x).to_numpy()
        of = column("shard")
        for k in np.unique(of):
            at = of == k
            shard = Shard(column("high")[at].view(np.uint64), column("low")[at].view(np.uint64), column("docs")[at], column("last")[at])
            shared.put(f"{path}/{k}.mph", shard.to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([int(at.sum())])], ["shard", "keys"])

    made = lines.select("*", _shard_of("high", n_shards)).repartition(n_shards, "shard").mapInArrow(run, "shard bigint, keys bigint").collect()
    empty = np.zeros(0, np.uint64)
    for k in set(range(n_shards)) - {r.shard for r in made}:
        shared.put(f"{path}/{k}.mph", Shard(empty, empty, empty.view(np.int64), empty.view(np.int64)).to_bytes())
    return path, n_shards


def _shard_of(high: str, n_shards: int):
    return F.pmod(F.shiftrightunsigned(high, 32), F.lit(n_shards)).alias("shard")


def probing(path: str, n_shards: int):
    """A function (high, low halves of hashes) -> (document counts, largest ids) that reads shards from the shared folder."""
    cache: dict[int, Shard] = {}

    def shard(k: int) -> Shard:
        if k not in cache:
            if len(cache) >= CACHED_SHARDS:
                del cache[next(iter(cache))]
            cache[k] = Shard.from_bytes(shared.get(f"{path}/{k}.mph"))
        return cache[k]

    def probe(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, last = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        of = ((high >> _U(32)) % _U(n_shards)).astype(np.int64)
        for k in np.unique(of):
            at = of == k
            docs[at], last[at] = shard(int(k)).probe(high[at], low[at])
        return docs, last

    return probe


def routed(docs: DataFrame, path: str, n_shards: int, least_chars: int, least_docs: int) -> DataFrame:
    """h1, h2, doc_id and gone: the hashes of the lines to drop of each document that loses some, found by the tasks that hold the shards."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = [], []
            for piece in bytescan.pieces(batch.column("text")):
                for row in range(piece.rows):
                    own = {hash_of(k) for k in keys_of(piece.text(row), least_chars) if k is not None}
                    hashes += own
                    rows += [piece.first + row] * len(own)
            high, low = _halves(hashes)
            at = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(at) for x in ("h1", "h2", "doc_id")), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["h1", "h2", "doc_id", "high", "low"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = probing(path, n_shards)
        for batch in batches:
            counts, last = probe(*(batch.column(x).to_numpy().view(np.uint64) for x in ("high", "low")))
            own = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            yield batch.select(["h1", "h2", "doc_id", "high", "low"]).filter(pa.array((counts >= min(least_docs, MOST_DOCS)) & (last != own)))

    found = docs.select(*text_key(), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lines, "h1 bigint, h2 bigint, doc_id bigint, high bigint, low bigint")
    dealt = found.distinct().select("*", _shard_of("high", n_shards), F.pmod("h1", F.lit(SALTS)).alias("_salt")).repartition(n_shards * SALTS, "shard", "_salt").sortWithinPartitions("shard")
    hits = dealt.mapInArrow(look, "h1 bigint, h2 bigint, doc_id bigint, high bigint, low bigint")
    return hits.groupBy("h1", "h2", "doc_id").agg(F.collect_list(F.struct("high", "low")).alias("gone"))


def _dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, direct_shards: int = CACHED_SHARDS) -> DataFrame:
    """docs (doc_id, text and others) with text replaced by the lines that stay, and n_lines and n_dropped."""
    shared.integer_ids(docs)
    path, n_shards = build(repeated_lines(docs, least_chars, least_docs), shard_keys)
    names, schema = docs.columns, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    at_text, direct = names.index("text"), n_shards <= direct_shards
    if not direct:
        gone = routed(docs, path, n_shards, least_chars, least_docs).withColumnsRenamed({"h1": "_h1", "h2": "_h2", "doc_id": "_of"})
        keyed = docs.select(*names, *[x.alias(f"_{n}") for x, n in zip(text_key(), ("k1", "k2"), strict=True)])
        docs = keyed.join(gone, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")) & F.col("doc_id").eqNullSafe(F.col("_of")), "left").select(*names, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = probing(path, n_shards) if direct else None
        for whole in batches:
            for first in range(0, whole.num_rows, PROBE_ROWS):
                batch = whole.slice(first, PROBE_ROWS)
                texts, hashes, where = [], [], []
                for piece in bytescan.pieces(batch.column(at_text)):
                    for row in range(piece.rows):
                        texts.append(text := piece.text(row))
                        if direct or batch.column("gone")[piece.first + row].is_valid:
                            for i, key in enumerate(keys_of(text, least_chars)):
                                if key is not None:
                                    hashes.append(hash_of(key))
                                    where.append((piece.first + row, i))
                drop: dict[int, set[int]] = {}
                high, low = _halves(hashes)
                if direct:
                    counts, last = probe(high, low)
                    ids = [_NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
                    hits = [k for k in np.flatnonzero(counts >= min(least_docs, MOST_DOCS)) if last[k] != ids[where[k][0]]]
                else:
                    own = [x and {(g["high"], g["low"]) for g in x} for x in batch.column("gone").to_pylist()]
                    hits = [k for k, x in enumerate(zip(high.view(np.int64).tolist(), low.view(np.int64).tolist(), strict=True)) if x in own[where[k][0]]]
                for k in hits:
                    drop.setdefault(where[k][0], set()).add(where[k][1])
                kept, lines = [], []
                for row, text in enumerate(texts):
                    parts = text.split(b"\n")
                    lines.append(len(parts))
                    lost = drop.get(row)
                    kept.append(b"\n".join(x for i, x in enumerate(parts) if i not in lost) if lost else text)
                nulls = batch.column(at_text).is_null().to_pylist()
                text = pa.array([None if none else x for x, none in zip(kept, nulls, strict=True)], type=pa.binary()).cast(pa.string())
                columns = [text if i == at_text else x for i, x in enumerate(batch.columns[: len(names)])]
                dropped = [len(drop.get(row, ())) for row in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, type=pa.int64()), pa.array(dropped, type=pa.int64())], [*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(run, f"{schema}, n_lines bigint, n_dropped bigint")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with text replaced by the lines that stay, and n_lines and n_dropped."""
    docs, back = shared.plain(docs, "doc_id", "text")
    return back(_dedup(docs, **options), "n_lines", "n_dropped")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: lines before, lines dropped, hash of what stays."""
    found = _dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
