"""A stored text index: positional postings of a store's revisions in sorted, immutable segments.

A posting is (term, field, sequence, places): where a term stands in one field of one revision.  A refresh inverts the
revisions that came since the last one, in Arrow batches and without a shuffle, once, and appends them as a segment: Parquet files sorted by ranges
of (term, field, sequence), so a frequent term spans several files and no task holds all of it.  Sequences and places are stored as
differences (Parquet's delta encoding).  Each segment has a sparse directory, the first and last term of every file; a search opens
the files that can have its words, with the words as Parquet filters, and reads places only if phrases or distances ask for them.  Segments are merged in geometric sizes,
and old ones stay for readers until the store is compacted.

A search takes its words' postings, brings those of a revision together by its sequence, and decides the tree of the search on them.
No document is read.
"""

from __future__ import annotations

import hashlib
import json
import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import LOWER, UPPER, Tokenizer
from ..operators import positions
from ..operators.text import Parser, TextIndex, needs_places, word_atoms
from ..plans.errors import QueryError
from . import folders
from .indexes import Index

SCHEMA = "term string, field int, sequence bigint, places array<int>"
#: Segments from which a refresh merges the last ones.
MERGE_SEGMENTS = 8
#: Tokens that are inverted together.
BATCH_TOKENS = 1 << 18
#: Format options: data pages with delta encoding in place of a dictionary for what only grows.
FORMAT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#sequence": "false", "parquet.enable.dictionary#places.list.element": "false"}

#: The simple tokenizer on bytes of UTF-8: ASCII in lower case, and what is no part of a token as a space.
SIMPLE = bytes(x if x > 127 or chr(x).isalnum() else 32 for x in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


@dataclass(frozen=True)
class Segment:
    """Postings of the revisions low..high; files: (name, first term, last term, postings)."""

    name: str
    low: int
    high: int
    files: tuple[tuple[str, str, str, int], ...]

    @property
    def postings(self) -> int:
        return sum(x[3] for x in self.files)


def inverted(batches: Iterator[pa.RecordBatch], plain: bool = False) -> Iterator[pa.RecordBatch]:
    """(sequence, texts as ` token token `) to postings; a posting's places are in order, and the postings of a batch in the order of a segment.

    With plain, texts are as they stand, to be cut into simple tokens.
    """
    tokens: list[bytes] = []
    rows: list[tuple[int, int, int]] = []  # field, sequence, number of tokens

    def out() -> pa.RecordBatch:
        field, sequence, size = np.array(rows, np.int64).T
        by_row = np.lexsort((sequence, field))
        row_rank = np.empty_like(by_row)
        row_rank[by_row] = np.arange(len(rows))
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        term_rank = np.empty(len(by_term), np.int64)
        term_rank[by_term] = np.arange(len(by_term))
        keys = term_rank[coded.indices.to_numpy()] * len(rows) + np.repeat(row_rank, size)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        places = (np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size))[order].astype(np.int32)
        term, row = np.divmod(keys[heads], len(rows))
        of = by_row[row]
        columns = [coded.dictionary.take(pa.array(by_term[term])).cast(pa.string()), pa.array(field[of], pa.int32()), pa.array(sequence[of]), pa.ListArray.from_arrays(np.append(heads, len(keys)).astype(np.int32), places)]
        tokens.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, ["term", "field", "sequence", "places"])

    for batch in batches:
        lists = batch.column(1)
        texts = iter(lists.flatten().cast(pa.binary()))
        for sequence, size in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
            for field, text in enumerate(islice(texts, size)):
                found = (text.as_py() or b"").translate(SIMPLE).split() if plain else [x for x in (text.as_py() or b"").split(b" ") if x]
                if found:
                    tokens += found
                    rows.append((field, sequence, len(found)))
                if len(tokens) >= BATCH_TOKENS:
                    yield out()
    if tokens:
        yield out()


class StoredTextIndex:
    """The postings of a text index of a store."""

    def __init__(self, store, index: Index):
        self.store, self.index = store, index
        definition = hashlib.sha1(json.dumps([index.fields, index.type, index.tokenizer.name, index.tokenizer.arguments]).encode()).hexdigest()[:10]
        self.folder = f"{store.path}/index/{index.name}-{definition}"
        self.load()

    def load(self) -> None:
        """Takes the published segments: those that go on where the ones before end, of several the longest."""
        found = []
        for name in self.store.files.names(self.folder):
            if name.startswith("segment-") and self.store.files.exists(f"{self.folder}/{name}/directory.json"):
                low, high = map(int, name.split("-")[1:3])
                found.append((low, -high, name))
        self.segments: list[Segment] = []
        for low, high, name in sorted(found):
            if low == self.last_sequence + 1:
                files = json.loads(self.store.files.read(f"{self.folder}/{name}/directory.json"))
                self.segments.append(Segment(name, low, -high, tuple(tuple(x) for x in files)))

    @property
    def last_sequence(self) -> int:
        return self.segments[-1].high if self.segments else 0

    def _write(self, postings: DataFrame, low: int, high: int) -> None:
        """A segment of sorted files, then its directory, which makes it visible."""
        name = f"segment-{low:012d}-{high:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{name}"
        order = ["term", "field", "sequence"]
        postings.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**FORMAT).parquet(f"{path}/postings")
        self.store.files.publish(f"{path}/directory.json", json.dumps(self._directory(self.store.spark.read.schema(SCHEMA).parquet(f"{path}/postings"))))

    def _directory(self, written: DataFrame) -> list[list]:
        """Each file's name, first and last term and number of postings.  Files are sorted, so only their first and last rows are looked at."""
        rows = written.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), "term")
        # One row for each file, not for each term, comes to the driver.
        sizes = {r.file: r.n for r in rows.groupBy("file").agg((F.max("at") + 1).alias("n")).collect()}
        if not sizes:
            return []
        last = self.store.spark.createDataFrame([(k, n - 1) for k, n in sizes.items()], "file string, last bigint")
        ends = rows.join(F.broadcast(last), "file").where((F.col("at") == 0) | (F.col("at") == F.col("last")))
        found = ends.groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last")).collect()
        return sorted([r.file, r.first, r["last"], sizes[r.file]] for r in found)

    def _texts(self, low: int, high: int, plain: bool) -> DataFrame:
        """Fields of the revisions low..high that have a body, cut into tokens, or plain."""
        revs = self.store.revisions(low, high).where(~F.col("deleted") & F.col("json").isNotNull())
        docs = revs.select("_id", F.col("revid").alias("_rev"), "sequence", F.parse_json("json").alias("body"))
        found = TextIndex(docs, [x for x in self.index.fields if x not in ("_id", "_rev")], self.index.tokenizer)
        by_name = found.texts(plain)
        return docs.select("sequence", F.array(*[by_name[x] for x in self.index.fields]).alias("texts"))

    def refresh(self) -> None:
        """Appends the revisions that came since the last refresh, and merges segments if there are many."""
        self.load()
        last = max(self.store.last_sequence, 0)
        if last > self.last_sequence:
            low = self.last_sequence + 1
            plain = self.index.tokenizer == Tokenizer()
            # Ranges are found from a sample, for which texts would be inverted a second time.
            postings = folders.written(self._texts(low, last, plain).mapInArrow(partial(inverted, plain=plain), SCHEMA), "inverted")
            self._write(postings, low, last)
            folders.discard(postings)
            self.load()
        if len(self.segments) > MERGE_SEGMENTS:
            self.merge()

    def merge(self, all_of_them: bool = False) -> None:
        """Merges the last segments into one: as far back as what is behind a segment is at least half as large."""
        at, size = len(self.segments) - 1, self.segments[-1].postings
        while at > 0 and (all_of_them or self.segments[at - 1].postings <= 2 * size):
            at -= 1
            size += self.segments[at].postings
        if at < len(self.segments) - 1:
            chosen = self.segments[at:]
            paths = [f"{self.folder}/{x.name}/postings" for x in chosen]
            self._write(self.store.spark.read.schema(SCHEMA).parquet(*paths), chosen[0].low, chosen[-1].high)
            self.load()

    def clean(self) -> None:
        """Deletes segments that a merged one stands for, and those that were never published."""
        kept = {x.name for x in self.segments}
        for name in self.store.files.names(self.folder):
            if name not in kept:
                self.store.files.delete(f"{self.folder}/{name}")

    def files(self, atoms: set[tuple[str, bool]]) -> list[str]:
        """Files that can have postings of the words."""
        there = lambda first, last: any(first <= word <= last or prefix and (first.startswith(word) or first <= word <= last) for word, prefix in atoms)
        return [f"{self.folder}/{s.name}/postings/{name}" for s in self.segments for name, first, last, _ in s.files if there(first, last)]

    def postings(self, atoms: set[tuple[str, bool]]) -> DataFrame:
        """The postings of the words, from the files that can have them."""
        spark = self.store.spark
        if not (files := self.files(atoms)):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(*files).where(reduce(operator.or_, (_is(*x) for x in sorted(atoms))))

    def matches(self, search: str) -> DataFrame:
        """The sequences of the revisions that match a search, of old revisions too; each once."""
        fields = self.index.fields
        tree = Parser(search, list(fields), self.index.tokenizer).parse()
        atoms = sorted(word_atoms(tree))
        rows, exact = self.postings(set(atoms)), needs_places(tree)
        # Where only presence counts, the places are not read.
        value = F.col("places") if exact else F.array(F.lit(0))
        names = {(word, prefix, field): f"w{k}_{n}" for k, (word, prefix) in enumerate(atoms) for n, field in enumerate(fields)}
        gathered = [
            F.flatten(F.collect_list(F.when(_is(word, prefix) & (F.col("field") == fields.index(field)), value))).alias(name) for (word, prefix, field), name in names.items()
        ]
        if not gathered:
            return rows.select("sequence")
        found = rows.groupBy("sequence").agg(*gathered)
        return found.where(positions.holds(tree, fields, lambda word, prefix, field: F.col(names[word, prefix, field]))).select("sequence")


def _is(word: str, prefix: bool) -> Column:
    return F.col("term").startswith(word) if prefix else F.col("term") == word


def opened(store, index: Index) -> StoredTextIndex:
    if index.tokenizer is None:
        raise QueryError(f"{index.name} is no text index")
    return StoredTextIndex(store, index)
