"""Substring dedup: words that an earlier document has too, by matching statistics over FM-indexes of shards.

1. Equal texts are one: its least doc_id stands for it, and its other documents
   lose every window.  The rest is about distinct texts.
2. The least of the GRAM-word hashes in a window (its seed) depends on the window alone, so
   equal windows have equal seeds.  A seed that only one text has rules out its
   windows; one aggregation of (seed, least text, greatest text) finds the others.
3. Of each text, the stretches of windows around one shared seed go to the shard of
   the seed, equal stretches merged before the shuffle with their least doc_id.
   Of a seed in more than HOT_TEXTS texts each window goes by itself, to the shard of
   its own hash, so no shard depends on one seed.
4. Each shard (about SHARD_WORDS words) builds a compressed FM-index of its stretches
   and streams the stretches of its documents through it.  Backward search over the wavelet matrix
   gives their matching statistics: at each place the longest match with a stretch of a smaller doc_id.
   Matches of at least `window` words are reported as intervals, joined where they touch.
   A stretch that an earlier document has as a whole is one interval without a search.
5. The words of the reported intervals, brought back to their documents, are removed.

A window lies in one stretch as a whole, so an interval holds just the windows that start in a document with a
smaller doc_id; a match that goes on beyond its stretch goes on in the next one's intervals.
Words are `[^\\x20\\x09-\\x0D]+`, compared by 64-bit hashes; texts and stretches by 128 bits.

Defined results: null and empty texts have no words; documents with fewer words
than a window lose nothing; a null doc_id is neither smaller nor larger than
another, so its document loses nothing and removes nothing; repeated rows get one
result each; an empty table gives no rows; a doc_id that is no integer is refused (TypeError); columns of docs are kept whatever
their names, and the added ones get underscores where docs has theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, shared
from .fmindex import FmIndex
from .neardup import text_key

WINDOW = 13
GRAM = 4
HOT_TEXTS = 2500
SHARD_WORDS = 500_000
#: Stretches that are streamed through an index at a time.
STREAMED = 20_000


class Seeds:
    """Windows of a piece with the place and hash of their seeds."""

    def __init__(self, piece: bytescan.Piece, window: int, gram: int):
        found = bytescan.words(piece.data, piece.offsets, bytescan.spaced_words())
        self.bounds = found.bounds
        self.hashes = bytescan.span_hashes(piece.data, found.starts, found.ends)
        self.first, self.row = bytescan.run_rows(found.bounds, window)
        grams = bytescan.run_hashes(self.hashes, gram)
        place = self.first.copy()
        best = grams[place] if len(place) else np.zeros(0, np.uint64)
        for k in range(1, window - gram + 1):
            other = grams[self.first + k]
            less = other < best
            best = np.where(less, other, best)
            place = np.where(less, self.first + k, place)
        self.place, self.seed = place, best.view(np.int64)

    def changes(self) -> np.ndarray:
        """Windows with another seed place or row than the one before."""
        new = np.ones(len(self.place), dtype=bool)
        new[1:] = (self.place[1:] != self.place[:-1]) | (self.row[1:] != self.row[:-1])
        return np.flatnonzero(new)


def seeds(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """seed and h1 of every text, each once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1 = batch.column("h1").to_numpy()
            for piece in bytescan.pieces(batch.column("text")):
                found = Seeds(piece, window, gram)
                at = found.changes()
                row, seed = found.row[at], found.seed[at]
                order = np.lexsort((seed, row))
                row, seed = row[order], seed[order]
                once = np.ones(len(row), dtype=bool)
                once[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(seed[once]), pa.array(h1[piece.first + row[once]])], ["seed", "h1"])

    return keyed.select("h1", "text").mapInArrow(run, "seed bigint, h1 bigint")


STRETCH = "shard bigint, s1 bigint, s2 bigint, words string, n_words int, h1 bigint, first_id bigint, start bigint"


def stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches around the shared seeds of texts (h1, first_id, text, cold, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                keys = list(zip(*(batch.column(x).to_pylist() for x in ("h1", "first_id")), strict=True))
                cold, hot = batch.column("cold"), batch.column("hot")
                for piece in bytescan.pieces(batch.column("text")):
                    found = Seeds(piece, window, gram)
                    begins = found.changes()
                    stops = np.append(begins[1:], len(found.place))
                    rows = found.row[begins]
                    for row in range(piece.rows):
                        low, high = np.searchsorted(rows, [row, row + 1])
                        if low == high:
                            continue
                        own, base = piece.text(row).split(), int(found.bounds[row])
                        seed = found.seed[begins[low:high]]
                        i = piece.first + row
                        of_cold, of_hot = (np.array(x[i].as_py() or (), dtype=np.int64) for x in (cold, hot))
                        for k in np.flatnonzero(np.isin(seed, of_cold)):
                            a, b = int(begins[low + k]), int(stops[low + k])
                            start = int(found.first[a]) - base
                            out.append((int(seed[k]), own[start : start + b - a + window - 1], start, *keys[i]))
                        for k in np.flatnonzero(np.isin(seed, of_hot)):
                            for a in range(int(begins[low + k]), int(stops[low + k])):
                                start = int(found.first[a]) - base
                                out.append((None, own[start : start + window], start, *keys[i]))
                if out:
                    spelled = [b" ".join(x[1]) for x in out]
                    halves = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in spelled), dtype=np.int64).reshape(-1, 2)
                    shard = [int(h) if x[0] is None else x[0] for x, h in zip(out, halves[:, 0], strict=True)]
                    columns = [pa.array(shard, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(spelled, pa.binary()).cast(pa.string()), pa.array([len(x[1]) for x in out], pa.int32())]
                    columns += [pa.array([x[k] for x in out], pa.int64()) for k in (3, 4, 2)]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in STRETCH.split(", ")])

    return texts.select("h1", "first_id", "text", "cold", "hot").mapInArrow(run, STRETCH)


SPANS = "array<struct<start:int,words:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))


def intervals(lengths: np.ndarray, bounds: np.ndarray, window: int) -> pa.ListArray:
    """Joined intervals (start, words) of matches of at least `window` words, for each of the sequences that end at bounds."""
    sizes = np.diff(bounds, prepend=0)
    begins = bounds - sizes
    at = np.flatnonzero(lengths >= window)
    row = np.searchsorted(bounds, at, side="right")
    ends = at + lengths[at]
    # Ends never fall from one place to the next inside a sequence, so a match starts an interval if it starts after the one before it ended.
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > ends[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    start, words = at[first] - begins[row[first]], ends[last] - at[first]
    offsets = np.searchsorted(row[first], np.arange(len(bounds) + 1))
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32))], ["start", "words"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)


def searched(distinct: DataFrame, window: int, shards: int) -> DataFrame:
    """s1, s2, least and spans of distinct stretches: the intervals that stretches of documents before `least` have.

    Stretches of one document in which nothing is found are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        parts, counts = [], []
        for piece in bytescan.pieces(table.column("words")):
            found = bytescan.words(piece.data, piece.offsets, bytescan.spaced_words())
            parts.append(bytescan.span_hashes(piece.data, found.starts, found.ends))
            counts.append(found.counts)
        hashes, lengths, least = np.concatenate(parts), np.concatenate(counts), table.column("least").to_numpy()
        table = table.drop_columns(["words"])
        index, ends = FmIndex(hashes, lengths, least, window), np.cumsum(lengths)
        for at in range(0, len(lengths), STREAMED):
            part = slice(at, at + STREAMED)
            own = slice(ends[at] - lengths[at], ends[part][-1])
            spans = intervals(index.matching(hashes[own], lengths[part], least[part]), np.cumsum(lengths[part]), window)
            rows = table.slice(at, len(spans)).combine_chunks()
            some = pa.array((np.diff(spans.offsets.to_numpy()) > 0) | rows.column("shared").to_numpy())
            batch = pa.RecordBatch.from_arrays([*(rows.column(x).combine_chunks() for x in ("s1", "s2", "least")), spans.cast(_SPANS)], ["s1", "s2", "least", "spans"])
            yield batch.filter(some)

    rows = distinct.select("shard", "s1", "s2", "words", "least", (F.col("_greatest") > F.col("least")).alias("shared"))
    return rows.repartition(shards, "shard").drop("shard").mapInArrow(run, f"s1 bigint, s2 bigint, least bigint, spans {SPANS}")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_texts: int = HOT_TEXTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """h1 and doc_id, which tell texts of one doc_id apart, of documents that lose words: `copy` (a later copy of a whole text) or the `spans` of words to remove."""
    shared.integer_ids(docs)
    keyed = docs.select(*text_key(), F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    light = keyed.select("h1", "h2", "doc_id").where("doc_id is not null")
    firsts = shared.written(light.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("_last")), "firsts")
    copies = light.join(firsts.where("_last > first_id"), ["h1", "h2"]).where("doc_id > first_id").select("h1", "doc_id").distinct()

    pairs = shared.written(seeds(keyed, window, gram), "pairs")
    common = shared.written(pairs.groupBy("seed").agg(F.min("h1").alias("_low"), F.max("h1").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low <> _high").select("seed", (F.col("_n") > hot_texts).alias("is_hot")), "seeds")
    of_text = pairs.join(common, "seed").groupBy("h1").agg(F.collect_set(F.when(~F.col("is_hot"), F.col("seed"))).alias("cold"), F.collect_set(F.when(F.col("is_hot"), F.col("seed"))).alias("hot"))
    marked = firsts.select("h1", "h2", "first_id").join(of_text, "h1").withColumnRenamed("h1", "_h1").withColumnRenamed("h2", "_h2")
    texts = keyed.join(marked, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("doc_id") == F.col("first_id")))
    found = shared.written(stretches(texts, window, gram), "stretches")
    shared.discard(pairs, common)

    distinct = shared.written(found.groupBy("s1", "s2").agg(F.min("shard").alias("shard"), F.first("words").alias("words"), F.first("n_words").alias("n_words"), F.min("first_id").alias("least"), F.max("first_id").alias("_greatest")), "distinct")
    total = distinct.agg(F.sum("n_words")).first()[0] or 0
    matched = searched(distinct, window, max(1, -(-total // shard_words)))
    held = found.select("s1", "s2", "n_words", "h1", "first_id", "start").join(matched, ["s1", "s2"])
    start = F.col("start").cast("int")
    whole = F.array(F.struct(start.alias("start"), F.col("n_words").alias("words")))
    own = F.transform("spans", lambda x: F.struct((start + x.start).alias("start"), x.words.alias("words")))
    spans = held.select("h1", F.col("first_id").alias("doc_id"), F.when(F.col("first_id") > F.col("least"), whole).otherwise(own).alias("spans")).where(F.size("spans") > 0)
    spans = spans.groupBy("h1", "doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = shared.written(spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True), "spans")
    shared.discard(firsts, found, distinct)
    return out


def _kept(docs: DataFrame, found: DataFrame, window: int, text: bool) -> DataFrame:
    """docs (doc_id, text and others) with n_words, n_removed and what stays: its hash, or itself."""
    names = docs.columns
    keyed = docs.select(*names, text_key()[0].alias("_k1"))
    found = found.withColumnsRenamed({"h1": "_h1", "doc_id": "_of", "spans": "_spans", "copy": "_copy"})
    joined = keyed.join(found, (F.col("_k1") == F.col("_h1")) & (F.col("doc_id") == F.col("_of")), "left").select(*names, "_spans", "_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                counts, removed, kept = [], [], []
                for value, spans, copy in zip(batch.column("text"), batch.column("_spans"), batch.column("_copy").to_pylist(), strict=True):
                    own = (value.as_py() or "").encode().split()
                    counts.append(len(own))
                    if copy and len(own) >= window:
                        stay = []
                    elif spans.is_valid:
                        cover = np.zeros(len(own) + 1, dtype=np.int64)
                        first, words = (spans.values.field(x).to_numpy() for x in ("start", "words"))
                        np.add.at(cover, first, 1)
                        np.add.at(cover, first + words, -1)
                        stay = [w for w, c in zip(own, np.cumsum(cover).tolist(), strict=False) if not c]
                    else:
                        stay = own
                    removed.append(len(own) - len(stay))
                    left = b" ".join(stay)
                    kept.append(left.decode() if text else hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + ", n_words bigint, n_removed bigint, kept string")


def dedup(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs with n_words, n_removed and kept, the words that stay joined by one space."""
    docs, back = shared.plain(docs, "doc_id", "text")
    return back(_kept(docs, repeats(docs, window, **options), window, text=True), "n_words", "n_removed", "kept")


def digest(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """One row per document: words, removed words, and the hash of what stays."""
    docs = docs.select("doc_id", "text")
    return _kept(docs, repeats(docs, window, **options), window, text=False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
