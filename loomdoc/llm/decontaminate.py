"""Benchmark decontamination: training text that repeats benchmark items.

Every 13-word window of the normalised benchmark items (an item of fewer words
is one window) goes into a hash set that is broadcast to the tasks; they scan
the windows of each document, look them up by hash, and compare the words of
each hit with the item's words.  The windows are counted first: a benchmark of more than
`broadcast_windows` of them, or of more than BROADCAST_BYTES, is not brought together anywhere.  There the hashes of the documents' windows are
joined with those of the benchmark, and each distinct text gets the windows of its own matches to verify.

Defined results: a null or empty text has no words and no hits; null or empty
items have no windows; the windows of a row with a null item_id make hits, but no item; item_ids may be of any type that has a text; equal rows get equal results; an empty benchmark or
document table gives unhit documents or no rows.  Columns of docs are kept whatever their names by `scan`
(whose added ones get underscores where docs has theirs), `remove_documents` and `remove_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from . import bytescan, shared
from .neardup import text_key

WINDOW = 13
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 128 << 20


class WindowSet:
    """Benchmark windows: sorted hashes, the items of each, and their words for verification."""

    def __init__(self, windows: list[tuple[bytes, int | None]]):
        by_words: dict[bytes, set[int]] = {}
        for spelled, item in windows:
            by_words.setdefault(spelled, set()).update([] if item is None else [item])
        self.spelled = list(by_words)
        self.items = [sorted(by_words[x], key=str) for x in self.spelled]
        sizes = np.array([x.count(b" ") + 1 for x in self.spelled], dtype=np.int64)
        hashes = np.array([_window_hash(x) for x in self.spelled], dtype=np.uint64)
        self.by_size = {}
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            order = np.argsort(hashes[at], kind="stable")
            self.by_size[int(size)] = (hashes[at][order], at[order])

    def hits(self, piece: bytescan.Piece, lowered: np.ndarray, found: bytescan.Words) -> Iterator[tuple[int, int, int, list[int]]]:
        """(row, first word, words, items) of every occurrence of a window in the piece."""
        hashes = bytescan.span_hashes(lowered, found.starts, found.ends)
        for size, (known, which) in self.by_size.items():
            runs = bytescan.run_hashes(hashes, size)
            at, rows = bytescan.run_rows(found.bounds, size)
            if not len(at):
                continue
            place = np.searchsorted(known, runs[at])
            place[place == len(known)] = 0
            for i in np.flatnonzero(known[place] == runs[at]):
                first = int(at[i])
                spelled = b" ".join(lowered[found.starts[w] : found.ends[w]].tobytes() for w in range(first, first + size))
                k = int(place[i])
                while k < len(known) and known[k] == runs[first]:
                    if self.spelled[which[k]] == spelled:
                        yield int(rows[i]), first, size, self.items[which[k]]
                    k += 1


def _window_hash(spelled: bytes) -> int:
    data = np.frombuffer(spelled, dtype=np.uint8)
    found = bytescan.words(data, np.array([0, len(data)]), bytescan.spaced_words())
    return int(bytescan.run_hashes(bytescan.span_hashes(data, found.starts, found.ends), len(found.starts))[0])


def item_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The normalised windows of an item, words joined by one space."""
    data = bytescan.lower_table()[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    found = bytescan.words(data, np.array([0, len(data)]), bytescan.letter_digit_words())
    spelled = [data[s:e].tobytes() for s, e in zip(found.starts, found.ends, strict=True)]
    if not spelled:
        return []
    return [b" ".join(spelled[i : i + size]) for i in range(max(1, len(spelled) - size + 1))]


def _found(windows: WindowSet, piece: bytescan.Piece) -> tuple[np.ndarray, dict[int, list[dict]], dict[int, list]]:
    """Words of each row of a piece, and spans and items of the rows that are hit."""
    lowered = bytescan.lower_table()[piece.data]
    words = bytescan.words(lowered, piece.offsets, bytescan.letter_digit_words())
    hit: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, set] = {}
    for row, first, size, of in windows.hits(piece, lowered, words):
        hit.setdefault(row, []).append((first, first + size))
        seen.setdefault(row, set()).update(of)
    spans: dict[int, list[dict]] = {}
    for row, ranges in hit.items():
        base, start = int(words.bounds[row]), piece.offsets[row]
        spans[row] = [
            {"first_word": low - base, "end_word": high - base, "first_byte": int(words.starts[low] - start), "end_byte": int(words.ends[high - 1] - start)} for low, high in _merged(ranges)
        ]
    return words.counts, spans, {row: sorted(x) for row, x in seen.items()}


def _rows(batch: pa.RecordBatch, keep: list[str], n_words: np.ndarray, spans: list, items: list, item: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(n_words), pa.array(spans, type=SPANS), pa.array(items, type=pa.list_(item))], [*keep, "n_words", "spans", "items"])


def _scan_with(windows: WindowSet, batches: Iterator[pa.RecordBatch], keep: list[str], item: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Scans all rows with one set of windows."""
    for batch in batches:
        n_words, spans, items = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for piece in bytescan.pieces(batch.column("text")):
            counts, hit, of = _found(windows, piece)
            n_words[piece.first : piece.first + piece.rows] = counts
            for row, own in hit.items():
                spans[piece.first + row], items[piece.first + row] = own, of[row]
        yield _rows(batch, keep, n_words, spans, items, item)


def _scan_own(batches: Iterator[pa.RecordBatch], keep: list[str], item: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Scans each row with the windows in its column `_windows`."""
    none = WindowSet([])
    for batch in batches:
        n_words, spans, items = np.zeros(batch.num_rows, dtype=np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for piece in bytescan.pieces(batch.column("text")):
            n_words[piece.first : piece.first + piece.rows] = _found(none, piece)[0]
        for row in np.flatnonzero(batch.column("_windows").is_valid().to_numpy(zero_copy_only=False)):
            windows = WindowSet([(bytes(x["spelled"]), i) for x in batch.column("_windows")[int(row)].as_py() for i in x["items"] or [None]])
            [piece] = bytescan.pieces(batch.column("text").slice(row, 1))
            _, hit, of = _found(windows, piece)
            if hit:
                spans[row], items[row] = hit[0], of[0]
        yield _rows(batch, keep, n_words, spans, items, item)


SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
SPANS_DDL = "array<struct<first_word:bigint,end_word:bigint,first_byte:bigint,end_byte:bigint>>"


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """hash, n (words), spelled and item_id of every window."""
    item = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled, of = [], []
            for i, text in enumerate(batch.column("text")):
                own = item_windows(text.as_py(), size)
                spelled += own
                of += [i] * len(own)
            columns = [pa.array(np.array([_window_hash(x) for x in spelled], dtype=np.uint64).view(np.int64)), pa.array([x.count(b" ") + 1 for x in spelled], pa.int32()), pa.array(spelled, pa.binary()), batch.column("item_id").cast(item).take(pa.array(of, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "n", "spelled", "item_id"])

    return benchmark.select("item_id", "text").where("text is not null").mapInArrow(run, f"hash bigint, n int, spelled binary, item_id {benchmark.schema['item_id'].dataType.simpleString()}")


def _matched(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """_h1, _h2 and _windows of texts: the benchmark windows that share a hash with one of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, table = bytescan.lower_table(), bytescan.letter_digit_words()
        for batch in batches:
            for piece in bytescan.pieces(batch.column("text")):
                lowered = fold[piece.data]
                found = bytescan.words(lowered, piece.offsets, table)
                hashes = bytescan.span_hashes(lowered, found.starts, found.ends)
                for size in sizes:
                    runs = bytescan.run_hashes(hashes, size)
                    at, rows = bytescan.run_rows(found.bounds, size)
                    order = np.lexsort((runs[at], rows))
                    own, of = runs[at][order], rows[order]
                    once = np.ones(len(own), dtype=bool)
                    once[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
                    where = pa.array(piece.first + of[once])
                    yield pa.RecordBatch.from_arrays([batch.column("h1").take(where), batch.column("h2").take(where), pa.array(own[once].view(np.int64))], ["h1", "h2", "hash"])

    of_docs = docs.select(*text_key(), "text").mapInArrow(run, "h1 bigint, h2 bigint, hash bigint")
    spelled = windows.groupBy("hash", "spelled").agg(F.collect_set("item_id").alias("items"))
    found = of_docs.join(spelled.select("hash").distinct(), "hash", "left_semi").distinct().join(spelled, "hash")
    return found.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.collect_list(F.struct("spelled", "items")).alias("_windows"))


def _scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (text and others) with n_words, spans and items."""
    names, kind = docs.columns, benchmark.schema["item_id"].dataType
    item = to_arrow_type(kind)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + f", n_words bigint, spans {SPANS_DDL}, items array<{kind.simpleString()}>"
    windows = benchmark_windows(benchmark, size)
    # An item has a window for every second byte at most, and each word is in `size` of them: mostly these bounds do, and nothing is counted.
    items, n_bytes = benchmark.agg(F.count("text"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count, n_bytes = items + n_bytes // 2, size * (n_bytes + items)
    if count > broadcast_windows or n_bytes > broadcast_bytes:
        count, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("spelled")), F.lit(0))).first()
    if count <= broadcast_windows and n_bytes <= broadcast_bytes:
        held = windows.select("spelled", "item_id").toArrow()
        sent = shared.Sent(docs.sparkSession, WindowSet(list(zip(held.column("spelled").to_pylist(), held.column("item_id").to_pylist(), strict=True))))
        return docs.mapInArrow(lambda batches: _scan_with(sent(), batches, names, item), schema)
    windows = shared.written(windows, "windows")
    sizes = [r.n for r in windows.select("n").distinct().collect()]
    keyed = docs.select(*names, *[x.alias(f"_{n}") for x, n in zip(text_key(), ("k1", "k2"), strict=True)])
    matched = _matched(docs, windows, sizes)
    joined = keyed.join(matched, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left").select(*names, "_windows")
    return joined.mapInArrow(lambda batches: _scan_own(batches, names, item), schema)


def scan(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with n_words, spans (merged word and byte ranges inside windows) and items (ids of items that occur).

    One pass over the documents, without a shuffle, as long as the benchmark can be broadcast.
    """
    docs, back = shared.plain(docs, "text")
    return back(_scan(docs, benchmark, **options), "n_words", "spans", "items")


def n_hit(spans="spans"):
    """Number of words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x.end_word - x.first_word)


def is_contaminated(words="n_words", spans="spans"):
    """At least a twentieth of the words lie inside benchmark windows."""
    return (n_hit(spans) > 0) & (n_hit(spans) * 20 >= F.col(words))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, the items found and the verdict."""
    found = _scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    docs, back = shared.plain(docs, "text")
    return back(_scan(docs, benchmark, **options).where(~is_contaminated()))


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs whose text lacks the hit spans (from the first byte of a span's first word to the last of its last)."""
    raw = F.encode("text", "UTF-8")
    after = F.transform(F.col("spans"), lambda x: x.end_byte)
    before = F.transform(F.col("spans"), lambda x: x.first_byte)
    cuts = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), after).alias("low"), F.concat(before, F.array(F.octet_length(raw).cast("long"))).alias("high"))
    kept = F.array_join(F.transform(cuts, lambda x: F.decode(F.substring(raw, (x.low + 1).cast("int"), (x.high - x.low).cast("int")), "UTF-8")), "")
    docs, back = shared.plain(docs, "text")
    return back(_scan(docs, benchmark, **options).withColumn("text", F.when(F.size("spans") > 0, kept).otherwise(F.col("text"))))
