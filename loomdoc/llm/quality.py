"""Quality classifier: a factorisation machine over hashed words and statistics of structure.

A document's features are its words, hashed into WORD_SLOTS (log counts, scaled
to length one), the statistics of STATISTICS, of the whole text and of its
most extreme line, and metadata: numeric columns, as signed logarithms and whether they are there, and text columns, hashed
into META_SLOTS.  The model is
    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
which scores all pairwise interactions in time linear in the features.  It is
fitted on the driver by Adam on at most SAMPLE_PER_CLASS labelled documents of each class,
weighted so that the classes weigh as in all labelled rows.

Defined results: null and empty texts have no words and zero statistics and
get the score of that; without labels of both classes every score is the share
of label 1 (0.5 without labels); equal texts with equal metadata get equal scores; a metadata column that docs lacks is null
everywhere, and numbers that are no numbers are null; columns of docs are kept by `scored` and `keep_good` whatever their names;
labels count as `labelled` says; an empty table gives no rows.

The query's contract bars doc_id, lang and source from the score; of the columns of documents that leaves n_chars, its METADATA.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan, labelled, shared

SAMPLE_PER_CLASS = 3000
WORD_BITS = 12
WORD_SLOTS = 1 << WORD_BITS
RANK = 8
THRESHOLD = 0.3
META_SLOTS = 64
METADATA = ("n_chars",)
PIECE_ROWS = 256

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "exclamation": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=<>\\{}[]_",
    "punctuation": b".,;:'\"()-/",
    "space": b" \t\r\x0b\x0c",
    "other": bytes(range(128, 256)),
}
STATISTICS = [*(f"share of {x}" for x in CLASSES), *(f"most {x} in a line" for x in CLASSES), "repeated words", "most repeated words in a line", "longest word", "distinct words", "top word", "log words", "log bytes", "word length", "words a line"]
LINE_BYTES = 20


def features(piece: bytescan.Piece, meta: np.ndarray | None = None) -> np.ndarray:
    """(rows, WORD_SLOTS + len(STATISTICS)) features of a piece, and those of its metadata after them."""
    n_meta = 0 if meta is None else meta.shape[1]
    data, offsets, rows = piece.data, piece.offsets, piece.rows
    found = bytescan.words(data, offsets, bytescan.spaced_words())
    hashes = bytescan.span_hashes(bytescan.lower_table()[data], found.starts, found.ends)
    of = found.rows()
    slots = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    counts = np.bincount(of * WORD_SLOTS + slots, minlength=rows * WORD_SLOTS).reshape(rows, WORD_SLOTS)
    out = np.zeros((rows, WORD_SLOTS + len(STATISTICS) + n_meta), dtype=np.float32)
    out[:, :WORD_SLOTS] = np.log1p(np.arange(counts.max(initial=0) + 1, dtype=np.float32))[counts]
    length = np.sqrt((out[:, :WORD_SLOTS] ** 2).sum(axis=1, keepdims=True))
    out[:, :WORD_SLOTS] /= np.maximum(length, 1)

    breaks = np.flatnonzero(data == 10) + 1
    line_starts = np.union1d(breaks[breaks < len(data)], offsets[:-1][np.diff(offsets) > 0])
    line_ends = np.append(line_starts[1:], len(data))
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    size, line_size = np.maximum(np.diff(offsets), 1), np.maximum(line_ends - line_starts, LINE_BYTES)

    def most(values: np.ndarray) -> np.ndarray:
        best = np.zeros(rows)
        np.maximum.at(best, line_row, values)
        return best

    columns, extremes = [], []
    for members in CLASSES.values():
        table = np.zeros(256, dtype=np.int64)
        table[list(members)] = 1
        sums = np.concatenate([[0], np.cumsum(table[data])])
        columns.append((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
        extremes.append(most((sums[line_ends] - sums[line_starts]) / line_size))
    n = np.maximum(found.counts, 1)
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    sums = np.concatenate([[0], np.cumsum(same)])
    first, last = np.searchsorted(found.starts, line_starts), np.searchsorted(found.starts, line_ends)
    lengths, longest = found.ends - found.starts, np.zeros(rows)
    np.maximum.at(longest, of, lengths)
    line_count = np.maximum(np.bincount(line_row, minlength=rows), 1)
    columns += extremes
    columns += [
        (sums[found.bounds[1:]] - sums[found.bounds[:-1]]) / n,
        most((sums[last] - sums[first]) / np.maximum(last - first, 5)),
        np.log1p(longest),
        (counts > 0).sum(axis=1) / n,
        counts.max(axis=1) / n,
        np.log1p(found.counts),
        np.log1p(np.diff(offsets)),
        np.bincount(of, weights=lengths, minlength=rows) / n,
        np.log1p(found.counts / line_count),
    ]
    out[:, WORD_SLOTS : WORD_SLOTS + len(STATISTICS)] = np.stack(columns, axis=1)
    if n_meta:
        out[:, -n_meta:] = meta
    return out


def metadata_features(columns: list[pa.Array]) -> np.ndarray:
    """(rows, features) of metadata columns: two for a numeric one, META_SLOTS for others."""
    out = []
    for column in columns:
        rows = len(column)
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_null(column.type):
            x = column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            there = np.isfinite(x)
            x = np.where(there, x, 0)
            out.append(np.stack([np.sign(x) * np.log1p(np.abs(x)), there], axis=1))
        else:
            slots = np.zeros((rows, META_SLOTS))
            for i, value in enumerate(column.cast(pa.string()).to_pylist()):
                if value is not None:
                    slots[i, zlib.crc32(value.encode()) % META_SLOTS] = 1
            out.append(slots)
    return np.concatenate(out, axis=1).astype(np.float32) if out else np.zeros((0, 0), np.float32)


class FactorisationMachine:
    """Weights of a fitted machine; `share` alone where there was nothing to fit."""

    def __init__(self, share: float, metadata: Sequence[str] = (), texts: Sequence[str] = ()):
        self.share, self.weights, self.metadata, self.texts = share, None, tuple(metadata), tuple(texts)

    def margins(self, x: np.ndarray) -> np.ndarray:
        w0, w, v = self.weights
        return w0 + x @ w + 0.5 * ((x @ v) ** 2 - (x * x) @ (v * v)).sum(axis=1)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WORD_SLOTS:] = np.clip((x[:, WORD_SLOTS:] - self.middle) / self.spread, -4, 4) / 4
        return x

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        # Doubles, and rounded: equal texts get equal scores in whatever block they are.
        return np.round(1 / (1 + np.exp(-np.clip(self.margins(self.scaled(x).astype(np.float64)), -30, 30))), 9)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> FactorisationMachine:
        """Adam on the weighted log loss."""
        self.middle = x[:, WORD_SLOTS:].mean(axis=0)
        self.spread = x[:, WORD_SLOTS:].std(axis=0) + 1e-6
        x = self.scaled(x)
        draw = np.random.default_rng(seed)
        theta = [np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), draw.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32)]
        moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xs = x[rows]
                self.weights = (theta[0][0], theta[1], theta[2])
                factors = xs @ theta[2]
                error = ((1 / (1 + np.exp(-np.clip(self.margins(xs), -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                slopes = [error.sum(keepdims=True), xs.T @ error + decay * theta[1], xs.T @ (error[:, None] * factors) - theta[2] * ((xs * xs).T @ error)[:, None] + decay * theta[2]]
                step += 1
                speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for t, g, (m, s) in zip(theta, slopes, moments, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    t -= speed * m / (np.sqrt(s) + 1e-8)
        self.weights = (theta[0][0], theta[1], theta[2])
        return self


def _with_metadata(docs: DataFrame, metadata: Sequence[str], texts: Sequence[str] | None = None) -> list:
    """Columns meta_0, meta_1, ... of docs: those of `texts` (by default the ones that are no numbers) as texts, others as doubles."""
    if texts is None:
        texts = _text_columns(docs, metadata)
    kind = lambda name: "string" if name in texts else "double"
    return [(F.col(f"`{x}`").cast("string").try_cast(kind(x)) if x in docs.columns else F.lit(None).cast(kind(x))).alias(f"meta_{i}") for i, x in enumerate(metadata)]


def _text_columns(docs: DataFrame, metadata: Sequence[str]) -> list[str]:
    return [x.name for x in docs.schema if x.name in metadata and not isinstance(x.dataType, (T.NumericType, T.NullType))]


def _features(batch: pa.RecordBatch, n_meta: int) -> Iterator[np.ndarray]:
    """Features of the rows of a batch, a piece at a time."""
    for piece in bytescan.pieces(batch.column("text"), max_rows=PIECE_ROWS):
        meta = [batch.column(f"meta_{i}").slice(piece.first, piece.rows) for i in range(n_meta)]
        yield features(piece, metadata_features(meta) if meta else None)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, metadata: Sequence[str] = ()) -> FactorisationMachine:
    """Fits a machine on a bounded sample, whose features are computed by the executors and sent to the driver as sparse rows."""

    n_meta = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values, widths = [], [], []
            for x in _features(batch, n_meta):
                for row in x:
                    at = np.flatnonzero(row)
                    places.append(at.astype(np.uint16).tobytes())
                    values.append(row[at].tobytes())
                    widths.append(len(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "label", "population")), pa.array(widths, type=pa.int32()), pa.array(places, type=pa.binary()), pa.array(values, type=pa.binary())], ["doc_id", "label", "population", "width", "places", "values"])

    # The metadata travel with the text, so they are those of the document that stands for its doc_id.
    chosen = labelled.sample(docs, labels, label, per_class, extra=_with_metadata(docs, metadata))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(run, f"doc_id {kind}, label int, population bigint, width int, places binary, values binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["places"], r["values"]))
    y = np.array([r["label"] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return FactorisationMachine(float(y[0]) if len(y) else 0.5, metadata, _text_columns(docs, metadata))
    x = np.zeros((len(rows), rows[0]["width"]), dtype=np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    population = {r["label"]: r["population"] for r in rows}
    weight = np.where(y == 1, population[1] / (y == 1).sum(), population[0] / (y == 0).sum())
    return FactorisationMachine(population[1] / sum(population.values()), metadata, _text_columns(docs, metadata)).fit(x, y, (weight / weight.mean()).astype(np.float32))


def _scored(docs: DataFrame, model: FactorisationMachine, meta: Sequence) -> DataFrame:
    """docs (text and others) with a column score; meta are its metadata columns."""
    sent, names, schema, n_meta = shared.Sent(docs.sparkSession, model), docs.columns, docs.schema, len(meta)
    docs = docs.select("*", *meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent()
        for batch in batches:
            out = [machine.scores(x) for x in _features(batch, n_meta)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.concatenate(out) if out else [], type=pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema) + ", score double")


def scored(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """docs with a column score (with underscores after it where docs has one)."""
    names = [x for x in model.metadata if x in docs.columns]
    plain, back = shared.plain(docs, "text", *names)
    return back(_scored(plain, model, _with_metadata(plain, model.metadata, model.texts)), "score")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: fold, score and prediction."""
    docs = docs.select("doc_id", "text", *[x for x in METADATA if x in docs.columns])
    found = _scored(docs, train(docs, labels, metadata=METADATA), _with_metadata(docs, METADATA))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = METADATA) -> DataFrame:
    """docs without those predicted 0, all columns kept."""
    plain, back = shared.plain(docs, "doc_id", "text", *[x for x in metadata if x in docs.columns])
    found = _scored(plain, train(plain, labels, metadata=metadata), _with_metadata(plain, metadata))
    return back(found.where(F.col("score") >= THRESHOLD))
