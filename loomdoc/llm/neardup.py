"""MinHash near-duplicates with odd sketches.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; a document's set
is its distinct shingles of `size` words (fewer words: the whole sequence as one).
Two documents are linked if the Jaccard similarity of their sets reaches a
threshold, and groups are the components of the links.

1. Equal texts (by 128 bits of hash) are one node.  Each node gets MinHash values, a
   key for each band of BAND_ROWS of them, and an odd sketch: of a second set of
   MinHash samples, the least hash in each part of the hash range,
   every sample flips one of SKETCH_BITS bits.  There are as many parts as the bits can tell apart: FINE_PARTS for sets of up to
   FINE_SIZE elements, which are nearly all sampled (the number of elements that are no samples is known), and COARSE_PARTS for
   larger ones, so that a sketch does not fill up however long the document is.
2. In each band bucket, all nodes are compared with its least node.  Sketches
   decide first: the population count of their XOR estimates the number of samples
   that differ, and a pair passes unless it has more than a pair at the threshold can have,
   or, of large sets, DEVIATIONS standard deviations more than it has.  A pair of one small and one larger set of fitting
   sizes passes.  Pairs that pass are confirmed on the full sets, read back from the texts.
3. Components of those links are formed.  Then every pair of a bucket that is in
   two components is compared in the same way, sketches in blocks of
   BLOCK nodes, so nothing but pairs that pass leaves a task.  Pairs within
   a component need no look: they cannot change the groups.

A pair at the threshold t shares no bucket with probability
(1 - t ** BAND_ROWS) ** bands; `bands_for` chooses the bands so that this is below 1e-7.  In step 3 a pair is looked at in
the first band in which 32 bits of the keys agree; a chance agreement before the band that it shares hides it, with
probability below bands / 2 ** 32.  Two texts take one node's place if all 128 bits agree; nodes go by 64 of them, and those that
share these are told apart by a hash of all (`named`).

Scale: bucket sizes and least nodes come from partial aggregates; a bucket's
rows are dealt to block pairs, so no task holds a whole large bucket; no pair
of equal texts or of one component is made; links and components stay in
the shared folder.

Defined results: texts without words have an empty set and are linked with
nothing; a null doc_id is a document of its own node that never names a
component unless all its documents are null, and is kept only then; repeated rows get
one result each; an empty table gives no rows; ids may be of any type that can be ordered; columns of docs are kept whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, components, shared

BAND_ROWS = 5
MISSED = 1e-7
SKETCH_BITS = 4096
FINE_SIZE = 4096
FINE_PARTS = 1 << 14
COARSE_PARTS = 1 << 11
DEVIATIONS = 6.0
#: Nodes of a block of a bucket: an eighth of the bucket, within these bounds.
LEAST_BLOCK, BLOCK = 1024, 2048
#: Rows of shingle hashes that are multiplied at a time.
HASHED_AT_ONCE = 1024

_U = np.uint64


def bands_for(threshold: float, rows: int = BAND_ROWS) -> int:
    """Bands with which a pair at the threshold is missed with probability below MISSED."""
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**rows))


def shingle_sets(piece: bytescan.Piece, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a piece."""
    lowered = bytescan.lower_table()[piece.data]
    found = bytescan.words(lowered, piece.offsets, bytescan.spaced_words())
    hashes = bytescan.span_hashes(lowered, found.starts, found.ends)
    runs = bytescan.run_hashes(hashes, size)
    for low, high in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if high - low >= size:
            yield np.unique(runs[low : high - size + 1])
        elif high > low:
            yield bytescan.run_hashes(hashes[low:high], high - low)
        else:
            yield np.zeros(0, dtype=np.uint64)


class Signer:
    """MinHash samples and band keys."""

    def __init__(self, bands: int, rows: int = BAND_ROWS, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shifts = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of each hash function over a set of 64-bit hashes."""
        short, best = (hashes >> _U(32)).astype(np.uint32), None
        for at in range(0, len(short), HASHED_AT_ONCE):
            part = (short[at : at + HASHED_AT_ONCE, None] * self.factors + self.shifts).min(axis=0)
            best = part if best is None else np.minimum(best, part)
        return best

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """(sets, bands) 64-bit keys of (sets, bands * rows) samples."""
        keys = np.broadcast_to(np.arange(self.bands, dtype=np.uint64) + _U(1), (len(samples), self.bands)).copy()
        parts = samples.reshape(len(samples), self.bands, self.rows).astype(np.uint64)
        for k in range(self.rows):
            keys = bytescan.mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
        return keys

    def short_keys(self, samples: np.ndarray) -> np.ndarray:
        """The lower halves of the band keys."""
        return self.band_keys(samples).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Size, number of samples and odd sketch of a sorted set of 64-bit hashes, as 64-bit words."""
    part = hashes >> _U(64 - ((FINE_PARTS if len(hashes) <= FINE_SIZE else COARSE_PARTS).bit_length() - 1))
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = part[1:] != part[:-1]
    samples = hashes[first]
    flips = np.bincount((bytescan.mix(samples) % _U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    bits = np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    return np.concatenate([np.array([len(hashes), len(samples)], dtype=np.uint64), bits])


def differing(size_a: np.ndarray, size_b: np.ndarray, threshold: float, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of differing samples of two sets of these sizes with similarity threshold.

    The elements fall on the parts at random, so how many parts are occupied, and
    by which elements, varies too: the moments are those of parts with Poisson numbers of common and
    own elements, less the share of the variance that the fixed sizes take away.
    """
    common = threshold * (size_a + size_b) / (1 + threshold)
    both, own_a, own_b = common / parts, np.maximum(size_a - common, 0) / parts, np.maximum(size_b - common, 0) / parts
    every = both + own_a + own_b
    some = -np.expm1(-every)
    empty_a, empty_b = np.exp(-(own_a + both)), np.exp(-(own_b + both))
    # Of one part: one sample differs (the other set has none there), or two; and how the mean moves with each rate.
    one = -np.expm1(-own_a) * empty_b - np.expm1(-own_b) * empty_a
    two = (own_a + own_b) / every * some - one
    mean = one + 2 * two
    share = some / every
    slope = (every * np.exp(-every) - some) / every**2
    by_a, by_b = empty_a - 2 * both * slope, empty_b - 2 * both * slope
    by_both = empty_a + empty_b - 2 * share - 2 * both * slope
    variance = one + 4 * two - mean**2 - own_a * by_a**2 - own_b * by_b**2 - both * by_both**2
    return parts * mean, parts * np.maximum(variance, 0)


def folded(differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and variance of the bits that so many samples leave odd, and how the mean moves with their number."""
    x = differ / SKETCH_BITS
    even = np.exp(-4 * x)
    return SKETCH_BITS / 2 * -np.expm1(-2 * x), SKETCH_BITS * np.maximum((1 - even) / 4 - x * even, 0), np.exp(-2 * x)


def most_flips(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Greatest XOR population count taken for a similarity of at least threshold; a and b are (size, samples) of sets with the same parts.

    Every element that is no sample shares its part with a lesser one of its set, and puts
    at most one sample more on the differing side, so the differing samples are at most the
    elements that differ and the elements that are no samples.  This holds always, and is
    the limit of small sets.  That of large ones is the mean with a margin for
    the tail of a count (Bernstein's bound, which holds for skewed counts too); the
    variances of the samples and of the bits add up.
    """
    (size_a, samples_a), (size_b, samples_b) = a, b
    always = (size_a + size_b) * (1 - threshold) / (1 + threshold) + (size_a - samples_a) + (size_b - samples_b) + 1e-6
    mean, variance = differing(size_a, size_b, threshold, np.where(size_a <= FINE_SIZE, float(FINE_PARTS), float(COARSE_PARTS)))
    skewed = mean + DEVIATIONS**2 / 3 + 2
    differ = np.minimum(always, skewed + DEVIATIONS * np.sqrt(variance))
    bits, spread, _ = folded(always)
    by_always = bits + DEVIATIONS * np.sqrt(spread)
    bits, _, slope = folded(skewed)
    by_mean = bits + DEVIATIONS * np.sqrt(folded(differ)[1] + slope**2 * variance)
    return np.minimum(differ, np.minimum(by_always, by_mean))


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches may be of sets with at least this similarity; sizes alone rule out some pairs."""
    size_a, size_b = a[..., 0].astype(float), b[..., 0].astype(float)
    flips = np.bitwise_count(a[..., 2:] ^ b[..., 2:]).sum(axis=-1)
    fits = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-6
    other_parts = (size_a <= FINE_SIZE) != (size_b <= FINE_SIZE)
    return fits & (other_parts | (flips <= most_flips((size_a, a[..., 1].astype(float)), (size_b, b[..., 1].astype(float)), threshold)))


def signatures(docs: DataFrame, signer: Signer, size: int) -> DataFrame:
    """h1, h2, doc_id, n_shingles, bands, sketch and short_bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bands, sketches, shorts = [], [], [], []
            for piece in bytescan.pieces(batch.column("text")):
                sets = list(shingle_sets(piece, size))
                some = [x for x in sets if len(x)]
                samples = np.array([signer.samples(x) for x in some], dtype=np.uint32).reshape(len(some), len(signer.factors))
                keys = iter(signer.band_keys(samples).view(np.int64))
                counts += map(len, sets)
                bands += [next(keys) if len(x) else np.zeros(0, np.int64) for x in sets]
                sketches += [sketch(x).tobytes() if len(x) else b"" for x in sets]
                short = iter(signer.short_keys(samples))
                shorts += [next(short).tobytes() if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("h1", "h2", "doc_id")), pa.array(counts, type=pa.int64()), pa.array(bands, type=pa.list_(pa.int64())), pa.array(sketches, type=pa.binary()), pa.array(shorts, type=pa.binary())],
                ["h1", "h2", "doc_id", "n_shingles", "bands", "sketch", "short_bands"],
            )

    return docs.select(*text_key(), "doc_id", "text").mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, bands array<bigint>, sketch binary, short_bands binary")


def text_key() -> list:
    """Two 64-bit hashes of the text; a null is an empty text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def close_by_sketch(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b) of pairs (a, b, sketch_a, sketch_b) whose sketches are close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = close(_sketches(batch.column("sketch_a")), _sketches(batch.column("sketch_b")), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each wanted node, as a table in the shared folder: the one shuffle of the texts.

    A node's text is read from one of its documents; equal doc_ids with other texts are told apart by both text hashes.
    """
    keyed = wanted.join(nodes.select("node", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("doc_id").alias("_of")), "node")
    texts = docs.select(*text_key(), F.col("doc_id").alias("_id"), "text")
    found = texts.join(keyed, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    return shared.written(found.select("node", "text").dropDuplicates(["node"]), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes that are similar on the full sets of their texts; the threshold is compared in whole numbers of hundredths."""
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # b is the node of few pairs: its text is attached first, so a text that is in many pairs is not shuffled once a pair.
    both = pairs.join(right, "b").join(left, "a")
    hundredths = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_node, last_set = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yes = []
                others = [x for piece in bytescan.pieces(batch.column("text_b")) for x in shingle_sets(piece, size)]
                for k, (node, other) in enumerate(zip(batch.column("a").to_pylist(), others, strict=True)):
                    if node != last_node:
                        [piece] = bytescan.pieces(batch.column("text_a").slice(k, 1))
                        [last_set], last_node = shingle_sets(piece, size), node
                    common = len(np.intersect1d(last_set, other, assume_unique=True))
                    yes.append(common > 0 and 100 * common >= hundredths * (len(last_set) + len(other) - common))
                yield batch.select(["a", "b"]).filter(pa.array(yes, type=pa.bool_()))

    return shared.written(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "links")


def cross_pairs(members: DataFrame, threshold: float, block: int = BLOCK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Pairs (a, b) of members (band, n, node, root, sketch, short_bands) in one bucket but two components whose sketches are close.

    A pair is looked at in the first band that it shares only.  A bucket's nodes fall on blocks by hash, and each pair of
    blocks is a group of its own: a node is copied once a block, no pair is
    made that fails, and no group is larger than about two blocks.
    """
    blocks = F.ceil(F.col("n") / F.greatest(F.lit(least_block), F.least(F.lit(block), F.col("n") / 8))).cast("int")
    rows = members.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("band", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "node", "root", "sketch", "short_bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs_of(table: pa.Table) -> pa.RecordBatch:
            node, root, own = (table.column(x).to_numpy() for x in ("node", "root", "_own"))
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            sketch = _sketches(table.column("sketch"))
            bands = np.frombuffer(b"".join(table.column("short_bands").to_pylist()), dtype=np.uint32).reshape(len(node), -1)
            here = np.uint32(table.column("band")[0].as_py() & 0xFFFFFFFF)
            first = np.flatnonzero(own == i)
            second = np.flatnonzero(own == j)
            out_a, out_b = [], []
            for k in first:
                others = second if i != j else second[second > k]
                others = others[root[others] != root[k]]
                common = (bands[others] == bands[k]).argmax(axis=1)
                others = others[bands[k][common] == here]
                near = others[close(sketch[k], sketch[others], threshold)]
                out_a.append(np.minimum(node[k], node[near]))
                out_b.append(np.maximum(node[k], node[near]))
            empty = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *out_a])), pa.array(np.concatenate([empty, *out_b]))], ["a", "b"])

        # Rows come sorted by group; a group may go on in the next batch.
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(x).to_numpy() for x in ("band", "i", "j")]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            if held and any(held[-1].column(x)[0].as_py() != batch.column(x)[0].as_py() for x in ("band", "i", "j")):
                yield pairs_of(pa.Table.from_batches(held))
                held = []
            for low, high in zip(bounds, bounds[1:], strict=False):
                held.append(batch.slice(low, high - low))
                if high < batch.num_rows:
                    if sum(x.num_rows for x in held) > 1:
                        yield pairs_of(pa.Table.from_batches(held))
                    held = []
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    sorted_rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint")


def named(nodes: DataFrame) -> DataFrame:
    """nodes with a 64-bit name `node`: h1, or of texts that share it a hash of h1 and h2."""
    twice = shared.written(nodes.groupBy("h1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h1", F.lit(True).alias("_twice")), "twice")
    if not twice.limit(1).count():
        return nodes.withColumn("node", F.col("h1"))
    return nodes.join(twice, "h1", "left").withColumn("node", F.when(F.col("_twice"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("_twice")


def grouped(docs: DataFrame, size: int = 5, threshold: float = 0.8, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, h1, h2, n_shingles and component_id of each row."""
    signer = Signer(bands_for(threshold, rows), rows)
    if docs.schema["doc_id"].dataType.typeName() == "void":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    every = shared.written(signatures(docs, signer, size), "signatures")
    nodes = shared.written(every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("short_bands").alias("short_bands")), "nodes")
    nodes = named(nodes)
    placed = nodes.where("n_shingles > 0").select(F.explode("bands").alias("band"), "node")
    buckets = placed.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = shared.written(placed.join(buckets, "band"), "members")
    sketches = nodes.select("node", "sketch")
    stars = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    sketched = stars.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    # Both rounds of pairs lie within the buckets' nodes, so their texts are fetched once for both.
    texts = texts_of(members.select("node").distinct(), nodes, docs)
    links = confirmed(shared.written(close_by_sketch(sketched, threshold), "pairs"), texts, size, threshold)
    roots = components.components(links)
    # Buckets whose nodes are in more than one component.
    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("band", "n", "node", "root")
    mixed = labelled.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("band")
    open_members = labelled.join(mixed, "band").join(nodes.select("node", "sketch", "short_bands"), "node")
    # A pair with the least node was looked at before.
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = shared.written(cross_pairs(open_members, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
    shared.discard(members)
    if more.limit(1).count():
        links = links.unionByName(confirmed(more, texts, size, threshold))
        roots = components.components(links)
    shared.discard(texts)
    by_node = nodes.join(roots, "node", "left").select("h1", "h2", "doc_id", F.coalesce("root", "node").alias("root"))
    least = by_node.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = by_node.join(least, "root").select("h1", "h2", "component_id")
    # A text may have any number of copies: those of frequent ones stay where they are.
    copied = components.hot_keys(nodes.where(F.col("copies") > components.HOT).select("h1", "h2"))
    rows = components.joined(every.select("h1", "h2", "doc_id", "n_shingles"), names, ["h1", "h2"], copied)
    return rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def digest(docs: DataFrame, size: int = 3, threshold: float = 0.85) -> DataFrame:
    """One row per document: the size of its set, its component, and whether it is the one that stays."""
    found = grouped(docs.select("doc_id", "text"), size, threshold)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with the document of least doc_id of each group, all columns kept."""
    docs, back = shared.plain(docs, "doc_id", "text")
    found = grouped(docs.select("doc_id", "text"), size, threshold)
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("doc_id").alias("_lost")).distinct()
    keyed = docs.select("*", *[x.alias(f"_{n}") for x, n in zip(text_key(), ("k1", "k2"), strict=True)])
    same = F.col("doc_id").eqNullSafe(F.col("_lost")) & (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2"))
    return back(keyed.join(lost, same, "left_anti"))
