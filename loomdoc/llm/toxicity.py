"""Toxicity: a subsequence string kernel machine with Nystroem landmarks.

The kernel of two strings sums, over all sequences of three characters that
both hold in this order, DECAY to the power of the stretches that they
span, so insults with gaps or inserted characters stay near their plain form.
Strings are the units of a sentence: its words in lower case, with runs of
one-letter words joined (`i d i o t`), common digit spellings read as letters,
and other signs as gaps.  A support vector machine on the Nystroem features of
LANDMARKS units separates insults from other units.  A sentence scores as its
worst unit, a document as its worst sentence, and a logistic curve fitted on
the sample turns that into a probability.

Only documents are labelled.  Every sentence of a clean document is clean; of a
toxic document the sentence with its most telling unit is toxic, and which that is
is settled in ROUNDS rounds of training.

The kernel's feature space (three characters of SIGNS) is small, so the trained
machine, a sum over landmarks of kernels, is collapsed into one weight per
character triple: scores are exact, and cost one pass over a unit's triples.

Fitting takes at most SAMPLE_PER_CLASS labelled documents of each class.  A first
machine then reads at most HARD_DOCUMENTS clean labelled ones, and the units that it takes
for insults there are counter-examples for the second.
Units longer than WIDTH characters are read in windows of WIDTH that overlap by half.

Defined results: null and empty texts have no units and score as the cleanest
unit there can be; without labels of both classes every score is the share of
label 1 (0 without labels); equal texts get equal scores; columns of docs are kept by `scored` and
`drop_toxic` whatever their names; labels count as `labelled` says; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan, labelled, shared

SAMPLE_PER_CLASS = 1000
HARD_DOCUMENTS = 20_000
HARD_SCORE = -0.5
LANDMARKS = 160
DECAY = 0.6
WIDTH = 24
ROUNDS = 3
NEGATIVES = 6000
THRESHOLD = 0.5
LOWEST = -8.0
#: A unit or a piece of one is evidence from this value of the likelihood ratio statistic on, if at most a twentieth of its documents are clean.
EVIDENCE = 18.0
PIECE = 4

#: Digits and signs that are read as letters.
READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SIGNS = 36
BLOCK = 1 << 21


def codes_table() -> np.ndarray:
    """Byte -> sign: letters 1-26, bytes inside a UTF-8 character 27-34, everything else 0, a gap."""
    table = np.zeros(256, dtype=np.int32)
    table[97:123] = table[65:91] = np.arange(1, 27)
    for sign, letter in READ_AS.items():
        table[ord(sign)] = ord(letter) - 96
    table[128:192] = 27 + np.arange(64) % 8
    return table


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the units of a piece of lower-cased bytes."""
    found = bytescan.words(data, offsets, bytescan.spaced_words())
    starts, ends, rows = found.starts, found.ends, found.rows()
    if len(starts):
        # A one-letter word goes on if its neighbour is one too, a single byte away and in the same row.
        single = ends - starts == 1
        joined = np.zeros(len(starts), dtype=bool)
        joined[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (rows[1:] == rows[:-1]) & (data[starts[1:] - 1] != 10)
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(starts)) - 1
        starts, ends, rows = starts[first], ends[last], rows[first]
    long = ends - starts > WIDTH
    if long.any():
        half = WIDTH // 2
        more = np.where(long, -(-(ends - starts - WIDTH) // half), 0) + 1
        which = np.repeat(np.arange(len(starts)), more)
        step = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more)
        starts, ends, rows = starts[which] + step * half, np.minimum(ends[which], starts[which] + step * half + WIDTH), rows[which]
    return starts, ends, rows


_known_triples = bytescan.WorkerCache()


def _triples(n: int) -> tuple[np.ndarray, ...]:
    """Places i < j < k below n and DECAY ** (k - i + 1)."""
    if n in _known_triples:
        return _known_triples[n]
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(n)] * 3, indexing="ij"))
    on = (i < j) & (j < k)
    i, j, k = i[on], j[on], k[on]
    return _known_triples.setdefault(n, (i, j, k, DECAY ** (k - i + 1.0)))


def self_kernels(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row of codes (units of one length) with itself, by prefix sums over pairs of places."""
    n = codes.shape[1]
    equal = ((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)).astype(np.float64)
    place = np.arange(n)
    out = equal * DECAY ** (-(place[:, None] + place[None, :]).astype(float))
    for _ in range(2):
        sums = np.zeros_like(out)
        sums[:, 1:, 1:] = np.cumsum(np.cumsum(out, axis=1), axis=2)[:, :-1, :-1]
        out = equal * sums
    return (out * DECAY ** (place[:, None] + place[None, :] + 2.0)).sum(axis=(1, 2))


def by_length(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, indices) of units of 3 to WIDTH bytes, in blocks that bound the memory of what is made of them."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cut = np.searchsorted(lengths[order], np.arange(3, WIDTH + 2))
    for n, low, high in zip(range(3, WIDTH + 1), cut, cut[1:], strict=False):
        block = max(1, BLOCK // (n * n * max(n - 2, 1)))
        for at in range(low, high, block):
            yield n, order[at : min(at + block, high)]


class Machine:
    """A trained machine: a weight for each character triple, an offset, and the curve from scores to probabilities."""

    def __init__(self, share: float = 0.0):
        self.share, self.weights, self.offset, self.curve = share, None, 0.0, (1.0, 0.0)

    def unit_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Score of each span of lower-cased bytes; LOWEST without a triple."""
        out, table = np.full(len(starts), LOWEST), codes_table()
        for n, at in by_length(starts, ends):
            codes = table[data[starts[at][:, None] + np.arange(n)]]
            i, j, k, decay = _triples(n)
            # Summed row by row: a product of matrices would round by the shape of the block.
            products = (self.weights[(codes[:, i] * SIGNS + codes[:, j]) * SIGNS + codes[:, k]] * decay).sum(axis=1)
            norm = np.sqrt(self_kernels(codes))
            some = norm > 0
            out[at[some]] = np.maximum(products[some] / norm[some] + self.offset, LOWEST)
        return out

    def document_scores(self, piece: bytescan.Piece) -> np.ndarray:
        """Probability of each row of a piece."""
        if self.weights is None:
            return np.full(piece.rows, self.share)
        data = bytescan.lower_table()[piece.data]
        starts, ends, rows = units(data, piece.offsets)
        worst = np.full(piece.rows, LOWEST)
        if len(starts):
            _, first, inverse = np.unique(bytescan.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            np.maximum.at(worst, rows, self.unit_scores(data, starts[first], ends[first])[inverse])
        slope, shift = self.curve
        return np.round(1 / (1 + np.exp(-np.clip(slope * worst + shift, -30, 30))), 9)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character triples of a string and their weights, of length one together; empty if it has none."""
    codes = codes_table()[np.frombuffer(text, np.uint8)]
    i, j, k, decay = _triples(len(codes))
    on = (codes[i] > 0) & (codes[j] > 0) & (codes[k] > 0)
    triples, which = np.unique(((codes[i] * SIGNS + codes[j]) * SIGNS + codes[k])[on], return_inverse=True)
    weights = np.bincount(which, weights=decay[on], minlength=len(triples))
    return triples, weights / max(np.linalg.norm(weights), 1e-300)


def triple_vectors(strings: list[bytes]) -> np.ndarray:
    """Normalised explicit kernel features of each string: (strings, SIGNS ** 3)."""
    out = np.zeros((len(strings), SIGNS**3), dtype=np.float32)
    for row, text in zip(out, strings, strict=True):
        triples, weights = features(text)
        row[triples] = weights
    return out


def _kernels(strings: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """(strings, landmarks) kernel values; a string reads the few rows of its own triples."""
    across, out = np.ascontiguousarray(landmarks.T), np.zeros((len(strings), len(landmarks)))
    for row, text in zip(out, strings, strict=True):
        triples, weights = features(text)
        row[:] = weights @ across[triples]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0) -> np.ndarray:
    """Weights (offset last) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        gap = 1 - y * (x @ theta)
        on = gap > 0
        slope = ridge @ theta - 2 * cost * x[on].T @ (weight[on] * y[on] * gap[on])
        step = np.linalg.solve(ridge + 2 * cost * (x[on].T * weight[on]) @ x[on], slope)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return theta


def fit(sample: list[tuple[int, list[bytes]]], population: dict[int, int], hard: Sequence[bytes] = (), seed: int = 3) -> Machine:
    """A machine from documents given as (label, distinct units); units in hard are clean, whatever the documents say."""
    labels = np.array([label for label, _ in sample])
    total = sum(population.values())
    machine = Machine(population.get(1, 0) / total if total else 0.0)
    if len(set(labels.tolist())) < 2:
        return machine
    draw = np.random.default_rng(seed)
    vocabulary = sorted({u for _, own in sample for u in own} | set(hard))
    number = {u: i for i, u in enumerate(vocabulary)}
    held = [np.array([number[u] for u in own], dtype=np.int64) for _, own in sample]
    first = _first_copies(held, len(vocabulary))
    labels, held = labels[first], [held[i] for i in first]
    counts = np.zeros((2, len(vocabulary)))
    for label, own in zip(labels, held, strict=True):
        counts[label, own] += 1
    data = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
    ends = np.cumsum([len(u) for u in vocabulary])
    starts = ends - np.array([len(u) for u in vocabulary])
    sizes = np.array([(labels == k).sum() for k in (0, 1)])
    rates = (counts + 0.5) / (sizes[:, None] + 1)
    telling = np.log(rates[1] / rates[0])
    # Inflected insults are rare each, but their pieces are not: a unit is evidence by itself or by a piece of PIECE signs.
    evidence = np.maximum(_evidence(counts, sizes), _piece_evidence(vocabulary, held, labels, sizes))
    refuted = np.array(sorted({number[u] for u in hard}), dtype=np.int64)
    evidence[refuted] = 0
    counts[0, refuted] += 1 + counts[1, refuted]
    telling = np.where(evidence > 0, np.maximum(telling, 0) + np.sqrt(evidence), np.minimum(telling, 0.5))
    clean = np.flatnonzero(counts[0] > 0)
    toxic = [own for label, own in zip(labels, held, strict=True) if label and len(own)]
    chosen = [own[np.argmax(telling[own])] for own in toxic]
    tally = np.bincount(chosen, minlength=len(vocabulary))
    positive = np.flatnonzero((evidence > 0) & (counts[0] <= 0.05 * counts[1]))
    if not len(positive):
        positive = np.flatnonzero((tally > 0) & (telling > 0))
    if not len(positive):
        return machine
    negative = np.setdiff1d(np.union1d(refuted, draw.choice(clean, min(NEGATIVES, len(clean)), replace=False)), positive)
    for turn in range(ROUNDS):
        strong = positive[np.argsort(-tally[positive], kind="stable")][: LANDMARKS // 2]
        some = np.concatenate([strong, draw.choice(negative, min(LANDMARKS - len(strong), len(negative)), replace=False)])
        landmarks = triple_vectors([vocabulary[i] for i in some])
        landmarks = landmarks[np.linalg.norm(landmarks, axis=1) > 0]
        values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
        keep = values > 1e-4
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = np.vstack([_kernels([vocabulary[i] for i in positive], landmarks), _kernels([vocabulary[i] for i in negative], landmarks)]) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        # A unit weighs by the documents it explains; the clean ones weigh as much together as the others.
        weight = np.concatenate([np.sqrt(np.maximum(tally[positive], 1)), np.ones(len(negative))])
        weight[: len(positive)] *= max(1.0, 0.3 * len(negative) / weight[: len(positive)].sum())
        theta = _svm(x, y, weight)
        machine.weights = ((root @ theta[:-1]) @ landmarks).astype(np.float32)
        machine.offset = float(theta[-1])
        scores = machine.unit_scores(data, starts, ends)
        if turn + 1 < ROUNDS:
            rank = scores + 0.3 * np.clip(telling, -2, 6)
            chosen = [own[np.argmax(rank[own])] for own in toxic]
            tally = np.bincount(chosen, minlength=len(vocabulary))
            positive = np.flatnonzero((((tally > 0) & (scores > -0.5)) | (evidence > 0)) & (counts[0] <= 0.05 * counts[1]))
            if not len(positive):
                break
            near = np.union1d(refuted, clean[np.argsort(-scores[clean], kind="stable")[: NEGATIVES // 2]])
            negative = np.setdiff1d(np.union1d(near, draw.choice(clean, min(NEGATIVES // 2, len(clean)), replace=False)), positive)
    worst = np.array([scores[own].max(initial=LOWEST) if len(own) else LOWEST for own in held])
    machine.curve = _curve(worst, labels, population)
    return machine


def _first_copies(held: list[np.ndarray], size: int, keep: int = 16) -> list[int]:
    """Documents without those that share three quarters of their `keep` pseudorandom least units with an earlier one: copies are no further evidence."""
    place = np.random.default_rng(size).permutation(size)
    seen: dict[int, list[int]] = {}
    first = []
    for i, own in enumerate(held):
        least = own[np.argsort(place[own])[:keep]].tolist()
        shared_with = np.bincount([j for u in least for j in seen.get(u, ())] or [0])
        if len(least) and seen and shared_with.max() * 4 >= 3 * max(len(least), 4):
            continue
        first.append(i)
        for u in least:
            seen.setdefault(u, []).append(i)
    return first


def _evidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic of counts (clean, toxic) where it speaks for toxic documents, else 0."""
    total = counts.sum(axis=0)
    share = sizes[1] / sizes.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(counts[1] > 0, counts[1] * np.log(counts[1] / (total * share)), 0) + np.where(counts[0] > 0, counts[0] * np.log(counts[0] / (total * (1 - share))), 0))
    return np.where((counts[0] <= 0.05 * counts[1]) & (g >= EVIDENCE), g, 0)


def _piece_evidence(vocabulary: list[bytes], held: list[np.ndarray], labels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each unit the greatest evidence of a piece that it holds, gaps left out and digits read as letters."""
    code = codes_table()[np.frombuffer(b"".join(vocabulary), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(len(vocabulary)), [len(u) for u in vocabulary])[code > 0]
    code = code[code > 0]
    n = max(0, len(code) - PIECE + 1)
    flat = np.zeros(n, dtype=np.int64)
    for i in range(PIECE):
        flat = flat * SIGNS + code[i : i + n]
    inside = owner[:n] == owner[PIECE - 1 : PIECE - 1 + n]
    flat, bounds = flat[inside], np.searchsorted(owner[:n][inside], np.arange(len(vocabulary) + 1))
    counts = np.zeros((2, SIGNS**PIECE))
    for label, own in zip(labels, held, strict=True):
        if len(own):
            counts[label, np.unique(np.concatenate([flat[bounds[u] : bounds[u + 1]] for u in own]))] += 1
    found = np.append(_evidence(counts, sizes)[flat], 0)
    best = np.zeros(len(vocabulary))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        best[some] = np.maximum.reduceat(found, bounds[:-1][some])
    return best


def _curve(worst: np.ndarray, labels: np.ndarray, population: dict[int, int]) -> tuple[float, float]:
    """Slope and shift of the logistic curve, classes weighing as in the population; Newton steps with a weak prior."""
    weight = np.where(labels == 1, population[1] / (labels == 1).sum(), population[0] / (labels == 0).sum())
    weight = weight / weight.mean()
    x, theta = np.stack([worst, np.ones(len(worst))], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + np.array([1e-2, 1e-3]) * theta
        bend = (x.T * (weight * p * (1 - p))) @ x + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(bend, slope)
        theta = theta - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, hard_documents: int = HARD_DOCUMENTS) -> Machine:
    """Fits a machine on a bounded sample; the driver gets each sampled document's distinct units (no unit holds a line break)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for piece in bytescan.pieces(batch.column("text")):
                data = bytescan.lower_table()[piece.data]
                starts, ends, rows = units(data, piece.offsets)
                own: list[set[bytes]] = [set() for _ in range(piece.rows)]
                for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
                    if e - s >= 3:
                        own[r].add(data[s:e].tobytes())
                found += [b"\n".join(sorted(x)) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("population"), pa.array(found, type=pa.binary())], ["doc_id", "label", "population", "units"])

    chosen = labelled.sample(docs, labels, label, per_class)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("doc_id", "text", "label", "population").mapInArrow(run, f"doc_id {kind}, label int, population bigint, units binary").toArrow()
    ids, marks, found, sizes = (rows.column(x).to_pylist() for x in ("doc_id", "label", "units", "population"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], found[i]))
    sample, population = [(marks[i], found[i].split(b"\n") if found[i] else []) for i in order], dict(zip(marks, sizes, strict=True))
    machine = fit(sample, population)
    if machine.weights is None:
        return machine
    hard = mistaken(labelled.of_class(docs, labels, label, 0, hard_documents), machine)
    return fit(sample, population, hard) if hard else machine


def mistaken(clean: DataFrame, machine: Machine) -> list[bytes]:
    """The worst unit of each of these clean documents, where it is near the insults; at most one for a document."""
    sent = shared.Sent(clean.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = sent()
        for batch in batches:
            found: set[bytes] = set()
            for piece in bytescan.pieces(batch.column("text")):
                data = bytescan.lower_table()[piece.data]
                starts, ends, rows = units(data, piece.offsets)
                scores = trained.unit_scores(data, starts, ends)
                order = np.lexsort((-scores, rows))
                first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
                found |= {data[starts[i] : ends[i]].tobytes() for i in first if scores[i] > HARD_SCORE}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), type=pa.binary())], ["unit"])

    return sorted(set(clean.select("text").mapInArrow(run, "unit binary").toArrow().column("unit").to_pylist()))


def _scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs (text and others) with a column score."""
    sent = shared.Sent(docs.sparkSession, machine)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = sent()
        for batch in batches:
            out = [trained.document_scores(piece) for piece in bytescan.pieces(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], type=pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + ", score double")


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with a column score (with underscores after it where docs has one)."""
    docs, back = shared.plain(docs, "text")
    return back(_scored(docs, machine), "score")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: fold, score and prediction."""
    found = _scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, all columns kept."""
    docs, back = shared.plain(docs, "doc_id", "text")
    return back(_scored(docs, train(docs, labels)).where(F.col("score") < THRESHOLD))
