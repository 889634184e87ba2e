import hashlib
import random
import re

import numpy as np
import pytest

from loomdoc.llm import substring_dedup
from loomdoc.llm.fmindex import FmIndex

from .conftest import SCHEMA, same, sentence


def brute_force(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for r, own in zip(rows, split, strict=True):
        if r[0] is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i : i + window])
                first[key] = min(r[0], first.get(key, r[0]))
    out = []
    for r, own in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(own) - window + 1):
            if r[0] is not None and first[tuple(own[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((r[0], len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_texts": 2, "shard_words": 300}])
def test_digest_equals_brute_force(spark, rows, docs, options):
    want = brute_force(rows, 13)
    assert sum(w[2] > 0 for w in want) > 10
    same([tuple(r) for r in substring_dedup.digest(docs, **options).collect()], want)


def test_few_words_many_repeats(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60))), "", "", 0) for i in range(40)]
    rows += [(100, "same " * 50, "", "", 0), (101, "same " * 30, "", "", 0), (101, "same other " * 20, "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for window, gram in ((13, 4), (5, 3)):
        same([tuple(r) for r in substring_dedup.digest(docs, window=window, gram=gram).collect()], brute_force(rows, window))


def test_kept_text_and_columns(spark, docs):
    found = substring_dedup.dedup(docs.selectExpr("*", "1 as h1", "2 as starts", "3 as _k1", "4 as N_Words"))
    assert found.columns == [*docs.columns, "h1", "starts", "_k1", "N_Words", "n_words_", "n_removed", "kept"]
    for r in found.collect():
        assert len(r.kept.split(" ")) == max(1, r.n_words_ - r.n_removed)


def longest_match(sequences, values, own, value):
    """At each place the longest match with a sequence of a smaller value, by comparing everything."""
    out = []
    for i in range(len(own)):
        best = 0
        for s, v in zip(sequences, values, strict=True):
            for j in range(len(s) if v < value else 0):
                k = 0
                while i + k < len(own) and j + k < len(s) and own[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3, 8, 13, 25])
@pytest.mark.parametrize("signs", [2, 5])
def test_matching_statistics(threshold, signs):
    draw = random.Random(threshold * 10 + signs)
    sequences = [[draw.randint(1, signs) for _ in range(draw.randint(1, 45))] for _ in range(25)]
    sequences += [s[:] for s in sequences[:4]] + [[*s[2:], 9] for s in sequences[:4]]
    values = [draw.randint(0, 12) for _ in sequences]
    streamed = [*sequences, *([draw.randint(1, signs + 1) for _ in range(draw.randint(1, 30))] for _ in range(8))]
    own = values + [draw.randint(0, 14) for _ in range(8)]
    flat = lambda x: np.array([w for s in x for w in s], dtype=np.uint64)
    lengths = lambda x: np.array([len(s) for s in x])
    index = FmIndex(flat(sequences), lengths(sequences), np.array(values), threshold)
    found = np.split(index.matching(flat(streamed), lengths(streamed), np.array(own)), np.cumsum(lengths(streamed))[:-1])
    for s, v, got in zip(streamed, own, found, strict=True):
        assert [x if x >= threshold else 0 for x in got] == [x if x >= threshold else 0 for x in longest_match(sequences, values, s, v)]


def test_the_index_is_compressed():
    draw = np.random.default_rng(1)
    n = 100_000
    index = FmIndex(draw.integers(0, 5000, n).astype(np.uint64), np.full(n // 20, 20), draw.integers(0, 1000, n // 20), 13)
    wavelet = sum(x.nbytes for x in (*index.wavelet.bits, *index.wavelet.ranks))
    assert wavelet < 3 * index.size and not any(isinstance(x, np.ndarray) and x.dtype.itemsize == 8 and len(x) >= n for x in vars(index).values())


def test_intervals():
    lengths = np.array([0, 4, 3, 0, 0, 5, 4, 3, 0, 0, 0, 2, 3, 0, 0])
    assert substring_dedup.intervals(lengths, np.array([5, 11, 11, 15]), 3).to_pylist() == [[{"start": 1, "words": 4}], [{"start": 0, "words": 5}], [], [{"start": 1, "words": 3}]]


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        substring_dedup.digest(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_empty_table(empty):
    assert substring_dedup.digest(empty).count() == 0
