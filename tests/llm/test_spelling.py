"""Spelling variants against comparing words place by place."""

import collections
import random
import re
import zlib

import pytest

from loomdoc.llm import spelling as sp

from .conftest import SCHEMA


def counted(rows):
    counts, lower = collections.Counter(), str.maketrans(sp.UPPER, sp.LOWER)
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """word -> (n, n_near, form, form_n, root)."""
    near = {w: [u for u in words if u != w and one_edit(u, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def as_dict(table):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in table.collect()}


def vocabulary(draw, n, signs, sizes):
    """Random words over few signs, edits of them, and chains of forms."""
    words = {}
    while len(words) < n:
        w = "".join(draw.choice(signs) for _ in range(draw.choice(sizes)))
        for k in range(draw.randint(1, 5)):
            words.setdefault(w, draw.choice([5, 6, 30, 150, 800, 5000]))
            i, how = draw.randrange(len(w)), draw.randrange(3)
            w = w[:i] + (draw.choice(signs) if how else "") + w[i + (how < 2) :] or draw.choice(signs)
    return {w: n for w, n in words.items() if w}


@pytest.mark.parametrize(("signs", "sizes", "shard_chars"), [("ab", [6, 7, 8, 9], 400), ("abcé", [6, 7, 12], 1 << 16), ("aÿ÷", [3, 4, 5, 30, 31], 2000), ("xyz😀", [1, 2, 6, 7], 300)])
def test_variants(spark, signs, sizes, shard_chars):
    words = vocabulary(random.Random(len(signs)), 500, signs, sizes)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert as_dict(sp.variants(table, shard_chars=shard_chars)) == brute(words)


def test_near_of_one_shard():
    draw = random.Random(5)
    for _ in range(60):
        length = draw.randint(1, 9)
        words = list({"".join(draw.choice("ab") for _ in range(length - draw.randrange(2))) for _ in range(40)} - {""})
        if max(map(len, words), default=0) < length:
            continue
        a, b = sp.near(words, length, 0, length)
        pairs = [(words[i], words[j]) for i, j in zip(a, b)]
        assert len(set(pairs)) == len(pairs)
        assert set(pairs) == {(x, y) for x in words for y in words if x != y and one_edit(x, y) and max(len(x), len(y)) == length}


def test_range_reporting():
    import numpy as np

    from loomdoc.llm.fmindex import WaveletMatrix

    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 64, 65, 300):
        values = draw.permutation(n)
        tree = WaveletMatrix(values, max(1, (n - 1).bit_length()))
        low, first = draw.integers(0, n, 200), draw.integers(0, n, 200)
        high, last = low + draw.integers(0, n - low + 1), first + draw.integers(0, n - first + 1)
        got = set(zip(*(x.tolist() for x in sp.reported(tree, low, high, first, last))))
        assert got == {(q, int(v)) for q in range(200) for v in values[low[q] : high[q]] if first[q] <= v < last[q]}


def test_digest(spark, docs, rows):
    """Words of the small documents, with nulls, repeated rows and long texts; a run hit by its checksum loses a code point."""
    words = counted(rows)
    assert as_dict(sp.digest(docs)) == brute(words)
    hit = next(i for i in range(10**6) if zlib.crc32(f"{i}:wonderful".encode()) % 199 == 0)
    text = " ".join(["Wonderful!"] * 6)
    assert as_dict(sp.digest(spark.createDataFrame([(hit, text, None, None, None)], SCHEMA))) == brute(counted([(hit, text)]))


def test_many_variants_of_one_word(spark, monkeypatch):
    """More variants than the limit from which a form's words stay where they are."""
    monkeypatch.setattr(sp.components, "HOT", 20)
    base = "abcdefghij"
    words = {base: 10**6} | {base[:i] + s + base[i + 1 :]: 10**4 for i in range(10) for s in "xyz"}
    words |= {w[:i] + "q" + w[i + 1 :]: 5 for w in list(words) if w != base for i in range(10)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert as_dict(sp.variants(table)) == brute(words)


def test_long_words_and_empty_tables(spark, empty):
    long = "ab" * 3000
    words = {long: 500, long[:2500] + "z" + long[2501:]: 7, long[:-1]: 6, "abcdef": 5}
    assert as_dict(sp.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))) == brute(words)
    assert sp.digest(empty).collect() == [] and sp.digest(empty).columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sp.digest(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect() == []
    assert as_dict(sp.digest(spark.createDataFrame([("x", "wonder " * 5, 1), ("y", None, 2)], "doc_id string, text string, word int")))
