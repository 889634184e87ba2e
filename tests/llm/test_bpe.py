"""Byte-pair encoding against the installed library, and the trie against merges done one by one."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomdoc.llm import bpe

from .conftest import SCHEMA, same

SIGNS = "ab'elthn rsio<|>0 1!É é́\n\tΣßİ日本語각ᄀ🎉²"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.vocabulary_path())


def as_library(library, texts):
    return [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]


def texts(draw, names):
    fixed = ["", " ", "a", "Hello <|endoftext|> wörld's <|startoftext|><|endoftext|>x", "ΑΣΣ ΣΑΣ", "İstanbul", "é x ́", "가각가", "\x1c\x1d\x85\xa0a b", "don't WON'T 'S'd''ll I'Ve", "ab" * 5000, "the cat " * 50000]
    mixed = ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    any_sign = ["".join(chr(draw.choice([draw.randrange(32, 0x250), draw.randrange(0x250, 0xD7FF), draw.randrange(0x10000, 0x1FFFF)])) for _ in range(draw.randint(1, 20))) for _ in range(600)]
    joined = ["".join(draw.choice(names).removesuffix("</w>") for _ in range(draw.randint(1, 5))) for _ in range(3000)]
    return [*fixed, *mixed, *any_sign, *joined]


def test_as_the_library(library, vocabulary):
    cases = texts(random.Random(3), list(vocabulary.merges.ids))
    assert list(bpe.Encoder(vocabulary).encode(cases)) == as_library(library, cases)


def test_the_same_with_little_memory(library, vocabulary, monkeypatch):
    """Small pieces and a forgetful cache change nothing."""
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    monkeypatch.setattr(bpe, "LONG_WORD", 7)
    cases = texts(random.Random(4), list(vocabulary.merges.ids))[:3000]
    assert list(bpe.Encoder(vocabulary).encode(cases)) == as_library(library, cases)


def merged(word, merges, suffix):
    """Merges in order of rank, the leftmost first."""
    parts = [*word[:-1], word[-1] + suffix]
    while pairs := [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_the_trie_against_merges(suffix):
    """Small vocabularies of two and three signs, where ties and repeated signs abound; tokens that merges do not reach never occur."""
    draw = random.Random(11)
    for _ in range(60):
        signs = "ab" if draw.random() < 0.5 else "abc"
        names, merges = [*signs, *(s + suffix for s in signs if suffix)], []
        for _ in range(draw.randint(1, 9)):
            a, b = draw.choice([n for n in names if not suffix or not n.endswith(suffix)]), draw.choice(names)
            if a + b not in names:
                names.append(a + b)
                merges.append((a, b))
        ranks = {m: k for k, m in enumerate(merges)}
        ids = {n: k for k, n in enumerate(names)}
        words = {"".join(draw.choice(signs) for _ in range(draw.randint(1, 12))) for _ in range(150)} | {signs * 60}
        for word, tokens in bpe.TrieEncoder(bpe.Merges(ids, merges, suffix)).encode(words):
            assert [names[t] for t in tokens] == merged(word, ranks, suffix)


def test_shared_prefixes_are_encoded_once(vocabulary, monkeypatch):
    encoder, seen = bpe.TrieEncoder(vocabulary.merges), []
    ends = encoder._end
    monkeypatch.setattr(encoder, "_end", lambda tail, depth, last, found: seen.append(depth) or ends(tail, depth, last, found))
    words = ["understand", "understands", "understanding", "under", "undertow"]
    assert len(dict(encoder.encode(words))) == len(words)
    nodes = {w[:k] for w in words for k in range(1, len(w))}
    assert len(seen) == len(nodes) + len(words)


def test_digest(spark, docs, rows, library):
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.digest(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same([tuple(r) for r in got.collect()], want)


def test_columns_stay_and_empty_tables(spark, docs, empty):
    wide = docs.selectExpr("*", "1 AS ids", "2 AS IDS_", "3 AS n_tokens", "4 AS other_0")
    got = bpe.encoded(wide)
    assert got.columns == [*wide.columns, "n_tokens_", "ids__"] and got.count() == docs.count()
    back = bpe.decoded(got, "ids__")
    assert back.columns == [*got.columns, "decoded"] and back.where("ids = 1 AND n_tokens = 3 AND other_0 = 4").count() == docs.count()
    assert bpe.digest(empty).collect() == [] and bpe.digest(spark.createDataFrame([], SCHEMA)).columns[1] == "n_tokens"
    nulls = spark.createDataFrame([(b"",), (None,)], "ids binary")
    assert {tuple(r) for r in bpe.decoded(nulls).collect()} == {(b"", ""), (None, None)}


def test_ids_of_any_type(spark):
    got = bpe.digest(spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {("x", 2), (None, 0)}


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(bpe.Vocabulary(bpe.vocabulary_path()).file)
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"pre_tokenizer": None}):
        path = tmp_path / "vocabulary.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))
