import random
import re

import numpy as np
import pytest

from loomdoc.llm import bytescan, components, neardup

from .conftest import SCHEMA, same, sentence


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size):
    own = words_of(text)
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()


def brute_force(rows, size, hundredths):
    sets = [shingles(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= hundredths * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0], r[0] == (least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows)]


def chained(seed=4):
    """Chains of documents, each near the next but not the one after."""
    draw = random.Random(seed)
    rows, n = [], 1000
    for _ in range(12):
        own = sentence(draw, 120).split()
        for step in range(8):
            rows.append((n, " ".join(own), None, "s", 0))
            n += draw.randint(1, 5)
            for k in draw.sample(range(120), 2):
                own[k] = f"new{step}x{k}"
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "hundredths"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, rows, size, hundredths):
    every = rows + chained()
    docs = spark.createDataFrame(every, SCHEMA).repartition(3)
    want = brute_force(every, size, hundredths)
    assert sum(not w[3] for w in want) > 30
    got = [tuple(r) for r in neardup.digest(docs, size, hundredths / 100).collect()]
    same(got, want)
    kept = neardup.keep_one(docs.selectExpr("*", "1 as h1", "2 as sketch", "3 as _H1", "4 as _k1"), size, hundredths / 100)
    assert kept.columns == [*docs.columns, "h1", "sketch", "_H1", "_k1"]
    same([(r.doc_id, r.text) for r in kept.collect()], [(r[0], r[1]) for r, w in zip(every, want, strict=True) if w[3]])


def test_small_blocks_find_the_same(spark, monkeypatch):
    every = chained(9)
    monkeypatch.setattr(components, "HOT", 2)
    monkeypatch.setattr(neardup.cross_pairs, "__defaults__", (3, 3))
    same([tuple(r) for r in neardup.digest(spark.createDataFrame(every, SCHEMA), 3, 0.85).collect()], brute_force(every, 3, 85))


@pytest.mark.parametrize("size", [20, 130, 900, 4000, 30_000])
@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_sketches_keep_similar_pairs_and_drop_others(size, threshold):
    draw = np.random.default_rng(size)

    def passes(similarity):
        union = draw.integers(0, 2**64, size, dtype=np.uint64)
        common, rest = np.split(union, [int(np.ceil(size * similarity))])
        half = len(rest) // 2
        a, b = (neardup.sketch(np.unique(np.concatenate([common, x]))) for x in (rest[:half], rest[half:]))
        return bool(neardup.close(a, b, threshold))

    assert all(passes(threshold) and passes((1 + threshold) / 2) for _ in range(60))
    assert not any(passes(threshold - 0.3) for _ in range(60)) or size < 100


@pytest.mark.parametrize("size", [5000, 20_000, 60_000, 200_000])
def test_sketches_of_long_documents_do_not_fill_up(size):
    draw = np.random.default_rng(size)

    def passes(similarity, threshold):
        union = draw.integers(0, 2**64, size, dtype=np.uint64)
        common, rest = np.split(union, [int(np.ceil(size * similarity))])
        a, b = (neardup.sketch(np.sort(np.concatenate([common, x]))) for x in np.split(rest, [len(rest) // 2]))
        return bool(neardup.close(a, b, threshold))

    for threshold in (0.8, 0.85):
        assert not any(passes(s, threshold) for s in (0, 0.3, 0.6, threshold - 0.15) for _ in range(20))
        assert all(passes(s, threshold) for s in (threshold, 0.9, 1) for _ in range(40))


def test_sets_on_both_sides_of_the_two_sketch_sizes_are_not_lost():
    draw = np.random.default_rng(3)
    for size in (3700, 4000, 4500):
        union = draw.integers(0, 2**64, size, dtype=np.uint64)
        a, b = neardup.sketch(np.sort(union)), neardup.sketch(np.sort(union[: int(size * 0.86)]))
        assert neardup.close(a, b, 0.85) and not neardup.close(a, neardup.sketch(np.sort(union[: int(size * 0.8)])), 0.85)


def test_texts_that_share_a_hash_are_told_apart(spark, rows, monkeypatch):
    every = rows + chained(5)
    key = neardup.text_key
    monkeypatch.setattr(neardup, "text_key", lambda: [neardup.F.pmod(key()[0], neardup.F.lit(7)).alias("h1"), key()[1]])
    same([tuple(r) for r in neardup.digest(spark.createDataFrame(every, SCHEMA), 3, 0.85).collect()], brute_force(every, 3, 85))


def test_ids_of_other_types(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("b", words), ("a", words + " more"), ("c", "else"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in neardup.digest(docs).collect()} == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True)}


@pytest.mark.parametrize("size", [60, 100, 200, 400, 700, 1000])
@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_sketches_lose_no_pair_at_the_threshold(size, threshold):
    draw = np.random.default_rng(size)
    union = draw.integers(0, 2**64, (4000, size), dtype=np.uint64)
    common = -(-round(100 * threshold) * size // 100)
    half = common + (size - common) // 2
    a = np.array([neardup.sketch(np.sort(x[:half])) for x in union])
    b = np.array([neardup.sketch(np.sort(np.concatenate([x[:common], x[half:]]))) for x in union])
    assert neardup.close(a, b, threshold).all()
    one_sided = np.array([neardup.sketch(np.sort(x[:common])) for x in union])
    whole = np.array([neardup.sketch(np.sort(x)) for x in union])
    assert neardup.close(one_sided, whole, threshold).all()


@pytest.mark.parametrize("hot", [2000, 3])
def test_components_of_long_paths(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    path = list(range(300))
    random.Random(2).shuffle(path)
    links = [(int(a), int(b)) for a, b in zip(path, path[1:], strict=False)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)] + [(5000, 5001 + i) for i in range(30)]
    got = {}
    for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [2, 31, 300]


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    for piece in bytescan.pieces(pa.array([r[1] for r in rows]), limit=200):
        found = bytescan.words(piece.data, piece.offsets, bytescan.spaced_words())
        for row in range(piece.rows):
            own = [piece.data[found.starts[i] : found.ends[i]].tobytes().decode() for i in range(found.bounds[row], found.bounds[row + 1])]
            assert own == re.findall(r"[^\x20\x09-\x0D]+", rows[piece.first + row][1] or "")


def test_empty_table(empty):
    assert neardup.digest(empty).count() == 0
