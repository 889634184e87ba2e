"""The trie of conversation prefixes against nodes built one by one, with partitions that cut through nodes and runs of copies."""

import collections
import hashlib
import random
import zlib

import pytest

from loomdoc.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn int, role string, text string"


def nodes_of(sequences):
    """The contract's rows of {conv_id: [(role, text), ...]}, by counting members of every prefix."""
    members = collections.defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    saved, leaves = collections.Counter(), collections.Counter()
    for key, of in members.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(of) - 1) * len(key[-1][1]) if key else 0
            leaves[key[:d]] += not children[key]
    ends = lambda key: ",".join(map(str, sorted(c for c in members[key] if len(sequences[c]) == len(key))))
    return [(min(of), len(k), min(members[k[:-1]]) if k else None, len(of), children[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, of in members.items()]


def rebuilt(own):
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[: h(c)] + turns[h(c) :] for c, turns in own.items()}


def as_rows(own, draw):
    rows = [(c, i if i else None, role or None, text or None) for c, turns in own.items() for i, (role, text) in enumerate(turns)]
    draw.shuffle(rows)
    return rows


def some(draw, n, words, deepest=7):
    """Conversations of few different turns, so prefixes and whole copies abound; empty roles and texts, signs beyond the BMP."""
    turns = [(draw.choice(["user", "assistant", ""]), draw.choice(words)) for _ in range(4)]
    return {c: [draw.choice(turns) for _ in range(draw.randint(1, deepest))] for c in draw.sample(range(4 * n), n)}


def of(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_digest(spark, many_partitions, seed, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_IDS", 3)
    draw = random.Random(seed)
    own = some(draw, 150, ["", "yes", "no 😀", "a longer text"])
    assert of(pt.digest(spark.createDataFrame(as_rows(own, draw), SCHEMA))) == sorted(nodes_of(rebuilt(own)), key=str)


def packed(turns):
    """The bytes that `arrays` makes of turns."""
    return b"".join(hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() + len(t).to_bytes(4, "big") for r, t in turns)


def test_copies_across_many_partitions(spark, many_partitions, monkeypatch):
    """A third and more of all conversations are one, others are its heads or go on from it, one is empty."""
    monkeypatch.setattr(pt, "PIECE_IDS", 4)
    a, b, c = ("u", "hello"), ("a", "world"), ("u", "")
    own = {i: [a, b] for i in range(0, 120)} | {i: [a] for i in range(200, 230)} | {i: [a, b, c] for i in range(300, 330)} | {i: [b] * (i % 5) for i in range(400, 430)}
    table = spark.createDataFrame([(i, bytearray(packed(t))) for i, t in own.items()], "conv_id bigint, turns binary")
    found = pt.trie(table)
    assert of(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) == sorted(nodes_of(own), key=str)
    assert found.select("id").distinct().count() == found.count()


def test_conversations_without_turns(spark):
    table = spark.createDataFrame([(3, bytearray()), (1, bytearray())], "conv_id bigint, turns binary")
    assert of(pt.trie(table).drop("id", "parent").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) == nodes_of({1: [], 3: []})


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_sweeps_of_any_cut(parts):
    """The same sums, whatever borders cut the sorted arrays."""
    draw = random.Random(parts)
    for _ in range(30):
        own = some(draw, 40, ["x", "yy", ""], 4)
        rows = sorted((packed(t), c) for c, t in own.items())
        cuts = [0, *sorted(draw.sample(range(1, len(rows)), parts - 1)), len(rows)]
        seen, ids = collections.defaultdict(list), collections.defaultdict(list)
        for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
            sweep = pt.Sweep(k, rows[low - 1][0] if low else None, rows[high][0] if high < len(rows) else None)
            for turns, c in rows[low:high]:
                sweep.add(turns, c)
            sweep.finish()
            for node in sweep.rows():
                seen[node[0]].append(node) if node[2] is not None else ids[node[0]].append(node[10:])
        got = []
        for key, nodes in seen.items():
            assert len(nodes) == 1 or not any(n[8] for n in nodes)
            pieces = ",".join(x[2] for x in sorted(ids[key]))
            digest = hashlib.sha256(pieces.encode()).hexdigest() if pieces else max((n[9] for n in nodes if n[9]), default=pt._NOBODY)
            got.append((min(n[3] for n in nodes), nodes[0][2], nodes[0][1], *(sum(n[i] for n in nodes) for i in (4, 5, 6, 7)), digest))
        least = {key: min(n[3] for n in nodes) for key, nodes in seen.items()}
        got = [(c, d, least.get(p), *rest) for c, d, p, *rest in got]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, nodes_of(own)))


def test_common():
    draw = random.Random(0)
    for _ in range(500):
        a = [draw.randrange(2) for _ in range(draw.randrange(40))]
        b = a[: draw.randrange(41)] + [draw.randrange(2) for _ in range(draw.randrange(10))]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert pt.common(*(b"".join(x.to_bytes(pt.TURN, "big") for x in z) for z in (a, b))) == n


def test_nulls_ties_and_empty_tables(spark):
    rows = [(5, None, "u", "first"), (5, 0, None, None), (5, 1, "u", "b"), (5, 1, "u", "b"), (None, 0, "u", "nobody"), (205, 0, "u", "x")]
    got = pt.digest(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS turns", "2 AS part"))
    own = {5: [("u", "first"), ("", ""), ("u", "b"), ("u", "b")], 205: [("u", "x")]}
    assert of(got) == sorted(nodes_of(rebuilt(own)), key=str)
    assert pt.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pt.digest(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).collect() == []
    with pytest.raises(TypeError):
        pt.arrays(spark.createDataFrame([("a", 1, "u", "x")], "conv_id string, turn int, role string, text string"))


def test_a_very_long_conversation(spark):
    own = {1: [("u", f"turn {i}") for i in range(3000)], 2: [("u", f"turn {i}") for i in range(2000)]}
    table = spark.createDataFrame([(i, bytearray(packed(t))) for i, t in own.items()], "conv_id bigint, turns binary")
    got = {(r.depth, r.conv_id): r for r in pt.trie(table).collect()}
    assert len(got) == 3001 and got[2000, 1].n_convs == 2 and got[2001, 1].n_convs == 1 and got[0, 1].saved_tokens == sum(len(f"turn {i}") for i in range(2000))
