import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomdoc.llm import mixing

from .conftest import same


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = sum(weight[s] for s in free)
        out = {s: cap * sizes[s] if s in capped else left * weight[s] / share for s in order}
        above = {s for s in free if out[s] > cap * sizes[s]}
        if not above:
            return out
        capped |= above


def sizes_of(rows):
    out = {}
    for _, text, _, source, _ in rows:
        out[source] = out.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


def test_targets(spark, rows):
    for sizes in (sizes_of(rows), {"a": 1, "b": 1000, "c": 10, None: 5, "d": 0}, {"a": 0}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_digest(docs, rows):
    found = mixing.digest(docs, block_words=8, keep_keys=True).collect()
    want = plain_targets(sizes := sizes_of(rows))
    same([(r.doc_id, r.size, r.source_size) for r in found], [(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), sizes[r[3]]) for r in rows])
    for source, size in sizes.items():
        own = [r for r in found if r.source == source]
        assert all(r.target == pytest.approx(want[source]) for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= 16 or size < 16
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    same([(r.doc_id, r.taken) for r in found], [(r.doc_id, r.taken) for r in mixing.digest(docs.repartition(5), block_words=8).collect()])


def number(*parts):
    return int(hashlib.md5("|".join("null" if x is None else str(x) for x in parts).encode()).hexdigest()[:15], 16)


def plain_permuted(index, n, *key):
    """The Feistel network by hand: a row moves by its column, then the column by its row, twice, until the place is below n."""
    rows = next(r for r in range(max(0, int(n**0.5) - 2), n + 2) if r * r >= n)
    columns = -(-n // rows)
    while True:
        row, column = divmod(index, columns)
        for k in (0, 2):
            row = (row + number(*key, k, column)) % rows
            column = (column + number(*key, k + 1, row)) % columns
        index = row * columns + column
        if index < n:
            return index


def permuted(spark, n, *key):
    size = F.lit(n).cast("long")
    return spark.range(n).select("id", mixing.permuted(F.col("id"), size, mixing.shape(size), *key).alias("p"))


def test_permutations_are_bijections_and_depend_on_their_key(spark):
    for n in (1, 2, 3, 5, 6, 17, 101, 577, 999, 10_001):
        rows = permuted(spark, n, 20, F.lit(3), 0).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert [r.p for r in rows[:200]] == [plain_permuted(r.id, n, 20, 3, 0) for r in rows[:200]]
    ways = {tuple(r.p for r in permuted(spark, 50, seed, source, turn).collect()) for seed in (1, 2) for source in (0, 1) for turn in (0, 1)}
    assert len(ways) == 8


@pytest.mark.parametrize("n", [1000, 10_000, 100_000, 250_000])
def test_a_part_of_a_pass_is_spread_evenly(spark, n):
    """The first tenth of the slots falls evenly on all tenths of a source, and its neighbours' distances are of all sizes: no stride."""
    places = [r.p for r in permuted(spark, n, 20, 1, 2).where(F.col("id") < n // 10).orderBy("id").collect()]
    counts = [sum(1 for p in places if p * 10 // n == k) for k in range(10)]
    mean = n / 100
    assert sum((c - mean) ** 2 for c in counts) / mean < 9 + 6 * 18**0.5, counts
    steps = [(b - a) % n for a, b in zip(places, places[1:])]
    assert len(set(steps)) > 0.8 * len(steps) and 0.4 < sum(steps) / len(steps) / n < 0.6


def test_counts_of_shards_are_multinomial(spark):
    sizes = spark.createDataFrame([("a", 400_000), ("b", 300_000), ("c", 100_000), (None, 90_000)], "source string, source_size bigint")
    plan = mixing.slotted(mixing.targets(sizes), 64, 100)
    counts = {(r.source_no, r.shard): r.n for r in mixing.draws(plan).collect()}
    totals = {r.source_no: (r.n_slots, r.n_shards) for r in plan.collect()}
    for k, (slots, shards) in totals.items():
        own = [counts.get((k, i), 0) for i in range(shards)]
        assert sum(own) == slots and max(x[1] for x in counts) == shards - 1
        spread = sum((x - slots / shards) ** 2 for x in own) / (slots / shards)
        assert abs(spread - (shards - 1)) < 6 * (2 * shards) ** 0.5, "chi square"
    other = {(r.source_no, r.shard): r.n for r in mixing.draws(plan, seed=5).collect()}
    assert other != counts
    slots = mixing.drawn(plan).collect()
    seen = {}
    for r in sorted(slots, key=lambda r: (r.source_no, r.n)):
        seen.setdefault(r.source_no, []).append(r)
    for k, own in seen.items():
        assert [r.n for r in own] == list(range(totals[k][0])) and [r.shard for r in own] == sorted(r.shard for r in own)
        assert {i: c for (s, i), c in counts.items() if s == k} == {i: sum(r.shard == i for r in own) for i in {r.shard for r in own}}


def plain_mix(rows, block_words, shard_slots, seed=mixing.SEED):
    """taken and n_shards of each row, slot by slot."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    hashes = [number("text", r[1]) for r in rows]
    sizes = sizes_of(rows)
    want, order = plain_targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    n_blocks = {s: -(-sizes[s] // block_words) for s in order}
    n_slots = {s: int(want[s] // sizes[s]) * n_blocks[s] + int((want[s] - want[s] // sizes[s] * sizes[s]) * n_blocks[s] / sizes[s] + 0.5) if sizes[s] else 0 for s in order}
    shards = max(1, -(-sum(n_slots.values()) // shard_slots))
    taken, inside = [0] * len(rows), [set() for _ in rows]
    for no, s in enumerate(order):
        own = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (number("bucket", rows[i][0], hashes[i]) % mixing.BUCKETS, rows[i][0] is not None, rows[i][0] or 0, hashes[i]))
        stream = [i for i in own for _ in range(size[i])]
        dealt = sorted(number(seed, "shard", no, j) % shards for j in range(n_slots[s]))
        for n, shard in enumerate(dealt):
            k, turn = n_blocks[s], n // n_blocks[s]
            block = plain_permuted(n % k, k, seed, no, turn)
            for i in stream[block * block_words : (block + 1) * block_words]:
                taken[i] += 1
                inside[i].add(shard)
    return [(r[0], t, len(x)) for r, t, x in zip(rows, taken, inside, strict=True)]


@pytest.mark.parametrize(("block_words", "shard_slots"), [(8, 10), (64, 1024), (5, 3)])
def test_taken_equals_brute_force(docs, rows, block_words, shard_slots):
    found = mixing.digest(docs, block_words=block_words, shard_slots=shard_slots)
    same([(r.doc_id, r.taken, r.n_shards) for r in found.collect()], plain_mix(rows, block_words, shard_slots))


def test_shards_and_slots_are_in_the_plan_of_the_query(docs):
    spans = mixing.digest(docs, block_words=8, shard_slots=10)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in plan and "ArrowEval" not in plan and "MapInArrow" not in plan and "PythonUDF" not in plan


def test_columns_are_kept(docs):
    clashing = docs.selectExpr("*", "1 as _id", "2 as Size", "3 as taken", "4 as _n", "5 as block")
    kept = mixing.taken_documents(clashing, block_words=8)
    assert kept.columns == [*clashing.columns, "size_", "source_size", "target", "taken_", "n_shards"]
    assert {(r["_id"], r.Size, r.taken, r["_n"], r.block) for r in kept.collect()} == {(1, 2, 3, 4, 5)} and kept.where("taken_ <= 0").count() == 0


def test_mixed_texts_hold_the_taken_words(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.digest(unique, block_words=8).collect()}
    spans = mixing.mix(unique, block_words=8)
    assert {r.doc_id: r.w for r in spans.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()} == {k: v for k, v in taken.items() if v}
    texts = mixing.mixed_texts(unique, block_words=8).collect()
    assert sum(len(r.text.split(" ")) for r in texts) == sum(taken.values())
    assert max(len(r.text.split(" ")) for r in texts) <= 8


def test_empty_table(empty):
    assert mixing.digest(empty).count() == 0
