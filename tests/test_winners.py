"""Winners of streamed trees against the rule over the whole table; the table that batches are merged into."""

import random

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import mvcc
from loomdoc.streaming import winners as w


def trees(draw, documents):
    """Trees with branches, several roots, tombstones and tied revision ids: (sequence, _id, parent, revid, deleted)."""
    rows, sequence = [], 0
    for d in range(documents):
        own = []
        for _ in range(draw.randint(1, 9)):
            sequence += 1
            parent = draw.choice([None, *own]) if own else None
            generation = 1 if parent is None else int(next(r[3] for r in rows if r[0] == parent).split("-")[0]) + 1
            rows.append((sequence, f"d{d}", parent, f"{generation}-{draw.choice('abcé')}", draw.random() < 0.3))
            own.append(sequence)
    return rows


SHAPE = "sequence bigint, _id string, parent bigint, revid string, deleted boolean"


def test_leaves_in_any_order():
    draw = random.Random(1)
    for _ in range(200):
        rows = trees(draw, 1)
        parents = {r[2] for r in rows}
        want = {r[0]: (r[3], r[4]) for r in rows if r[0] not in parents}
        draw.shuffle(rows)
        leaves, awaited = {}, set()
        while rows:
            n = draw.randint(1, 4)
            w.followed(leaves, awaited, ((s, p, r, d) for s, _, p, r, d in rows[:n]))
            rows = rows[n:]
        assert leaves == want and w.winner_of(leaves)[0] in want
    assert w.winner_of({}) is None


def test_a_stream_in_batches(spark, tmp_path):
    draw = random.Random(2)
    rows = trees(draw, 40)
    revs = spark.createDataFrame([(*r, True, "{}") for r in rows], SHAPE + ", available boolean, json string")
    draw.shuffle(rows)
    source, state = str(tmp_path / "revs"), str(tmp_path / "state")
    half = len(rows) // 2
    for part in (rows[:half], [*rows[half:], (10**6, None, None, "1-a", False)]):
        spark.createDataFrame(part, SHAPE).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 2).parquet(source)
        found = w.winners_of_stream(stream, state)  # the second run goes on from the first one's state
    same = lambda df: sorted(tuple(r) for r in df.select("_id", "sequence", "revid", "deleted").collect())
    assert same(found) == same(mvcc.winners(revs))


def test_nothing_to_follow(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(str(tmp_path / "revs"))
    assert w.winners_of_stream(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "revs"))).collect() == []


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "MERGE_PARTS", 3)
    table, want = w.WinnerTable(spark, str(tmp_path / "table")), {}
    for batch in range(7):
        rows = [(f"d{i}", batch * 10 + i, f"{batch + 1}-x", False) for i in range(batch, batch + 3)]
        table.add(spark.createDataFrame(rows, w.WINNER), batch)
        want |= {r[0]: r[1] for r in rows}
        assert {r["_id"]: r.sequence for r in table.winners().collect()} == want
    parts = table.parts()
    assert len(parts) <= 3 and parts[0][0] == 0 and parts[-1][1] == 6 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    table.add(spark.createDataFrame([("late", 1, "1-x", False)], w.WINNER), 1)  # a batch of a merged part does not come twice
    assert table.winners().where(F.col("_id") == "late").count() == 0
    last = len(table.parts())
    table.add(spark.createDataFrame(rows, w.WINNER), 6)
    assert len(table.parts()) == last and {r["_id"]: r.sequence for r in table.winners().collect()} == want


@pytest.mark.parametrize("n", [1, 4])
def test_only_changes_come_out(spark, tmp_path, n):
    rows = [(1, "a", None, "1-a", False), (2, "a", 1, "2-a", False), (3, "a", 1, "2-A", False)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query, table = w.follow(stream, str(tmp_path / f"state{n}"))
    query.awaitTermination()
    assert sum(spark.read.parquet(table._path(*p)).count() for p in table.parts()) == 1
