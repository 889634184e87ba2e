"""Bulk merges and resolved conflicts: what the store knows is not joined again."""

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import mvcc
from loomdoc.sources.store import DocumentStore

INCOMING = "_id string, history array<string>, deleted boolean, json string"


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"))


def pointers(df):
    return {r["_id"]: r.sequence for r in df.select("_id", "sequence").collect()}


def test_roots_are_merged_and_resolved_without_joins(spark, store, monkeypatch):
    def joined(*_):
        raise AssertionError("leaves of a store of roots are its revisions")

    monkeypatch.setattr(mvcc, "leaves", joined)
    rows = [(f"d{k}", [f"1-{x}"], x == "c", '{"x":1}') for k in range(4) for x in "abc"[: k + 1]]
    assert store.force_insert(spark.createDataFrame(rows, INCOMING)) == len(rows)
    assert store.resolve_conflicts(lambda name, leaves: {"merged": [x["revid"] for x in leaves], "none": [x["parent"] for x in leaves]}) == 6
    monkeypatch.undo()
    assert pointers(store.pointers()) == pointers(mvcc.winners(store.revs))
    assert {r["_id"]: r.json for r in store.current().where("sequence > 9").collect()} == {f"d{k}": '{"merged": ["1-a", "1-b"], "none": [null, null]}' for k in (1, 2, 3)}


def test_pointers_of_resolved_trees_are_the_winners(spark, store):
    long = [("t", ["1-a", "2-a", "3-a"], False, "{}"), ("t", ["1-a", "2-b"], False, "{}"), ("t", ["1-a", "2-c"], True, "{}"), ("u", ["1-a", "2-a"], False, "{}"), ("u", ["1-b"], False, "{}"), ("v", ["1-a"], False, "{}"), ("w", ["1-a"], False, "{}"), ("w", ["1-b"], False, "{}")]
    assert store.force_insert(spark.createDataFrame(long, INCOMING)) == 11
    choice = {"t": "2-b", "u": ("1-b", {"n": 1}), "w": None}
    assert store.resolve_conflicts(lambda name, leaves: choice[name]) == 3
    assert pointers(store.pointers()) == pointers(mvcc.winners(store.revs))
    assert [r["_id"] for r in store.conflicted_ids().collect()] == ["w"]
    assert {r["_id"]: r.revid.partition("-")[0] for r in store.current().collect()} == {"t": "2", "u": "2", "v": "1", "w": "1"}


def test_joins_with_an_empty_table_are_dropped(spark, store):
    docs = spark.range(3).select(F.col("id").cast("string").alias("_id"))
    assert "Join" not in docs.join(store.revs, "_id", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
