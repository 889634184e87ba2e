import json

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import mvcc
from loomdoc.operators.find import document_ids, find, multi_get
from loomdoc.plans.errors import QueryError
from loomdoc.sources import feeds
from loomdoc.sources.indexes import Index, MaterialisedIndex
from loomdoc.sources.store import DocumentStore


def put(path, value):
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def test_change_feeds(spark, tmp_path):
    path = put(tmp_path / "feed.json", {"last_seq": "9-x", "results": [{"seq": 1, "id": "a", "changes": [{"rev": "1-x"}, {"rev": "1-y"}]}, {"seq": "2-abc", "id": "b", "changes": [{"rev": "3-z"}], "deleted": True}, {"seq": 3, "id": "", "changes": []}]})
    feed = feeds.change_feed(spark, path)
    assert [(r.seq, r["_id"], list(r.revids), r.deleted) for r in feed.collect()] == [("1", "a", ["1-x", "1-y"], False), ("2-abc", "b", ["3-z"], True), ("3", "", [], False)]
    stored = spark.createDataFrame([(1, "a", None, "1-x", False, True, "{}")], mvcc.SCHEMA)
    assert sorted((r["_id"], list(r.missing)) for r in mvcc.revs_diff(stored, feeds.wanted(feed)).collect()) == [("a", ["1-y"]), ("b", ["3-z"])]


def test_bulk_and_open_revisions(spark, tmp_path):
    docs = [{"_id": "d", "_rev": "3-c", "_revisions": {"start": 3, "ids": ["c", "b", "a"]}, "name": 'quote" é', "age": 12, "list": [1, "x"], "z": None}, {"_id": "e", "_rev": "1-q", "_deleted": True}]
    rows = {r["_id"]: r for r in feeds.bulk_docs(spark, put(tmp_path / "bulk.json", {"docs": docs})).collect()}
    assert list(rows["d"].history) == ["1-a", "2-b", "3-c"] and json.loads(rows["d"].json) == {"name": 'quote" é', "age": 12, "list": [1, "x"], "z": None}
    assert (list(rows["e"].history), rows["e"].deleted, rows["e"].json) == (["1-q"], True, "{}")
    assert feeds.bulk_docs(spark, put(tmp_path / "one.json", docs[0])).count() == 1
    found, missing = feeds.open_revisions(spark, put(tmp_path / "open.json", [{"ok": docs[0]}, {"missing": "2-zz"}]))
    assert [r["_id"] for r in found.collect()] == ["d"] and [r.revid for r in missing.collect()] == ["2-zz"]
    store = DocumentStore(spark, str(tmp_path / "store"))
    assert store.force_insert(found) == 3 and json.loads(store.read("d").json)["age"] == 12
    with pytest.raises(Exception, match="reserved names: _strange"):
        feeds.bulk_docs(spark, put(tmp_path / "bad.json", {"_id": "x", "_rev": "1-a", "_strange": 1})).collect()


def test_materialised_indexes_follow_the_store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.create_many(spark.createDataFrame([(f"d{i}", json.dumps({"n": i, "s": "x"})) for i in range(5)], "_id string, json string"))
    view = MaterialisedIndex(store, Index("by-n", ("_id", "_rev", "n")))
    with pytest.raises(QueryError):
        view.table()
    assert view.refresh().count() == 5 and view.refresh().count() == 5
    store.update("d1", store.read("d1").revid, {"n": 100})
    store.delete("d2")
    store.create({"n": 7}, "new")
    rows = {r["_id"]: r.n for r in view.refresh().collect()}
    assert rows == {"d0": "0", "d1": "100", "d3": "3", "d4": "4", "new": "7"}
    again = MaterialisedIndex(DocumentStore(spark, store.path), Index("by-n", ("_id", "_rev", "n")))
    assert again.last_sequence == store.last_sequence and again.table().count() == 5


def test_materialised_indexes_list_the_elements_of_stored_arrays(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    bodies = {"a": {"pet": ["x", 2], "o": ["k", "l"]}, "b": {"pet": []}, "c": {"n": 1}, "d": {"pet": "y", "o": ["m", "n"]}, "e": {"pet": [["z"], None]}}
    store.create_many(spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "_id string, json string"))
    view = MaterialisedIndex(store, Index("by-pet", ("_id", "_rev", "pet", "o")))
    listed = lambda rows: sorted((r["_id"], r.pet or "", r.o or "") for r in rows)
    want = [("a", "2", '["k","l"]'), ("a", "x", '["k","l"]'), ("b", "", ""), ("c", "", ""), ("d", "y", "m"), ("d", "y", "n"), ("e", "", ""), ("e", '["z"]', "")]
    assert listed(view.refresh().collect()) == want
    store.update("c", store.read("c").revid, {"pet": ["p", "q"]})
    assert listed(view.refresh().collect()) == sorted([w for w in want if w[0] != "c"] + [("c", "p", ""), ("c", "q", "")])


def test_results_by_id(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    row = store.create({"n": 1, "m": 2}, "a")
    part = store.find({"n": 1}, fields=["n"])
    assert list(document_ids(part)) == ["a"]
    [whole] = store.full_revisions(part).select("_rev", F.to_json("body").alias("j")).collect()
    assert (whole["_rev"], json.loads(whole.j)) == (row.revid, {"n": 1, "m": 2})
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "_id string, n int")
    assert [r.n for r in multi_get(df, ["c", "x", "a", "c"]).collect()] == [3, 1] and find(df, {}).count() == 3
    with pytest.raises(QueryError):
        multi_get(df, [])
