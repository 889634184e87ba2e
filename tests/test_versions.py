"""Versions of a store: the log of changes, point reads from few files, compaction that frees space, merged bodies."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from loomdoc.plans.errors import NotFoundError
from loomdoc.sources import events as ev
from loomdoc.sources import store as stores
from loomdoc.sources.store import DocumentStore


def on_disk(spark, store, table="revs"):
    """Everything that any file of a table holds."""
    files = glob.glob(f"{store.path}/{table}/**/*.parquet", recursive=True)
    return spark.read.schema(stores.SCHEMAS[table]).parquet(*files).collect() if files else []


def test_compaction_and_expiry_free_space(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    a = store.create({"v": "first body"}, "a", {"blob": (b"gone", "x")})
    store.update("a", a.revid, {"v": "second body"}, kept=[])
    b = store.create({"v": "other"}, "b", {"blob": (b"stays", "x")})
    reader = DocumentStore(spark, store.path)
    lease, before = reader.hold(), sorted(r.revid for r in reader.revs.collect())
    store.compact()
    store.expire()
    assert "first body" in str(on_disk(spark, store)) and reader.read("a", a.revid).json == '{"v": "first body"}'
    assert sorted(r.revid for r in reader.revs.collect()) == before and reader.attachment("a", "blob", a.revid) == b"gone"
    reader.release(lease)
    assert store.expire() > 0
    assert "first body" not in str(on_disk(spark, store)) and "second body" in str(on_disk(spark, store)) and [bytes(r.content) for r in on_disk(spark, store, "blobs")] == [b"stays"]
    assert len(store.files.names(f"{store.path}/manifest")) == 1 and store.expire() == 0
    again = DocumentStore(spark, store.path)
    assert again.read("a").json == '{"v": "second body"}' and again.attachment("b", "blob") == b"stays" and again.read("b").revid == b.revid
    assert again.create({}, "c").sequence == store.last_sequence + 1


def test_leases_run_out_and_begun_parts_stay(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.create({"v": 1}, "a")
    store.hold(seconds=-1)
    begun = f"{store.path}/revs/part-{store.version + 1:012d}-deadbeef"
    store.revs.write.parquet(begun)  # another writer's next version
    lost = f"{store.path}/revs/part-{store.version:012d}-deadbeef"
    store.revs.write.parquet(lost)  # of a writer that came second
    assert store.expire() == 1 and store.files.exists(begun) and not store.files.exists(lost) and store.files.names(f"{store.path}/leases") == []
    assert store.read("a").json == '{"v": 1}'


def test_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "CHECKPOINT", 3)
    store = DocumentStore(spark, str(tmp_path / "store"))
    for i in range(7):
        store.put_local(f"x{i}", {"i": i})
        fresh = DocumentStore(spark, store.path)
        assert (fresh.version, fresh.manifest) == (store.version, store.manifest)
    lines = [json.loads(store.files.read(f"{store.path}/manifest/{v:012d}.json")) for v in store._versions()]
    assert ["whole" in x for x in lines] == [False, False, True, False, False, True, False] and all(len(x["added"]["local"]) == 1 for x in lines if "added" in x)
    lease = store.hold()
    store.put_local("x8", {})
    store.expire()
    assert store._versions() == [6, 7, 8] and store._manifest(7)["parts"]["local"] == store.manifest["parts"]["local"][:-1]
    store.release(lease)


def test_point_reads_open_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BUCKET_ROWS", 10)
    store = DocumentStore(spark, str(tmp_path / "store"))
    for k in range(3):
        store.create_many(spark.createDataFrame([(f"{'abc'[k]}{i}", f'{{"i": {i}}}') for i in range(20)], "_id string, json string"))
    row = store.create({"i": "one"}, "single")
    assert len(store._of_id("revs", "single").inputFiles()) == 1
    parts = {x.split("/revs/")[1].split("/")[0] for x in store._of_id("revs", "b7").inputFiles()}
    assert parts == {store.manifest["parts"]["revs"][1]}
    store.compact()
    buckets = store._facts(store.manifest["parts"]["revs"][0])["buckets"]
    assert buckets == 7 and len(store.revs.inputFiles()) > 4
    assert len(store._of_id("revs", "b7").inputFiles()) == 1 == len(store._of_id("current", "b7").inputFiles())
    assert json.loads(store.read("b7").json) == {"i": 7} and store.read("single") == row and store.contains("a0") and not store.contains("zz") and not store.contains("b777")
    with pytest.raises(NotFoundError):
        store.read("b70")
    assert store.update("b7", store.read("b7").revid, {"i": 8}).revid.startswith("2-") and store.document_count() == 61

    assert len(store.find({"i": 8}).inputFiles()) > 1 and sorted(r["_id"] for r in store.find({"i": 8}).collect()) == ["a8", "b7", "b8", "c8"]


def test_merged_bodies_of_many_conflicts(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    histories = [(d, [f"1-{s}"], False, json.dumps({"v": s})) for d in ("w", "x", "y", "z") for s in "abc"] + [("calm", ["1-a"], False, "{}")]
    store.force_insert(spark.createDataFrame(histories, "_id string, history array<string>, deleted boolean, json string"))
    kept = store.read("x").sequence
    store.commit({"attachments": [(kept, "note", "key", "text/plain", "plain", 3, 1)], "blobs": [("key", bytearray(b"abc"))]})

    def merge(name, leaves):
        bodies = sorted(json.loads(x["json"])["v"] for x in leaves)
        return {"x": {"all": bodies}, "y": ("1-a", {"all": bodies}), "z": {"_bad": 1}, "w": "1-b"}[name]

    version = store.version
    assert store.resolve_conflicts(merge) == 3 + 3 + 2 and store.version == version + 1
    x, y = store.read("x"), store.read("y")
    assert json.loads(x.json) == json.loads(y.json) == {"all": ["a", "b", "c"]} and x.revid.startswith("2-") and x.parent == kept
    assert store.revs.where(F.col("sequence") == y.parent).first().revid == "1-a"
    assert store.attachment("x", "note") == b"abc" and store.read("w").revid == "1-b"
    assert [r["_id"] for r in store.conflicted_ids().collect()] == ["z"]
    seen = []
    store.bus.register(ev.DocumentUpdated, seen.append)
    assert store.resolve_with("z", lambda name, leaves: {"v": len(leaves)}) and store.read("z").json == '{"v": 3}' and len(seen) == 1
    assert store.conflicted_ids().count() == 0
