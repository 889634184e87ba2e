"""Rounds between stores through a folder, cut off and begun again; revisions fetched from the buckets that hold them."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import mvcc
from loomdoc.sources import exchange, fetch
from loomdoc.sources.store import DocumentStore
from loomdoc.streaming import rounds


@pytest.fixture
def store(spark, tmp_path):
    made = DocumentStore(spark, str(tmp_path / "near"))
    made.force_insert(spark.createDataFrame([(f"d{i}", ["1-a"], False, json.dumps({"i": i})) for i in range(12)] + [("torn", ["1-r", f"2-{s}"], s == "c", json.dumps({"v": s})) for s in "abc"], "_id string, history array<string>, deleted boolean, json string"))
    made.create({"n": 1}, "held", {"note": (b"hello \x00 world", "text/plain"), "zip": (b"many words " * 50, "text/plain", "gzip")})
    made.delete("d3")
    return made


def shape(store):
    return sorted((r["_id"], r.revid, r.deleted, json.dumps(json.loads(r.json or "{}"), sort_keys=True)) for r in mvcc.leaves(store.revs).collect())


def test_push_through_files(spark, store, tmp_path, monkeypatch):
    remote, other = str(tmp_path / "remote"), DocumentStore(spark, str(tmp_path / "far"))
    push = rounds.Rounds(store, remote)
    assert push.push(limit=6, most=1) > 0 and push.checkpoint("push") == 6
    first = shape(other)
    assert rounds.receive(other, remote) > 0 and shape(other) != first
    again = rounds.Rounds(DocumentStore(spark, store.path), remote)
    real = again._record
    monkeypatch.setattr(again, "_record", lambda *x: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        again.push_round(limit=6)  # its requests are there, its checkpoint is not
    monkeypatch.setattr(again, "_record", real)
    assert again.push_round(limit=6) == 0  # the same window: nothing is lacking any more
    again.push(limit=6)
    rounds.receive(other, remote)
    assert shape(other) == shape(store) and again.checkpoint("push") == store.last_sequence
    assert other.attachment("held", "note") == b"hello \x00 world" and other.attachment("held", "zip") == b"many words " * 50
    before = other.last_sequence
    assert rounds.receive(other, remote) == 0 and again.push() == 0 and other.last_sequence == before
    docs = [d for r in spark.read.format("loomdoc_requests").load(f"{remote}/requests").collect() for d in json.loads(r.value)["docs"]]
    assert len(docs) == len({(d["_id"], d["_rev"]) for d in docs})


def test_pull_by_pages(spark, store, tmp_path):
    remote, other = str(tmp_path / "remote"), DocumentStore(spark, str(tmp_path / "far"))
    rounds.serve(store, remote, results=3)
    pull = rounds.Rounds(other, remote)
    assert pull.pull_round(limit=4) > 0
    seen = pull.checkpoint("pull")
    assert 0 < seen < store.last_sequence
    assert rounds.Rounds(DocumentStore(spark, other.path), remote).pull(limit=5) > 0
    other.refresh()
    assert shape(other) == shape(store) and pull.checkpoint("pull") > seen and pull.pull() == 0
    few = DocumentStore(spark, str(tmp_path / "few"))
    rounds.Rounds(few, remote, doc_ids=["torn", "d1"]).pull()
    assert {r["_id"] for r in few.revs.collect()} == {"torn", "d1"}


def test_fetch_opens_what_holds_it(spark, store, tmp_path):
    path = str(tmp_path / "revisions")
    found = rounds.histories(store)
    assert fetch.publish(found, path, buckets=5) == 5
    wanted = spark.createDataFrame([("torn", ["2-a", "2-c", "9-z"]), ("d1", ["1-a"]), ("nobody", ["1-a"]), (None, ["1-a"])], "_id string, missing array<string>")
    rows = fetch.fetch(spark, path, wanted)
    assert sorted((r["_id"], r.revid, list(r.history), r.deleted) for r in rows.collect()) == [("d1", "1-a", ["1-a"], False), ("torn", "2-a", ["1-r", "2-a"], False), ("torn", "2-c", ["1-r", "2-c"], True)]
    hit = spark.createDataFrame([("torn",), ("d1",)], "_id string").select(fetch._bucket(5).alias("b")).distinct()
    kept = {r.b for r in hit.collect()}
    for folder in glob.glob(f"{path}/of-5/bucket=*"):
        if int(folder.rpartition("=")[2]) not in kept:
            for x in glob.glob(f"{folder}/*"):
                os.remove(x)  # buckets that nobody asks for are not opened
    assert fetch.fetch(spark, path, wanted.where("_id in ('torn', 'd1')")).count() == 3
    with pytest.raises(FileNotFoundError):
        fetch.layout(spark, str(tmp_path / "none"))


def test_attempts(monkeypatch):
    monkeypatch.setattr(fetch.time, "sleep", lambda _: None)
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "there"

    assert fetch._attempts(flaky) == "there" and len(tries) == 3
    with pytest.raises(OSError):
        fetch._attempts(lambda: (_ for _ in ()).throw(OSError("gone for good")))


def test_diff_asks_for_what_is_lacking(spark, store, tmp_path):
    path = str(tmp_path / "revisions")
    fetch.publish(rounds.histories(store), path)
    have = store.revs.where(F.col("_id") != "torn")
    asked = rounds.histories(store).select("_id", F.element_at("history", -1).alias("revid"))
    got = fetch.fetch(spark, path, mvcc.revs_diff(have, asked))
    assert sorted(r.revid for r in got.collect()) == ["2-a", "2-b", "2-c"] and exchange.committed(str(tmp_path / "no requests")) == []
