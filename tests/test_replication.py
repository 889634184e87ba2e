import pytest
from pyspark.sql import functions as F

from loomdoc.plans.errors import QueryError
from loomdoc.sources import events as ev
from loomdoc.sources.store import DocumentStore
from loomdoc.streaming import replication as rp
from loomdoc.streaming.latest import latest_of_stream

BOATS = {"heron": ("sail", 9), "otter": ("motor", 14), "petrel": ("sail", 1), "swift": ("motor", 0.5), "tug": ("steam", 300)}


@pytest.fixture
def stores(spark, tmp_path):
    source, target = (DocumentStore(spark, str(tmp_path / x)) for x in ("source", "target"))
    docs = spark.createDataFrame([(k, f'{{"drive": "{c}", "load": {w}}}') for k, (c, w) in BOATS.items()], "_id string, json string")
    source.create_many(docs)
    return source, target


def winners(store):
    return sorted((r["_id"], r.revid, r.deleted) for r in store.current().collect())


def test_goes_on_where_it_stopped(stores):
    source, target = stores
    seen = []
    target.bus.register(ev.ReplicationCompleted, seen.append)
    run = rp.replicate(source, target)
    assert run.state == "COMPLETE" and run.documents == 5 and winners(source) == winners(target)
    assert run.checkpoint() == source.last_sequence and [x.documents for x in seen] == [5]
    row = source.read("otter")
    row = source.update("otter", row.revid, {"drive": "motor", "load": 8}, {"photo": (b"pixels", "image/x")})
    source.delete("tug", source.read("tug").revid)
    again = rp.replicate(source, target)
    assert again.id == run.id and again.documents == 2 and winners(source) == winners(target)
    assert target.attachment("otter", "photo") == b"pixels"
    assert rp.replicate(source, target).documents == 0


def test_checkpoints_name_what_was_merged(stores):
    source, target = stores
    run = rp.Replicator(source, target)
    late = source.create({"drive": "sail"}, "late").sequence
    run._merge(source.revs.where(F.col("sequence") <= 3), 0)
    assert run.checkpoint() == 3 < late and not target.contains("late")
    run._merge(source.revs.where(F.col("sequence") == 2), 1)
    assert run.checkpoint() == 3


def test_conflicts_come_over_whole(stores):
    source, target = stores
    for suffix in ("a", "b"):
        source.create_with_history("raft", {"v": suffix}, 3, [suffix, "m", "r"])
    target.create_with_history("raft", {"v": "t"}, 2, ["m", "r"])
    rp.replicate(source, target)
    assert target.read("raft").revid == "3-b" and [r["_id"] for r in target.conflicted_ids().collect()] == ["raft"]
    assert target.revs.where("_id = 'raft'").count() == 4


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({"selector": {"drive": "sail"}}, ["heron", "petrel"]),
        ({"doc_ids": ["tug", "none", "otter"]}, ["otter", "tug"]),
        ({"filter": "by_drive", "parameters": {"drive": "sail"}}, ["heron", "petrel"]),
        ({"push_filter": lambda docs: F.try_variant_get("body", "$.load", "double") < 2}, ["petrel", "swift"]),
    ],
)
def test_filters(stores, options, want):
    rp.register_filter("by_drive", lambda docs, p: F.try_variant_get("body", "$.drive", "string") == p["drive"])
    source, target = stores
    rp.replicate(source, target, **options)
    assert sorted(r["_id"] for r in target.ids().collect()) == want


def test_states_and_refusals(spark, stores, tmp_path):
    source, target = stores
    for options in ({"filter": "x", "selector": {}}, {"selector": {}, "doc_ids": []}, {"filter": "unknown"}):
        with pytest.raises(QueryError):
            rp.Replicator(source, target, **options)
    run = rp.Replicator(source, target)
    assert run.state == "PENDING" and run.start(interval="1 second").state == "STARTED" and run.start() is run
    assert run.stop().state == "STOPPED"
    empty = DocumentStore(spark, str(tmp_path / "empty"))
    assert rp.replicate(empty, target).state == "COMPLETE"
    failing = rp.Replicator(source, target, push_filter=lambda docs: F.col("no_such_column") == 1)
    failed = []
    target.bus.register(ev.ReplicationErrored, failed.append)
    with pytest.raises(Exception, match="no_such_column"):
        failing.start().wait()
    assert failing.state == "ERROR" and failed[0].replication_id == failing.id


def test_replication_ids():
    assert rp.replication_id("a", "b") == rp.replication_id("a", "b") != rp.replication_id("b", "a")
    assert rp.replication_id("a", "b", doc_ids=["y", "x"]) == rp.replication_id("a", "b", doc_ids=["x", "y"])
    assert len({rp.replication_id("a", "b", **o) for o in ({}, {"filter": "f"}, {"filter": "f", "parameters": {"x": 1}}, {"selector": {"a": 1}})}) == 4


def test_winners_of_a_stream(spark, tmp_path):
    path = str(tmp_path / "revs")
    schema = "_id string, sequence bigint, revid string, deleted boolean"
    for rows in ([("a", 1, "1-x", False), ("b", 2, "1-y", False)], [("a", 3, "2-x", True), ("a", 4, "1-z", False), ("b", 5, "2-y", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted((r["_id"], r.revid) for r in latest_of_stream(stream, str(tmp_path / "out")).collect()) == [("a", "1-z"), ("b", "2-y")]


def test_a_stream_that_dies_is_seen_without_waiting(stores):
    """On an interval, the engine's end of the stream sets the state and posts the event once; a policy starts it again."""
    source, target = stores
    failed, done, broken = [], [], [True]
    target.bus.register(ev.ReplicationErrored, failed.append)
    target.bus.register(ev.ReplicationCompleted, done.append)

    def merge(batch, number):
        if broken[0]:
            raise RuntimeError("the merge was killed")

    run = rp.Replicator(source, target)
    run._merge = merge
    run.start(interval="1 second")
    assert run._over.wait(60) and run.state == "ERROR" and "killed" in str(run.error)
    assert len(failed) == 1 and failed[0].replication_id == run.id and not done
    broken[0] = False
    policy = rp.Policy([run])
    assert policy.look() == 1 and run.state == "STARTED" and policy.look() == 0 and policy.restarts == 1
    policy.stop()
    assert run.state == "STOPPED" and len(failed) == 1 and len(done) == 1
    limited = rp.Policy([run], most=0)
    assert limited.look() == 0
