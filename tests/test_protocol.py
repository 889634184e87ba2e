import json

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import mvcc
from loomdoc.sources import feeds, folders, protocol
from loomdoc.sources.store import DocumentStore


@pytest.fixture
def store(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    for suffix in "ab":
        store.create_with_history("torn", {"v": suffix, "q": 'say "é"'}, 2, [suffix, "r"])
    store.create({}, "bare")
    store.create({"n": 1}, "gone")
    store.delete("gone")
    return store


def all_histories(store):
    chosen = mvcc.leaves(store.revs)
    return mvcc.paths(store.revs).join(chosen.select("sequence", "deleted", "json"), "sequence").select("_id", F.reverse("path").alias("history"), "deleted", "json")


def test_bulk_requests_make_the_same_store(spark, store, tmp_path):
    requests = protocol.bulk_requests(all_histories(store), size=2)
    texts = [r.value for r in requests.collect()]
    assert sum(len(json.loads(x)["docs"]) for x in texts) == 4 and all(not json.loads(x)["new_edits"] and len(json.loads(x)["docs"]) <= 2 for x in texts)
    requests.write.text(str(tmp_path / "bulk"))
    found = None
    for i, text in enumerate(texts):
        (tmp_path / f"request-{i}.json").write_text(text)
        rows = feeds.bulk_docs(spark, str(tmp_path / f"request-{i}.json"))
        found = rows if found is None else found.unionByName(rows)
    copy = DocumentStore(spark, str(tmp_path / "copy"))
    copy.force_insert(found)
    shape = lambda s: sorted((r["_id"], r.revid, r.deleted) for r in mvcc.leaves(s.revs).collect())
    assert shape(copy) == shape(store) and json.loads(copy.read("torn").json) == json.loads(store.read("torn").json)


def test_change_pages_and_their_source(spark, store, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    since, n = 0, 0
    while True:
        page = protocol.change_page(store.revs, since, 2).first().value
        if json.loads(page)["last_seq"] == since and since >= store.last_sequence:
            break
        (pages / f"page-{n}.json").write_text(page)
        since, n = max(json.loads(page)["last_seq"], since + 2), n + 1
    protocol.register(spark)
    rows = spark.read.format("loomdoc_changes").load(str(pages)).collect()
    latest = {r["_id"]: (list(r.revids), r.deleted) for r in rows}
    assert latest["torn"] == (["2-b", "2-a"], False) and latest["gone"][1] and set(latest) == {"torn", "bare", "gone"}
    assert spark.read.format("loomdoc_changes").option("since", rows[1].seq).load(str(pages)).count() == len(rows) - 2
    assert spark.read.format("loomdoc_changes").option("limit", 1).load(str(pages)).count() == 1
    empty = spark.createDataFrame([], mvcc.SCHEMA)
    assert {r["_id"] for r in mvcc.revs_diff(empty, feeds.wanted(spark.read.format("loomdoc_changes").load(str(pages)))).collect()} == {"torn", "bare", "gone"}


def test_the_source_streams_by_sequence(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    put = lambda name, *seqs: (pages / name).write_text(json.dumps({"results": [{"seq": s, "id": f"d{s}", "changes": [{"rev": "1-x"}]} for s in seqs], "last_seq": seqs[-1]}))
    protocol.register(spark)

    def run():
        stream = spark.readStream.format("loomdoc_changes").option("since", 1).load(str(pages))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("a.json", 1, "2-q", 3)
    assert run() == ["2-q", "3"]
    put("b.json", 3, 4)
    assert run() == ["2-q", "3", "4"]


def test_diff_requests(spark, store):
    wanted = spark.createDataFrame([("torn", "2-a"), ("torn", "3-z"), ("torn", "3-y"), ("new", "1-n")], "_id string, revid string")
    requests = protocol.diff_requests(wanted)
    assert json.loads(requests.where("value like '%torn%'").first().value)["torn"] == ["2-a", "3-y", "3-z"]
    rows = {r["_id"]: (list(r.missing), r.possible_ancestors and list(r.possible_ancestors)) for r in protocol.diff_response(store.revs, requests).collect()}
    assert rows == {"torn": (["3-y", "3-z"], ["1-r", "2-a", "2-b"]), "new": (["1-n"], None)}
    assert json.loads(protocol.checkpoint_document("abc", 7)) == {"_id": "_local/abc", "lastSequence": 7}


def test_written_tables_can_be_discarded(spark):
    table = folders.written(spark.range(3), "some")
    assert table.count() == 3
    folders.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|doesn't exist|FILE_NOT_EXIST"):
        spark.read.parquet(table._written_at)
