import pytest
from pyspark.sql import functions as F

from loomdoc.functions.tokens import Tokenizer
from loomdoc.plans.errors import ConflictError, NotFoundError, QueryError
from loomdoc.sources import attachments as att
from loomdoc.sources import events as ev
from loomdoc.sources.indexes import JSON, TEXT, Catalog, Index, MaterialisedIndex, projection
from loomdoc.sources.store import DocumentStore

from . import fixtures as fx


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"))


def test_create_read_update_delete(store, spark):
    seen = []
    store.bus.register(ev.DocumentModified, seen.append)
    a = store.create({"n": 1}, "a")
    assert a.revid.startswith("1-") and a.parent is None and store.document_count() == 1
    with pytest.raises(ConflictError):
        store.create({}, "a")
    b = store.update("a", a.revid, {"n": 2})
    assert b.revid.startswith("2-") and b.parent == a.sequence
    with pytest.raises(ConflictError):
        store.update("a", a.revid, {"n": 3})
    assert store.read("a").revid == b.revid and store.read("a", a.revid).json == '{"n": 1}'
    [gone] = store.delete("a", b.revid)
    assert gone.deleted and store.read("a").revid == gone.revid and store.document_count() == 0
    with pytest.raises(NotFoundError):
        store.delete("a", gone.revid)
    with pytest.raises(ConflictError):
        store.delete("a", a.revid)
    with pytest.raises(NotFoundError):
        store.delete("none")
    again = store.create({"n": 4}, "a")
    assert again.revid.startswith("4-") and again.parent == gone.sequence
    assert [type(x).__name__ for x in seen] == ["DocumentCreated", "DocumentUpdated", "DocumentDeleted", "DocumentCreated"]
    for bad in ({"_x": 1}, []):
        with pytest.raises(QueryError):
            store.create(bad)
    reopened = DocumentStore(spark, store.path)
    assert reopened.last_sequence == store.last_sequence and reopened.contains("a") and not reopened.contains("b")


def test_pointer_stays_on_a_deleted_winner(store):
    for suffix in "abc":
        store.create_with_history("d", {"v": suffix}, 2, [suffix, "root"])
    assert store.read("d").revid == "2-c" and [r["_id"] for r in store.conflicted_ids().collect()] == ["d"]
    [tomb] = store.delete("d", "2-c")
    child = store.create({"v": "again"}, "d")
    assert child.revid.startswith("4-") and child.parent == tomb.sequence


def test_deleting_another_leaf_leaves_the_winner(store):
    for suffix in "ab":
        store.create_with_history("d", {"v": suffix}, 2, [suffix, "root"])
    store.delete("d", "2-a")
    assert store.read("d").revid == "2-b"
    with pytest.raises(ConflictError):
        store.create({}, "d")
    store.delete("d")
    assert store.read("d").deleted


def test_many_documents_and_paging(store, spark):
    docs = spark.createDataFrame([(f"d{i}", f'{{"n": {i}}}') for i in range(20)], "_id string, json string")
    store.create_many(docs)
    with pytest.raises(ConflictError):
        store.create_many(docs.limit(1))
    assert store.last_sequence == 20 and store.document_count() == 20
    assert [r["_id"] for r in store.read_many(["d7", "x", "d3", "d7"]).collect()] == ["d7", "d3"]
    every = [r["_id"] for r in store.read_all().collect()]
    assert [r["_id"] for r in store.read_all(5, 3).collect()] == every[5:8] and [r["_id"] for r in store.read_all(descending=True, limit=2).collect()] == every[::-1][:2]
    assert len(store.ids().collect()) == 20
    for call in (lambda: store.read_all(-1), lambda: store.read_all(0, -1), lambda: store.read_many([])):
        with pytest.raises(QueryError):
            call()
    top, rows = store.changes(5, 3)
    assert top == 8 and [r.last_sequence for r in rows.collect()] == [6, 7, 8]
    assert store.changes(100, 5)[0] == 100


def test_conflict_resolution(store):
    for doc in ("x", "y"):
        for suffix in "abc":
            store.create_with_history(doc, {"v": suffix}, 1, [suffix])
    assert store.resolve_conflicts(lambda name, leaves: "1-b" if name == "x" else None) == 2
    assert store.read("x").revid == "1-b" and store.conflicted_ids().count() == 1
    assert store.resolve_with("y", lambda name, leaves: 1 / 0) is False
    assert store.resolve_with("y", lambda name, leaves: {"v": "merged"})
    assert store.read("y").json == '{"v": "merged"}' and store.read("y").revid.startswith("2-") and store.conflicted_ids().count() == 0


def test_local_documents(store):
    store.create({"a": 1}, "_local/x")
    assert store.read("_local/x").json == '{"a": 1}' and store.document_count() == 0
    store.update("_local/x", "", {"a": 2})
    assert store.read_local("x").json == '{"a": 2}'
    store.delete("_local/x")
    for call in (lambda: store.read("_local/x"), lambda: store.delete("_local/x")):
        with pytest.raises(NotFoundError):
            call()
    with pytest.raises(QueryError):
        store.read("_local/x", "1-a")


def test_attachments_and_compaction(store):
    a = store.create({"n": 1}, "a", {"one": (b"hello", "text/plain"), "two": (b"world", "text/plain")})
    store.create({"n": 1}, "b", {"same": (b"hello", "text/plain")})
    assert store.table("blobs").count() == 2
    b = store.update("a", a.revid, {"n": 2}, kept=["one"], attachments={"three": (b"!", "x")})
    assert store.attachment("a", "one") == b"hello" and store.attachment("a", "three") == b"!" and store.attachment("a", "two", a.revid) == b"world"
    with pytest.raises(NotFoundError):
        store.attachment("a", "two")
    assert {(r.filename, r.revpos) for r in store.table("attachments").where(F.col("sequence") == b.sequence).collect()} == {("one", 1), ("three", 2)}
    store.compact()
    assert store.read("a", a.revid).json is None and store.read("a").json == '{"n": 2}'
    assert store.table("blobs").count() == 2 and store.attachment("b", "same") == b"hello"
    assert all(len(x) <= 1 for x in store.manifest["parts"].values()) and store.document_count() == 2


def test_compaction_keeps_pointers_and_local_documents(store):
    for suffix in "ab":
        store.create_with_history("d", {"v": suffix}, 2, [suffix, "r"])
    store.delete("d", "2-b")
    for i in range(3):
        store.put_local("_local/x", {"i": i})
    store.put_local("_local/y", {})
    store.delete("_local/y")
    before = sorted((r["_id"], r.revid, r.deleted) for r in store.current().collect())
    store.compact()
    assert sorted((r["_id"], r.revid, r.deleted) for r in store.current().collect()) == before and store.read("d").deleted
    assert store.read_local("x").json == '{"i": 2}' and not store.contains("_local/y")
    assert store.create({"v": "again"}, "d").revid.startswith("4-")


def test_codecs(spark):
    key, vector = F.unhex(F.lit("00" * 16)), F.unhex(F.lit("01" * 16))
    df = spark.createDataFrame([(bytearray(b"some text"),), (bytearray(b""),)], "c binary")
    coded = df.withColumn("e", att.encrypted("c", key, vector)).withColumn("z", att.gzipped("c"))
    for r in coded.select("c", "e", att.decrypted("e", key).alias("d"), att.gunzipped("z").alias("g")).collect():
        assert r.c == r.d == r.g and bytes(r.e[:17]) == b"\x01" + b"\x01" * 16 and len(r.e) % 16 == 1
    with pytest.raises(Exception, match="unknown version"):
        coded.select(att.decrypted(F.concat(F.unhex(F.lit("02")), F.substring("e", 2, 1000)), key)).collect()


def test_inlining(spark):
    rows = [("a", "2-x", "old", 5, 1, 1, b"old"), ("a", "2-x", "new", 5, 2, 1, b"new"), ("b", "1-x", "big", 70_000, 1, None, b"big"), ("b", "1-x", "small", 1, 1, None, b"s")]
    df = spark.createDataFrame([(*r[:6], bytearray(r[6])) for r in rows], "_id string, revid string, filename string, length bigint, revpos int, ancestor_generation int, content binary")
    kinds = lambda mode: {r.filename: (r.kind, r.data) for r in att.inline(df, mode).collect()}
    assert kinds("small") == {"old": ("stub", None), "new": ("inline", "bmV3"), "big": ("follows", None), "small": ("follows", None)}
    assert kinds("all")["big"][0] == "inline" and kinds("none")["new"][0] == "follows"


def test_indexes(store, spark):
    index = store.create_json_index(["name", ("age", "asc")], "basic")
    assert index.fields == ("_id", "_rev", "name", "age")
    assert store.create_json_index(["age", "name"]) is index and store.create_json_index(["age", "name"], "basic") is index
    text = store.create_text_index(["comment"], "words")
    assert store.create_text_index(["comment"]) is text and text.tokenizer == Tokenizer("simple")
    for call in (
        lambda: store.create_json_index(["x"], "basic"), lambda: store.create_json_index([("x", "desc")]), lambda: store.create_json_index([]), lambda: store.create_json_index(["a", "a"]),
        lambda: store.create_json_index(["a.$b"]), lambda: store.create_json_index(["a"], ""), lambda: store.create_text_index(["name"]), lambda: store.delete_index("none"), lambda: store.delete_index(""),
    ):
        with pytest.raises(QueryError):
            call()
    assert {x.name: x.type for x in DocumentStore(spark, store.path).list_indexes()} == {"basic": JSON, "words": TEXT}
    store.delete_index("words")
    assert [x.name for x in store.list_indexes()] == ["basic"] and store.is_text_search_enabled()
    assert Index("a", ("x", "y")) == Index("a", ("y", "x")) != Index("b", ("x", "y")) and not Catalog().text()


def test_projections(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "_id string, pet array<string>")
    rows = projection(df, Index("i", ("_id", "pet"))).collect()
    assert sorted((r["_id"], r.pet or "") for r in rows) == [("a", "x"), ("a", "y"), ("b", ""), ("c", "")]


def test_find(store, spark):
    import json

    store.create_many(spark.createDataFrame([(k, json.dumps(v | {"note": f"the {v['rig']} at {v.get('berth')}"})) for k, v in fx.BOATS.items()], "_id string, json string"))
    assert fx.ids(store.find({"length": {"$gt": 9}, "berth": "south"})) == ["otter", "swift"]
    assert [r["_id"] for r in store.find({}, sort=[("length", "desc"), ("rig", "asc")], limit=2).collect()] == ["swift", "tern"]
    with pytest.raises(QueryError):
        store.find({"$text": {"$search": "south"}})
    store.create_text_index(["note"])
    assert fx.ids(store.find({"rig": "sloop", "$text": {"$search": "south OR north"}})) == ["heron", "swift"]
    with pytest.raises(QueryError):
        store.find({"rig": "sloop", "$text": {"$search": "south"}}, strict=True)
    with pytest.raises(QueryError):
        store.find({}, sort=["length"], strict=True)
    store.create_json_index(["rig", "length"])
    assert store.find({"rig": "sloop", "$text": {"$search": "south OR north"}}, sort=["length"], strict=True).count() == 2
    row = store.read("heron")
    store.delete("heron", row.revid)
    assert "heron" not in fx.ids(store.find({}))


def test_bus_and_closing(store):
    seen = []

    def fails(event):
        raise RuntimeError

    store.bus.register(ev.Event, fails)
    store.bus.register(ev.StoreEvent, seen.append)
    store.create({}, "a")
    store.close()
    store.bus.unregister(fails)
    store.delete_store()
    assert [type(x) for x in seen] == [ev.StoreClosed, ev.StoreDeleted] and not store.files.exists(store.path)


def test_the_loser_of_two_writers_keeps_nothing(store, spark):
    store.create({"n": 0}, "first")
    docs = lambda *ids: spark.createDataFrame([(x, "{}") for x in ids], "_id string, json string")
    history = lambda x: spark.createDataFrame([(x, ["1-a", "2-b"], False, "{}")], "_id string, history array<string>, deleted boolean, json string")
    actions = [lambda s, x: s.create({}, x), lambda s, x: s.create_many(docs(x)), lambda s, x: s.force_insert(history(x)), lambda s, x: s.put_local(x, {})]
    for i, act in enumerate(actions):
        loser = DocumentStore(spark, store.path)
        act(store, f"won{i}")
        with pytest.raises(ConflictError):
            act(loser, f"lost{i}")
        assert (loser.version, loser.last_sequence, loser.manifest) == (store.version, store.last_sequence, store.manifest)
        assert loser.revs.where(F.col("_id").startswith("lost")).count() == 0
        act(loser, f"again{i}")
        store.refresh()
        assert store.last_sequence == loser.last_sequence == store.revs.agg(F.max("sequence")).first()[0]
    assert sorted(r["_id"] for r in store.ids().collect()) == ["again0", "again1", "again2", "first", "won0", "won1", "won2"]
    for suffix in "ab":
        store.create_with_history("torn", {}, 1, [suffix])
    loser = DocumentStore(spark, store.path)
    store.resolve_conflicts(lambda name, leaves: "1-a")
    with pytest.raises(ConflictError):
        loser.resolve_conflicts(lambda name, leaves: "1-b")
    assert loser.read("torn").revid == "1-a" and not loser.has_conflicts("torn")


def test_encoded_and_encrypted_attachments(spark, tmp_path):
    path, key = str(tmp_path / "sealed"), bytes(range(16))
    store = DocumentStore(spark, path, key=key)
    text = b"many words " * 500
    store.create({}, "a", {"zip": (text, "text/plain", "gzip"), "raw": (text, "text/plain")})
    assert store.attachment("a", "zip") == store.attachment("a", "raw") == text
    lines = {r.filename: (r.encoding, r.length) for r in store.table("attachments").collect()}
    assert lines == {"zip": ("gzip", len(text)), "raw": ("plain", len(text))}
    assert all(b"many words" not in bytes(r.content) and bytes(r.content)[0] == 1 for r in store.table("blobs").collect())
    assert DocumentStore(spark, path, key=key).attachment("a", "zip") == text
    for wrong in (None, bytes(16)):
        with pytest.raises(QueryError):
            DocumentStore(spark, path, key=wrong)
    with pytest.raises(QueryError):
        DocumentStore(spark, str(tmp_path / "x"), key=b"short")
    with pytest.raises(QueryError):
        store.create({}, "b", {"bad": (b"", "x", "zstd")})
    from loomdoc.streaming.replication import replicate

    plain = DocumentStore(spark, str(tmp_path / "plain"))
    replicate(store, plain)
    assert plain.attachment("a", "zip") == plain.attachment("a", "raw") == text


def test_saving_what_was_read(store):
    row = store.create({"n": 1, "m": 2}, "a")
    with pytest.raises(QueryError):
        store.save(store.find({"n": 1}, fields=["n"]).first())
    again = store.save(store.find({"n": 1}).first(), {"n": 3})
    assert again.parent == row.sequence and again.json == '{"n": 3}'
    copy = store.save(again)
    assert copy.json == '{"n": 3}' and store.update("a", copy.revid, {"n": 9}, deleted=True).deleted
    assert store.read("a").deleted and store.document_count() == 0


def test_reading_by_sequences(store):
    a = store.create({"n": 1}, "a")
    b = store.create({"n": 1}, "b")
    newer = store.update("a", a.revid, {"n": 2})
    store.delete("b")
    got = lambda *x, **k: [(r["_id"], r.sequence) for r in store.read_sequences(x, **k).collect()]
    assert got(a.sequence, a.sequence, b.sequence) == [("a", newer.sequence), ("b", newer.sequence + 1)]
    assert got(b.sequence, a.sequence, deleted=False) == [("a", newer.sequence)] and got() == got(99) == []


def test_find_reads_the_index_first(store, spark):
    import json

    store.create_many(spark.createDataFrame([(k, json.dumps(v)) for k, v in (fx.CARGO | {"x" + k: v for k, v in fx.MIXED.items()} | {"d" + k: v for k, v in fx.DEPTHS.items()}).items()], "_id string, json string"))
    every = fx.CARGO | {"x" + k: v for k, v in fx.MIXED.items()} | {"d" + k: v for k, v in fx.DEPTHS.items()}
    selectors = [
        {"holds": "tea"}, {"holds": {"$gt": "salt"}}, {"holds": {"$lt": "salt"}, "rig": "sloop"}, {"v": {"$gte": 7}}, {"v": {"$lt": "a"}}, {"v": {"$in": [7, "q"]}}, {"depth": {"$gt": 7}}, {"depth": {"$lte": 0}},
        {"$or": [{"depth": 42}, {"holds": "wool"}]}, {"$or": [{"depth": 42}, {"keel": {"$exists": False}}]}, {"holds": {"$ne": "tea"}, "rig": {"$in": ["sloop", "yawl"]}}, {"v": True}, {"v": {"$in": [True]}},
    ]
    before = [fx.ids(store.find(s)) for s in selectors]
    store.create_json_index(["holds", "rig"], "cargo")
    store.create_json_index(["v", "depth"], "values")
    assert [fx.ids(store.find(s)) for s in selectors] == before == [fx.matching(every, s) for s in selectors]
    plan = store.find({"holds": {"$gt": "salt"}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(greatest_string_2,salt)" in plan and "least_string_2,IsNotNull" not in plan
    parts = store.files.names(MaterialisedIndex(store, store.indexes.indexes["cargo"]).folder)
    row = store.read("otter")
    store.update("otter", row.revid, {"holds": ["tea"]})
    store.delete("heron")
    store.create({"holds": ["tea", 4]}, "lugger")
    assert fx.ids(store.find({"holds": "tea"})) == ["lugger", "otter", "petrel", "swift"] and fx.ids(store.find({"holds": "wool"})) == ["wren"]
    assert fx.ids(store.find({"holds": 4})) == ["lugger"]
    after = store.files.names(MaterialisedIndex(store, store.indexes.indexes["cargo"]).folder)
    assert len(parts) == 1 and set(parts) < set(after)
    store.refresh_all_indexes()
    store.compact()
    assert fx.ids(store.find({"holds": "tea"})) == ["lugger", "otter", "petrel", "swift"]
    folder = MaterialisedIndex(store, store.indexes.indexes["cargo"]).folder
    store.delete_index("cargo")
    assert not store.files.exists(folder) and fx.ids(store.find({"holds": "wool"})) == ["wren"]


def test_an_indexed_find_parses_what_the_index_lets_through(spark, tmp_path):
    """No parsing on the scan of the revisions, and only the parts that hold candidates are opened."""
    store = DocumentStore(spark, str(tmp_path / "store"))
    for k in range(3):
        store.create_many(spark.createDataFrame([(f"d{k}-{i}", f'{{"n": {100 * k + i}, "rig": "{"sloop" if i % 2 else "ketch"}", "deep": {{"x": [{i}, {k}]}}}}') for i in range(10)], "_id string, json string"))
    store.create_json_index(["n"], "by n")
    found = store.find({"$and": [{"n": {"$gte": 104}}, {"n": {"$lt": 107}}, {"rig": "sloop"}]})
    assert fx.ids(found) == ["d1-5"]
    assert {x.split("/revs/")[1].split("/")[0] for x in found.inputFiles() if "/revs/" in x} == {store.manifest["parts"]["revs"][1]}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed = max(i for i, line in enumerate(plan) if "parse" in line and "son" in line)
    assert parsed < min(i for i, line in enumerate(plan) if "Join" in line)  # above every join
    assert store.find({"n": 7000}).count() == 0


def test_a_covering_index_answers_alone(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    bodies = {f"d{i}": {"n": i, "rig": None if i % 4 == 0 else ["a", "b"] if i % 4 == 1 else "c", "deep": {"x": i % 3, "y": "big"}} for i in range(12)} | {"bare": {}}
    import json

    store.create_many(spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "_id string, json string"))
    store.create_json_index(["n", "rig", "deep.x"], "cover")
    store.delete("d3")
    bodies.pop("d3")
    for selector in ({"n": {"$gt": 4}}, {"rig": "a"}, {"rig": {"$exists": False}}, {"$or": [{"deep.x": 2}, {"n": 0}]}, {}):
        found = store.find(selector, fields=["n", "rig"])
        assert not [x for x in found.inputFiles() if "/revs/" in x]
        assert fx.ids(found) == fx.matching(bodies, selector)
    got = {r["_id"]: json.loads(r.j) for r in store.find({}, fields=["n", "rig"]).select("_id", F.to_json("body").alias("j")).collect()}
    assert got == {k: {x: v[x] for x in ("n", "rig") if x in v} for k, v in bodies.items()}
    assert [r["_id"] for r in store.find({"n": {"$gt": 8}}, fields=["n"], sort=[("n", "desc")]).collect()] == ["d11", "d10", "d9"]
    assert [x for x in store.find({"n": 1}, fields=["n", "other"]).inputFiles() if "/revs/" in x]
