"""The stored text index against SQLite's full-text tables, its segments and what a search reads; NEAR by places."""

import random

import pytest
from pyspark.sql import functions as F

from loomdoc.functions.tokens import Tokenizer
from loomdoc.operators.text import search
from loomdoc.sources import postings
from loomdoc.sources.postings import StoredTextIndex
from loomdoc.sources.store import DocumentStore

from . import fixtures as fx
from .test_text import SEARCHES


def as_json(v):
    import json

    return json.dumps({"rig": v[0], "length": v[1], "berth": v[2], "log": v[3]})


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = DocumentStore(spark, str(tmp_path_factory.mktemp("postings") / "store"))
    made.create_many(spark.createDataFrame([(k, as_json(v)) for k, v in fx.LOGS.items()], "_id string, json string"))
    made.create_text_index(["log", "rig", "length", "berth"], "words")
    made.refresh_all_indexes()
    return made


def rows():
    return [{"_id": k, "log": v[3], "rig": v[0], "length": v[1], "berth": v[2]} for k, v in fx.LOGS.items()]


@pytest.mark.parametrize("text", [*SEARCHES[::3], "rig:sloop log:the yard", "sloop dawn", "berth:north OR length:30", "quay NEAR/60 the", "..."])
def test_searches(store, text):
    columns = ["_id", "log", "rig", "length", "berth"]
    want = [] if text == "..." else fx.found_by_fts(rows(), columns, text)
    view = StoredTextIndex(store, store.indexes.text())
    found = view.matches(text).join(store.documents(), "sequence")
    assert fx.ids(found) == want


def test_find_reads_postings(store):
    """Alone, beside other conditions, and as one of two ways to match."""
    lamp = fx.found_by_fts(rows(), ["_id", "log", "rig", "length", "berth"], "lamp")
    assert fx.ids(store.find({"$text": {"$search": "lamp"}})) == lamp
    sloops = [k for k, v in fx.LOGS.items() if v[0] == "sloop"]
    assert fx.ids(store.find({"$text": {"$search": "lamp"}, "rig": "sloop"})) == sorted(set(lamp) & set(sloops))
    either = store.find({"$or": [{"$text": {"$search": "lamp"}}, {"rig": "sloop"}]})
    assert fx.ids(either) == sorted({*lamp, *sloops}) and either.columns == ["_id", "_rev", "sequence", "body"]


def test_updates_segments_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "MERGE_SEGMENTS", 3)
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.create_text_index(["log"], "words", Tokenizer("porter"))
    words, live, draw = ["anchor", "anchors", "mast", "sail", "sailing"], {}, random.Random(3)
    for i in range(5):
        name = f"d{i % 4}"
        log = " ".join(draw.choice(words) for _ in range(4))
        row = store.update(name, store.read(name).revid, {"log": log}) if name in live else store.create({"log": log}, name)
        live[name] = log
        if i == 4:
            store.delete("d1", store.read("d1").revid)
            del live["d1"]
        view = StoredTextIndex(store, store.indexes.text())
        view.refresh()
        assert view.last_sequence == store.last_sequence and len(view.segments) <= 3 and row is not None
    want = sorted(k for k, v in live.items() if "anchor" in v)
    assert fx.ids(store.find({"$text": {"$search": "anchoring"}})) == want
    names = store.files.names(view.folder)
    view.merge(all_of_them=True)
    assert len(view.segments) == 1 and len(store.files.names(view.folder)) == len(names) + (len(view.segments) < len(names) and names[-1:] != [view.segments[0].name])
    store.compact()
    assert store.files.names(view.folder) == [view.segments[0].name]
    assert fx.ids(store.find({"$text": {"$search": "anchoring"}})) == want
    store.delete_index("words")
    assert not store.files.exists(view.folder)


def test_a_search_opens_few_files(spark, tmp_path):
    """Files are chosen by the words, revisions by their parts, and nothing is parsed on the way."""
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.create_text_index(["log"], "words")
    for k in range(3):
        docs = [(f"d{k}-{i}", f'{{"log": "common word{k}x{i} {"rare" if k == 1 and i == 7 else ""}"}}') for i in range(40)]
        store.create_many(spark.createDataFrame(docs, "_id string, json string"))
        store.refresh_all_indexes()
    view = StoredTextIndex(store, store.indexes.text())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    view.merge(all_of_them=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = len(view.segments[0].files)
    assert every > 2 and len(view.files({("rare", False)})) == 1 and len(view.files({("word1x", True)})) < every
    rows = view.postings({("rare", False)})
    assert len(rows.inputFiles()) == 1
    plan = view.matches("rare")._jdf.queryExecution().toString()
    assert "places" not in plan.split("ReadSchema")[-1] and "PushedFilters" in plan
    assert "places" in view.matches('"rare word1x7"')._jdf.queryExecution().toString().split("ReadSchema")[-1]
    found = store.find({"$text": {"$search": "rare"}})
    assert fx.ids(found) == ["d1-7"]
    assert {x.split("/revs/")[1].split("/")[0] for x in found.inputFiles() if "/revs/" in x} == {store.manifest["parts"]["revs"][1]}


def test_a_refresh_goes_on_where_the_last_one_ended(store):
    view = StoredTextIndex(store, store.indexes.text())
    before = store.files.names(view.folder)
    view.refresh()
    assert store.files.names(view.folder) == before


def test_near_over_long_distances(spark):
    """No recursion: a distance of 20000 words in texts as long, on raw texts, on tokens and with phrases."""
    between = " ".join(f"w{i % 97}" for i in range(20000))
    docs = spark.createDataFrame([("a", f"alpha {between} omega"), ("b", f"omega one {between} alpha"), ("c", "alpha omega"), ("d", f"alpha {between} w1 w2 omega"), ("e", None)], "_id string, log string")
    for tokenizer in (None, Tokenizer("porter")):
        assert fx.ids(search(docs, "alpha NEAR/20000 omega", ["log"], tokenizer)) == ["a", "c"]
        assert fx.ids(search(docs, "alpha NEAR/20001 omega", ["log"], tokenizer)) == ["a", "b", "c"]
        assert fx.ids(search(docs, '"w1 w2 omega" NEAR/20000 alpha', ["log"], tokenizer)) == ["d"]


def test_near_against_sqlite(spark):
    draw = random.Random(9)
    made = [{"_id": f"d{i}", "log": " ".join(draw.choice("abcd") for _ in range(draw.randint(1, 140)))} for i in range(60)]
    docs = spark.createDataFrame([(r["_id"], r["log"]) for r in made], "_id string, log string")
    for text in ("a NEAR/41 b", '"a b c" NEAR/50 "d d"', "a* NEAR/45 d", '"d c b a" NEAR/60 "a b c d"'):
        assert fx.ids(search(docs, text, ["log"])) == fx.found_by_fts(made, ["_id", "log"], text)


def test_documents_of_sequences(store):
    wanted = store.revs.where(F.col("_id").isin("heron", "wren")).select("sequence")
    assert fx.ids(store.documents_of(wanted)) == ["heron", "wren"]
    assert store.documents_of(wanted.limit(0)).collect() == []
