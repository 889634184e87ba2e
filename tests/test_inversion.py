"""Inverted texts: each posting once, in order, by one pass over the texts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomdoc.functions.tokens import Tokenizer
from loomdoc.sources import postings
from loomdoc.sources.store import DocumentStore

TEXTS = ["", "A", "one Two,one\ttwo\x00ONE", "éÉ Ünder　score_x 9", "   ", "\x7f-\x80z ~z"]


def batches(rows):
    return iter([pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int64()), pa.array([t for _, t in own], pa.list_(pa.string()))], ["sequence", "texts"]) for own in (rows[:7], rows[7:])])


def test_postings_of_plain_texts_are_those_of_their_tokens(spark, monkeypatch):
    monkeypatch.setattr(postings, "BATCH_TOKENS", 9)
    rng = random.Random(3)
    rows = [(s, [rng.choice([None, *TEXTS]), " ".join(rng.choices(["b", "a", "C", "é"], k=rng.randrange(9)))]) for s in rng.sample(range(100), 20)]
    cut = Tokenizer().column(F.col("t"))
    shown = {r.t: r.cut for r in spark.createDataFrame([(t,) for _, own in rows for t in own], "t string").distinct().select("t", cut.alias("cut")).collect()}
    want = {}
    for s, own in rows:
        for field, text in enumerate(own):
            for at, term in enumerate(x for x in shown[text].split(" ") if x):
                want.setdefault((term, field, s), []).append(at)
    for given, plain in ((rows, True), ([(s, [shown[t] for t in own]) for s, own in rows], False)):
        got = [[(r["term"], r["field"], r["sequence"], r["places"]) for r in b.to_pylist()] for b in postings.inverted(batches(given), plain)]
        assert len(got) > 3 and sorted(x for b in got for x in b) == sorted((*k, v) for k, v in want.items())
        assert all(b == sorted(b, key=lambda x: (x[0].encode(), *x[1:3])) for b in got)


def test_a_refresh_inverts_once(spark, tmp_path):
    """Neither the sample for the ranges nor the directory goes over the texts again, and simple tokens are not cut before they are inverted."""
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.create_many(spark.range(50).select(F.col("id").cast("string").alias("_id"), F.format_string('{"t":"word%d common"}', "id").alias("json")))
    index = postings.StoredTextIndex(store, store.create_text_index(["t"], "words"))
    runs, inverted = spark.sparkContext.accumulator(0), postings.inverted

    def counted(rows, plain=False):
        for batch in rows:
            runs.add(batch.num_rows)
            yield from inverted(iter([batch]), plain)

    postings.inverted = counted
    try:
        index.refresh()
    finally:
        postings.inverted = inverted
    assert runs.value == 50 and sum(s.postings for s in index.segments) == 250  # ids have one token, and revision ids two
    files = [f for s in index.segments for f in s.files]
    assert min(f[1] for f in files) == "0" and max(f[2] for f in files) == "word9"
