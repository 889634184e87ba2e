"""Every operator that keeps the columns of its input, on inputs whose columns have the names that operators use."""

import pytest

import corpus_pipeline
from loomdoc.llm import avi, decontaminate, line_dedup, mixing, neardup, quality, secrets_scan, shared, substring_dedup, toxicity

NAMES = [
    "_h1", "_H2", "_k1", "_K2", "_lost", "_id", "_n", "_source", "_hash", "_starts", "_spans", "_copy", "_of", "_windows", "Spans", "ITEMS", "N_Words", "n_removed", "Kept", "N_Lines", "n_dropped", "gone", "Size", "taken",
    "TARGET", "source_size", "n_shards", "Score", "media", "node", "root", "band", "h1", "h2", "other_0", "other_7", "meta_0", "label", "population", "start", "block", "doc_id_", "text_", "_low", "_row",
]


@pytest.fixture(scope="module")
def wide(docs):
    return docs.selectExpr("*", *[f"{i} AS `{x}`" for i, x in enumerate(NAMES)])


def tables(spark, rows):
    labels = spark.createDataFrame([(r[0], i % 2, int(i % 7 == 0)) for i, r in enumerate(rows) if r[0] is not None], "doc_id bigint, quality int, toxic int")
    return labels, spark.createDataFrame([(1, rows[7][1]), (None, rows[8][1])], "item_id bigint, text string")


KEEP = {
    "neardup": (lambda d, labels, bench: neardup.keep_one(d), []),
    "substring": (lambda d, labels, bench: substring_dedup.dedup(d), ["n_words", "n_removed", "kept"]),
    "quality": (lambda d, labels, bench: quality.keep_good(d, labels), []),
    "quality scores": (lambda d, labels, bench: quality.scored(d, quality.train(d, labels)), ["score"]),
    "mixing": (lambda d, labels, bench: mixing.taken_documents(d), ["size", "source_size", "target", "taken", "n_shards"]),
    "media": (lambda d, labels, bench: avi.with_media(d), ["media"]),
    "lines": (lambda d, labels, bench: line_dedup.dedup(d, least_docs=2), ["n_lines", "n_dropped"]),
    "lines by shard": (lambda d, labels, bench: line_dedup.dedup(d, least_docs=2, shard_keys=3, direct_shards=0), ["n_lines", "n_dropped"]),
    "scan": (lambda d, labels, bench: decontaminate.scan(d, bench), ["n_words", "spans", "items"]),
    "scan joined": (lambda d, labels, bench: decontaminate.scan(d, bench, broadcast_windows=1), ["n_words", "spans", "items"]),
    "contaminated": (lambda d, labels, bench: decontaminate.remove_documents(d, bench), []),
    "contaminated spans": (lambda d, labels, bench: decontaminate.remove_spans(d, bench), []),
    "toxicity": (lambda d, labels, bench: toxicity.drop_toxic(d, labels), []),
    "secrets": (lambda d, labels, bench: secrets_scan.redact(d), []),
}


@pytest.mark.parametrize("name", KEEP)
def test_columns_and_their_values_stay(spark, wide, rows, name):
    call, added = KEEP[name]
    found = call(wide, *tables(spark, rows))
    assert found.columns == [*wide.columns, *shared.unused(wide.columns, *added)]
    kept = found.toDF(*[f"c{i}" for i in range(len(found.columns))]).collect()
    first = len(wide.columns) - len(NAMES)
    assert kept and all(tuple(r)[first : first + len(NAMES)] == tuple(range(len(NAMES))) for r in kept)
    assert {r.c0 for r in kept} <= {r[0] for r in rows}


def test_stages_keep_them_too(spark, wide, rows, tmp_path):
    labels, bench = tables(spark, rows)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = wide
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns[: len(wide.columns)] == wide.columns, name
    assert docs.columns[len(wide.columns) :] == shared.unused(wide.columns, "size", "source_size", "target", "taken", "n_shards")


def test_unused_names():
    assert shared.unused(["A", "b_"], "a", "b", "B", "c") == ["a_", "b", "B__", "c"]
    with pytest.raises(ValueError, match="no column"):
        shared.plain(type("T", (), {"columns": ["x"]})(), "text")
