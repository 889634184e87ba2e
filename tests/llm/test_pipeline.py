import corpus_pipeline
from loomdoc.llm import toxicity

from . import test_decontaminate, test_line_dedup, test_mixing, test_neardup
from .conftest import SCHEMA, make_rows, same
from .test_classifiers import labelled_rows


def tables(spark, folder):
    plain, labels = labelled_rows(160, seed=8)
    rows = [(r[0] + 10_000 if r[0] is not None else None, *r[1:]) for r in make_rows(n=70)] + plain
    rows += [(20_000 + i, rows[5 + i][1] + " tail", "en", "src2", 0) for i in range(10)]
    clean = [d[1] for d, x in zip(plain, labels, strict=True) if not x[2]]
    bench = [(i, text) for i, text in enumerate(clean[:6])] + [(90, "never seen " * 20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bench


def test_each_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    bench = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([tuple(r) for r in docs.collect()])
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    inputs.append([tuple(r) for r in docs.collect()])
    read = spark.read.parquet

    scores = toxicity.digest(read(f"{folder}/documents.parquet"), read(f"{folder}/labels.parquet")).collect()
    rejected = {r.doc_id for r in scores if r.predicted}
    same(inputs[1], [r for r in inputs[0] if r[0] not in rejected])
    assert rejected

    lines = {}
    for r, w in zip(inputs[1], test_line_dedup.brute_force(inputs[1]), strict=True):
        lines.setdefault(r[0], set()).add(w[2])
    assert len(inputs[2]) == len(inputs[1]) and sum(map(sum, lines.values())) > 5
    dropped = sum((r[1] or "").count("\n") for r in inputs[1]) - sum((r[1] or "").count("\n") for r in inputs[2])
    assert dropped >= sum(w[2] for w in test_line_dedup.brute_force(inputs[1])) - len(inputs[1]) and dropped > 5

    groups = test_neardup.brute_force(inputs[2], 5, 80)
    same(inputs[3], [r for r, w in zip(inputs[2], groups, strict=True) if w[3]])
    verdicts = test_decontaminate.brute_force([r[:2] for r in inputs[3]], bench)
    same(inputs[4], [r for r, w in zip(inputs[3], verdicts, strict=True) if not w[5]])
    assert len(inputs[4]) < len(inputs[3]) < len(inputs[2]) < len(inputs[0])

    sizes = test_mixing.sizes_of(inputs[4])
    want = test_mixing.plain_targets(sizes)
    taken = {}
    for r in docs.collect():
        assert 0 < r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken.get(s, 0) - t) <= 130 for s, t in want.items())
    same([r[:5] for r in inputs[5]], [r[:5] for r in inputs[4] if r[0] in {x[0] for x in inputs[5]}])


def test_run_gives_the_same(spark, tmp_path):
    tables(spark, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() > 50 and found.where("taken is null or text is null").count() == 0
