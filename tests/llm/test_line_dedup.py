import hashlib
import re

import duckdb
import numpy as np
import pytest

from loomdoc.llm import line_dedup, queries

from .conftest import same


def brute_force(rows, least_chars=40, least_docs=5):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    held = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(("null", i) if doc_id is None else doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            docs = held.get(key(line), ())
            ids = [x for x in docs if isinstance(x, int)]
            if not (len(docs) >= least_docs and doc_id != (max(ids) if ids else None)):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_digest_equals_brute_force(docs, rows):
    want = brute_force(rows)
    assert sum(w[2] for w in want) > 10
    same([tuple(r) for r in line_dedup.digest(docs).collect()], want)


def test_sql_equals_brute_force(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    same(db.execute(queries.oracle_sql()["op7_line_dedup"]).fetchall(), brute_force(rows))


@pytest.mark.parametrize("direct_shards", [1000, 0])
def test_many_shards_and_clashing_columns(docs, rows, direct_shards):
    clashing = docs.selectExpr("*", "7 as N_Lines", "source as high", "1 as _k1", "2 as gone")
    got = line_dedup.dedup(clashing, least_chars=5, least_docs=2, shard_keys=3, direct_shards=direct_shards)
    assert got.columns == [*clashing.columns, "n_lines_", "n_dropped"]
    same([(r.doc_id, r.n_lines_, r.n_dropped) for r in got.collect()], [w[:3] for w in brute_force(rows, 5, 2)])
    texts = {(r.doc_id, r.text) for r in line_dedup.dedup(docs, least_chars=5, least_docs=2, shard_keys=3).collect()}
    assert {(r.doc_id, r.text) for r in got.collect()} == texts and {r.N_Lines for r in got.collect()} == {7}


def test_a_missing_shard_is_an_error(spark, docs, tmp_path):
    path, n = line_dedup.build(line_dedup.repeated_lines(docs, 5, 2), 3)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert sorted(int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(files)) == list(range(n))
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/0.mph"), False)
    with pytest.raises(FileNotFoundError):
        line_dedup.probing(path, n)(np.array([0], np.uint64), np.array([0], np.uint64))


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        line_dedup.digest(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_null_texts_stay_null(docs):
    assert line_dedup.dedup(docs).where("text is null").count() == docs.where("text is null").count()


def test_perfect_hash_is_minimal_and_probes_are_exact():
    draw = np.random.default_rng(1)
    high, low = (np.unique(draw.integers(0, 2**64, 50_000, dtype=np.uint64)) for _ in range(2))
    n = min(len(high), len(low))
    high, low = high[:n], draw.permutation(low[:n])
    shard = line_dedup.Shard.from_bytes(line_dedup.Shard(high, low, np.arange(n) + 1, np.arange(n)).to_bytes())
    assert sorted(shard.hash(high)) == list(range(n))
    docs, last = shard.probe(high, low)
    assert (docs == np.arange(n) + 1).all() and (last == np.arange(n)).all()
    assert not shard.probe(high + np.uint64(1), low)[0].any()


def test_empty_table(empty):
    assert line_dedup.digest(empty).count() == 0


def test_counts_beyond_32_bits():
    """A line of 2**32 and more documents is as repeated as one of fewer."""
    import numpy as np

    keys = np.arange(5, dtype=np.uint64)
    docs = np.array([1, 5, 2**32 - 1, 2**32 + 2, 2**40], dtype=np.int64)
    shard = line_dedup.Shard.from_bytes(line_dedup.Shard(keys, keys, docs, keys.view(np.int64)).to_bytes())
    found, last = shard.probe(keys, keys)
    assert found.tolist() == [1, 5, 2**32 - 1, 2**32 - 1, 2**32 - 1] and last.tolist() == list(range(5))
    assert (found >= 5).tolist() == [False, True, True, True, True]
