import hashlib
import re

import pytest

from loomdoc.llm import decontaminate

from .conftest import same


def brute_force(docs, benchmark, window=13):
    """digest() of small lists (id, text), word by word."""
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for doc_id, text in docs:
        have, covered, items = split(text), set(), []
        for item_id, item in benchmark:
            want, hit = split(item), False
            for i in range(max(1, len(want) - window + 1) if want else 0):
                part = want[i : i + window]
                for j in range(len(have) - len(part) + 1):
                    if have[j : j + len(part)] == part:
                        covered.update(range(j, j + len(part)))
                        hit = True
            if hit and item_id is not None:
                items.append(item_id)
        sha = hashlib.sha256(",".join(sorted(map(str, set(items)))).encode()).hexdigest()
        out.append((doc_id, len(have), len(covered), len(set(items)), sha, bool(covered) and 20 * len(covered) >= len(have)))
    return out


def bench(spark, rows):
    short = " ".join(rows[8][1].split()[:4])
    items = [(1, rows[7][1]), (2, short), (10, "Not There " * 9), (3, None), (4, " ..! "), (None, "x"), (5, rows[14][1].upper())]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def test_digest_equals_brute_force(spark, docs, rows):
    items, table = bench(spark, rows)
    want = brute_force([r[:2] for r in rows], items)
    same([tuple(r) for r in decontaminate.digest(docs, table).collect()], want)
    assert any(w[5] for w in want) and any(w[2] and not w[5] for w in want)


def test_a_large_benchmark_is_joined_with_the_same_result(spark, docs, rows):
    _, table = bench(spark, rows)
    one, many = (decontaminate.scan(docs, table, broadcast_windows=n).selectExpr("doc_id", "n_words", "cast(spans as string)", "cast(items as string)").collect() for n in (10**6, 5))
    same([tuple(r) for r in one], [tuple(r) for r in many])
    by_bytes = decontaminate.scan(docs, table, broadcast_bytes=100).selectExpr("doc_id", "n_words", "cast(spans as string)", "cast(items as string)").collect()
    same([tuple(r) for r in one], [tuple(r) for r in by_bytes])


@pytest.mark.parametrize("options", [{}, {"broadcast_windows": 5}])
def test_item_ids_that_are_texts(spark, docs, rows, options):
    items = [("b-2", rows[7][1]), ("a", rows[14][1]), (None, rows[8][1]), ("c", rows[7][1])]
    found = decontaminate._scan(docs.select("doc_id", "text"), spark.createDataFrame(items, "item_id string, text string"), **options)
    got = {r.doc_id: list(r["items"]) for r in found.collect() if r.doc_id is not None}
    for r, w in zip(rows, brute_force([r[:2] for r in rows], items), strict=True):
        assert r[0] is None or len(got[r[0]]) == w[3]
    assert got[rows[7][0]] == ["a", "b-2", "c"]


def test_removal_and_columns(spark, docs, rows):
    items, table = bench(spark, rows)
    bad = [w[0] for w in brute_force([r[:2] for r in rows], items) if w[5]]
    clashing = docs.selectExpr("*", "1 as n_words", "lang as Spans", "2 as _h1", "3 as _windows")
    left = decontaminate.remove_documents(clashing, table)
    assert left.columns == clashing.columns
    assert decontaminate.scan(clashing, table).columns == [*clashing.columns, "n_words_", "spans_", "items"]
    assert decontaminate.remove_documents(clashing, table, broadcast_windows=5).columns == clashing.columns
    same([(r.doc_id,) for r in left.collect()], [(r[0],) for r in rows if r[0] not in bad])
    cleaned = {r.doc_id: r.text for r in decontaminate.remove_spans(docs.where("doc_id = 22"), table).collect()}
    assert len(cleaned[22] or "") < len(next(r[1] for r in rows if r[0] == 22))


def test_items_without_an_id_are_hit(spark, docs, rows):
    items = [(None, rows[8][1]), (5, rows[14][1]), (None, rows[14][1]), (None, None)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_force([r[:2] for r in rows], items)
    assert any(w[5] and not w[3] for w in want) and any(w[5] and w[3] == 1 for w in want)
    same([tuple(r) for r in decontaminate.digest(docs, table).collect()], want)
    one, many = (decontaminate.scan(docs, table, broadcast_windows=n).selectExpr("doc_id", "cast(spans as string)", "cast(items as string)").collect() for n in (10**6, 5))
    same([tuple(r) for r in one], [tuple(r) for r in many])
    assert rows[8][0] not in {r.doc_id for r in decontaminate.remove_documents(docs, table).collect()}


def test_empty_tables(spark, docs, empty, rows):
    _, table = bench(spark, rows)
    assert decontaminate.digest(empty, table).count() == 0
    assert decontaminate.digest(docs, table.limit(0)).where("n_hit > 0 or contaminated").count() == 0
