import random

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import revisions
from loomdoc.operators import mvcc
from loomdoc.plans.errors import QueryError


def tree(spark, rows):
    """Rows (sequence, parent, revid[, deleted[, id]])."""
    return spark.createDataFrame([(r[0], r[4] if len(r) > 4 else "doc", r[1], r[2], bool(r[3]) if len(r) > 3 else False, True, "{}") for r in rows], mvcc.SCHEMA)


FOREST = [(1, None, "1-c"), (2, 1, "2-c"), (3, 2, "3-c"), (4, 3, "4-c"), (5, 4, "5-c"), (6, 2, "3-d"), (7, 6, "4-d"), (8, None, "1-e"), (9, 8, "2-e"), (10, 9, "3-e"), (11, 9, "3-f"), (12, 11, "4-f")]


def revids(df):
    return sorted(r.revid for r in df.collect())


def test_forest(spark):
    revs = tree(spark, FOREST)
    assert revids(mvcc.leaves(revs)) == ["3-e", "4-d", "4-f", "5-c"]
    assert revids(mvcc.roots(revs)) == ["1-c", "1-e"] and revids(mvcc.children(revs, 9)) == ["3-e", "3-f"]
    found = {r.revid: (r.depth, list(r.path)) for r in mvcc.paths(revs).collect()}
    assert found["4-d"] == (3, ["4-d", "3-d", "2-c", "1-c"]) and found["1-e"] == (0, ["1-e"]) and found["5-c"][0] == 4
    assert mvcc.document_count(revs).first()[0] == 1 and mvcc.last_sequence(revs).first()[0] == 12
    assert mvcc.last_sequence(revs.limit(0)).first()[0] == -1


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (FOREST, "5-c"),
        ([(i, i - 1 or None, f"{i}-x", i == 7) for i in range(1, 8)] + [(8, None, "1-y"), (9, 8, "2-y")], "2-y"),
        ([(1, None, "1-a"), (2, None, "1-b")], "1-b"),
        ([(1, None, "1-x"), (2, None, "1-a")], "1-x"),
        ([(1, None, "1-a", True), (2, None, "1-b", True), (3, 1, "2-0", True)], "2-0"),
        ([(1, None, "9-x"), (2, None, "10-a")], "10-a"),
        ([(1, None, "3-k-7"), (2, None, "3-k-6")], "3-k-7"),
    ],
)
def test_winners(spark, rows, want):
    assert revids(mvcc.winners(tree(spark, rows))) == [want]


def test_winner_after_random_deletes(spark):
    draw = random.Random(6)
    rows = [(1, None, "1-a")]
    for gen in range(2, 9):
        for k in range(3):
            rows.append((len(rows) + 1, draw.choice([r[0] for r in rows if r[2].startswith(f"{gen - 1}-")]), f"{gen}-{draw.randint(0, 99)}x{k}"))
    docs = []
    for step in range(6):
        parents = {r[1] for r in rows}
        open_leaves = [r for r in rows if r[0] not in parents]
        alive = [r for r in open_leaves if len(r) < 4] or open_leaves
        want = max(alive, key=lambda r: (revisions.split_revid(r[2])))[2]
        docs += [((*r, False)[:4] + (f"doc{step}",), want) for r in rows]
        victim = draw.choice([r for r in open_leaves if len(r) < 4])
        rows.append((len(rows) + 1, victim[0], f"{revisions.split_revid(victim[2])[0] + 1}-gone", True))
    shifted = [(r[0] + 1000 * int(r[4][3:]), r[1] and r[1] + 1000 * int(r[4][3:]), *r[2:]) for r, _ in docs]
    got = {r["_id"]: r.revid for r in mvcc.winners(tree(spark, shifted)).collect()}
    assert got == {r[4]: want for r, want in docs}


def test_conflicts(spark):
    rows = [(i * 10 + k, None, f"1-{k}", False, f"d{i}") for i in range(5) for k in range(i)] + [(100, 40, "2-x", True, "d4")]
    assert sorted((r["_id"], r.leaves) for r in mvcc.conflicted(tree(spark, rows)).collect()) == [("d2", 2), ("d3", 3), ("d4", 3)]


def test_revs_diff_and_ancestors(spark):
    revs = tree(spark, FOREST)
    wanted = spark.createDataFrame([("doc", "5-c"), ("doc", "6-z"), ("doc", "2-q"), ("doc", "2-q"), ("other", "1-a"), ("doc", "1-c")], "_id string, revid string")
    assert sorted((r["_id"], list(r.missing)) for r in mvcc.revs_diff(revs, wanted).collect()) == [("doc", ["2-q", "6-z"]), ("other", ["1-a"])]
    found = {r.revid: list(r.ancestors) for r in mvcc.possible_ancestors(revs, wanted.where("_id = 'doc'").distinct(), 3).collect()}
    assert found["2-q"] == ["1-e", "1-c"] and found["6-z"] == ["4-f", "3-f", "3-e"] and "1-c" not in found


def added(spark, revs, incoming):
    df = spark.createDataFrame([(*x, False, '{"a":1}') if len(x) == 2 else x for x in incoming], "_id string, history array<string>, deleted boolean, json string")
    return mvcc.merge_history(revs, df)


def test_history_merge(spark):
    revs = tree(spark, [(1, None, "1-x")])
    new = added(spark, revs, [("doc", ["1-a", "2-c"]), ("doc", ["1-x", "2-x", "3-x"]), ("doc", ["1-x"]), ("fresh", ["4-a", "5-b"])])
    rows = {(r["_id"], r.revid): r for r in new.collect()}
    assert sorted(rows) == [("doc", "1-a"), ("doc", "2-c"), ("doc", "2-x"), ("doc", "3-x"), ("fresh", "4-a"), ("fresh", "5-b")]
    assert sorted(r.sequence for r in rows.values()) == list(range(2, 8))
    assert rows["doc", "2-x"].parent == 1 and rows["doc", "3-x"].parent == rows["doc", "2-x"].sequence and rows["doc", "1-a"].parent is None
    assert [rows[k].available for k in (("doc", "1-a"), ("doc", "2-c"))] == [False, True] and rows["doc", "2-c"].json == '{"a":1}'
    every = revs.unionByName(new)
    assert {r["_id"]: r.revid for r in mvcc.winners(every).collect()} == {"doc": "3-x", "fresh": "5-b"}
    assert added(spark, every, [("doc", ["1-a", "2-c"])]).count() == 0


def test_histories_of_one_batch_share_ancestors(spark):
    new = added(spark, tree(spark, []), [("d", ["1-a", "2-b", "3-c"]), ("d", ["1-a", "2-b"]), ("d", ["2-b", "3-d"])])
    rows = {r.revid: r for r in new.collect()}
    assert sorted(rows) == ["1-a", "2-b", "3-c", "3-d"] and rows["2-b"].available
    assert rows["2-b"].parent == rows["1-a"].sequence and rows["3-d"].parent == rows["3-c"].parent == rows["2-b"].sequence


def test_compaction_and_repair(spark):
    assert {r.revid for r in mvcc.compact(tree(spark, FOREST)).where("json is not null").collect()} == {"3-e", "4-d", "4-f", "5-c"}
    twice = tree(spark, [(1, None, "1-a"), (2, None, "1-a"), (3, 2, "2-b"), (4, 1, "2-b"), (5, 4, "3-c")])
    assert sorted((r.sequence, r.parent, r.revid) for r in mvcc.repair_duplicates(twice).collect()) == [(1, None, "1-a"), (3, 1, "2-b"), (5, 3, "3-c")]


def test_changes(spark):
    revs = tree(spark, [(1, None, "1-a", False, "a"), (2, None, "1-b", False, "b"), (3, 1, "2-a", False, "a"), (4, None, "1-c", False, "c")])
    show = lambda since, limit: [(r["_id"], r.revid, r.last_sequence) for r in mvcc.changes(revs, since, limit).collect()]
    assert show(0, 2) == [("a", "2-a", 1), ("b", "1-b", 2)]
    assert show(2, 2) == [("a", "2-a", 3), ("c", "1-c", 4)]
    assert show(-5, 10) == [("b", "1-b", 2), ("a", "2-a", 3), ("c", "1-c", 4)]
    assert show(4, 10) == []
    with pytest.raises(QueryError):
        mvcc.changes(revs, 0, 0)


def test_resolvers(spark):
    revs = tree(spark, [(1, None, "1-a", False, "x"), (2, None, "1-b", False, "x"), (3, None, "1-a", False, "y"), (4, None, "1-b", False, "bad"), (5, None, "1-c", False, "bad")])
    least = lambda name, leaves: 1 / 0 if name == "bad" else min(x["revid"] for x in leaves)
    assert [(r["_id"], r.kept, list(r.losers)) for r in mvcc.resolve(revs, least).collect()] == [("x", "1-a", ["1-b"])]
    assert mvcc.resolve(revs, lambda name, leaves: None).count() == 0


def test_revision_ids(spark):
    row = spark.sql("select '8-2-w' revid, 3 start, array('c', 'b-1', 'a') ids").select(revisions.generation(), revisions.suffix(), revisions.full_history("start", "ids").alias("h")).first()
    assert (row[0], row[1], list(row.h)) == (8, "2-w", ["1-a", "2-b-1", "3-c"])
    back = spark.createDataFrame([(["1-a", "2-b-1", "3-c"],)], "h array<string>").select(revisions.short_history("h").alias("s")).first().s
    assert (back.start, list(back.ids)) == (3, ["c", "b-1", "a"])
    assert revisions.split_revid(revisions.next_revid("9-z"))[0] == 10 and revisions.first_revid().startswith("1-")
    for bad in ("", "_x", None):
        with pytest.raises(QueryError):
            revisions.check_id(bad)
    assert revisions.check_id("_local/x") and F
    for bad in ("x", "1", "-a"):
        with pytest.raises(QueryError):
            revisions.split_revid(bad)


def test_faults_and_accessors(spark):
    revs = tree(spark, FOREST)
    assert mvcc.faults(revs).count() == 0
    assert [r.sequence for r in mvcc.lookup(revs, "doc", "3-d").collect()] == [6] and mvcc.lookup(revs, "doc", "9-z").count() == 0
    assert [tuple(r) for r in mvcc.has_conflicts(revs).collect()] == [("doc", True)]
    assert mvcc.leaf_revisions(tree(spark, [(1, None, "1-a"), (2, None, "1-b", True)]), exclude_deleted=True).count() == 1
    bad = tree(spark, [(1, None, "1-a"), (2, 7, "2-b"), (3, 1, "2-c", False, "other"), (4, 5, "3-d"), (5, None, "1-e"), (5, 1, "2-f")])
    want = [("doc", 2, "missing parent"), ("doc", 4, "later parent"), ("doc", 5, "repeated sequence"), ("other", 3, "parent of another document")]
    assert sorted((r["_id"], r.sequence, r.fault) for r in mvcc.faults(bad).collect()) == want


def test_attachments_of_repaired_revisions(spark):
    revs = tree(spark, [(1, None, "1-a"), (2, None, "1-a"), (3, 2, "2-b"), (4, 1, "2-b")])
    lines = spark.createDataFrame([(1, "x", "k1"), (2, "x", "k2"), (2, "y", "k3"), (4, "z", "k4")], "sequence bigint, filename string, key string")
    assert sorted(tuple(r) for r in mvcc.repair_attachments(revs, lines).collect()) == [(1, "x", "k1"), (1, "y", "k3"), (3, "z", "k4")]
    assert revids(mvcc.winners(mvcc.repair_duplicates(revs))) == ["2-b"]


def test_winners_of_equal_revision_ids(spark):
    assert [r.sequence for r in mvcc.winners(tree(spark, [(4, None, "1-a"), (2, None, "1-a"), (3, None, "1-a")])).collect()] == [2]


def test_parents_that_go_round(spark):
    rows = [(1, "a", 2, "1-x", False, True, "{}"), (2, "a", 1, "2-x", False, True, "{}"), (3, "b", None, "1-y", False, True, "{}")]
    with pytest.raises(QueryError, match="circle"):
        mvcc.paths(spark.createDataFrame(rows, mvcc.SCHEMA))


def test_paths_of_long_chains(spark):
    rows = [(i, "a", i - 1 if i > 1 else None, f"{i}-x", False, True, "{}") for i in range(1, 131)]
    got = {r.sequence: (r.depth, len(r.path)) for r in mvcc.paths(spark.createDataFrame(rows, mvcc.SCHEMA)).collect()}
    assert got == {i: (i - 1, i) for i in range(1, 131)}
