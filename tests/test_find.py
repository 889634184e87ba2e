import datetime

import pytest

from loomdoc.operators.find import find
from loomdoc.plans.errors import QueryError

from . import fixtures as fx

SELECTORS = {
    "BOATS": [
        {}, {"length": {"$gt": 9}}, {"rig": "sloop", "length": {"$gt": 9}}, {"rig": {"$gt": "ketch"}, "length": 14}, {"length": {"$lte": 9}}, {"length": 9.0}, {"length": "9"},
        {"length": {"$lt": "a"}}, {"rig": {"$gt": 5}}, {"rig": {"$lt": "sloop"}}, {"rig": {"$not": {"$lt": "sloop"}}}, {"berth": {"$not": {"$eq": "north"}}}, {"berth": {"$not": {"$gte": "north"}}},
        {"$and": [{"berth": {"$ne": "north"}}, {"berth": {"$ne": "south"}}]}, {"$and": [{"berth": {"$ne": "north"}}, {"berth": "north"}]}, {"$or": [{"berth": {"$ne": "north"}}, {"berth": {"$ne": "south"}}]},
        {"berth": {"$exists": False}}, {"berth": {"$not": {"$exists": True}}}, {"berth": {"$exists": True}}, {"berth": {"$in": []}}, {"berth": {"$nin": ["north", 3]}},
        {"keel": {"$exists": True}}, {"keel": {"$ne": 1}}, {"_id": {"$in": ["tern", "x"]}}, {"$or": [{"rig": "yawl"}, {"$and": [{"length": {"$gte": 14}}, {"berth": "south"}]}]},
        {"$and": [{"$or": [{"rig": "ketch"}, {"length": {"$gt": 20}}]}, {"$or": [{"berth": "east"}, {"berth": "north"}]}]},
    ],
    "CARGO": [
        {"holds": "tea"}, {"holds": "wool"}, {"holds": {"$not": {"$ne": "salt"}}}, {"holds": {"$ne": "tea"}}, {"holds": {"$gt": "salt"}}, {"holds": {"$lte": "salt"}}, {"holds": {"$not": {"$gt": "salt"}}},
        {"$and": [{"holds": {"$ne": "salt"}}, {"holds": {"$ne": "tea"}}]}, {"holds": {"$in": ["rice", "copper"]}}, {"holds": {"$in": ["salt", "tea"]}}, {"holds": {"$nin": ["salt", "tea"]}},
        {"holds": {"$exists": True}}, {"holds": {"$exists": False}}, {"rig": "yawl", "holds": {"$not": {"$in": ["tea"]}}},
    ],
    "DEPTHS": [
        {"depth": {"$mod": [10, 7]}}, {"depth": {"$mod": [-10, 7.6]}}, {"zone": "b", "depth": {"$mod": [10, 7]}}, {"zone": {"$mod": [10, 1]}}, {"depth": {"$mod": [7.9, 0]}}, {"depth": {"$mod": [-10, -7]}},
        {"depth": {"$mod": [40, -2]}}, {"depth": {"$not": {"$mod": [7, 0]}}}, {"depth": 0}, {"depth": {"$gte": 7.4}},
    ],
    "CREWS": [
        {"crew": {"$size": 2}}, {"crew": {"$size": 1}}, {"crew": {"$size": 0}}, {"crew": {"$size": -1}}, {"crew": {"$size": 1.5}}, {"crew": {"$size": "2"}}, {"crew": {"$not": {"$size": 2}}}, {"crew": {"$size": 3.0}},
    ],
    "NESTED": [{"owner.town": "Cove"}, {"owner.name.last": "Hale"}, {"$or": [{"owner.name": "Hale"}, {"owner": "Cove"}]}, {"owner.name": {"$exists": False}}, {"owner.town": {"$ne": "Cove"}}],
    "MIXED": [
        {"v": 7}, {"v": True}, {"v": {"$gt": True}}, {"v": {"$lt": "a"}}, {"v": {"$gte": 7}}, {"v": {"$exists": True}}, {"v": {"$not": {"$gt": 0}}}, {"v": {"$in": [True, "q", 0.25]}}, {"v": {"$nin": [7, "q"]}}, {"v.w": 7},
    ],
}
CASES = [(name, selector) for name, own in SELECTORS.items() for selector in own]


@pytest.fixture(scope="module")
def tables(spark):
    return {name: fx.variant(spark, getattr(fx, name)).cache() for name in SELECTORS}


@pytest.mark.parametrize(("name", "selector"), CASES)
def test_dynamic_bodies(tables, name, selector):
    assert fx.ids(find(tables[name], selector)) == fx.matching(getattr(fx, name), selector)


def test_the_evaluator_itself():
    """Results that were worked out by hand, so that the evaluator is not the only witness."""
    assert fx.matching(fx.CARGO, {"holds": {"$ne": "tea"}}) == ["gull", "otter", "tern", "wren"]
    assert fx.matching(fx.CARGO, {"holds": {"$gt": "salt"}}) == ["heron", "otter", "petrel", "swift", "wren"]
    assert fx.matching(fx.DEPTHS, {"depth": {"$mod": [-10, -7]}}) == ["sounding 2"]
    assert fx.matching(fx.MIXED, {"v": {"$lt": "a"}}) == ["both", "capital", "digits", "part", "seven"]
    assert fx.matching(fx.MIXED, {"v": {"$exists": True}}) == ["both", "capital", "digits", "inside", "letter", "part", "seven", "yes"]
    assert fx.matching(fx.CREWS, {"crew": {"$not": {"$size": 2}}}) == ["gull", "heron", "petrel", "tern", "wren"]


@pytest.fixture(scope="module")
def typed(spark):
    boats = spark.createDataFrame([(k, v["rig"], v["length"], v.get("berth")) for k, v in fx.BOATS.items()], "_id string, rig string, length bigint, berth string")
    cargo = spark.createDataFrame([(k, v["rig"], [v["holds"]] if isinstance(v.get("holds"), str) else v.get("holds")) for k, v in fx.CARGO.items()], "_id string, rig string, holds array<string>")
    depths = spark.createDataFrame([(k, v["zone"], float(v["depth"])) for k, v in fx.DEPTHS.items()], "_id string, zone string, depth double")
    return {"BOATS": boats.cache(), "CARGO": cargo.cache(), "DEPTHS": depths.cache()}


@pytest.mark.parametrize(("name", "selector"), [c for c in CASES if c[0] in ("BOATS", "CARGO", "DEPTHS")])
def test_typed_columns_give_the_same(typed, name, selector):
    assert fx.ids(find(typed[name], selector)) == fx.matching(getattr(fx, name), selector)


def test_structs_maps_and_times(spark):
    df = spark.createDataFrame([("a", (1, {"k": "v"}), datetime.datetime(2024, 1, 2), True), ("b", None, None, None)], "_id string, s struct<x: int, m: map<string,string>>, t timestamp_ntz, b boolean")
    assert fx.ids(find(df, {"s.x": 1, "s.m.k": "v", "t": {"$gte": "2024-01-02"}, "b": True})) == ["a"]
    assert fx.ids(find(df, {"s.x": {"$ne": 1}})) == ["b"]
    assert fx.ids(find(df, {"s.x.y": {"$exists": True}})) == []
    assert fx.ids(find(df, {"s": {"$exists": True}})) == ["a"]
    assert fx.ids(find(df, {"t": {"$not": {"$lt": "2024-01-02"}}})) == ["a", "b"]
    assert fx.ids(find(df, {"b": {"$lt": True}})) == []


def test_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x")], "_id string, n bigint, s string").write.parquet(path)
    df = spark.read.parquet(path)
    plan = find(df, {"n": {"$gt": 3.0}, "s": {"$ne": "y"}}, fields=["n"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,3)" in plan and "Not(EqualNullSafe(s,y))" in plan
    plan = find(df, {"n": {"$not": {"$gte": 3}}})._jdf.queryExecution().executedPlan().toString()
    assert "Or(LessThan(n,3),IsNull(n))" in plan


def test_sort_skip_limit(spark):
    docs = {"k1": {"rig": "sloop", "length": 12, "open": "y"}, "k2": {"rig": "cutter", "length": 34, "berth": "quay", "open": "y"}, "k3": {"rig": "cutter", "length": 11, "berth": "mole", "open": "y"}}
    df = fx.variant(spark, docs)
    order = lambda **k: [r["_id"] for r in find(df, {"open": "y"}, **k).collect()]
    assert order(sort=[("rig", "asc"), ("length", "desc")]) == ["k2", "k3", "k1"]
    assert order(sort=[{"berth": "asc"}]) == ["k1", "k3", "k2"]
    assert order(sort=[("berth", "desc")]) == ["k2", "k3", "k1"]
    many = spark.range(180).selectExpr("concat('n', id) AS _id", "'z' AS kind", "id AS place")
    assert find(many, {"kind": "z"}, limit=70).count() == 70
    assert [r.place for r in find(many, {}, skip=95, limit=25, sort=["place"]).collect()] == list(range(95, 120))
    assert find(many, {}, skip=179).count() == 1
    for bad in ({"skip": -1}, {"limit": -1}, {"sort": [("place", "up")]}):
        with pytest.raises(QueryError):
            find(many, {}, **bad)


def test_arrays_sort_by_their_least_or_greatest_element(spark, typed):
    for df in (typed["CARGO"], fx.variant(spark, fx.CARGO)):
        rows = find(df, {"holds": {"$exists": True}}, sort=[("holds", "asc"), ("_id", "asc")]).collect()
        assert [r["_id"] for r in rows] == ["wren", "petrel", "heron", "swift", "otter"]
        rows = find(df, {"holds": {"$exists": True}}, sort=[("holds", "desc"), ("_id", "asc")]).collect()
        assert [r["_id"] for r in rows] == ["otter", "wren", "heron", "petrel", "swift"]


def test_mixed_values_sort_by_type(spark):
    got = [r["_id"] for r in find(fx.variant(spark, {k: v for k, v in fx.MIXED.items() if k not in ("yes", "nothing", "inside", "no element", "without")}), {}, sort=["v"]).collect()]
    assert got[:3] in (["part", "seven", "both"], ["part", "both", "seven"]) and got[3:] == ["digits", "capital", "letter"]


def test_projection(spark, tables, typed):
    df = find(typed["BOATS"], {"rig": "sloop"}, fields=["length"])
    assert df.columns == ["_id", "length"]
    [row] = find(tables["BOATS"], {"_id": "petrel"}, fields=["rig", "berth"]).selectExpr("_id", "to_json(body) j").collect()
    assert (row["_id"], row.j) == ("petrel", '{"rig":"sloop"}')
    assert find(typed["BOATS"], {}, fields=[]).columns == typed["BOATS"].columns
    with pytest.raises(QueryError):
        find(typed["BOATS"], {}, fields=["a.b"])


def test_names_in_other_scripts(spark):
    docs = {"лодка": {"名": "海", "μήκος": 34}, "boat": {"名": "sea", "μήκος": 12}}
    assert fx.ids(find(fx.variant(spark, docs), {"μήκος": {"$gt": 12}, "名": "海"})) == ["лодка"]


def test_whole_numbers_beyond_doubles(spark, tmp_path):
    """Neighbours that are one double, in a VARIANT as in a typed column, and through an index."""
    import json

    from loomdoc.sources.store import DocumentStore

    n = 9007199254740992
    values = {"a": n - 1, "b": n, "c": n + 1, "d": n + 2, "e": -n - 1, "f": float(n), "g": str(n), "h": 1.5}
    typed = spark.createDataFrame([(k, v) for k, v in values.items() if isinstance(v, int)], "_id string, n bigint")
    store = DocumentStore(spark, str(tmp_path / "store"))
    store.create_many(spark.createDataFrame([(k, json.dumps({"n": v})) for k, v in values.items()], "_id string, json string"))
    selectors = {"$eq": n, "$gt": n, "$gte": n + 1, "$lt": n + 1, "$lte": -n - 1, "$in": [n + 1, 3]}
    for indexed in (False, True):
        if indexed:
            store.create_json_index(["n"], "by n")
        for op, value in selectors.items():
            whole = [x for x in fx.ids(store.find({"n": {op: value}})) if isinstance(values[x], int)]
            assert whole == fx.ids(find(typed, {"n": {op: value}})), (op, indexed)
