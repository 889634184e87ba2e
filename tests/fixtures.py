"""Small document sets of our own, and plain evaluators that say what a query over them must give.

`matches` evaluates a selector on one JSON body; `found_by_fts` asks SQLite's full-text tables.
"""

import json
import math
import sqlite3

from pyspark.sql import functions as F

BOATS = {
    "heron": {"rig": "sloop", "length": 9, "berth": "north"},
    "otter": {"rig": "ketch", "length": 14, "berth": "south"},
    "petrel": {"rig": "sloop", "length": 14},
    "tern": {"rig": "yawl", "length": 21, "berth": "north"},
    "wren": {"rig": "ketch", "length": 9, "berth": "east"},
    "swift": {"rig": "sloop", "length": 30, "berth": "south"},
}
CARGO = {
    "heron": {"rig": "sloop", "holds": ["salt", "tea"]},
    "otter": {"rig": "ketch", "holds": "wool"},
    "petrel": {"rig": "sloop", "holds": ["tea", "rice", "salt"]},
    "tern": {"rig": "yawl"},
    "wren": {"rig": "ketch", "holds": ["copper", "wool"]},
    "swift": {"rig": "sloop", "holds": "tea"},
    "gull": {"rig": "yawl", "holds": []},
}
DEPTHS = {f"sounding {i}": {"zone": "ab"[i % 2], "depth": v} for i, v in enumerate([42, 7, -7, 7.4, 7.9, 0, 0.0, 0.3, -0.3, 27, -42, 100])}
CREWS = {
    "heron": {"crew": ["ann"]}, "otter": {"crew": ["ann", "bo"]}, "petrel": {"crew": "cy"}, "tern": {}, "wren": {"crew": []},
    "swift": {"crew": ["cy", "di"]}, "gull": {"crew": ["ann", "bo", "cy"]},
}
NESTED = {
    "heron": {"owner": {"town": "Cove", "name": {"last": "Hale"}}}, "otter": {"owner": {"town": "Cove", "name": "Hale"}},
    "petrel": {"owner": "Cove"}, "tern": {}, "wren": {"owner": {"town": "Mere", "name": {"last": "Hale"}}},
}
MIXED = {
    "yes": {"v": True}, "seven": {"v": 7}, "digits": {"v": "7"}, "nothing": {"v": None}, "without": {}, "inside": {"v": {"w": 7}}, "no element": {"v": []},
    "part": {"v": 0.25}, "both": {"v": [7, "q"]}, "letter": {"v": "q"}, "capital": {"v": "Q"},
}
LOGS = {
    "heron": ("sloop", 9, "north", "Left the quay at dawn; the wind's northerly and the pump leaks."),
    "otter": ("ketch", 14, "south", "Anchored off the quay, pump repaired, wind northerly again."),
    "petrel": ("sloop", 14, None, "The repairs at the northern yard took a week."),
    "tern": ("yawl", 21, "north", "Dawn watch saw the lamp of the heron by the yard."),
    "wren": ("ketch", 9, "east", "At the yard the lamp was repaired and the quay swept."),
    "swift": ("sloop", 30, "south", "Κύμα και άνεμος"),
}


def variant(spark, docs):
    """_id, body VARIANT."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "_id string, json string").select("_id", F.parse_json("json").alias("body"))


def ids(df):
    return sorted(r["_id"] for r in df.collect())


def _order(value):
    """Numbers before strings; nothing else compares."""
    if isinstance(value, bool):
        return None
    return (1, float(value)) if isinstance(value, (int, float)) else (2, value) if isinstance(value, str) else None


def _one(value, op, operand):
    if op == "$in":
        return any(_one(value, "$eq", x) for x in operand)
    if op == "$mod":
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and math.fmod(math.trunc(value), math.trunc(operand[0])) == math.trunc(operand[1])
    if isinstance(value, bool) or isinstance(operand, bool):
        return op == "$eq" and value is operand
    a, b = _order(value), _order(operand)
    if a is None or b is None:
        return False
    return {"$eq": a == b, "$lt": a < b, "$lte": a <= b, "$gt": a > b, "$gte": a >= b}[op]


def _clause(value, op, operand):
    if op == "$not":
        [(inner, x)] = operand.items()
        return not _clause(value, inner, x)
    if op in ("$ne", "$nin"):
        return not _clause(value, {"$ne": "$eq", "$nin": "$in"}[op], operand)
    if op == "$size":
        return isinstance(value, list) and isinstance(operand, (int, float)) and len(value) == operand
    if op == "$exists":
        there = any(x is not None for x in value) if isinstance(value, list) else value is not None
        return there == operand
    return any(_one(x, op, operand) for x in (value if isinstance(value, list) else [value]))


def matches(name, body, selector):
    """Whether a selector holds for a document."""
    for key, want in selector.items():
        if key in ("$and", "$or"):
            holds = (all if key == "$and" else any)(matches(name, body, x) for x in want)
        else:
            value = {**body, "_id": name}
            for part in key.split("."):
                value = value.get(part) if isinstance(value, dict) else None
            [(op, operand)] = want.items() if isinstance(want, dict) else [("$eq", want)]
            holds = _clause(value, op, operand)
        if not holds:
            return False
    return True


def matching(docs, selector):
    return sorted(k for k, v in docs.items() if matches(k, v, selector))


def found_by_fts(rows, columns, search, tokenizer="simple"):
    """Ids of rows ({column: text}, `_id` among them) that SQLite's full-text index finds."""
    with sqlite3.connect(":memory:") as db:
        db.execute(f"CREATE VIRTUAL TABLE t USING fts4({', '.join(columns)}, tokenize={tokenizer})")
        db.executemany(f"INSERT INTO t ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})", [[None if r[c] is None else str(r[c]) for c in columns] for r in rows])
        return sorted(x[0] for x in db.execute("SELECT _id FROM t WHERE t MATCH ?", (search,)))
