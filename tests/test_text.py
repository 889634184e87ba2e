import pytest

from loomdoc.functions.porter import stem
from loomdoc.functions.tokens import Tokenizer, simple_words
from loomdoc.operators.find import find
from loomdoc.operators.text import TextIndex, search
from loomdoc.plans.errors import QueryError

from . import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, *v) for k, v in fx.LOGS.items()], "_id string, rig string, length bigint, berth string, log string").cache()


SEARCHES = [
    "the quay", '"the quay"', "wind's northerly", "yard lamp", "yArD LaMp", '"yard lamp"', "lamp OR pump", "lamp or pump", "lamp NOT quay", '(lamp OR pump) AND "the quay"', "lamp OR pump AND dawn",
    '"the quay" NEAR/2 dawn', "quay NEAR/0 the", "quay NEAR/1 at", "dawn NEAR leaks", "dawn NEAR heron", "quay NEAR/3 dawn NEAR/0 the", "nor* pump", '"the y*"', "nor pum", "άνεμος", "log:the dawn", "quay,", "re*", "(dawn OR week) NOT (heron OR pump)",
]


def as_rows():
    return [{"_id": k, "rig": v[0], "length": v[1], "berth": v[2], "log": v[3]} for k, v in fx.LOGS.items()]


@pytest.mark.parametrize("text", SEARCHES)
def test_searches(docs, text):
    assert fx.ids(search(docs, text, ["log"])) == fx.found_by_fts(as_rows(), ["_id", "log"], text)


def test_nothing_to_search_for(docs):
    assert fx.ids(search(docs, "...", ["log"])) == []
    assert len({tuple(fx.ids(search(docs, x, ["log"]))) for x in SEARCHES}) > 8


@pytest.mark.parametrize("text", ["14", "north", "rig:sloop log:the yard", "_id:h*", "sloop dawn", "berth:north OR length:30"])
def test_columns(docs, text):
    columns = ["rig", "length", "berth", "log"]
    assert fx.ids(search(docs, text, columns)) == fx.found_by_fts(as_rows(), ["_id", *columns], text) != []


@pytest.mark.parametrize("text", ["repair", "repairing northerly", '"lamps was"', "leaking OR anchors", "watched lamps", "northern NOT pumping"])
def test_porter(docs, text):
    assert fx.ids(search(docs, text, ["log"], Tokenizer("porter"))) == fx.found_by_fts(as_rows(), ["_id", "log"], text, "porter")


def test_porter_finds_more(docs):
    assert fx.ids(search(docs, "repairing", ["log"], Tokenizer("porter"))) == ["otter", "petrel", "wren"]
    assert fx.ids(search(docs, "repairing", ["log"])) == []


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "formative": "form", "hopefulness": "hope",
        "revival": "reviv", "allowance": "allow", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
    }
    assert {k: stem(k) for k in known} == known


def test_in_a_selector(docs):
    index = TextIndex(docs, ["log"])
    assert fx.ids(find(docs, {"rig": "ketch", "$text": {"$search": "lamp OR anchored"}}, text=index)) == ["otter", "wren"]
    assert fx.ids(find(docs, {"$or": [{"length": 30}, {"$text": {"$search": "week"}}]}, text=index)) == ["petrel", "swift"]
    with pytest.raises(QueryError):
        find(docs, {"$text": {"$search": "x"}})


def test_arrays_match_in_one_element(spark):
    df = spark.createDataFrame([("a", ["red apple", "green pear"], "x"), ("b", ["red pear"], "y"), ("c", [], "pear red")], "_id string, items array<string>, note string")
    assert fx.ids(search(df, "red pear", ["items"])) == ["b"]
    assert fx.ids(search(df, "red pear", ["items", "note"])) == ["b", "c"]


@pytest.mark.parametrize("text", ["", "  ", "(a", "a)", "a OR", "NOT a", "a NEAR (b c)", "none:x y OR", 'bad:"x y"'])
def test_refused(docs, text):
    with pytest.raises(QueryError):
        search(docs, text, ["log"])


def test_tokenizers(docs):
    assert simple_words("It's 3x ÉTÉ-été _a") == ["it", "s", "3x", "ÉtÉ", "été", "a"]
    with pytest.raises(QueryError):
        Tokenizer("none")
    Tokenizer.register("letters", lambda c, args: c, lambda text, args: list(text))
    assert Tokenizer("letters").words("ab") == ["a", "b"]
    with pytest.raises(QueryError):
        TextIndex(docs, [])
