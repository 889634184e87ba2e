"""One query per operator over the driver's tables, and the SQL with the same result.

Tables with a key and an order play the part of revision trees: a conversation is
a document and its turns are revisions, an order's lines are the leaves of a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tokens
from .operators import mvcc
from .operators.find import find, multi_get
from .operators.text import TextIndex, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 50")
def sel_eq_and_range(spark, folder):
    return find(table(spark, folder, "events"), {"event_type": "error", "value": {"$gt": 50}}, fields=["event_id", "user_id", "value"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice >= 150000) OR (o_orderpriority = '1-URGENT' AND o_totalprice < 20000)")
def sel_or_nested(spark, folder):
    either = [{"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gte": 150000}}]}, {"$and": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"$lt": 20000}}]}]
    return find(table(spark, folder, "orders"), {"$or": either}, fields=["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0 OR c_acctbal <= 100")
def sel_lt_lte(spark, folder):
    return find(table(spark, folder, "customer"), {"$or": [{"c_acctbal": {"$lt": 0}}, {"c_acctbal": {"$lte": 100}}]}, fields=["c_custkey", "c_nationkey"])


@query("SELECT event_id FROM events WHERE NOT coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) = 12, false)")
def sel_ne_missing(spark, folder):
    bodies = table(spark, folder, "events").withColumn("body", F.parse_json("props"))
    return find(bodies, {"k": {"$ne": 12}}).select("event_id")


@query("SELECT event_id, user_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 40")
def sel_variant_range(spark, folder):
    bodies = table(spark, folder, "events").withColumn("body", F.parse_json("props"))
    return find(bodies, {"$and": [{"k": {"$gte": 10}}, {"k": {"$lte": 40}}]}).select("event_id", "user_id")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def sel_in(spark, folder):
    return find(table(spark, folder, "customer"), {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, fields=["c_custkey", "c_mktsegment"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)")
def sel_nin(spark, folder):
    return find(table(spark, folder, "customer"), {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY", 7]}}, fields=["c_custkey", "c_mktsegment"])


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def sel_exists(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return find(joined, {"quality": {"$exists": False}}, fields=["doc_id"])


@query("SELECT p_partkey FROM part WHERE CAST(trunc(p_retailprice) AS BIGINT) % 10 = 3")
def sel_mod(spark, folder):
    return find(table(spark, folder, "part"), {"p_retailprice": {"$mod": [10, 3]}}, fields=["p_partkey"])


@query("SELECT c_custkey FROM customer WHERE CAST(trunc(c_acctbal) AS BIGINT) % 7 = -2")
def sel_mod_negative(spark, folder):
    return find(table(spark, folder, "customer"), {"c_acctbal": {"$mod": [-7.9, -2]}}, fields=["c_custkey"])


@query("SELECT l_orderkey, len(list(l_linenumber)) AS n_lines FROM lineitem GROUP BY l_orderkey HAVING len(list(l_linenumber)) = 3")
def sel_size(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    return find(lines, {"lines": {"$size": 3}}).select("l_orderkey", F.size("lines").cast("long").alias("n_lines"))


@query("SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0")
def sel_array_any(spark, folder):
    return find(table(spark, folder, "embeddings"), {"embedding": {"$gt": 0.35}}, fields=["vec_id", "label"])


@query("SELECT vec_id, label FROM embeddings WHERE NOT coalesce(len(list_filter(embedding, lambda x: x > 0.35)) > 0, false)")
def sel_array_not_any(spark, folder):
    return find(table(spark, folder, "embeddings"), {"embedding": {"$not": {"$gt": 0.35}}}, fields=["vec_id", "label"])


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 20")
def sort_multi_skip_limit(spark, folder):
    return find(table(spark, folder, "customer"), {}, skip=20, limit=10, fields=["c_custkey", "c_nationkey", "c_acctbal"], sort=[("c_nationkey", "asc"), ("c_acctbal", "desc"), ("c_custkey", "asc")])


@query("SELECT p_partkey, p_brand, p_size FROM part")
def project_fields(spark, folder):
    return find(table(spark, folder, "part"), {}, fields=["p_partkey", "p_brand", "p_size"])


_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10ffff}]+')"
_DOCS = f"(SELECT doc_id, {_TOKENS} AS tk FROM documents)"


def _has(word: str) -> str:
    return f"list_contains(tk, '{word}')"


@query(f"SELECT doc_id, len(tk) AS n_tokens, sha256(array_to_string(tk, ' ')) AS tokens_sha256 FROM {_DOCS}")
def text_tokens(spark, folder):
    cut = table(spark, folder, "documents").select("doc_id", tokens.token_array(F.col("text")).alias("tk"))
    return cut.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.sha2(F.array_join("tk", " "), 256).alias("tokens_sha256"))


def _searched(spark, folder, text):
    return search(table(spark, folder, "documents").select("doc_id", "text"), text, ["text"]).select("doc_id")


@query(f"SELECT doc_id FROM {_DOCS} WHERE {_has('the')} AND {_has('from')}")
def text_and(spark, folder):
    return _searched(spark, folder, "The from")


@query(f"SELECT doc_id FROM {_DOCS} WHERE {_has('worthless')} OR {_has('pathetic')}")
def text_or(spark, folder):
    return _searched(spark, folder, "worthless OR pathetic")


@query(f"SELECT doc_id FROM {_DOCS} WHERE ({_has('the')} OR {_has('les')}) AND NOT {_has('from')}")
def text_not(spark, folder):
    return _searched(spark, folder, "(the OR les) NOT from")


@query(f"SELECT doc_id FROM {_DOCS} WHERE len(list_filter(tk, lambda t: starts_with(t, 'ther'))) > 0")
def text_prefix(spark, folder):
    return _searched(spark, folder, "ther*")


@query(f"SELECT doc_id FROM {_DOCS} WHERE contains(' ' || array_to_string(tk, ' ') || ' ', ' rights reserved ')")
def text_phrase(spark, folder):
    return _searched(spark, folder, '"rights reserved"')


@query(f"""WITH p AS (SELECT doc_id, unnest(tk) AS t, unnest(range(len(tk))) AS i FROM {_DOCS})
SELECT DISTINCT a.doc_id FROM (SELECT * FROM p WHERE t = 'the') a JOIN (SELECT * FROM p WHERE t = 'of') b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 3""")
def text_near(spark, folder):
    return _searched(spark, folder, "the NEAR/2 of")


@query(f"SELECT doc_id FROM {_DOCS} WHERE {_has('the')} AND lang = 'en'".replace("SELECT doc_id, ", "SELECT doc_id, lang, "))
def text_in_selector(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return find(docs, {"lang": "en", "$text": {"$search": "the"}}, text=TextIndex(docs, ["text"])).select("doc_id")


#: Words whose Porter stem is that of "reserving" or "licensing".
_INFLECTED = ("reserve", "reserves", "reserved", "reserving", "reservation", "reservations", "license", "licenses", "licensed", "licensing")


@query(f"SELECT doc_id FROM {_DOCS} WHERE len(list_intersect(tk, {list(_INFLECTED)!r})) > 0")
def text_porter(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return search(docs, "reserving OR licensing", ["text"], tokens.Tokenizer("porter")).select("doc_id")


@query(f"SELECT doc_id FROM {_DOCS} WHERE lower(source) = 'src1' AND {_has('the')}".replace("SELECT doc_id, ", "SELECT doc_id, source, "))
def text_column_filter(spark, folder):
    return search(table(spark, folder, "documents").select("doc_id", "source", "text"), "source:SRC1 text:the", ["source", "text"]).select("doc_id")


@query(f"SELECT conv_id FROM (SELECT conv_id, {_TOKENS} AS tk FROM conversations) GROUP BY conv_id HAVING bool_or({_has('the')} AND {_has('and')})")
def text_array(spark, folder):
    """Both words in one element of an array."""
    whole = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("turns"))
    return search(whole, "the and", ["turns"]).select("conv_id")


@query("SELECT page_id FROM (SELECT page_id, string_split(split_part(url, '://', 2), '/') AS parts FROM pages) WHERE list_contains(parts, (SELECT string_split(split_part(url, '://', 2), '/')[1] FROM pages WHERE page_id = 0))")
def text_custom_tokenizer(spark, folder):
    """Parts of a URL between slashes as tokens; the search is the host of page 0."""
    tokens.Tokenizer.register("url", lambda c, _: F.concat(F.lit(" "), F.replace(F.substring_index(c, "://", -1), F.lit("/"), F.lit(" ")), F.lit(" ")), lambda text, _: text.split("/"))
    pages = table(spark, folder, "pages").select("page_id", "url")
    host = pages.where("page_id = 0").select(F.substring_index(F.substring_index("url", "://", -1), "/", 1)).first()[0]
    return search(pages, host, ["url"], tokens.Tokenizer("url")).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def sel_dotted(spark, folder):
    nested = table(spark, folder, "orders").select("o_orderkey", F.struct("o_orderstatus", F.struct(F.col("o_totalprice").alias("price")).alias("cost")).alias("o"))
    return find(nested, {"o.o_orderstatus": "F", "o.cost.price": {"$gt": 100000}}).select("o_orderkey")


@query("SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 90")
def sel_dotted_variant(spark, folder):
    bodies = table(spark, folder, "events").select("event_id", F.parse_json(F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}"))).alias("body"))
    return find(bodies, {"a.b.k": {"$gt": 90}}).select("event_id")


@query("SELECT vec_id FROM embeddings ORDER BY list_min(embedding) ASC NULLS FIRST, vec_id LIMIT 20")
def sort_array(spark, folder):
    return find(table(spark, folder, "embeddings"), {}, limit=20, sort=[("embedding", "asc"), ("vec_id", "asc")]).select("vec_id")


def _lines(spark, folder):
    """Orders as documents, their distinct line numbers as leaves of generation line number."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    revid = F.concat("l_linenumber", F.lit("-"), F.lpad(F.col("part").cast("string"), 10, "0"))
    return lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("sequence"), F.col("l_orderkey").cast("string").alias("_id"), F.lit(None).cast("bigint").alias("parent"),
        revid.alias("revid"), (F.col("part") % 5 == 0).alias("deleted"), F.lit(True).alias("available"), F.lit("{}").alias("json"),
    )


_LINES = """(SELECT l_orderkey * 100 + l_linenumber AS sequence, CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS gen, max(l_partkey) AS part,
l_linenumber || '-' || lpad(CAST(max(l_partkey) AS VARCHAR), 10, '0') AS revid, max(l_partkey) % 5 = 0 AS deleted FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(f"SELECT id, revid, deleted FROM {_LINES} QUALIFY row_number() OVER (PARTITION BY id ORDER BY deleted ASC, gen DESC, part DESC) = 1")
def mvcc_winner(spark, folder):
    return mvcc.winners(_lines(spark, folder)).select(F.col("_id").alias("id"), "revid", "deleted")


@query(f"SELECT id, count(*) AS leaves FROM {_LINES} WHERE NOT deleted GROUP BY id HAVING count(*) > 1")
def mvcc_conflicted(spark, folder):
    return mvcc.conflicted(_lines(spark, folder)).select(F.col("_id").alias("id"), "leaves")


def _turns(spark, folder):
    """Conversations as documents, each turn a revision of the one before."""
    turns = table(spark, folder, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    have = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("_before"))
    sequence = F.col("conv_id") * 100_000 + F.col("turn")
    return turns.join(have, ["conv_id", "turn"], "left").select(
        sequence.alias("sequence"), F.col("conv_id").cast("string").alias("_id"), F.when(F.col("_before"), sequence - 1).alias("parent"),
        F.concat((F.col("turn") + 1).cast("string"), F.lit("-"), F.sha1(F.coalesce("text", F.lit("")))).alias("revid"), F.lit(False).alias("deleted"), F.lit(True).alias("available"), F.coalesce("text", F.lit("")).alias("json"),
    )


_TURNS = """(SELECT conv_id, turn, min(text) AS text, (turn + 1) || '-' || sha1(coalesce(min(text), '')) AS revid FROM conversations GROUP BY conv_id, turn)"""


@query(f"SELECT CAST(conv_id AS VARCHAR) AS id, revid FROM {_TURNS} a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
def mvcc_leaves(spark, folder):
    return mvcc.leaves(_turns(spark, folder)).select(F.col("_id").alias("id"), "revid")


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {_TURNS}), p AS (
SELECT a.conv_id, a.turn, a.revid, 0 AS depth FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)
UNION ALL SELECT t.conv_id, t.turn, t.revid, p.depth + 1 FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn + 1)
SELECT CAST(conv_id AS VARCHAR) AS id, revid, depth FROM p""")
def mvcc_path(spark, folder):
    return mvcc.paths(_turns(spark, folder)).select(F.col("_id").alias("id"), "revid", F.col("depth").cast("int"))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS id, revid, CASE WHEN EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1) THEN NULL ELSE coalesce(text, '') END AS body FROM {_TURNS} a")
def mvcc_compact(spark, folder):
    return mvcc.compact(_turns(spark, folder)).select(F.col("_id").alias("id"), "revid", F.col("json").alias("body"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, count(DISTINCT n) AS missing FROM (SELECT o_orderkey, unnest(range(1, 4)) AS n FROM orders) o
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = n) GROUP BY o_orderkey""")
def revs_diff(spark, folder):
    stored = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("_id"), F.concat("l_linenumber", F.lit("-x")).alias("revid"))
    wanted = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), F.explode(F.array(*[F.lit(f"{i}-x") for i in (1, 2, 3)])).alias("revid"))
    return mvcc.revs_diff(stored, wanted).select(F.col("_id").alias("id"), F.size("missing").cast("long").alias("missing"))


def _events(spark, folder):
    """Events as revisions of their user's document, event_id the sequence, each a tree of its own."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("_id"), F.lit(None).cast("bigint").alias("parent"), F.concat(F.lit("1-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("revid"),
        (F.col("event_type") == "error").alias("deleted"), F.lit(True).alias("available"), F.col("props").alias("json"),
    )


_EVENT_WINNERS = "(SELECT user_id, event_id, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', event_id DESC) = 1)"


@query(f"SELECT CAST(c.user_id AS VARCHAR) AS id, last_sequence, w.event_id AS winner FROM (SELECT user_id, max(event_id) AS last_sequence FROM events WHERE event_id > 100 AND event_id <= 600 GROUP BY user_id) c JOIN {_EVENT_WINNERS} w ON w.user_id = c.user_id")
def changes_window(spark, folder):
    return mvcc.changes(_events(spark, folder), 100, 500).select(F.col("_id").alias("id"), "last_sequence", F.col("sequence").alias("winner"))


@query(f"SELECT count(*) AS documents FROM {_EVENT_WINNERS} WHERE NOT deleted")
def doc_count(spark, folder):
    return mvcc.document_count(_events(spark, folder))


@query("SELECT coalesce(max(event_id), -1) AS last_sequence FROM events")
def last_sequence(spark, folder):
    return mvcc.last_sequence(_events(spark, folder))


@query("""SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS added, CAST(count(DISTINCT revid) AS BIGINT) AS distinct_revs, CAST(sum(CASE WHEN turn = last THEN 1 ELSE 0 END) AS BIGINT) AS with_body
FROM (SELECT conv_id, turn, (turn + 1) || '-x' AS revid, max(turn) OVER (PARTITION BY conv_id) AS last FROM (SELECT DISTINCT conv_id, turn FROM conversations)) GROUP BY conv_id""")
def merge_history(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn").distinct()
    history = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat((x + 1).cast("string"), F.lit("-x")))
    incoming = turns.groupBy(F.col("conv_id").cast("string").alias("_id")).agg(history.alias("history")).withColumn("deleted", F.lit(False)).withColumn("json", F.lit("{}"))
    added = mvcc.merge_history(spark.createDataFrame([], mvcc.SCHEMA), incoming)
    return added.groupBy(F.col("_id").alias("id")).agg(F.count(F.lit(1)).alias("added"), F.count_distinct("revid").alias("distinct_revs"), F.sum(F.col("available").cast("int")).alias("with_body"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS id, turn + 1 AS gen, CASE WHEN turn = 0 THEN -1 ELSE turn END AS parent_gen FROM (SELECT DISTINCT conv_id, turn FROM conversations) a
WHERE turn >= 1 AND (SELECT min(turn) FROM conversations b WHERE b.conv_id = a.conv_id) = 0""")
def history_graft(spark, folder):
    """Conversations of which the first turn is stored: their histories are grafted on it, and each new revision follows the one before."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn").distinct().withColumn("_id", F.col("conv_id").cast("string"))
    revid = lambda turn: F.concat((turn + 1).cast("string"), F.lit("-x"))
    stored = turns.where("turn = 0").select((F.col("conv_id") + 1).alias("sequence"), "_id", F.lit(None).cast("bigint").alias("parent"), revid(F.col("turn")).alias("revid"), F.lit(False).alias("deleted"), F.lit(True).alias("available"), F.lit("{}").alias("json"))
    incoming = turns.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list("turn")), revid).alias("history")).join(stored.select("_id"), "_id", "left_semi").withColumn("deleted", F.lit(False)).withColumn("json", F.lit("{}"))
    new = mvcc.merge_history(stored, incoming)
    parents = stored.unionByName(new).select(F.col("sequence").alias("parent"), F.col("revid").alias("_above"))
    number = lambda c: F.substring_index(c, "-", 1).cast("bigint")
    return new.join(parents, "parent", "left").select(F.col("_id").alias("id"), number("revid").alias("gen"), F.coalesce(number("_above"), F.lit(-1).cast("bigint")).alias("parent_gen"))


@query("SELECT o_orderkey * 10 AS seq, 'missing parent' AS fault FROM orders WHERE o_orderkey % 7 = 0")
def tree_faults(spark, folder):
    orders = table(spark, folder, "orders").select((F.col("o_orderkey") * 10).alias("sequence"), F.col("o_custkey").cast("string").alias("_id"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") * 10 - 5).alias("parent"))
    return mvcc.faults(orders).select(F.col("sequence").alias("seq"), "fault")


@query(f"SELECT id, count(*) FILTER (WHERE NOT deleted) > 1 AS has_conflicts FROM {_LINES} GROUP BY id")
def mvcc_has_conflicts(spark, folder):
    return mvcc.has_conflicts(_lines(spark, folder)).select(F.col("_id").alias("id"), "has_conflicts")


@query("SELECT min(doc_id) AS first_id, count(*) AS n, sha1(text) AS revid FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def repair_reparent(spark, folder):
    """Copies of a text are one revision twice; children of the others (one each) follow the first after the repair."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("h"))
    revs = docs.select((F.col("doc_id") * 2 + 2).alias("sequence"), F.lit("d").alias("_id"), F.lit(None).cast("bigint").alias("parent"), F.concat(F.lit("1-"), "h").alias("revid"))
    below = docs.select((F.col("doc_id") * 2 + 3).alias("sequence"), F.lit("d").alias("_id"), (F.col("doc_id") * 2 + 2).alias("parent"), F.concat(F.lit("2-"), F.col("doc_id").cast("string")).alias("revid"))
    fixed = mvcc.repair_duplicates(revs.unionByName(below))
    moved = fixed.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return moved.join(fixed.select(F.col("sequence").alias("parent"), F.substring("revid", 3, 100).alias("revid")), "parent").select(((F.col("parent") - 2) / 2).cast("bigint").alias("first_id"), "n", "revid")


def _customer_store(spark, folder, name):
    from .sources.folders import fresh
    from .sources.store import DocumentStore

    store = DocumentStore(spark, fresh(spark, name))
    rows = table(spark, folder, "customer")
    store.create_many(rows.select(F.col("c_custkey").cast("string").alias("_id"), F.to_json(F.struct("c_nationkey", "c_acctbal", "c_mktsegment")).alias("json")))
    return store


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def store_find_indexed(spark, folder):
    """A find over stored JSON, answered through a materialised index."""
    store = _customer_store(spark, folder, "indexed")
    store.create_json_index(["c_mktsegment", "c_acctbal"], "by segment")
    return store.find({"c_mktsegment": "BUILDING", "c_acctbal": {"$gt": 5000}}).select(F.col("_id").alias("id"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS BIGINT) AS nation, round(c_acctbal * 100) AS cents FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (3, 7)")
def store_find_covering(spark, folder):
    """A find that an index answers alone, as it has every field that is asked for."""
    store = _customer_store(spark, folder, "covering")
    store.create_json_index(["c_nationkey", "c_acctbal"], "by nation")
    found = store.find({"$or": [{"c_acctbal": {"$lt": 0}}, {"c_nationkey": {"$in": [3, 7]}}]}, fields=["_id", "c_nationkey", "c_acctbal"])
    return found.select(F.col("_id").alias("id"), F.try_variant_get("body", "$.c_nationkey", "bigint").alias("nation"), F.round(F.try_variant_get("body", "$.c_acctbal", "double") * 100).alias("cents"))


@query(f"""WITH d AS (SELECT doc_id, lang, tk FROM {_DOCS.replace("SELECT doc_id, ", "SELECT doc_id, lang, ")}), p AS (SELECT doc_id, unnest(tk) AS t, unnest(range(len(tk))) AS i FROM d),
near AS (SELECT DISTINCT a.doc_id FROM (SELECT * FROM p WHERE t = 'the') a JOIN (SELECT * FROM p WHERE starts_with(t, 'fr')) b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 101)
SELECT CAST(doc_id AS VARCHAR) AS id FROM d WHERE lang = 'en' AND (contains(' ' || array_to_string(tk, ' ') || ' ', ' rights reserved ') OR doc_id IN (SELECT doc_id FROM near))""")
def store_text_indexed(spark, folder):
    """A search of stored documents by the postings of a text index, beside a condition on another field."""
    from .sources.folders import fresh
    from .sources.store import DocumentStore

    store = DocumentStore(spark, fresh(spark, "searched"))
    store.create_many(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.to_json(F.struct("text", "lang")).alias("json")))
    store.create_text_index(["text"], "words")
    return store.find({"lang": "en", "$text": {"$search": '"rights reserved" OR the NEAR/100 fr*'}}).select(F.col("_id").alias("id"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey IN (1, 2) THEN 2 ELSE 1 END AS generation, c_custkey = 2 AS deleted, CASE WHEN c_custkey = 1 THEN 'moved' WHEN c_custkey = 2 THEN NULL ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT 'new', 1, false, 'added'""")
def store_lifecycle(spark, folder):
    """Created, updated and deleted documents as the store's current revisions; a local document is none of them."""
    store = _customer_store(spark, folder, "lifecycle")
    store.update("1", store.read("1").revid, {"c_mktsegment": "moved"})
    store.delete("2")
    store.create({"c_mktsegment": "added"}, "new")
    store.create({"c_mktsegment": "local"}, "_local/state")
    rows = store.current()
    return rows.select(F.col("_id").alias("id"), F.substring_index("revid", "-", 1).cast("int").alias("generation"), "deleted", F.get_json_object("json", "$.c_mktsegment").alias("segment"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey = 3")
def replication_filtered(spark, folder):
    """What a replication with a selector brings to an empty store."""
    from .sources.folders import fresh
    from .sources.store import DocumentStore
    from .streaming.replication import replicate

    target = DocumentStore(spark, fresh(spark, "target"))
    replicate(_customer_store(spark, folder, "source"), target, selector={"c_nationkey": 3})
    return target.ids().select(F.col("_id").alias("id"))


@query("SELECT event_id + 1 AS number, CAST(user_id AS VARCHAR) AS id, '1-' || md5(event_type) AS revid FROM events WHERE event_id + 1 > 900 AND event_type <> 'error' AND value > 40")
def changes_source(spark, folder):
    """Events as pages of a change feed, read in parallel from a sequence on, without deleted ones, and by a selector on the documents that the pages carry."""
    from .sources import exchange, protocol
    from .sources.folders import fresh

    events = table(spark, folder, "events")
    rows = events.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").cast("string").alias("_id"), F.array(F.concat(F.lit("1-"), F.md5("event_type"))).alias("revids"), (F.col("event_type") == "error").alias("deleted"), F.to_json(F.struct("value")).alias("json"))
    protocol.change_pages(rows, 100).write.text(path := fresh(spark, "pages"))
    exchange.register(spark)
    exchange.index_pages(spark, path)
    read = spark.read.format("loomdoc_changes").load(path).where("number > 900 AND NOT deleted")
    return exchange.selected(read, {"value": {"$gt": 40}}).select("number", F.col("_id").alias("id"), F.element_at("revids", 1).alias("revid"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, '2-' || md5(c_name) AS revid, c_custkey % 5 = 0 AS deleted, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer")
def bulk_written(spark, folder):
    """Customers written as bulk requests with their histories, and read back."""
    from .sources import exchange, feeds, protocol
    from .sources.folders import fresh

    customers = table(spark, folder, "customer")
    deleted = F.col("c_custkey") % 5 == 0
    body = F.when(deleted, F.lit("{}")).otherwise(F.to_json(F.struct("c_mktsegment", "c_acctbal")))
    rows = customers.select(F.col("c_custkey").cast("string").alias("_id"), F.array(F.lit("1-a"), F.concat(F.lit("2-"), F.md5("c_name"))).alias("history"), deleted.alias("deleted"), body.alias("json"))
    exchange.register(spark)
    path = fresh(spark, "requests")
    rows.select(protocol.document().alias("value")).write.format("loomdoc_requests").option("kind", "bulk").option("size", 100).mode("append").save(path)
    back = feeds.bulk_histories(spark.read.format("loomdoc_requests").load(path))
    return back.select(F.col("_id").alias("id"), F.element_at("history", -1).alias("revid"), "deleted", F.get_json_object("json", "$.c_mktsegment").alias("segment"))


@query("SELECT l_orderkey AS order_key, l_linenumber AS line, min(l_partkey * 1000000 + l_suppkey) AS kept FROM lineitem GROUP BY l_orderkey, l_linenumber")
def repair_duplicates(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("rest")).distinct()
    # Sequences must tell rows apart: the order, then what is left of the line.
    revs = lines.select(F.struct("l_orderkey", "l_linenumber", "rest").alias("sequence"), F.col("l_orderkey").cast("string").alias("_id"), F.lit(None).cast("struct<l_orderkey:bigint,l_linenumber:int,rest:bigint>").alias("parent"), F.concat("l_linenumber", F.lit("-x")).alias("revid"))
    return mvcc.repair_duplicates(revs).select(F.col("sequence.l_orderkey").alias("order_key"), F.col("sequence.l_linenumber").alias("line"), F.col("sequence.rest").alias("kept"))


@query(f"SELECT id, max(revid) AS kept, count(*) - 1 AS lost FROM (SELECT id, revid FROM {_LINES} WHERE NOT deleted) GROUP BY id HAVING count(*) > 1")
def resolve_conflicts_udf(spark, folder):
    found = mvcc.resolve(_lines(spark, folder), lambda name, own: max(x["revid"] for x in own))
    return found.select(F.col("_id").alias("id"), "kept", F.size("losers").cast("long").alias("lost"))


@query(f"""SELECT id, max(gen) + 1 AS generation, count(*) AS merged FROM {_LINES} WHERE NOT deleted GROUP BY id HAVING count(*) > 1""")
def resolve_conflicts_merge(spark, folder):
    """Conflicts of a store resolved in one commit by new bodies, which count what they merge."""
    from .sources.folders import fresh
    from .sources.store import DocumentStore

    store = DocumentStore(spark, fresh(spark, "merged"))
    lines = _lines(spark, folder)
    store.force_insert(lines.select("_id", F.array("revid").alias("history"), "deleted", F.lit("{}").alias("json")))
    before = store.last_sequence
    store.resolve_conflicts(lambda name, leaves: {"merged": len(leaves)})
    new = store.current().where(~F.col("deleted") & (F.col("sequence") > before))
    return new.select(F.col("_id").alias("id"), F.substring_index("revid", "-", 1).cast("int").alias("generation"), F.get_json_object("json", "$.merged").cast("long").alias("merged"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS nation FROM customer WHERE c_custkey % 7 <> 0 ORDER BY id OFFSET 10 LIMIT 200")
def store_read_all(spark, folder):
    """A page of all documents in order of their creation, without deleted ones."""
    from .sources.folders import fresh
    from .sources.store import DocumentStore

    store = DocumentStore(spark, fresh(spark, "all"))
    rows = table(spark, folder, "customer")
    store.force_insert(rows.select(F.col("c_custkey").cast("string").alias("_id"), F.array(F.lit("1-a")).alias("history"), (F.col("c_custkey") % 7 == 0).alias("deleted"), F.to_json(F.struct("c_nationkey")).alias("json")))
    return store.read_all(offset=10, limit=200).select(F.col("_id").alias("id"), F.get_json_object("json", "$.c_nationkey").cast("int").alias("nation"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, string_agg(r, ',' ORDER BY r) AS missing, max(have) AS ancestors FROM (
SELECT o_orderkey, unnest(['1-a', '2-b', '3-c']) AS r, CASE WHEN o_orderkey % 3 = 2 THEN '1-a,2-b' WHEN o_orderkey % 3 = 1 THEN '1-a' END AS have, o_orderkey % 3 AS n FROM orders) WHERE CAST(left(r, 1) AS INT) > n GROUP BY o_orderkey""")
def diff_remote(spark, folder):
    """A diff request of three revisions for each order, answered from the first ones that are stored, with those that may be ancestors."""
    from .sources import protocol

    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderkey")
    every = F.array(*map(F.lit, ("1-a", "2-b", "3-c")))
    stored = orders.select((F.col("o_orderkey") * 3).alias("_from"), "_id", F.posexplode(F.slice(every, F.lit(1), (F.col("o_orderkey") % 3).cast("int"))).alias("_pos", "revid"))
    revs = stored.select((F.col("_from") + F.col("_pos")).alias("sequence"), "_id", F.when(F.col("_pos") > 0, F.col("_from") + F.col("_pos") - 1).alias("parent"), "revid", F.lit(False).alias("deleted"), F.lit(True).alias("available"), F.lit("{}").alias("json"))
    answer = protocol.diff_response(revs, protocol.diff_requests(orders.select("_id", F.explode(every).alias("revid")), 1000))
    return answer.select(F.col("_id").alias("id"), F.array_join("missing", ",").alias("missing"), F.array_join("possible_ancestors", ",").alias("ancestors"))


@query("""SELECT o_orderkey * 10 AS seq, ['missing parent', 'later parent', 'parent of another document', 'repeated sequence'][o_orderkey % 4 + 1] AS fault FROM orders WHERE o_orderkey % 5 = 0""")
def tree_faults_all(spark, folder):
    """Every kind of fault in a table of revisions, one for each fifth order, and none for the others."""
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") * 10).alias("seq"), (F.col("o_orderkey") % 5 == 0).alias("bad"), (F.col("o_orderkey") % 4).alias("kind"))
    whole = (F.lit(True).alias("available"), F.lit("{}").alias("json"))
    name = F.col("o_orderkey").cast("string").alias("_id")
    first = orders.select((F.col("seq") + 1).alias("sequence"), name, F.lit(None).cast("bigint").alias("parent"), F.lit("1-a").alias("revid"), F.lit(False).alias("deleted"), *whole)
    # Document `x...` owns the parent that another document's revision names.
    other = orders.where("bad AND kind = 2").select((F.col("seq") + 2).alias("sequence"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("_id"), F.lit(None).cast("bigint").alias("parent"), F.lit("1-b").alias("revid"), F.lit(False).alias("deleted"), *whole)
    parent = F.when(F.col("kind") == 0, F.col("seq") + 9).when(F.col("kind") == 1, F.col("seq") + 1).when(F.col("kind") == 2, F.col("seq") + 2)
    wrong = orders.where("bad AND kind < 3").select("seq", name, parent.alias("parent"), F.lit("2-c").alias("revid"))
    wrong = wrong.select(F.col("seq").alias("sequence"), "_id", "parent", "revid", F.lit(False).alias("deleted"), *whole)
    twice = orders.where("bad AND kind = 3").select(F.col("seq").alias("sequence"), name, F.lit(None).cast("bigint").alias("parent"), F.explode(F.array(F.lit("1-d"), F.lit("1-e"))).alias("revid"), F.lit(False).alias("deleted"), *whole)
    return mvcc.faults(first.unionByName(other).unionByName(wrong).unionByName(twice)).select(F.col("sequence").alias("seq"), "fault")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, '2-' || md5(c_name) AS revid, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0")
def fetch_missing(spark, folder):
    """Of published revisions those that a diff against what is stored asks for."""
    from .sources import fetch
    from .sources.folders import fresh

    customers = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.concat(F.lit("2-"), F.md5("c_name")).alias("revid"), "c_custkey", "c_mktsegment")
    fetch.publish(customers.select("_id", F.array(F.lit("1-a"), "revid").alias("history"), F.lit(False).alias("deleted"), F.to_json(F.struct("c_mktsegment")).alias("json")), path := fresh(spark, "revisions"), buckets=8)
    missing = mvcc.revs_diff(customers.where("c_custkey % 3 = 0"), customers)
    return fetch.fetch(spark, path, missing).select(F.col("_id").alias("id"), "revid", F.get_json_object("json", "$.c_mktsegment").alias("segment"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 2 + 1 AS generation, c_mktsegment AS segment FROM customer")
def push_rounds(spark, folder):
    """Customers, every second one updated, pushed by rounds in bulk requests and merged into another store."""
    from .sources.folders import fresh
    from .sources.store import DocumentStore
    from .streaming import rounds

    customers = table(spark, folder, "customer")
    history = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("1-a"))).otherwise(F.array(F.lit("1-a"), F.lit("2-b")))
    store, target = DocumentStore(spark, fresh(spark, "near")), DocumentStore(spark, fresh(spark, "far"))
    store.force_insert(customers.select(F.col("c_custkey").cast("string").alias("_id"), history.alias("history"), F.lit(False).alias("deleted"), F.to_json(F.struct("c_mktsegment")).alias("json")))
    remote = fresh(spark, "remote")
    rounds.Rounds(store, remote).push(limit=1 + store.last_sequence // 2)
    rounds.receive(target, remote)
    rows = target.current()
    return rows.select(F.col("_id").alias("id"), F.substring_index("revid", "-", 1).cast("int").alias("generation"), F.get_json_object("json", "$.c_mktsegment").alias("segment"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 97 = 5 ORDER BY o_orderkey LIMIT 12")
def store_point_reads(spark, folder):
    """Documents read one by one from a compacted store, each from its own bucket."""
    from .sources import store as stores
    from .sources.folders import fresh

    store = stores.DocumentStore(spark, fresh(spark, "points"))
    orders = table(spark, folder, "orders")
    store.create_many(orders.select(F.col("o_orderkey").cast("string").alias("_id"), F.to_json(F.struct("o_orderstatus")).alias("json")))
    store.compact()
    asked = [str(r.o_orderkey) for r in orders.where("o_orderkey % 97 = 5").orderBy("o_orderkey").limit(12).collect()]
    rows = [store.read(x) for x in asked]
    return spark.createDataFrame([(r["_id"], r.json) for r in rows], "id string, json string").select("id", F.get_json_object("json", "$.o_orderstatus").alias("status"))


@query("SELECT item_id, sha1(text) AS key, CAST(strlen(text) AS BIGINT) AS length FROM benchmark")
def attachment_key(spark, folder):
    from .sources.attachments import prepared

    blobs = prepared(table(spark, folder, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content")))
    return blobs.select("item_id", "key", "length")


@query("SELECT sha1(text) AS key, CAST(min(strlen(text)) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL GROUP BY sha1(text)")
def attachment_dedupe(spark, folder):
    from .sources.attachments import deduplicated, prepared

    blobs = table(spark, folder, "documents").where("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    return deduplicated(prepared(blobs)).select("key", "length")


@query("SELECT CAST(user_id AS VARCHAR) AS id, event_id AS winner, deleted FROM " + _EVENT_WINNERS)
def stream_changes_latest(spark, folder):
    from .streaming.latest import latest_of_stream

    shape = table(spark, folder, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "*.parquet").parquet(_as_folder(spark, f"{folder}/events.parquet"))
    revs = stream.select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("_id"), F.concat(F.lit("1-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("revid"), (F.col("event_type") == "error").alias("deleted"))
    return latest_of_stream(revs).select(F.col("_id").alias("id"), F.col("sequence").alias("winner"), "deleted")


_BRANCHED = f"""(SELECT conv_id, turn, revid, false AS deleted, conv_id * 100000 + turn AS seq, turn + 1 AS gen, split_part(revid, '-', 2) AS part FROM {_TURNS}
UNION ALL SELECT conv_id, 1, '2-zz', conv_id % 6 = 0, conv_id * 100000 + 50000, 2, 'zz' FROM (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND conv_id % 3 = 0))"""


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS id, seq AS winner, revid, deleted FROM {_BRANCHED} a
WHERE NOT EXISTS (SELECT 1 FROM {_BRANCHED} b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.seq <> a.conv_id * 100000 + 50000 AND (b.seq <> b.conv_id * 100000 + 50000 OR a.turn = 0))
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY deleted ASC, gen DESC, part DESC) = 1""")
def stream_winners_tree(spark, folder):
    """Winners of trees whose revisions come in batches and out of order; every third conversation has a second branch from its first turn, dead in half of them."""
    from .sources.folders import fresh
    from .streaming.winners import winners_of_stream

    turns = _turns(spark, folder)
    first = turns.where((F.col("sequence") % 100_000 == 0) & (F.col("_id").cast("bigint") % 3 == 0))
    branch = first.select(
        (F.col("sequence") + 50_000).alias("sequence"), "_id", F.col("sequence").alias("parent"), F.lit("2-zz").alias("revid"), (F.col("_id").cast("bigint") % 6 == 0).alias("deleted"), "available", "json"
    )
    dealt = turns.unionByName(branch).drop("json", "available").withColumn("_batch", F.pmod(F.xxhash64("sequence"), F.lit(4)))
    dealt.repartition(4, "_batch").drop("_batch").write.parquet(path := fresh(spark, "trees"))
    stream = spark.readStream.schema("sequence bigint, _id string, parent bigint, revid string, deleted boolean").option("maxFilesPerTrigger", 2).parquet(path)
    return winners_of_stream(stream).select(F.col("_id").alias("id"), F.col("sequence").alias("winner"), "revid", "deleted")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def scan_paged(spark, folder):
    return find(table(spark, folder, "orders"), {}, skip=100, limit=50, fields=["o_orderkey", "o_custkey", "o_totalprice"], sort=["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7, 3, 11)")
def scan_multi_get(spark, folder):
    return multi_get(table(spark, folder, "customer").select("c_custkey", "c_name"), [7, 3, 999_999_999, 7, 11], "c_custkey")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 25")
def sort_variant(spark, folder):
    bodies = table(spark, folder, "events").withColumn("body", F.parse_json("props"))
    return find(bodies, {}, limit=25, sort=[("k", "desc"), ("event_id", "asc")]).select("event_id", F.try_variant_get("body", "$.k", "double").alias("k"))


@query(f"SELECT id, string_agg(revid, ',' ORDER BY turn DESC) AS ancestors FROM (SELECT CAST(conv_id AS VARCHAR) AS id, turn, revid FROM {_TURNS} WHERE turn + 1 < 4) GROUP BY id")
def possible_ancestors(spark, folder):
    turns = _turns(spark, folder)
    wanted = turns.select("_id", F.lit("4-unknown").alias("revid")).distinct()
    return mvcc.possible_ancestors(turns, wanted).select(F.col("_id").alias("id"), F.array_join("ancestors", ",").alias("ancestors"))


@query("SELECT l_orderkey AS order_key, l_linenumber AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def index_projection(spark, folder):
    from .sources.indexes import Index, projection

    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_set("l_linenumber").alias("line"))
    return projection(lines, Index("lines", ("order_key", "line")))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'stub' WHEN strlen(coalesce(html, '')) <= 65536 THEN 'inline' ELSE 'follows' END AS kind FROM pages")
def attachment_inline(spark, folder):
    from .sources.attachments import inline

    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = table(spark, folder, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("_id"), F.lit("2-x").alias("revid"), F.lit("page").alias("filename"), F.octet_length(content).cast("long").alias("length"),
        F.when(F.col("page_id") % 3 == 0, 1).otherwise(2).alias("revpos"), F.lit(1).alias("ancestor_generation"), content.alias("content"),
    )
    return inline(rows).select("page_id", "kind")


@query("SELECT item_id, CAST(strlen(text) AS BIGINT) AS length, true AS same FROM benchmark")
def attachment_codecs(spark, folder):
    from .sources.attachments import decrypted, encrypted, gunzipped, gzipped

    key, vector = F.unhex(F.lit("0f" * 16)), F.unhex(F.substring(F.md5(F.col("item_id").cast("string").cast("binary")), 1, 32))
    coded = table(spark, folder, "benchmark").withColumn("content", F.encode("text", "UTF-8")).withColumn("stored", encrypted(gzipped("content"), key, vector))
    read = gunzipped(decrypted("stored", key))
    return coded.select("item_id", F.octet_length(read).cast("long").alias("length"), (read == F.col("content")).alias("same"))


def _as_folder(spark: SparkSession, path: str) -> str:
    """A file stream reads folders: of a single file, its folder and only this name by glob."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    is_folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    return path if is_folder else path.replace("events.parquet", "event[s].parquet")
