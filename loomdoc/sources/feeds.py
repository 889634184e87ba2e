"""Documents of the replication protocol as tables: change feeds, revision histories, fetched revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.revisions import full_history

#: Names with a meaning of their own in a revision's JSON; other names that start with _ are refused.
SPECIAL = ("_id", "_rev", "_deleted", "_attachments", "_revisions", "_conflicts", "_deleted_conflicts", "_revs_info", "_local_seq")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Each file's JSON as a VARIANT column v."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))


def change_feed(spark: SparkSession, path: str) -> DataFrame:
    """seq, _id, revids and deleted of the results in change feed files; sequences are numbers or strings, kept as text."""
    results = _whole(spark, path).select(F.explode(F.variant_get("v", "$.results", "array<variant>")).alias("r"))
    return results.select(
        F.coalesce(F.try_variant_get("r", "$.seq", "string"), F.to_json(F.try_variant_get("r", "$.seq", "variant"))).alias("seq"),
        F.variant_get("r", "$.id", "string").alias("_id"),
        F.transform(F.variant_get("r", "$.changes", "array<variant>"), lambda c: F.variant_get(c, "$.rev", "string")).alias("revids"),
        F.coalesce(F.try_variant_get("r", "$.deleted", "boolean"), F.lit(False)).alias("deleted"),
    )


def wanted(feed: DataFrame) -> DataFrame:
    """(_id, revid) of a feed, for `mvcc.revs_diff`; results without an id are left out."""
    return feed.where("_id is not null and _id <> ''").select("_id", F.explode("revids").alias("revid")).distinct()


def histories(docs: DataFrame, json: str = "json") -> DataFrame:
    """Revisions with `_revisions: {start, ids}` as rows for `mvcc.merge_history`; of a body the special names are dropped, and an unknown one is an error."""
    rows = docs.select(F.parse_json(json).alias("v"), F.from_json(json, "map<string,string>").alias("_names"))
    start, ids = F.variant_get("v", "$._revisions.start", "int"), F.variant_get("v", "$._revisions.ids", "array<string>")
    bad = F.filter(F.map_keys("_names"), lambda k: k.startswith("_") & ~k.isin(*SPECIAL))
    fields = F.filter(F.map_keys("_names"), lambda k: ~k.startswith("_"))
    # The object's own text for each value, so numbers and strings stay what they are.
    value = lambda k: F.to_json(F.element_at(F.from_json(F.to_json("v"), "map<string,variant>"), k))
    body = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda k: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), value(k))), ","), F.lit("}"))
    checked = F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("reserved names: "), F.array_join(bad, ","))).cast("string")).otherwise(body)
    return rows.select(
        F.variant_get("v", "$._id", "string").alias("_id"),
        F.coalesce(full_history(start, ids), F.array(F.variant_get("v", "$._rev", "string"))).alias("history"),
        F.coalesce(F.try_variant_get("v", "$._deleted", "boolean"), F.lit(False)).alias("deleted"),
        checked.alias("json"),
    )


def bulk_docs(spark: SparkSession, path: str) -> DataFrame:
    """The `docs` of bulk files, or a file's only document, as histories."""
    return bulk_histories(spark.read.text(path, wholetext=True))


def bulk_histories(requests: DataFrame) -> DataFrame:
    """The `docs` of bulk requests (value), or a request's only document, as histories."""
    parsed = requests.select(F.parse_json("value").alias("v"))
    docs = parsed.select(F.coalesce(F.try_variant_get("v", "$.docs", "array<variant>"), F.array("v")).alias("docs"))
    return histories(docs.select(F.explode("docs").alias("d")).select(F.to_json("d").alias("json")))


def open_revisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fetched revisions as histories, and the revision ids that were missing."""
    rows = _whole(spark, path).select(F.explode(F.variant_get("v", "$", "array<variant>")).alias("r"))
    found = rows.select(F.try_variant_get("r", "$.ok", "variant").alias("ok")).where("ok is not null")
    return histories(found.select(F.to_json("ok").alias("json"))), rows.select(F.try_variant_get("r", "$.missing", "string").alias("revid")).where("revid is not null")
