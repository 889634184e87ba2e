"""The replication protocol's messages, written and read as tables.

Messages are JSON texts in a column `value`, ready for `write.text` or the formats of `exchange`; `feeds` reads the
documents that come back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.revisions import short_history
from ..operators import mvcc
from .exchange import CHANGES, number_of, register

__all__ = ["CHANGES", "bulk_requests", "change_page", "change_pages", "checkpoint_document", "diff_requests", "diff_response", "document", "number_of", "register"]


def change_page(revs: DataFrame, since: int = 0, limit: int = 500) -> DataFrame:
    """One page of the feed: documents changed in the window of limit sequences after since, by sequence, with the ids of their leaves."""
    changed = mvcc.changes(revs, since, limit).select("_id", "last_sequence", "deleted")
    leaves = mvcc.leaves(revs).groupBy("_id").agg(F.sort_array(F.collect_list("revid"), asc=False).alias("_leaves"))
    row = F.struct(F.col("last_sequence").alias("seq"), F.col("_id").alias("id"), F.transform("_leaves", lambda x: F.struct(x.alias("rev"))).alias("changes"), F.when(F.col("deleted"), True).alias("deleted"))
    listed = changed.join(leaves, "_id").agg(F.array_sort(F.collect_list(row)).alias("results"), F.coalesce(F.max("last_sequence"), F.lit(max(since, 0))).alias("last_seq"))
    return listed.select(F.to_json(F.struct("results", "last_seq")).alias("value"))


def change_pages(changes: DataFrame, results: int = 500) -> DataFrame:
    """Pages of changes (seq bigint, _id, revids, deleted, json or null), each of the sequences of a window of `results` numbers; neighbouring pages are in one partition."""
    doc = F.parse_json("json") if "json" in changes.columns else F.lit(None).cast("string")
    row = F.struct(F.col("seq"), F.col("_id").alias("id"), F.transform("revids", lambda x: F.struct(x.alias("rev"))).alias("changes"), F.when(F.col("deleted"), True).alias("deleted"), doc.alias("doc"))
    rows = changes.select(F.floor((F.col("seq") - 1) / results).alias("page"), F.col("seq"), F.to_json(row).alias("row"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "row"))).alias("rows"))
    value = F.concat(F.lit('{"results":['), F.array_join(F.transform("rows", lambda x: x["row"]), ","), F.lit('],"last_seq":'), F.element_at("rows", -1)["seq"].cast("string"), F.lit("}"))
    return pages.repartitionByRange("page").sortWithinPartitions("page").select(value.alias("value"))


def document(body: str = "json") -> F.Column:
    """JSON of a revision (_id, history oldest first, deleted and its body's JSON) with its protocol fields before its own."""
    newest = F.element_at("history", -1)
    head = F.to_json(F.struct(F.col("_id"), newest.alias("_rev"), F.when(F.col("deleted"), True).alias("_deleted"), short_history("history").alias("_revisions")))
    inside = F.substring(F.trim(F.coalesce(body, F.lit("{}"))), 2, 2**31 - 1)
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.when(F.trim(inside) == "}", "}").otherwise(F.concat(F.lit(","), inside)))


def bulk_requests(histories: DataFrame, size: int = 10) -> DataFrame:
    """Bulk requests of at most size revisions of one partition each (_id, history, deleted, json), that keep their revision ids."""
    rows = histories.select(document().alias("_doc"), F.floor(F.monotonically_increasing_id() / size).alias("_batch"))
    joined = F.concat(F.lit('{"new_edits":false,"docs":['), F.array_join(F.collect_list("_doc"), ","), F.lit("]}"))
    return rows.groupBy("_batch").agg(joined.alias("value")).select("value")


def diff_requests(wanted: DataFrame, size: int = 500) -> DataFrame:
    """Revision diff requests: {id: [revision ids]} of wanted (_id, revid), at most about size documents each."""
    listed = wanted.groupBy("_id").agg(F.array_sort(F.collect_set("revid")).alias("_revids"))
    rows = listed.withColumn("_batch", F.floor(F.monotonically_increasing_id() / size))
    return rows.groupBy("_batch").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("_id", "_revids")))).alias("value")).select("value")


def diff_response(revs: DataFrame, requests: DataFrame) -> DataFrame:
    """_id, missing and possible_ancestors for diff requests (value): what the target lacks, and which stored revisions may be ancestors of it."""
    asked = requests.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("_id", "_revids")).select("_id", F.explode("_revids").alias("revid"))
    missing = mvcc.revs_diff(revs, asked)
    lacking = missing.select("_id", F.explode("missing").alias("revid"))
    near = mvcc.possible_ancestors(revs, lacking).groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ancestors")))).alias("possible_ancestors"))
    return missing.join(near, "_id", "left")


def checkpoint_document(replication_id: str, sequence: int | str) -> str:
    """The local document that records how far a replication has come."""
    return json.dumps({"_id": f"_local/{replication_id}", "lastSequence": sequence})
