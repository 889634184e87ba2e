"""Pull and push with a remote by rounds, each bounded by a page of changes and ended by a checkpoint.

A remote is a folder with the protocol's files: `pages` of its change feed, `revisions` in a keyed layout, and `requests` that others have written
to it.  `serve` makes the first two from a store; `receive` takes in the requests.

A pull round reads a page of changes after the checkpoint, asks the store what it lacks, fetches just that, merges it and
records the sequence.  A push round takes a window of the store's sequences, asks the remote what it lacks, writes bulk requests with attachments
inlined, and records the window.  A round that was cut off before its checkpoint runs again and adds nothing twice: revisions keep their ids.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mvcc
from ..plans.errors import NotFoundError
from ..sources import attachments as att
from ..sources import exchange, feeds, fetch, folders, protocol
from ..sources.store import DocumentStore
from .replication import replication_id

#: Results of a page, and revisions of a bulk request.
PAGE, BULK = 1000, 100


def histories(store: DocumentStore, revs: DataFrame | None = None) -> DataFrame:
    """The leaves of a store's trees, or those of some documents, with their histories and sequences."""
    revs = store.revs if revs is None else revs
    ends = mvcc.leaves(revs).select("sequence", "deleted", "json")
    return mvcc.paths(revs).join(ends, "sequence").select("sequence", "_id", F.reverse("path").alias("history"), "deleted", F.coalesce("json", F.lit("{}")).alias("json"))


def serve(store: DocumentStore, remote: str, results: int = PAGE) -> None:
    """Writes a store's change feed and revisions for others to pull."""
    found = histories(store)
    last = store.revs.groupBy("_id").agg(F.max("sequence").alias("seq"))
    ends = found.groupBy("_id").agg(F.sort_array(F.collect_list(F.element_at("history", -1)), asc=False).alias("revids"))
    current = store.current().select("_id", "deleted")
    protocol.change_pages(last.join(ends, "_id").join(current, "_id").select("seq", "_id", "revids", "deleted"), results).write.text(f"{remote}/pages")
    exchange.index_pages(store.spark, f"{remote}/pages")
    fetch.publish(found, f"{remote}/revisions")


class Rounds:
    """Rounds between a store and a remote folder; the checkpoint is a local document of the store."""

    def __init__(self, store: DocumentStore, remote: str, doc_ids: Sequence[str] | None = None):
        self.store, self.remote, self.doc_ids = store, remote.rstrip("/"), doc_ids
        exchange.register(store.spark)

    def _id(self, way: str) -> str:
        ends = (self.remote, self.store.path) if way == "pull" else (self.store.path, self.remote)
        return replication_id(*ends, doc_ids=self.doc_ids)

    def checkpoint(self, way: str) -> int:
        """The sequence up to which rounds are done."""
        try:
            return json.loads(self.store.read_local(f"_local/{self._id(way)}").json)["lastSequence"]
        except NotFoundError:
            return 0

    def _record(self, way: str, sequence: int) -> None:
        self.store.put_local(f"_local/{self._id(way)}", {"lastSequence": sequence})

    def pull_round(self, limit: int = PAGE) -> int | None:
        """One page; the number of new revisions, None if there was nothing to read."""
        spark = self.store.spark
        read = spark.read.format("loomdoc_changes").option("since", self.checkpoint("pull")).option("limit", limit).load(f"{self.remote}/pages")
        page = folders.written(read, "page")
        end = page.agg(F.max("number")).first()[0]
        if end is None:
            return None
        missing = mvcc.revs_diff(self.store.revs, feeds.wanted(exchange.selected(page, doc_ids=self.doc_ids)))
        added = self.store.force_insert(fetch.fetch(spark, f"{self.remote}/revisions", missing).drop("revid"))
        self._record("pull", end)
        folders.discard(page)
        return added

    def pull(self, limit: int = PAGE, most: int | None = None) -> int:
        """Rounds until nothing is left, or at most so many; the number of new revisions."""
        return self._repeated(lambda: self.pull_round(limit), most)

    def push_round(self, limit: int = PAGE) -> int | None:
        """One window of the store's sequences; the number of revisions in requests, None if there was nothing to send."""
        since = self.checkpoint("push")
        end = min(since + limit, self.store.last_sequence)
        if end <= since:
            return None
        changed = self.store.revisions(since + 1, end).select("_id").distinct()
        if self.doc_ids is not None:
            changed = changed.where(F.col("_id").isin(list(self.doc_ids)))
        found = histories(self.store, self.store.revs.join(changed, "_id", "left_semi"))
        asked = found.select("sequence", "_id", F.element_at("history", -1).alias("revid"), "history", "deleted", "json")
        lacking = mvcc.revs_diff(self._known(), asked).select("_id", F.explode("missing").alias("revid"))
        sent = folders.written(self._inlined(asked.join(lacking, ["_id", "revid"])), "sent")
        n = sent.count()
        if n:
            sent.select(protocol.document().alias("value")).write.format("loomdoc_requests").option("kind", "bulk").option("size", BULK).mode("append").save(f"{self.remote}/requests")
        self._record("push", end)
        folders.discard(sent)
        return n

    def push(self, limit: int = PAGE, most: int | None = None) -> int:
        """Rounds until nothing is left, or at most so many; the number of revisions in requests."""
        return self._repeated(lambda: self.push_round(limit), most)

    @staticmethod
    def _repeated(round_, most: int | None) -> int:
        total, n = 0, 0
        while most is None or n < most:
            if (added := round_()) is None:
                break
            total, n = total + added, n + 1
        return total

    def _known(self) -> DataFrame:
        """(_id, revid) that the remote has: those of its revisions, with all ancestors, and of the requests that wait there."""
        spark = self.store.spark
        known = [feeds.bulk_histories(spark.read.format("loomdoc_requests").option("kind", "bulk").load(f"{self.remote}/requests")).select("_id", "history")]
        if folders.names(spark, f"{self.remote}/revisions"):
            known.append(spark.read.option("recursiveFileLookup", "true").schema(fetch.SCHEMA).parquet(f"{self.remote}/revisions").select("_id", "history"))
        every = known[0] if len(known) == 1 else known[0].unionByName(known[1])
        return every.select("_id", F.explode("history").alias("revid")).distinct()

    def _inlined(self, rows: DataFrame) -> DataFrame:
        """Revisions with the attachments of their sequences in their bodies."""
        if not self.store.manifest["parts"]["attachments"]:
            return rows
        lines = self.store.table("attachments").join(rows.select("sequence", "_id", "revid"), "sequence").join(self.store.blobs().dropDuplicates(["key"]), "key")
        zipped = F.col("encoding") == att.GZIP
        content = F.coalesce(att.gunzipped(F.when(zipped, F.col("content"))), F.col("content"))  # a Python function sees every row
        # The remote has no ancestor of what it lacks for sure, so every attachment goes along.
        lines = att.inline(lines.withColumn("content", content).withColumn("ancestor_generation", F.lit(None).cast("int")), mode="all")
        one = F.struct(F.col("type").alias("content_type"), F.col("data"), "revpos")
        held = lines.groupBy("sequence").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("filename", one)))).alias("_held"))
        head = F.concat(F.lit('{"_attachments":'), F.col("_held"))
        inside = F.substring(F.trim("json"), 2, 2**31 - 1)
        body = F.when(F.col("_held").isNull(), F.col("json")).otherwise(F.concat(head, F.when(F.trim(inside) == "}", "}").otherwise(F.concat(F.lit(","), inside))))
        return rows.join(held, "sequence", "left").withColumn("json", body).drop("_held")


def receive(store: DocumentStore, remote: str) -> int:
    """Merges the bulk requests that wait in a remote's folder into its store, with the attachments in them; the number of new revisions."""
    exchange.register(store.spark)
    requests = store.spark.read.format("loomdoc_requests").option("kind", "bulk").load(f"{remote}/requests")
    docs = requests.select(F.explode(F.variant_get(F.parse_json("value"), "$.docs", "array<variant>")).alias("d"))
    added = store.force_insert(feeds.histories(docs.select(F.to_json("d").alias("json"))))
    form = "map<string,struct<content_type:string,data:string,revpos:int>>"
    held = docs.select(F.variant_get("d", "$._id", "string").alias("_id"), F.variant_get("d", "$._rev", "string").alias("revid"), F.explode(F.from_json(F.to_json(F.try_variant_get("d", "$._attachments", "variant")), form)).alias("filename", "a"))
    rows = held.select("_id", "revid", "filename", F.unbase64("a.data").alias("content"), F.col("a.content_type").alias("type"), F.col("a.revpos").alias("revpos"))
    lines = rows.join(store.revs.select("_id", "revid", "sequence"), ["_id", "revid"]).withColumn("key", F.sha1("content"))
    lines = lines.join(store.table("attachments").select("sequence", "filename"), ["sequence", "filename"], "left_anti").dropDuplicates(["sequence", "filename"])
    lines = folders.written(lines, "received")
    if lines.limit(1).count():
        blobs = lines.select("key", "content").dropDuplicates(["key"]).join(store.table("blobs").select("key"), "key", "left_anti")
        kept = lines.select("sequence", "filename", "key", "type", F.lit("plain").alias("encoding"), F.octet_length("content").cast("long").alias("length"), "revpos")
        store.commit({"attachments": kept, "blobs": store.sealed(blobs)})
    return added
