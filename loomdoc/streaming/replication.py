"""Replication between stores: a stream of revisions, filtered, merged batch by batch.

The source's revision parts are a file stream.  Each batch is brought to whole
histories, reduced to what the target lacks, merged with them, and a checkpoint document
is kept in the target.  Spark's own checkpoint makes restarts go on where
they stopped; a batch that runs again adds nothing, as known revisions are skipped.
"""

from __future__ import annotations

import hashlib
import json
import threading
import weakref
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import mvcc
from ..operators.predicates import predicate
from ..plans.errors import NotFoundError, QueryError
from ..sources import events as ev
from ..sources.store import SCHEMAS, DocumentStore

FILTERS: dict[str, Callable[[DataFrame, dict], Column]] = {}


def register_filter(name: str, condition: Callable[[DataFrame, dict], Column]) -> None:
    """condition(documents, parameters) decides which documents a named filter lets through."""
    FILTERS[name] = condition


def replication_id(source: str, target: str, filter: str | None = None, parameters: dict | None = None, selector: dict | None = None, doc_ids: Sequence[str] | None = None) -> str:
    """SHA-1 of what is replicated, the name of its checkpoints."""
    what = {"source": source, "target": target}
    if filter:
        what["filter"] = {"name": filter, "parameters": parameters or {}}
    if selector:
        what["selector"] = selector
    if doc_ids:
        what["docIds"] = sorted(doc_ids)
    return hashlib.sha1(json.dumps(what, sort_keys=True).encode()).hexdigest()


class _Follower(StreamingQueryListener):
    """Tells replications how their streams go, as the engine sees it."""

    def __init__(self):
        self.running: dict[str, Replicator] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 (names of the interface)
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if (own := self.running.get(str(event.progress.runId))) is not None:
            own.progress = event.progress.batchId

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if (own := self.running.pop(str(event.runId), None)) is not None:
            own.ended(event.exception)


_followers: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _follower(spark: SparkSession) -> _Follower:
    """The session's follower, which is a listener of its streams."""
    if spark not in _followers:
        _followers[spark] = _Follower()
        spark.streams.addListener(_followers[spark])
    return _followers[spark]


class Replicator:
    """One replication and its state: PENDING, STARTED, STOPPING, STOPPED, COMPLETE or ERROR.

    The engine drives the state: a stream that ends or dies sets it and posts its event, whether or not somebody waits.
    """

    def __init__(
        self,
        source: DocumentStore,
        target: DocumentStore,
        *,
        filter: str | None = None,
        parameters: dict | None = None,
        selector: dict | None = None,
        doc_ids: Sequence[str] | None = None,
        push_filter: Callable[[DataFrame], Column] | None = None,
        bus: ev.EventBus | None = None,
    ):
        if sum(x is not None for x in (filter, selector, doc_ids)) > 1:
            raise QueryError("a filter, a selector and document ids exclude each other")
        if filter is not None and filter not in FILTERS:
            raise QueryError(f"unknown filter {filter}")
        self.source, self.target, self.bus = source, target, bus or target.bus
        self.filter, self.parameters, self.selector, self.doc_ids, self.push_filter = filter, parameters or {}, selector, doc_ids, push_filter
        self.id = replication_id(source.path, target.path, filter, parameters, selector, doc_ids)
        self.state, self.error, self.documents, self.batches, self.query = "PENDING", None, 0, 0, None
        self.progress, self.last, self._lock, self._over = -1, None, threading.Lock(), threading.Event()

    def _wanted(self, changed: DataFrame) -> DataFrame:
        """Revisions whose document passes; local filters see the revision's body."""
        rows = changed.select("_id", F.col("revid").alias("_rev"), "deleted", F.parse_json(F.coalesce("json", F.lit("{}"))).alias("body"), "sequence")
        if self.doc_ids is not None:
            rows = rows.where(F.col("_id").isin(list(self.doc_ids)))
        if self.selector is not None:
            rows = rows.where(predicate(rows, self.selector))
        if self.filter is not None:
            rows = rows.where(FILTERS[self.filter](rows, self.parameters))
        if self.push_filter is not None:
            rows = rows.where(self.push_filter(rows))
        return rows.select("sequence")

    def _merge(self, batch: DataFrame, number: int) -> None:
        source = DocumentStore(self.source.spark, self.source.path, key=self.source.key)
        changed = batch.select("_id").distinct()
        trees = source.revs.join(changed, "_id", "left_semi")
        chosen = mvcc.leaves(trees)
        chosen = chosen.join(self._wanted(chosen), "sequence", "left_semi")
        histories = mvcc.paths(trees).join(chosen.select("sequence", "deleted", "json"), "sequence").select("_id", F.reverse("path").alias("history"), "deleted", "json")
        self.documents += self.target.force_insert(self._missing(histories))
        self._attachments(source, trees)
        self.batches += 1
        seen = batch.agg(F.max("sequence")).first()[0]
        self.target.put_local(f"_local/{self.id}", {"lastSequence": max(seen or 0, self.checkpoint())})

    def _missing(self, histories: DataFrame) -> DataFrame:
        have = self.target.revs.select(F.col("_id").alias("_have_id"), F.col("revid").alias("_have"))
        return histories.join(have, (F.col("_id") == F.col("_have_id")) & (F.element_at("history", -1) == F.col("_have")), "left_anti")

    def _attachments(self, source: DocumentStore, trees: DataFrame) -> None:
        """Attachments of merged revisions, by revision id, and the blobs that the target lacks."""
        lines = source.table("attachments").join(trees.select("sequence", "_id", "revid"), "sequence").drop("sequence")
        new = lines.join(self.target.revs.select("_id", "revid", "sequence"), ["_id", "revid"])
        new = new.join(self.target.table("attachments").select("sequence", "filename"), ["sequence", "filename"], "left_anti").select("sequence", "filename", "key", "type", "encoding", "length", "revpos")
        if new.limit(1).count():
            blobs = source.blobs().join(new.select("key").distinct(), "key", "left_semi").join(self.target.table("blobs").select("key"), "key", "left_anti").dropDuplicates(["key"])
            self.target.commit({"attachments": new, "blobs": self.target.sealed(blobs)})

    def checkpoint(self) -> int:
        """The greatest sequence of the batches that were merged, 0 before the first."""
        try:
            return json.loads(self.target.read_local(f"_local/{self.id}").json)["lastSequence"]
        except NotFoundError:
            return 0

    def start(self, interval: str | None = None) -> Replicator:
        """Streams what there is, or goes on every interval until stopped; does nothing while it runs."""
        if self.state in ("STARTED", "STOPPING"):
            return self
        if not self.source.files.names(f"{self.source.path}/revs"):
            self.state = "COMPLETE"
            self.bus.post(ev.ReplicationCompleted(self.id, 0, 0))
            return self
        # Folders of buckets are no columns; a part that expired is in a compacted one, which the stream has as well.
        reader = self.source.spark.readStream.schema(SCHEMAS["revs"]).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        stream = reader.parquet(f"{self.source.path}/revs/*")
        writer = stream.writeStream.foreachBatch(self._merge).option("checkpointLocation", f"{self.target.path}/replication/{self.id}")
        follower = _follower(self.source.spark)
        self.error, self.last = None, interval
        self._over.clear()
        self.state = "STARTED"
        with self._lock:
            self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
            follower.running[str(self.query.runId)] = self
        if not self.query.isActive:  # it was over before it was followed
            self._settle(follower)
        return self

    def _settle(self, follower: _Follower) -> None:
        """What the follower may have missed."""
        if follower.running.pop(str(self.query.runId), None) is not None:
            failed = self.query.exception()
            self.ended(None if failed is None else str(failed))

    def ended(self, failed: str | None) -> None:
        """The stream is over: sets the state and posts the event, once for each start."""
        with self._lock:
            if self._over.is_set():
                return
            if failed is not None:
                self.error = self.error or RuntimeError(failed)
                self.state, event = "ERROR", ev.ReplicationErrored(self.id, self.error)
            else:
                self.state, event = "STOPPED" if self.state == "STOPPING" else "COMPLETE", ev.ReplicationCompleted(self.id, self.documents, self.batches)
            self._over.set()
        self.bus.post(event)

    def wait(self) -> Replicator:
        """Waits for the end of a replication that streams what there is."""
        if self.query is None:
            return self
        try:
            self.query.awaitTermination()
        finally:
            self._settle(_follower(self.source.spark))
            self._over.wait(30)
        return self

    def stop(self) -> Replicator:
        if self.state == "STARTED":
            self.state = "STOPPING"
            self.query.stop()
            self._settle(_follower(self.source.spark))
            self._over.wait(30)
        return self


class Policy:
    """Keeps replications running: those that are not are started again with the interval that they had, at each look and at most so often."""

    def __init__(self, replicators: Sequence[Replicator], interval: str = "1 minute", most: int | None = None):
        self.replicators, self.interval, self.most, self.restarts = list(replicators), interval, most, 0
        self._timer: threading.Timer | None = None
        self._stopped = True

    def look(self) -> int:
        """Starts what does not run; how many."""
        n = 0
        for x in self.replicators:
            if x.state not in ("STARTED", "STOPPING") and (self.most is None or self.restarts < self.most):
                self.restarts += x.state != "PENDING"
                x.start(interval=x.last or self.interval)
                n += 1
        return n

    def start(self, seconds: float = 60) -> Policy:
        """Looks now and every so many seconds until stopped."""
        self._stopped = False

        def again() -> None:
            if not self._stopped:
                self.look()
                self._timer = threading.Timer(seconds, again)
                self._timer.daemon = True
                self._timer.start()

        again()
        return self

    def stop(self) -> None:
        """Stops looking and every replication."""
        self._stopped = True
        if self._timer is not None:
            self._timer.cancel()
        for x in self.replicators:
            x.stop()


def replicate(source: DocumentStore, target: DocumentStore, **options) -> Replicator:
    """Runs a replication to its end."""
    return Replicator(source, target, **options).start().wait()
