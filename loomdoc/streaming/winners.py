"""Winners of a stream of revision trees: each document's open leaves are state, revisions may come in any order.

`tree_winners` keeps, by document, the leaves that are known and the sequences of parents that are not there yet.  A revision closes its parent,
or announces it: a parent that comes later is no leaf.  So the state is as large as a document's open ends, not as its tree.
Each batch gives a row for every document whose winner is another one than before it.

`WinnerTable` keeps what the batches give: a part for each batch, written again under the same name if a batch runs again, and merged with its
neighbours in geometric sizes, so a batch costs what has changed and not what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.revisions import split_revid
from ..sources import folders
from ..sources.folders import delete, names

WINNER = "_id string, sequence bigint, revid string, deleted boolean"
_STATE = "sequences array<bigint>, revids array<string>, deleted array<boolean>, awaited array<bigint>"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a table of winners from which a batch merges the last ones.
MERGE_PARTS = 8


def winner_of(leaves: dict[int, tuple[str, bool]]) -> tuple[int, str, bool] | None:
    """The winning leaf of {sequence: (revid, deleted)}, as `mvcc.winners` has it."""
    best = max(leaves.items(), key=lambda x: (not x[1][1], *split_revid(x[1][0]), -x[0]), default=None)
    return None if best is None else (best[0], *best[1])


def followed(leaves: dict[int, tuple[str, bool]], awaited: set[int], revs: Iterator[tuple[int, int | None, str, bool]]) -> None:
    """Adds revisions (sequence, parent, revid, deleted) to a document's leaves and awaited parents, in any order."""
    for sequence, parent, revid, deleted in revs:
        if parent is not None and leaves.pop(parent, None) is None:
            awaited.add(parent)  # it comes later, or another revision has closed it
        if sequence in awaited:
            awaited.discard(sequence)
        else:
            leaves[sequence] = (revid, deleted)


class Leaves(StatefulProcessor):
    """A document's open leaves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("leaves", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (names of the interface)
        sequences, revids, deleted, awaited = self.state.get() if self.state.exists() else ([], [], [], [])
        leaves = dict(zip(sequences, zip(revids, deleted, strict=True), strict=True))
        before, waiting = winner_of(leaves), set(awaited)
        followed(leaves, waiting, ((r.sequence, r.parent, r.revid, r.deleted) for r in rows))
        order = sorted(leaves)
        self.state.update((order, [leaves[s][0] for s in order], [leaves[s][1] for s in order], sorted(waiting)))
        if (now := winner_of(leaves)) is not None and now != before:
            yield Row(_id=key[0], sequence=now[0], revid=now[1], deleted=now[2])

    def close(self) -> None:
        pass


def tree_winners(stream: DataFrame) -> DataFrame:
    """A streaming table (_id, sequence, revid, deleted) of the winners that change, of a stream (sequence, _id, parent, revid, deleted).

    A revision is there once.  Rows without an _id are left out.  The session keeps state in RocksDB, which this kind of state needs.
    """
    rows = stream.where("_id is not null").select("sequence", "_id", "parent", "revid", "deleted")
    return rows.groupBy("_id").transformWithState(Leaves(), WINNER, "update", "none")


class WinnerTable:
    """Changes of winners in parts of batches low..high; the part of the last batch that has a document holds its winner."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def parts(self) -> list[tuple[int, int]]:
        """Whole parts in order, without those that a merged one stands for."""
        found = sorted((tuple(map(int, x.split("-")[1:])) for x in names(self.spark, self.path) if x.startswith("part-") and "_SUCCESS" in names(self.spark, f"{self.path}/{x}")), key=lambda x: (x[0], -x[1]))
        out: list[tuple[int, int]] = []
        for low, high in found:
            if not out or low > out[-1][1]:
                out.append((low, high))
        return out

    def _path(self, low: int, high: int) -> str:
        return f"{self.path}/part-{low:012d}-{high:012d}"

    def add(self, changes: DataFrame, batch: int) -> None:
        """The changes of a batch; a batch that runs again replaces its own part, or is in a merged one already."""
        if any(low <= batch <= high and low < high for low, high in self.parts()):
            return
        changes.select("_id", "sequence", "revid", "deleted", F.lit(batch).cast("bigint").alias("batch")).write.mode("overwrite").parquet(self._path(batch, batch))
        parts = self.parts()
        if len(parts) > MERGE_PARTS:
            self._merge(parts)

    def _merge(self, parts: list[tuple[int, int]]) -> None:
        at = len(parts) - 1
        # Parts of as many batches as all behind them together, or fewer, go along.
        while at > 0 and parts[at - 1][1] - parts[at - 1][0] <= parts[-1][1] - parts[at][0]:
            at -= 1
        if at == len(parts) - 1:
            return
        low, high = parts[at][0], parts[-1][1]
        self._newest(parts[at:]).write.mode("overwrite").parquet(self._path(low, high))
        for part in parts[at:]:
            delete(self.spark, self._path(*part))

    def _newest(self, parts: list[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.schema(WINNER + ", batch bigint").parquet(*[self._path(*x) for x in parts])
        return rows.groupBy("_id").agg(F.max_by(F.struct("sequence", "revid", "deleted", "batch"), "batch").alias("_row")).select("_id", "_row.*")

    def winners(self) -> DataFrame:
        """Each document's winner so far."""
        parts = self.parts()
        return self._newest(parts).drop("batch") if parts else self.spark.createDataFrame([], WINNER)


def follow(stream: DataFrame, folder: str, interval: str | None = None) -> tuple[StreamingQuery, WinnerTable]:
    """Starts a query that follows a stream of revisions, all that is there or every interval, and the table in the folder that it keeps."""
    spark = stream.sparkSession
    table = WinnerTable(spark, f"{folder}/table")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = tree_winners(stream).writeStream.outputMode("update").foreachBatch(table.add).option("checkpointLocation", f"{folder}/checkpoint")
        query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    return query, table


def winners_of_stream(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Reads all that is there of a stream of revisions and returns each document's winner."""
    query, table = follow(stream, folder or folders.fresh(stream.sparkSession, "winners"))
    query.awaitTermination()
    return table.winners()
