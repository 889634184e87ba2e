"""The winner of each document over a stream of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mvcc import rank
from ..sources import folders


def best(revs: DataFrame) -> DataFrame:
    """The best revision of each document among parentless ones: partial aggregates, then one row per document and task."""
    row = F.struct("_id", "sequence", "revid", "deleted")
    return revs.groupBy("_id").agg(F.max_by(row, F.struct(rank(), "sequence")).alias("_row")).select("_row.*")


def latest_of_stream(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Reads all that is there of a stream (_id, sequence, revid, deleted) and returns each document's winner.

    Each batch merges the winners so far, a table version in the folder, with the best of the
    batch; versions are named by batch, so a batch that runs again writes the same.
    """
    spark = stream.sparkSession
    folder = folder or folders.fresh(spark, "stream")
    done: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        found = best(batch)
        if number:
            found = best(found.unionByName(spark.read.parquet(f"{folder}/winners-{number - 1}")))
        found.write.mode("overwrite").parquet(path := f"{folder}/winners-{number}")
        done.append(path)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], "_id string, sequence bigint, revid string, deleted boolean")
    return spark.read.parquet(done[-1])
