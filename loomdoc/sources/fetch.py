"""Revisions in a keyed layout, and a look-up join that fetches just those that are asked for.

`publish` deals revisions with their histories to buckets by a hash of their document's id, each sorted by id with small row groups.  `fetch` groups what is
wanted by document, deals it to tasks by the same buckets, and opens only buckets that somebody asks for, several at a time in a task and each
again a few times if it fails.  Ids reach the files as filters, so of a bucket only the row groups that can have them are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "_id string, revid string, history array<string>, deleted boolean, json string"
#: Revisions in a bucket, buckets that a task opens at a time, attempts for each, and documents in a request.
BUCKET_REVISIONS, AT_A_TIME, ATTEMPTS, REQUEST_IDS = 50_000, 4, 4, 500


def _bucket(buckets: int) -> F.Column:
    return (F.crc32(F.col("_id").cast("binary")) % buckets).cast("int")


def publish(histories: DataFrame, path: str, buckets: int | None = None) -> int:
    """Writes revisions (_id, history oldest first, deleted, json) in buckets; their number."""
    rows = histories.select("_id", F.element_at("history", -1).alias("revid"), "history", "deleted", "json")
    buckets = buckets or 1 + histories.count() // BUCKET_REVISIONS
    dealt = rows.withColumn("bucket", _bucket(buckets)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "_id", "revid")
    dealt.write.option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(f"{path}/of-{buckets}")
    return buckets


def _attempts(read: Callable, wait: float = 0.1):
    """The result of read(), tried again after a growing pause if the file system fails."""
    for k in range(ATTEMPTS):
        try:
            return read()
        except FileNotFoundError:
            raise
        except OSError:
            if k == ATTEMPTS - 1:
                raise
            time.sleep(wait * 2**k)


def _request(path: str, bucket: int, ids: list[str]) -> pa.Table | None:
    """The revisions of some documents of a bucket."""
    import pyarrow.parquet as pq

    from .exchange import _files

    at, where = _files(f"{path}/bucket={bucket}")
    try:
        return _attempts(lambda: pq.read_table(where, filesystem=at, filters=[("_id", "in", ids)], columns=["_id", "revid", "history", "deleted", "json"], partitioning=None))
    except FileNotFoundError:
        return None  # nobody has ids of this bucket


def layout(spark: SparkSession, path: str) -> int:
    """The number of buckets that a folder was published with."""
    from .folders import names

    found = [int(x.removeprefix("of-")) for x in names(spark, path) if x.startswith("of-")]
    if len(found) != 1:
        raise FileNotFoundError(f"{path} holds {len(found)} layouts of revisions")
    return found[0]


def fetch(spark: SparkSession, path: str, missing: DataFrame) -> DataFrame:
    """The revisions that are asked for (_id, missing: revision ids), as `revs_diff` gives them; what the folder does not have is left out."""
    buckets = layout(spark, path)
    place = f"{path}/of-{buckets}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(request: tuple[int, dict[str, list[str]]]) -> pa.Table | None:
            bucket, asked = request
            found = _request(place, bucket, sorted(asked))
            if found is None or not found.num_rows:
                return None
            return found.filter(pa.array([r in asked.get(i, ()) for i, r in zip(found.column("_id").to_pylist(), found.column("revid").to_pylist(), strict=True)], pa.bool_()))

        def requests() -> Iterator[tuple[int, dict[str, list[str]]]]:
            at, asked = None, {}
            for batch in batches:
                for bucket, name, revids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if asked and (bucket != at or len(asked) >= REQUEST_IDS):
                        yield at, asked
                        asked = {}
                    at = bucket
                    asked.setdefault(name, []).extend(revids)
            if asked:
                yield at, asked

        with ThreadPoolExecutor(AT_A_TIME) as pool:
            waiting: list = []
            for request in requests():
                waiting.append(pool.submit(answered, request))
                if len(waiting) >= AT_A_TIME:  # answers that wait are as few as requests at a time
                    if (table := waiting.pop(0).result()) is not None:
                        yield from table.to_batches()
            for x in waiting:
                if (table := x.result()) is not None:
                    yield from table.to_batches()

    wanted = missing.select(_bucket(buckets).alias("bucket"), "_id", "missing").where("_id is not null")
    return wanted.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "_id").mapInArrow(run, SCHEMA)
