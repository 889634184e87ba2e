"""The folder that the driver and all executors see, and tables that cut a lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """URI of the session's shared folder: spark.checkpoint.dir.

    Where that is unset a temporary folder serves, but only if driver and executors are one
    process; on a cluster nobody else would see it, so it is refused there.
    """
    context = spark.sparkContext
    uri = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not uri:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        uri = "file://" + tempfile.mkdtemp(prefix="loomdoc-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(uri)
    return uri.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses yet; all paths of an application lie in one folder."""
    return f"{folder(spark)}/loomdoc/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of an execution at its end; what is written needs none of them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and it survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if it is not there."""
    files, place = _place(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that no other table will read."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has written to the shared folder, once its results are saved elsewhere."""
    delete(spark, f"{folder(spark)}/loomdoc/{spark.sparkContext.applicationId}")
