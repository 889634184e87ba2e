"""A corpus pipeline: five filters and a mix, each stage reading what the one before has written.

Stages, in order: toxic documents go; repeated lines go; of each group of
near-duplicates (five-word shingles, similarity 0.8) one document stays; documents
contaminated with benchmark items go; the rest is mixed to source weights.

Every stage takes (spark, docs, folder of the tables).  All but the last return
the columns of docs; the last returns the documents that the mix takes, with
their size, their source's size and target, and the words taken of each.

Every stage takes nulls in any column, empty and very long texts, repeated rows and
columns of any name; an empty table gives an empty one.  A stage that needs no more than the text
keeps rows without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import decontaminate, line_dedup, mixing, neardup, shared, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; it learns from the labelled rows among docs.

    A null or empty text is no reason to reject; equal texts are judged alike; rows with a null doc_id are judged, and have no label; without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, _table(spark, folder, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that many documents share stay in one of them, that with the largest doc_id; n_chars follows the text.

    A null text stays null and an empty one empty; rows with one doc_id are one document and keep the line alike; a row with a null doc_id counts as a document of its own, and keeps the line only if no other row has it.
    """
    found = line_dedup.dedup(docs)
    _, dropped = shared.unused(docs.columns, "n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{x}`") for x in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; rows that have this doc_id and one text are one document and stay.

    Null and empty texts are near nothing and stay; a row with a null doc_id stays only if its group has no other doc_id.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    A null or empty text has no words and stays; benchmark rows without text find nothing, those without an item_id count like others.
    """
    return decontaminate.remove_documents(docs, _table(spark, folder, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of the mix and how much of each it takes.

    A null source is a source of its own, last in order; documents without words are taken nothing of and go; equal rows are documents of their own.
    """
    return mixing.taken_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL cannot express the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages applied to documents; each result is a Parquet table in the shared folder."""
    docs = _table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
