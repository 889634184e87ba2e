"""Labelled documents: the fold that is held out, and bounded samples to fit on.

A doc_id that is labelled more than once has the greatest of its labels; of several
documents with one doc_id the one with the least hash of its text (then the least
text) stands for it.  Labels of ids that no document has count for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

FOLDS = 5
#: Bytes of text of each class that a sample holds at most, whatever the number of its rows; its first document always counts.
SAMPLE_BYTES = 64 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def known(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of the labelled documents outside the held-out fold, each doc_id once."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return rows.where(~held_out()).join(docs.select("doc_id"), "doc_id", "left_semi")


def _least(rows: DataFrame, k: int, most: int) -> DataFrame:
    return rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _texts(docs: DataFrame, chosen: DataFrame, most_bytes: int, extra: Sequence[Column]) -> DataFrame:
    """Texts of the chosen ids (doc_id, label, population), up to most_bytes of each class in the order of the ids' hashes."""
    # One text for each id, by partial aggregates, so a doc_id in many rows is one row here.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *extra)
    own = rows.columns[1:]
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "population").agg(F.min(F.struct(F.xxhash64("text"), *own)).alias("_row")).select("doc_id", "label", "population", *[f"_row.{x}" for x in own])
    rows = shared.written(rows, "sample")
    # One row per chosen id, of which there are at most the sample's bound.
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("doc_id", "label", F.octet_length("text").cast("long").alias("_bytes"))
    fits = sizes.withColumn("_before", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).where((F.col("_before") + F.col("_bytes") <= most_bytes) | (F.col("_before") == 0))
    return rows.join(F.broadcast(fits.select("doc_id")), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = SAMPLE_BYTES, extra: Sequence[Column] = ()) -> DataFrame:
    """doc_id, text, extra columns, label and population (documents of the class) of at most per_class labelled documents of each class, outside the held-out fold.

    They are those with the least hash of doc_id, up to most_bytes of text of each class, so the
    sample depends on neither order nor partitions.
    """
    rows = shared.written(known(docs, labels, label), "labelled")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("population"))
    # At most 2 * per_class rows of an id and two numbers, and two sizes: small by construction.
    chosen = _least(rows, 0, per_class).unionByName(_least(rows, 1, per_class)).join(F.broadcast(sizes), "label")
    return _texts(docs, chosen.select("doc_id", "label", "population"), most_bytes, extra)


def of_class(docs: DataFrame, labels: DataFrame, label: str, k: int, most: int) -> DataFrame:
    """doc_id and text of at most `most` labelled documents of class k, outside the held-out fold."""
    chosen = _least(known(docs, labels, label), k, most).select("doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
