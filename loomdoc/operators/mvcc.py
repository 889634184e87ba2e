"""Revision trees as tables.

A table of revisions has the columns `sequence, _id, parent, revid, deleted,
available, json`; parent is the sequence of the revision that a row follows, null
at a root.  A document may have several roots and several leaves.  Nothing here
needs a document's revisions in one task, but `paths` and `resolve`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.revisions import check_body, generation, split_revid, suffix
from ..plans.errors import QueryError
from ..sources import folders

#: Rounds of `paths` after which their number is held against the sizes of the trees.
FREE_ROUNDS = 6
SCHEMA = "sequence bigint, _id string, parent bigint, revid string, deleted boolean, available boolean, json string"


def leaves(revs: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Revisions that no revision follows; children: those that can follow one, if not all can."""
    return revs.join((revs if children is None else children).select(F.col("parent").alias("_parent")).where("_parent is not null").distinct(), F.col("sequence") == F.col("_parent"), "left_anti")


def rank(revid: str | Column = "revid", deleted: str = "deleted") -> Column:
    """What the winner has the greatest of: a leaf that is not deleted, then the generation, then the suffix."""
    return F.struct((~F.col(deleted)).alias("live"), generation(revid).alias("gen"), suffix(revid).alias("suffix"))


def winners(revs: DataFrame) -> DataFrame:
    """The winning revision of each document, a function of its tree alone.

    Bodies move once, to be joined with the winners' sequences.
    """
    return revs.join(best(leaves(revs)).select("sequence"), "sequence", "left_semi").select(*revs.columns)


def best(ends: DataFrame) -> DataFrame:
    """_id and sequence of the winner among each document's leaves; sequences and ranks are aggregated map-side, so no document's tree meets in one task."""
    return ends.groupBy("_id").agg(F.max_by("sequence", F.struct(rank(), (-F.col("sequence")).alias("first"))).alias("sequence"))


def live(revs: DataFrame) -> DataFrame:
    """Winners that are not deleted."""
    return winners(revs).where(~F.col("deleted"))


def conflicted(revs: DataFrame) -> DataFrame:
    """_id and leaves (their number) of documents with more than one leaf that is not deleted."""
    return leaves(revs).where(~F.col("deleted")).groupBy("_id").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")


def document_count(revs: DataFrame) -> DataFrame:
    return live(revs).agg(F.count_distinct("_id").alias("documents"))


def last_sequence(revs: DataFrame) -> DataFrame:
    """The greatest sequence, -1 if there is none."""
    return revs.agg(F.coalesce(F.max("sequence"), F.lit(-1)).cast("bigint").alias("last_sequence"))


def roots(revs: DataFrame) -> DataFrame:
    return revs.where("parent is null")


def children(revs: DataFrame, sequence: int) -> DataFrame:
    return revs.where(F.col("parent") == sequence)


def lookup(revs: DataFrame, doc_id: str, revid: str) -> DataFrame:
    """The revisions of a document with this revision id, the first by sequence first."""
    return revs.where((F.col("_id") == doc_id) & (F.col("revid") == revid)).orderBy("sequence")


def leaf_revisions(revs: DataFrame, exclude_deleted: bool = False) -> DataFrame:
    """Leaves, with exclude_deleted those that are not deleted."""
    return leaves(revs).where(~F.col("deleted")) if exclude_deleted else leaves(revs)


def has_conflicts(revs: DataFrame) -> DataFrame:
    """_id and has_conflicts of every document: whether more than one leaf is not deleted."""
    return leaves(revs).groupBy("_id").agg((F.count_if(~F.col("deleted")) > 1).alias("has_conflicts"))


def faults(revs: DataFrame) -> DataFrame:
    """_id, sequence and fault of revisions that no tree can hold.

    `repeated sequence`: another revision has it; `missing parent`: no revision has the parent's
    sequence; `parent of another document`; `later parent`: the parent's sequence is not smaller.
    """
    repeated = revs.groupBy("sequence").agg(F.count(F.lit(1)).alias("_n"), F.collect_set("_id").alias("_ids")).where("_n > 1")
    twice = repeated.select(F.explode("_ids").alias("_id"), "sequence", F.lit("repeated sequence").alias("fault"))
    above = revs.groupBy(F.col("sequence").alias("_above")).agg(F.collect_set("_id").alias("_owners"))
    joined = revs.where("parent is not null").select("_id", "sequence", "parent").join(above, F.col("parent") == F.col("_above"), "left")
    fault = F.when(F.col("_above").isNull(), "missing parent").when(~F.array_contains("_owners", F.col("_id")), "parent of another document").when(F.col("parent") >= F.col("sequence"), "later parent")
    return twice.unionByName(joined.select("_id", "sequence", fault.alias("fault")).where("fault is not null"))


def paths(revs: DataFrame) -> DataFrame:
    """sequence, _id, revid, depth and path (revision ids from the node to its root) of each revision.

    By doubling: a node's known path ends at an ancestor whose known path is
    appended, so the rounds grow with the logarithm of the depth.  Rounds are tables in the
    shared folder; each replaces the one before.  A path is no longer than its document has revisions; parents that go round are an error.
    """
    rounds, most = 0, None
    state, last = revs.select("sequence", "_id", "revid", F.col("parent").alias("next"), F.array("revid").alias("path")), None
    while True:
        state = folders.written(state, "paths")
        if last is not None:
            folders.discard(last)
        last = state
        if not state.where("next is not null").limit(1).count():
            return state.select("sequence", "_id", "revid", (F.size("path") - 1).alias("depth"), "path")
        rounds += 1
        if rounds >= FREE_ROUNDS:
            if most is None:
                most = revs.groupBy("_id").count().agg(F.max("count")).first()[0]
            if 1 << (rounds - 1) > most:
                raise QueryError("revisions follow one another in a circle")
        above = state.select(F.col("sequence").alias("_sequence"), F.col("next").alias("_next"), F.col("path").alias("_path"))
        state = state.join(above, F.col("next") == F.col("_sequence"), "left").select(
            "sequence", "_id", "revid", F.col("_next").alias("next"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path")
        )


def revs_diff(revs: DataFrame, wanted: DataFrame) -> DataFrame:
    """_id and missing (revision ids) of wanted (_id, revid) that are not stored; documents without any are left out."""
    missing = wanted.select("_id", "revid").distinct().join(revs.select("_id", "revid"), ["_id", "revid"], "left_anti")
    return missing.groupBy("_id").agg(F.array_sort(F.collect_list("revid")).alias("missing"))


def possible_ancestors(revs: DataFrame, wanted: DataFrame, limit: int = 50) -> DataFrame:
    """_id, revid and ancestors of wanted (_id, revid): stored live revisions with a body and a lower generation, newest first, at most limit."""
    asked = wanted.select("_id", "revid", generation().alias("_gen")).where("_gen > 1")
    have = revs.where(~F.col("deleted") & F.col("json").isNotNull()).select("_id", F.col("revid").alias("_have"), generation().alias("_own"), F.col("sequence").alias("_seq"))
    newest = Window.partitionBy("_id", "revid").orderBy(F.col("_seq").desc())
    near = asked.join(have, "_id").where("_own < _gen").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit)
    return near.groupBy("_id", "revid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_have"))), lambda x: x._have).alias("ancestors"))


def numbered(df: DataFrame, order: list[str], start: Column, name: str) -> DataFrame:
    """df with name: start + 1, start + 2, ... in the given order, without one task that sees all rows.

    Rows are range-partitioned and sorted; a partition's offset is the sum of the sizes of
    those before it, a table of one row per partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_row", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")
    placed = folders.written(placed, "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return placed.join(offsets, "_part").withColumn(name, start + F.col("_offset") + F.col("_row") + 1).drop("_part", "_row", "_offset")


def merge_history(revs: DataFrame, incoming: DataFrame, last: int | None = None) -> DataFrame:
    """The rows that incoming (_id, history oldest first, deleted, json) adds to revs.

    A history ends in the revision that has the body; ancestors that are not stored
    come as stubs without one.  If the oldest revision is stored, the missing ones are grafted
    on the tree, else they are a tree of their own.  Revisions that are stored already
    add nothing.  New rows are numbered by generation, so parents come before children.
    """
    if last is None:
        last = last_sequence(revs).first()[0]
    listed = incoming.select("_id", "history", "deleted", "json", F.posexplode("history").alias("_pos", "revid"))
    ends = F.col("_pos") == F.size("history") - 1
    nodes = listed.select(
        "_id", "revid", F.when(F.col("_pos") > 0, F.try_element_at("history", F.col("_pos"))).alias("_parent_revid"),
        (ends & F.col("deleted")).alias("deleted"), ends.alias("available"), F.when(ends, F.coalesce("json", F.lit("{}"))).otherwise("{}").alias("json"),
    )
    # A revision that is a leaf of one history and an ancestor in another keeps its body; a parent is kept from the history that knows one.
    kept = F.max_by(F.struct("deleted", "available", "json"), F.struct("available", "json"))
    merged = nodes.groupBy("_id", "revid").agg(kept.alias("_best"), F.max("_parent_revid").alias("_parent_revid")).select("_id", "revid", "_best.*", "_parent_revid")
    new = merged.join(revs.select("_id", "revid"), ["_id", "revid"], "left_anti").withColumn("_gen", generation())
    new = numbered(new, ["_gen", "_id", "revid"], F.lit(last).cast("bigint"), "sequence")
    columns = ("sequence", "_id", F.col("_parent").alias("parent"), "revid", "deleted", "available", "json")
    if not new.where("_parent_revid is not null").limit(1).count():  # roots alone: there is nobody to look for
        return new.withColumn("_parent", F.lit(None).cast("bigint")).select(*columns)
    stored = revs.groupBy("_id", "revid").agg(F.min("sequence").alias("_parent"))
    known = stored.unionByName(new.select("_id", "revid", F.col("sequence").alias("_parent"))).withColumnRenamed("revid", "_parent_revid")
    return new.join(known, ["_id", "_parent_revid"], "left").select(*columns)


def compact(revs: DataFrame) -> DataFrame:
    """revs without the bodies of revisions that others follow."""
    parents = revs.select(F.col("parent").alias("_parent")).where("_parent is not null").distinct()
    return revs.join(parents, F.col("sequence") == F.col("_parent"), "left").withColumn("json", F.when(F.col("_parent").isNull(), F.col("json"))).drop("_parent")


def repair_duplicates(revs: DataFrame) -> DataFrame:
    """revs with each (_id, revid) once, the first by sequence, and children of the others moved to it."""
    kept = revs.groupBy("_id", "revid").agg(F.min("sequence").alias("_kept"))
    mapped = revs.select("sequence", "_id", "revid").join(kept, ["_id", "revid"]).select(F.col("sequence").alias("_from"), "_kept")
    own = revs.join(kept.select("_kept"), F.col("sequence") == F.col("_kept"), "left_semi")
    return own.join(mapped, F.col("parent") == F.col("_from"), "left").withColumn("parent", F.col("_kept")).drop("_from", "_kept").select(*revs.columns)


def repair_attachments(revs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments (sequence, filename, ...) after repair_duplicates: those of dropped revisions go to the kept one, each (sequence, filename) once, of several the one from the first revision."""
    kept = revs.groupBy("_id", "revid").agg(F.min("sequence").alias("_kept"))
    mapped = revs.select("sequence", "_id", "revid").join(kept, ["_id", "revid"]).select(F.col("sequence").alias("_from"), "_kept")
    moved = attachments.join(mapped, F.col("sequence") == F.col("_from"))
    rest = [x for x in attachments.columns if x not in ("sequence", "filename")]
    first = F.min_by(F.struct(*rest), "_from").alias("_rest")
    return moved.groupBy(F.col("_kept").alias("sequence"), "filename").agg(first).select("sequence", "filename", "_rest.*").select(*attachments.columns)


def changes(revs: DataFrame, since: int, limit: int, current: DataFrame | None = None) -> DataFrame:
    """Winners of documents with a revision in the sequences since+1 .. since+limit, and last_sequence, their greatest there.

    limit is a number of sequences, not of rows; current replaces the winners by other current revisions.
    """
    if limit <= 0:
        raise QueryError("limit is positive")
    since = max(since, 0)
    changed = revs.where((F.col("sequence") > since) & (F.col("sequence") <= since + limit)).groupBy("_id").agg(F.max("sequence").alias("last_sequence"))
    shown = winners(revs.join(changed.select("_id"), "_id", "left_semi")) if current is None else current
    return shown.join(changed, "_id").orderBy("last_sequence")


def resolve(revs: DataFrame, resolver: Callable[[str, list[dict]], Any]) -> DataFrame:
    """_id, kept, losers and body of conflicted documents, as resolver(id, its live leaves by revision id) decides.

    The resolver returns the revision id that stays, a new body (a dict, which goes under the winner), or both as a pair; None, an unknown id, a body
    that is none, or an error leaves the conflict.  Only the leaves of conflicted documents are gathered, one row
    per document, and resolved in Arrow batches.
    """
    return decided(leaves(revs), resolver).select("_id", "kept", "losers", "body")


def decided(ends: DataFrame, resolver: Callable[[str, list[dict]], Any]) -> DataFrame:
    """`resolve` of leaves, with the sequences of the revision that stays (at; of equal ones the first) and of the others (gone)."""
    row = F.struct("revid", "sequence", "parent", "json")
    gathered = ends.where(~F.col("deleted")).groupBy("_id").agg(F.array_sort(F.collect_list(row)).alias("leaves")).where(F.size("leaves") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for name, own in zip(batch.column("_id").to_pylist(), _dicts(batch.column("leaves")), strict=True):
                ids, sequences = [x["revid"] for x in own], [x["sequence"] for x in own]
                try:
                    stays = resolver(name, own)
                    stays, body = stays if isinstance(stays, tuple) else (None, stays) if isinstance(stays, dict) else (stays, None)
                    text = None if body is None else json.dumps(check_body(body))
                    if stays is None and body is not None:
                        stays = max(ids, key=split_revid)
                except Exception:  # a resolver that fails leaves the conflict, by contract
                    stays = None
                if stays in ids:
                    gone = [k for k, x in enumerate(ids) if x != stays]
                    for column, value in zip(out, (name, stays, [ids[k] for k in gone], text, sequences[ids.index(stays)], [sequences[k] for k in gone]), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["_id", "kept", "losers", "body", "at", "gone"])

    return gathered.mapInArrow(run, "_id string, kept string, losers array<string>, body string, at bigint, gone array<bigint>")


def _dicts(lists: pa.ListArray) -> Iterator[list[dict]]:
    """Lists of structs as lists of dicts; whole columns are converted, which is many times faster than value by value."""
    inner = lists.flatten()
    names = [x.name for x in inner.type]
    rows = zip(*(x.to_pandas(integer_object_nulls=True).tolist() for x in inner.flatten()), strict=True)
    for size in lists.value_lengths().to_pylist():
        yield [dict(zip(names, row, strict=True)) for row in islice(rows, size)]
