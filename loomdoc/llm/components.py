"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rows with one join key from which the key's rows are joined by broadcasting the one row of the other side.
HOT = 2000
#: Most keys that are broadcast; beyond it adaptive execution splits their partitions.
MOST_HOT = 1_000_000


def hot_keys(keys: DataFrame) -> DataFrame | None:
    """A table of keys of more than HOT rows, if there are any: at most a HOT-th of the rows, and never more than MOST_HOT."""
    return keys if 0 < keys.count() <= MOST_HOT else None


def joined(rows: DataFrame, one: DataFrame, key: str | list[str], hot: DataFrame | None) -> DataFrame:
    """rows with the row of `one` (unique by key); rows of hot keys stay where they are."""
    if hot is None:
        return rows.join(one, key)
    few = one.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(hot), key, "left_anti").join(one, key).unionByName(rows.join(F.broadcast(few), key))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); root is one node of the component, the same for all its nodes.

    Each round every node finds the least root among its neighbours' and its own, every root takes the least
    that one of its nodes has found, and is followed one step further; what holds for a root is
    joined to its nodes.  Rounds are written to the shared folder (the one before is deleted), so
    a lost executor costs one round, and their number grows with the logarithm
    of the longest path, not with its length.  Nodes of many links and roots of many nodes are joined by
    broadcast, so no task holds a whole large component.  Nodes may be of any type that
    can be ordered.  Null ends are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = shared.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    centres = hot_keys(shared.written(edges.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("b"), "centres"))
    # The first round needs no join: a node's root is the least of itself and its neighbours.
    labels = shared.written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = joined(edges, labels.withColumnRenamed("node", "b"), "b", centres).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        seen = labels.join(near, "node").select("root", F.least("root", "near").alias("best"))
        table = shared.written(seen.groupBy("root").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("_n")), "hooks")
        hooks, large = table.select("root", "best"), hot_keys(table.where(F.col("_n") > HOT).select("root"))
        # The root of what a root has found, and what that one has found: one row for each root.
        found = hooks.join(labels.select(F.col("node").alias("best"), F.col("root").alias("via")), "best").select("root", "via")
        steps = found.join(hooks.select(F.col("root").alias("via"), F.col("best").alias("next")), "via").select("root", "next")
        new = shared.written(joined(labels, steps, "root", large).select("node", F.col("next").alias("root"), F.col("root").alias("_old")), "labels")
        changed = new.where("root <> _old").limit(1).count()
        shared.discard(labels, table)
        labels = new.drop("_old")
        labels._written_at = new._written_at
        if not changed:
            return labels
