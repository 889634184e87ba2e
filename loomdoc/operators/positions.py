"""Searches over the places of words: a tree of terms becomes a condition on sorted arrays of places.

Phrases are intersections of shifted arrays.  A distance is decided in one pass over the merged places of both sides:
the nearest start behind an end is its neighbour there.  Both take time in proportion to the places, whatever the distance.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: places(word, is a prefix, column) -> the places of a word in a column, an array of int that is never null.
Places = Callable[[str, bool, str], Column]


def moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda at: at + by) if by else places


def starts(term, column: str, places: Places) -> Column:
    """Places where a term's words begin to stand in a row."""
    last = len(term.words) - 1
    own = [moved(places(word, term.prefix and k == last, column), -k) for k, word in enumerate(term.words)]
    return reduce(F.array_intersect, own)


def within(ends: Column, begins: Column, distance: int) -> Column:
    """Whether some place of begins is an end's or at most `distance` places behind it."""
    tagged = F.array_sort(F.concat(F.transform(ends, lambda x: F.struct(x.alias("at"), F.lit(0).alias("side"))), F.transform(begins, lambda x: F.struct(x.alias("at"), F.lit(1).alias("side")))))
    start = F.struct(F.lit(None).cast("int").alias("end"), F.lit(False).alias("found"))
    step = lambda seen, x: F.struct(F.when(x.side == 0, x["at"]).otherwise(seen.end).alias("end"), (seen.found | ((x.side == 1) & F.coalesce(x["at"] - seen.end <= distance, F.lit(False)))).alias("found"))
    return F.aggregate(tagged, start, step, lambda seen: seen.found)


def near(left, right, distance: int, column: str, places: Places) -> Column:
    """Whether two terms stand in a column with at most `distance` words between them, in either order."""
    a, b = starts(left, column, places), starts(right, column, places)
    return within(moved(a, len(left.words)), b, distance) | within(moved(b, len(right.words)), a, distance)


def holds(node, columns: Sequence[str], places: Places) -> Column:
    """The condition of a search tree."""
    from .text import Both, Either, Near, Term, Without

    if isinstance(node, (Both, Either, Without)):
        left, right = holds(node.left, columns, places), holds(node.right, columns, places)
        return left & right if isinstance(node, Both) else left | right if isinstance(node, Either) else left & ~right
    terms = (node,) if isinstance(node, Term) else (node.left, node.right)
    own = [c for c in columns if all(t.column in (None, c) for t in terms)]
    if not own or not all(t.words for t in terms):
        return F.lit(False)
    if isinstance(node, Near):
        return reduce(operator.or_, (near(node.left, node.right, node.distance, c, places) for c in own))
    return reduce(operator.or_, (F.size(starts(node, c, places)) > 0 for c in own))


def of_tokens(tokens: dict[str, Column]) -> Places:
    """Places of words in arrays of tokens, by column."""

    def places(word: str, prefix: bool, column: str) -> Column:
        there = (lambda x: F.startswith(x, F.lit(word))) if prefix else (lambda x: x == word)
        return F.array_compact(F.transform(tokens[column], lambda x, i: F.when(there(x), i)))

    return places
