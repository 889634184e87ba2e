"""Selector trees as Columns.

A positive predicate may be null, which a filter drops; only negations are
made two-valued.  On typed scalar columns the forms are those that Parquet
filters understand: literals are cast to the column's type, never the column,
and negations are null-safe inequalities or a negated comparison with `is null`.

Values compare by type: numbers as numbers, strings in binary order, every
number below every string, booleans only for equality.  On an array a condition holds if
it holds for some element.
"""

from __future__ import annotations

import datetime
import math
import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import fields as fld
from ..plans.errors import QueryError
from ..plans.selector import And, Everything, Leaf, Node, Not, Or, Text, parse

_COMPARE = {"$eq": operator.eq, "$lt": operator.lt, "$lte": operator.le, "$gt": operator.gt, "$gte": operator.ge}
_OPPOSITE = {"$lt": operator.ge, "$lte": operator.gt, "$gt": operator.le, "$gte": operator.lt}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def predicate(df: DataFrame, selector: dict | Node, text: Callable[[str], Column] | None = None, body: str = "body") -> Column:
    """The condition of a selector on df; text makes the condition of a search string."""
    tree = parse(selector) if isinstance(selector, dict) else selector
    return _compile(tree, fld.Resolver(df, body), text)


def _compile(node: Node, resolve: fld.Resolver, text: Callable[[str], Column] | None) -> Column:
    if isinstance(node, Everything):
        return F.lit(True)
    if isinstance(node, And):
        return reduce(operator.and_, (_compile(x, resolve, text) for x in node.children)) if node.children else F.lit(True)
    if isinstance(node, Or):
        return reduce(operator.or_, (_compile(x, resolve, text) for x in node.children)) if node.children else F.lit(False)
    if isinstance(node, Text):
        if text is None:
            raise QueryError("a text search needs a text index")
        return text(node.search)
    if isinstance(node, Not):
        return _negated(node.child, resolve(node.child.field))
    if isinstance(node, Leaf):
        return _leaf(node, resolve(node.field))
    raise TypeError(f"not a selector tree: {node!r}")


def _leaf(leaf: Leaf, field: fld.Field) -> Column:
    if leaf.operator == "$exists":
        return _exists(field) if leaf.operand else ~_exists(field)
    if leaf.operator == "$size":
        return _size(leaf.operand, field)
    if field.kind == "array":
        kind = fld.kind_of(field.element)
        return F.exists(field.column, lambda e: F.coalesce(_scalar(leaf, kind, e, field.element), F.lit(False)))
    if field.kind == "variant":
        some = F.exists(fld.variant_array(field.column), lambda e: F.coalesce(_scalar(leaf, "variant", e, None), F.lit(False)))
        return F.when(fld.variant_is_array(field.column), some).otherwise(_scalar(leaf, "variant", field.column, None))
    return _scalar(leaf, field.kind, field.column, field.type)


def _negated(leaf: Leaf, field: fld.Field) -> Column:
    """The complement, in a form that can be pushed down where the field is a typed scalar."""
    if leaf.operator == "$exists":
        return ~_leaf(leaf, field)
    if field.kind in ("number", "string", "time") and leaf.operator in _COMPARE:
        value = _literal(leaf.operand, field.kind, field.type)
        if value is not None and leaf.operator == "$eq":
            return ~field.column.eqNullSafe(value)
        if value is not None:
            return _OPPOSITE[leaf.operator](field.column, value) | field.column.isNull()
    return ~F.coalesce(_leaf(leaf, field), F.lit(False))


def _exists(field: fld.Field) -> Column:
    if field.kind == "missing":
        return F.lit(False)
    if field.kind == "array":
        return F.coalesce(F.exists(field.column, lambda e: e.isNotNull()), F.lit(False))
    if field.kind == "variant":
        v = field.column
        some = F.coalesce(F.exists(fld.variant_array(v), fld.variant_exists), F.lit(False))
        return F.coalesce(F.when(fld.variant_is_array(v), some).otherwise(fld.variant_exists(v)), F.lit(False))
    return field.column.isNotNull()


def _size(operand: Any, field: fld.Field) -> Column:
    whole = isinstance(operand, (int, float)) and not isinstance(operand, bool) and math.isfinite(operand) and operand == int(operand) and operand >= 0
    if not whole or field.kind not in ("array", "variant"):
        return F.lit(False)
    return F.size(field.column if field.kind == "array" else fld.variant_array(field.column)) == int(operand)


def _literal(value: Any, kind: str, data_type: T.DataType | None) -> Column | None:
    """value as a literal of a typed column's kind, or None if they never are equal or comparable."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number" and number:
        if isinstance(data_type, _WHOLE) and isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
            value = int(value)
        return F.lit(float(value) if isinstance(value, int) and abs(value) >= 2**63 else value)
    if kind == "string" and isinstance(value, str) or kind == "boolean" and isinstance(value, bool):
        return F.lit(value)
    if kind == "time" and isinstance(value, (str, datetime.date)):
        return F.lit(value).try_cast(data_type)
    return None


def _scalar(leaf: Leaf, kind: str, c: Column, data_type: T.DataType | None) -> Column:
    if leaf.operator == "$mod":
        return _mod(leaf.operand, kind, c)
    if leaf.operator == "$in":
        return _in(leaf.operand, kind, c, data_type)
    return _comparison(leaf.operator, leaf.operand, kind, c, data_type)


def _comparison(op: str, value: Any, kind: str, c: Column, data_type: T.DataType | None) -> Column:
    number, string = isinstance(value, (int, float)) and not isinstance(value, bool), isinstance(value, str)
    if isinstance(value, bool) and op != "$eq":
        return F.lit(False)
    if kind == "variant":
        if isinstance(value, bool):
            return fld.variant_boolean(c) == value
        same = _numbers(op, c, value) if number else _COMPARE[op](fld.variant_string(c), F.lit(value))
        if op == "$eq":
            return same
        if number:
            return F.coalesce(same, fld.variant_string(c).isNotNull() if op in ("$gt", "$gte") else F.lit(False))
        return F.coalesce(same, fld.variant_number(c).isNotNull() if op in ("$lt", "$lte") else F.lit(False))
    literal = _literal(value, kind, data_type)
    if literal is not None:
        return _COMPARE[op](c, literal)
    # Every number is below every string.
    if kind == "number" and string and op in ("$lt", "$lte") or kind == "string" and number and op in ("$gt", "$gte"):
        return c.isNotNull()
    return F.lit(False)


def _numbers(op: str, c: Column, value: float) -> Column:
    """A comparison with a number in a VARIANT: as doubles, but whole numbers that doubles cannot tell apart as they are."""
    as_doubles = _COMPARE[op](fld.variant_number(c), F.lit(float(value)))
    if isinstance(value, float) or abs(value) < fld.EXACT_DOUBLE or abs(value) >= 2**63:
        return as_doubles
    whole = fld.variant_whole(c)
    return F.when(whole.isNotNull(), _COMPARE[op](whole, F.lit(value).cast("bigint"))).otherwise(as_doubles)


def _in(values: tuple, kind: str, c: Column, data_type: T.DataType | None) -> Column:
    if kind != "variant":
        literals = [x for x in (_literal(v, kind, data_type) for v in values) if x is not None]
        return c.isin(*literals) if literals else F.lit(False)
    every = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    large = [v for v in every if isinstance(v, int) and fld.EXACT_DOUBLE <= abs(v) < 2**63]
    numbers = [float(v) for v in every if v not in large]
    strings, booleans = [v for v in values if isinstance(v, str)], [v for v in values if isinstance(v, bool)]
    parts = [F.coalesce(of(c).isin(*own), F.lit(False)) for of, own in ((fld.variant_number, numbers), (fld.variant_string, strings), (fld.variant_boolean, booleans)) if own]
    parts += [F.coalesce(_numbers("$eq", c, v), F.lit(False)) for v in large]
    return reduce(operator.or_, parts) if parts else F.lit(False)


def _mod(operand: tuple[int, int], kind: str, c: Column) -> Column:
    if kind == "variant":
        c = fld.variant_number(c)
    elif kind != "number":
        return F.lit(False)
    return c.try_cast("bigint") % F.lit(operand[0]).cast("bigint") == F.lit(operand[1]).cast("bigint")
