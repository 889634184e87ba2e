"""Queries: match, sort, skip, limit and project, in this order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fields as fld
from ..plans.errors import QueryError
from .predicates import predicate

#: Columns that a projection always carries, where they are there.
CARRIED = ("_id", "_rev", "_deleted", "_attachments")


def sort_keys(df: DataFrame, sort: Sequence, body: str = "body") -> list[Column]:
    """Order of values: missing, numbers, strings.  An array sorts by its least element, descending by its greatest."""
    resolve, keys = fld.Resolver(df, body), []
    for item in sort:
        name, way = item if isinstance(item, (tuple, list)) else next(iter(item.items())) if isinstance(item, dict) else (item, "asc")
        if str(way).lower() not in ("asc", "desc"):
            raise QueryError(f"sort {name} asc or desc, not {way}")
        down = str(way).lower() == "desc"
        ordered = (lambda c: c.desc_nulls_last()) if down else (lambda c: c.asc_nulls_first())
        field = resolve(name)
        if field.kind == "missing":
            continue
        if field.kind == "array":
            keys.append(ordered(F.array_max(field.column) if down else F.array_min(field.column)))
        elif field.kind == "variant":
            of = lambda v: F.struct(F.when(fld.variant_string(v).isNotNull(), 2).when(F.coalesce(fld.variant_number(v), fld.variant_boolean(v).cast("double")).isNotNull(), 1).otherwise(0).alias("rank"), F.coalesce(fld.variant_number(v), fld.variant_boolean(v).cast("double")).alias("number"), fld.variant_string(v).alias("string"))
            elements = F.transform(fld.variant_array(field.column), of)
            keys.append(ordered(F.when(fld.variant_is_array(field.column), F.array_max(elements) if down else F.array_min(elements)).otherwise(F.when(field.column.isNotNull(), of(field.column)))))
        elif field.kind != "object":
            keys.append(ordered(field.column))
    return keys


def project(df: DataFrame, names: Sequence[str] | None, body: str = "body") -> DataFrame:
    """df with the named top-level fields and the carried columns; of a VARIANT body only these fields."""
    if not names:
        return df
    for name in names:
        if "." in name:
            raise QueryError(f"projections take top-level fields, not {name}")
    resolve = fld.Resolver(df, body)
    wanted = dict.fromkeys([*(x for x in CARRIED if x in df.columns), *(x for x in names if x in df.columns)])
    columns = [F.col(fld.quoted(x)) for x in wanted]
    inside = [x for x in names if x not in wanted]
    if resolve.body and inside:
        columns.append(F.parse_json(F.to_json(F.struct(*[resolve(x).column.alias(x) for x in inside]))).alias(body))
    return df.select(*columns)


def find(
    df: DataFrame,
    selector: dict,
    skip: int = 0,
    limit: int = 0,
    fields: Sequence[str] | None = None,
    sort: Sequence | None = None,
    *,
    text: Callable[[str], Column] | None = None,
    body: str = "body",
) -> DataFrame:
    """Documents of df that match; a skip or limit of 0 means none.

    With a sort and a limit Spark keeps the best rows of each task only; without a
    sort the order is unspecified.
    """
    if skip < 0 or limit < 0:
        raise QueryError("skip and limit are not negative")
    out = df.where(predicate(df, selector, text, body))
    if sort:
        out = out.orderBy(*sort_keys(df, sort, body))
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(limit)
    return project(out, fields, body)


def document_ids(found: DataFrame) -> Iterator[str]:
    """The ids of a result, in its order, one partition at a time."""
    return (row["_id"] for row in found.select("_id").toLocalIterator())


def multi_get(df: DataFrame, ids: Sequence, key: str = "_id") -> DataFrame:
    """Rows by key in the order of ids; unknown keys are skipped and repeated ones count once."""
    if not ids:
        raise QueryError("a list of ids is not empty")
    # A short list is small enough for the planner to broadcast; a long one is joined like any table.
    order = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"`{key}` {df.schema[key].dataType.simpleString()}, _pos int")
    return df.join(order, key).orderBy("_pos").drop("_pos")
