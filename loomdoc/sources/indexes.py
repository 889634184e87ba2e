"""Index definitions, and the projections that they stand for."""

from __future__ import annotations

import hashlib
import json
import operator
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import Tokenizer
from ..plans import fields as fld
from ..plans.errors import QueryError
from ..plans.selector import And, Leaf, Or

JSON, TEXT = "json", "text"
RESERVED = ("_id", "_rev")


@dataclass(frozen=True)
class Index:
    """Fields under a name.  Indexes are equal if they have the same set of fields, name, type and tokenizer."""

    name: str
    fields: tuple[str, ...]
    type: str = JSON
    tokenizer: Tokenizer | None = None

    def definition(self) -> tuple:
        return (frozenset(self.fields), self.type, self.tokenizer)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Index) and (self.name, self.definition()) == (other.name, other.definition())

    def __hash__(self) -> int:
        return hash((self.name, self.definition()))


def checked(fields: Sequence) -> tuple[str, ...]:
    """Field names with _id and _rev before them; descending, empty, repeated and $ names are refused."""
    names = []
    for item in fields or ():
        name, way = item if isinstance(item, (tuple, list)) else (item, "asc")
        if str(way).lower() != "asc":
            raise QueryError("indexes with descending fields are not supported")
        if not isinstance(name, str) or not name or any(x.startswith("$") or not x for x in name.split(".")):
            raise QueryError(f"not a field name: {name!r}")
        names.append(name)
    if not names:
        raise QueryError("an index has at least one field")
    if len(set(names)) != len(names):
        raise QueryError(f"repeated fields: {names}")
    return (*[x for x in RESERVED if x not in names], *names)


class Catalog:
    """The indexes of a store."""

    def __init__(self, indexes: Sequence[Index] = ()):
        self.indexes = {x.name: x for x in indexes}

    def ensure(self, fields: Sequence, name: str | None = None, type: str = JSON, tokenizer: Tokenizer | None = None) -> Index:
        """The index of this definition: a known one, whatever its name, or a new one."""
        names = checked(fields)
        tokenizer = (tokenizer or Tokenizer()) if type == TEXT else None
        wanted = (frozenset(names), type, tokenizer)
        if name is not None and not name:
            raise QueryError("an index name is not empty")
        if name in self.indexes:
            if self.indexes[name].definition() != wanted:
                raise QueryError(f"index {name} has another definition")
            return self.indexes[name]
        for known in self.indexes.values():
            if known.definition() == wanted:
                return known
        if type == TEXT and any(x.type == TEXT for x in self.indexes.values()):
            raise QueryError("there is a text index already")
        new = Index(name or f"index-{uuid.uuid4().hex}", names, type, tokenizer)
        self.indexes[new.name] = new
        return new

    def delete(self, name: str) -> None:
        if not name:
            raise QueryError("an index name is not empty")
        if name not in self.indexes:
            raise QueryError(f"no index {name}")
        del self.indexes[name]

    def text(self) -> Index | None:
        return next((x for x in self.indexes.values() if x.type == TEXT), None)


def projection(df: DataFrame, index: Index, body: str = "body", carried: Sequence[Column] = (), once: Sequence[str] = ()) -> DataFrame:
    """The rows that an index stands for: _id, _rev and the fields, one row per element of an array field.

    A document without the array, or with an empty one, has one row; one with two
    arrays among the fields is listed with the first of them exploded (of typed columns and fields
    of a VARIANT body, the first typed array before the others).  carried columns come after the fields;
    those named in once are null but in the first row of a document.
    """
    resolve = fld.Resolver(df, body)
    fields = [resolve(name) for name in index.fields]
    typed = [k for k, x in enumerate(fields) if x.kind == "array"][:1]
    arrays = {k: fields[k].column for k in typed} | {k: fld.variant_array(x.column) for k, x in enumerate(fields) if x.kind == "variant"}
    columns = [x.column.alias(f"field_{k}") for k, x in enumerate(fields)]
    carried = list(carried)
    if arrays:
        which = F.coalesce(*[F.when(x.isNotNull(), F.lit(k)) for k, x in arrays.items()])
        places = F.coalesce(*[F.transform(x, lambda _, i: i) for x in arrays.values()])
        columns += [*(x.alias(f"array_{k}") for k, x in arrays.items()), which.alias("which"), F.explode_outer(places).alias("at")]
    rows, out = df.select(*columns, *carried), []
    own = rows.columns[len(columns) :]
    for k, (name, field) in enumerate(zip(index.fields, fields, strict=True)):
        column = F.col(f"field_{k}")
        if k in arrays:
            element = F.try_element_at(F.col(f"array_{k}"), F.col("at") + 1)
            column = element if k in typed else F.when(F.col("which") == k, element).otherwise(column)
        if field.kind == "variant":
            column = F.try_variant_get(column, "$", "string")
        out.append(column.alias(name))
    first = F.coalesce("at", F.lit(0)) == 0 if arrays else F.lit(True)
    return rows.select(*out, *(F.when(first, F.col(x)).alias(x) if x in once else x for x in own))


def bounds(df: DataFrame, index: Index, body: str = "body") -> list[Column]:
    """Least and greatest number and string of each field, over the elements of an array, as columns that Parquet can filter by."""
    resolve, out = fld.Resolver(df, body), []
    for k, name in enumerate(index.fields):
        if name in RESERVED:
            continue
        v = resolve(name).column
        numbers, strings = (F.when(fld.variant_is_array(v), F.transform(fld.variant_array(v), of)).otherwise(F.array(of(v))) for of in (fld.variant_number, fld.variant_string))
        out += [F.array_min(numbers).alias(f"least_number_{k}"), F.array_max(numbers).alias(f"greatest_number_{k}"), F.array_min(strings).alias(f"least_string_{k}"), F.array_max(strings).alias(f"greatest_string_{k}")]
    return out


def covered(df: DataFrame, index: Index, body: str = "body") -> Column:
    """JSON of the index's fields, with the paths that lead to them; a field that is within another one comes with it."""
    resolve, tree = fld.Resolver(df, body), {}
    names = [x for x in index.fields if x not in RESERVED]
    for name in names:
        if not any(name != x and name.startswith(x + ".") for x in names):
            at = tree
            for part in name.split(".")[:-1]:
                at = at.setdefault(part, {})
            at[name.split(".")[-1]] = resolve(name).column

    def built(node: dict) -> Column:
        inside = [(built(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]
        there = reduce(operator.or_, (x.isNotNull() for x in (built(v) if isinstance(v, dict) else v for v in node.values())))
        return F.when(there, F.struct(*inside))

    return F.coalesce(F.to_json(built(tree)) if tree else F.lit(None).cast("string"), F.lit("{}")).alias("_covered")


def _bound(node, index: Index) -> Column | None:
    """A condition on bounds that every matching document meets, or None if the index says nothing."""
    if isinstance(node, (And, Or)):
        parts = [_bound(x, index) for x in node.children]
        if isinstance(node, Or):
            return None if not parts or any(x is None for x in parts) else reduce(operator.or_, parts)
        return reduce(operator.and_, some) if (some := [x for x in parts if x is not None]) else None
    if not isinstance(node, Leaf) or node.field not in index.fields or node.field in RESERVED:
        return None
    k = index.fields.index(node.field)
    least = {"number": F.col(f"least_number_{k}"), "string": F.col(f"least_string_{k}")}
    greatest = {"number": F.col(f"greatest_number_{k}"), "string": F.col(f"greatest_string_{k}")}

    def compared(op: str, value) -> Column | None:
        kind = "string" if isinstance(value, str) else "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else None
        if kind is None:
            return None
        # Bounds are doubles; of numbers that these cannot tell apart the nearest ones count as equal.
        strict = kind == "string" or abs(value) < fld.EXACT_DOUBLE
        value = F.lit(float(value) if kind == "number" else value)
        if op == "$eq":
            return (least[kind] <= value) & (greatest[kind] >= value)
        if op in ("$gt", "$gte"):
            own = greatest[kind] > value if op == "$gt" and strict else greatest[kind] >= value
            return own | least["string"].isNotNull() if kind == "number" else own
        own = least[kind] < value if op == "$lt" and strict else least[kind] <= value
        return own | least["number"].isNotNull() if kind == "string" else own

    if node.operator == "$in":
        parts = [compared("$eq", x) for x in node.operand]
        return None if not parts or any(x is None for x in parts) else reduce(operator.or_, parts)
    return compared(node.operator, node.operand) if node.operator in ("$eq", "$gt", "$gte", "$lt", "$lte") else None


def bounded_fields(node, index: Index) -> set[str]:
    """Fields of the index that bound the documents of a selector tree."""
    if _bound(node, index) is None:
        return set()
    if isinstance(node, Leaf):
        return {node.field}
    return set().union(*(bounded_fields(x, index) for x in node.children))


class MaterialisedIndex:
    """An index's projection as a table that grows with a store.

    Every revision with a body is projected once, in the part of the refresh that first saw
    it, and no part is written again: readers keep the rows whose sequence is a current
    revision's, so rows of replaced revisions drop out by themselves.  Parts are folders
    named by the sequences that they cover.
    """

    def __init__(self, store, index: Index):
        self.store, self.index = store, index
        definition = hashlib.sha1(json.dumps([index.fields, index.type]).encode()).hexdigest()[:10]
        self.folder = f"{store.path}/index/{index.name}-{definition}"
        found = [tuple(map(int, x.split("-")[1:])) for x in store.files.names(self.folder) if x.startswith("part-") and store.files.exists(f"{self.folder}/{x}/_SUCCESS")]
        # A part counts if it goes on where the ones before it end: of two writers' parts the longer.
        self.parts, self.last_sequence = [], 0
        for low, high in sorted(found, key=lambda x: (x[0], -x[1])):
            if low == self.last_sequence + 1:
                self.parts.append((low, high))
                self.last_sequence = high

    def _path(self, low: int, high: int) -> str:
        return f"{self.folder}/part-{low:012d}-{high:012d}"

    def rows(self) -> DataFrame:
        """The rows of all revisions, with their sequence and the bounds of their fields."""
        if not self.parts:
            raise QueryError("the index was never refreshed")
        return self.store.spark.read.parquet(*[self._path(*x) for x in self.parts])

    def table(self) -> DataFrame:
        """The projection of current documents that are not deleted."""
        current = self.store.current().where(~F.col("deleted")).select("sequence")
        return self.rows().join(current, "sequence", "left_semi").select(*[F.col(fld.quoted(x)) for x in self.index.fields])

    def candidates(self, tree) -> DataFrame:
        """Sequences of revisions within the bounds of a selector tree; the filter reaches the files."""
        return self.rows().where(_bound(tree, self.index)).select("sequence")

    def documents(self, tree) -> DataFrame:
        """Current documents with the index's fields alone as their body, those within the bounds of a selector tree; revisions are not opened."""
        rows = self.rows() if self.parts else None
        if rows is None:
            return self.store.documents().limit(0)
        bound = _bound(tree, self.index)
        rows = rows.where(F.col("_covered").isNotNull() if bound is None else F.col("_covered").isNotNull() & bound)
        rows = rows.join(self.store.pointers(), ["_id", "sequence"], "left_semi")
        # As in DocumentStore.documents_of, a generator keeps the parsing above the join.
        return rows.select("_id", "_rev", "sequence", F.explode(F.array("_covered")).alias("_covered")).select("_id", "_rev", "sequence", F.parse_json("_covered").alias("body"))

    def refresh(self) -> DataFrame:
        """Appends the revisions that came since the last refresh."""
        last = max(self.store.last_sequence, 0)
        if last > self.last_sequence or not self.parts:
            new = self.store.revisions(self.last_sequence + 1, last).where(~F.col("deleted") & F.col("json").isNotNull())
            docs = new.select("_id", F.col("revid").alias("_rev"), "sequence", F.parse_json("json").alias("body"))
            rows = projection(docs, self.index, carried=[F.col("sequence"), *bounds(docs, self.index), covered(docs, self.index)], once=["_covered"])
            low, high = self.last_sequence + 1, max(last, self.last_sequence + 1)
            if last:
                rows.write.mode("overwrite").parquet(self._path(low, high))
                self.parts.append((low, high))
                self.last_sequence = high
        return self.table()
