"""What a field name means in a DataFrame: a typed column, or a path into a VARIANT body."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Field:
    """A resolved field. `kind` is number, string, boolean, time, array, variant, object or missing."""

    kind: str
    column: Column
    type: T.DataType | None = None
    name: str = ""

    @property
    def element(self) -> T.DataType:
        return self.type.elementType


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, NUMBERS):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TIMES):
        return "time"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, T.VariantType):
        return "variant"
    return "object"


def quoted(*path: str) -> str:
    return ".".join("`" + x.replace("`", "``") + "`" for x in path)


def variant_path(parts: list[str]) -> str:
    return "$" + "".join('["' + x.replace("\\", "\\\\").replace('"', '\\"') + '"]' for x in parts)


class Resolver:
    """Finds fields in a DataFrame's columns, then in its VARIANT column `body` if there is one.

    Dots separate the segments of a path.  A path does not go through arrays;
    a field that is nowhere is missing in every document.
    """

    def __init__(self, df: DataFrame, body: str = "body"):
        self.schema = df.schema
        self.body = body if body in df.columns and isinstance(df.schema[body].dataType, T.VariantType) else None

    def __call__(self, name: str) -> Field:
        if name in self.schema.names:
            return Field(kind_of(self.schema[name].dataType), F.col(quoted(name)), self.schema[name].dataType, name)
        parts = name.split(".")
        if parts[0] in self.schema.names and parts[0] != self.body:
            return self._inside(parts, name)
        if self.body:
            return Field("variant", F.try_variant_get(F.col(quoted(self.body)), variant_path(parts), "variant"), T.VariantType(), name)
        return Field("missing", F.lit(None), None, name)

    def _inside(self, parts: list[str], name: str) -> Field:
        data_type, column = self.schema[parts[0]].dataType, F.col(quoted(parts[0]))
        for i, part in enumerate(parts[1:], 1):
            if isinstance(data_type, T.StructType) and part in data_type.names:
                data_type, column = data_type[part].dataType, column.getField(part)
            elif isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType):
                data_type, column = data_type.valueType, F.try_element_at(column, F.lit(part))
            elif isinstance(data_type, T.VariantType):
                return Field("variant", F.try_variant_get(column, variant_path(parts[i:]), "variant"), data_type, name)
            else:
                return Field("missing", F.lit(None), None, name)
        return Field(kind_of(data_type), column, data_type, name)


def variant_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def variant_number(v: Column) -> Column:
    """The value as a double if it is a number, else null; the plain getter would read strings and booleans too."""
    kind = variant_type(v)
    is_number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(is_number, F.try_variant_get(v, "$", "double"))


#: Whole numbers below this are told apart as doubles.
EXACT_DOUBLE = 2**53


def variant_whole(v: Column) -> Column:
    """The value as a whole number of 64 bits if it is stored as one, else null."""
    return F.when(variant_type(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "bigint"))


def variant_string(v: Column) -> Column:
    return F.when(variant_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def variant_boolean(v: Column) -> Column:
    return F.when(variant_type(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def variant_is_array(v: Column) -> Column:
    return variant_type(v).startswith("ARRAY")


def variant_array(v: Column) -> Column:
    return F.when(variant_is_array(v), v.try_cast("array<variant>"))


def variant_exists(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)
