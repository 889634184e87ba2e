"""What the operators share: the folder that driver and executors see, and tables whose column names cannot clash."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.folders import clear, discard, folder, fresh, written

__all__ = ["Sent", "clear", "discard", "folder", "fresh", "get", "integer_ids", "opener", "plain", "put", "unused", "written"]


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores after it until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs for an operator that reads the columns `names` and keeps the rest, and the way back.

    The named columns keep their names, whatever their case in docs; all others become `other_0`, `other_1`, ...,
    so nothing that the operator adds can clash with them.  The way back, (found, *added), selects
    the columns of docs under their own names and order, then the added ones, under names that docs does not have (`unused`).
    """
    columns = docs.columns
    own = [f"other_{i}" for i in range(len(columns))]
    for name in names:
        exact = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        if not exact:
            raise ValueError(f"no column {name}")
        own[exact[0]] = name

    def back(found: DataFrame, *added: str) -> DataFrame:
        return found.select(*own, *added).toDF(*columns, *unused(columns, *added))

    return docs.toDF(*own), back


def integer_ids(docs: DataFrame, name: str = "doc_id") -> None:
    """Refuses ids that are not integers, for operators that keep them in arrays of numbers."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{name} is an integer here, not {kind.simpleString()}")


class Sent:
    """An object sent to the executors once each; classes of this package go by value.  Call it to get the object."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __call__(self):
        return pickle.loads(self.data.value)


def opener(uri: str) -> Callable:
    """A function (path) -> (file system, path there), for executors; plain and file: paths are local files."""

    def at(path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)

    return at


def put(path: str, data: bytes) -> None:
    """Writes a file so that it appears whole: a retried or doubled task replaces it with the same bytes."""
    fs, at = opener(path)(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def get(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """length bytes of a file from offset, or all that follow."""
    fs, at = opener(path)(path)
    with fs.open_input_file(at) as source:
        if length is None:
            length = source.size() - offset
        return source.read_at(length, offset)
