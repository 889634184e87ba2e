"""Revision ids `generation-suffix`, document ids and histories."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import QueryError


def generation(revid: str | Column = "revid") -> Column:
    """The number before the first dash."""
    return F.substring_index(revid, "-", 1).cast("int")


def suffix(revid: str | Column = "revid") -> Column:
    """The text after the first dash; it may hold dashes itself."""
    c = F.col(revid) if isinstance(revid, str) else revid
    return F.substring(c, F.locate("-", c) + 1, F.length(c))


def full_history(start: str | Column, ids: str | Column) -> Column:
    """{start, ids newest first} as full revision ids, oldest first."""
    s = F.col(start) if isinstance(start, str) else start
    return F.reverse(F.transform(ids, lambda x, i: F.concat((s - i).cast("string"), F.lit("-"), x)))


def short_history(history: str | Column) -> Column:
    """Full revision ids, oldest first, as a struct {start, ids newest first}."""
    newest = F.reverse(history)
    return F.struct(generation(F.element_at(newest, 1)).alias("start"), F.transform(newest, suffix).alias("ids"))


def split_revid(revid: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d+)-(.*)", revid or "", re.DOTALL)
    if not m:
        raise QueryError(f"not a revision id: {revid!r}")
    return int(m[1]), m[2]


def first_revid() -> str:
    return f"1-{uuid.uuid4().hex}"


def next_revid(revid: str) -> str:
    return f"{split_revid(revid)[0] + 1}-{uuid.uuid4().hex}"


def new_id() -> str:
    return uuid.uuid4().hex


def check_id(doc_id: str) -> str:
    """A document id is not empty; a leading underscore is for _design/ and _local/."""
    if not doc_id or doc_id.startswith("_") and not doc_id.startswith(("_design/", "_local/")):
        raise QueryError(f"not a document id: {doc_id!r}")
    return doc_id


def check_body(body: dict) -> dict:
    if not isinstance(body, dict):
        raise QueryError("a body is a JSON object")
    for name in body:
        if name.startswith("_"):
            raise QueryError(f"top-level names starting with _ are reserved: {name}")
    return body
