"""Attachments: content-addressed blobs, optionally gzipped and encrypted."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..plans.errors import QueryError

#: The encrypted form is a version byte, a 16-byte initialisation vector and AES-CBC with PKCS padding.
VERSION, VECTOR_BYTES = 1, 16
SMALL_BYTES = 65_536
PLAIN, GZIP = "plain", "gzip"


def coded(content: bytes, encoding: str) -> bytes:
    """content in a stored encoding."""
    if encoding not in (PLAIN, GZIP):
        raise QueryError(f"an attachment is {PLAIN} or {GZIP}, not {encoding}")
    return gzip.compress(content, mtime=0) if encoding == GZIP else content


def plain(stored: bytes, encoding: str) -> bytes:
    return gzip.decompress(stored) if encoding == GZIP else stored


def prepared(blobs: DataFrame, content: str = "content") -> DataFrame:
    """blobs with key (SHA-1, hex) and length of their content."""
    return blobs.withColumn("key", F.sha1(content)).withColumn("length", F.octet_length(content).cast("long"))


def deduplicated(blobs: DataFrame) -> DataFrame:
    """Each key once."""
    return blobs.dropDuplicates(["key"])


@F.pandas_udf(BinaryType())
def gzipped(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else gzip.compress(bytes(x), mtime=0))


@F.pandas_udf(BinaryType())
def gunzipped(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else gzip.decompress(bytes(x)))


def encrypted(content: str | Column, key: str | Column, vector: str | Column) -> Column:
    """Version byte, vector and ciphertext."""
    return F.concat(F.unhex(F.lit(f"{VERSION:02x}")), vector, F.substring(F.aes_encrypt(content, key, F.lit("CBC"), F.lit("PKCS"), vector), VECTOR_BYTES + 1, 2**31 - 1))


def decrypted(content: str | Column, key: str | Column) -> Column:
    """The content; a wrong version is an error."""
    c = F.col(content) if isinstance(content, str) else content
    body = F.aes_decrypt(F.substring(c, 2, 2**31 - 1), key, F.lit("CBC"), F.lit("PKCS"))
    return F.when(F.hex(F.substring(c, 1, 1)) == f"{VERSION:02X}", body).otherwise(F.raise_error(F.lit("unknown version of an encrypted attachment")).cast("binary"))


def inline(rows: DataFrame, mode: str = "small", ancestor_generation: str = "ancestor_generation") -> DataFrame:
    """rows (_id, revid, filename, length, revpos, ancestor_generation, content) as they are pushed.

    Attachments that the target has through the ancestor are stubs.  The others go inline, in base64, if mode is
    `all`, or `small` and every one of the revision is at most SMALL_BYTES; else they follow the revision.
    """
    new = F.col("revpos") > F.coalesce(F.col(ancestor_generation), F.lit(0))
    largest = rows.where(new).groupBy("_id", "revid").agg(F.max("length").alias("_largest"))
    fits = {"all": F.lit(True), "none": F.lit(False), "small": F.col("_largest") <= SMALL_BYTES}[mode]
    kind = F.when(~new, "stub").when(fits, "inline").otherwise("follows")
    return rows.join(largest, ["_id", "revid"], "left").withColumn("kind", kind).withColumn("data", F.when(F.col("kind") == "inline", F.base64("content"))).drop("_largest")


def unreferenced(blobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Blobs whose key no attachment has."""
    return blobs.join(attachments.select("key").distinct(), "key", "left_anti")
