"""Tokenizers: a text column becomes its tokens, each between single spaces.

The form ` token token ` lets one string search or one regular expression test
terms, prefixes, phrases and distances without arrays or lambdas.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.errors import QueryError
from .porter import stem

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens are runs of ASCII letters and digits and of all other code points from 128 on.
NO_TOKEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def simple(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, ASCII in lower case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_TOKEN, " ")), F.lit(" "))


def token_array(text: Column) -> Column:
    """The simple tokens as an array."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[0-9a-z\x{80}-\x{10ffff}]+"), F.lit(0))


@F.pandas_udf(StringType())
def _stemmed(texts: pd.Series) -> pd.Series:
    words = [t.split() for t in texts]
    stems = {w: stem(w) for w in {w for own in words for w in own}}
    return pd.Series([" " + " ".join(stems[w] for w in own) + " " for own in words], dtype=object)


def porter(text: Column) -> Column:
    """Simple tokens, reduced to their Porter stems."""
    return _stemmed(simple(text))


def token_list(tokens: Column) -> Column:
    """` token token ` as an array."""
    return F.filter(F.split(tokens, " "), lambda x: x != "")


def simple_words(text: str) -> list[str]:
    """The simple tokens of a search string."""
    return [x for x in re.sub(NO_TOKEN, " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ") if x]


class Tokenizer:
    """A named tokenizer: how columns and search strings are cut."""

    registry: dict[str, tuple[Callable, Callable]] = {
        "simple": (lambda text, *_: simple(text), lambda text, *_: simple_words(text)),
        "porter": (lambda text, *_: porter(text), lambda text, *_: [stem(x) for x in simple_words(text)]),
    }

    def __init__(self, name: str = "simple", arguments: str = ""):
        if name not in self.registry:
            raise QueryError(f"unknown tokenizer {name}")
        self.name, self.arguments = name, arguments

    @classmethod
    def register(cls, name: str, column: Callable[..., Column], words: Callable[..., list[str]]) -> None:
        """column(text, arguments) gives ` token token `; words(text, arguments) cuts a search string."""
        cls.registry[name] = (column, words)

    def column(self, text: Column) -> Column:
        return self.registry[self.name][0](text, self.arguments)

    def words(self, text: str) -> list[str]:
        return self.registry[self.name][1](text, self.arguments)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Tokenizer) and (self.name, self.arguments) == (other.name, other.arguments)

    def __hash__(self) -> int:
        return hash((self.name, self.arguments))
