"""Full-text search: a search string becomes a condition on token columns.

Grammar, tightest first: terms (`word`, `pre*`, `"a phrase"`, `column:term`),
`NEAR` and `NEAR/n` between terms, `NOT`, `AND` or nothing, `OR`; parentheses
group.  Operators are in upper case.  A term holds if some column has it; a
phrase or a distance must hold within one column.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import Tokenizer, token_array, token_list
from ..plans import fields as fld
from ..plans.errors import QueryError
from . import positions

NEAR_DEFAULT = 10
#: Distances up to which a pattern finds both terms.  A regular expression goes one level deeper for every word between, so beyond it places of tokens are compared.
NEAR_PATTERN = 40
_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<phrase>(?:(?P<pcol>[^\s()":]+):)?"(?P<ptext>[^"]*)"?)|(?P<word>[^\s()"]+))')


@dataclass(frozen=True)
class Term:
    """Words in a row, in one column or any; the last may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    left: Term
    right: Term
    distance: int


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


class Parser:
    """A search string's tree, over the words that a tokenizer makes."""

    def __init__(self, search: str, columns: Sequence[str], tokenizer: Tokenizer):
        self.columns, self.tokenizer, self.items, at = columns, tokenizer, [], 0
        search = search.rstrip()
        while at < len(search):
            m = _TOKEN.match(search, at)
            if not m:
                raise QueryError(f"cannot read the search from {search[at:]!r}")
            self.items.append(m)
            at = m.end()
        self.at = 0

    def parse(self):
        if not self.items:
            raise QueryError("an empty search")
        tree = self._either()
        if self.at < len(self.items):
            raise QueryError("a parenthesis is closed that was not opened")
        return tree

    def _word(self) -> str | None:
        return self.items[self.at]["word"] if self.at < len(self.items) else None

    def _either(self):
        left = self._both()
        while self._word() == "OR":
            self.at += 1
            left = Either(left, self._both())
        return left

    def _both(self):
        left = self._without()
        while self.at < len(self.items) and not self.items[self.at]["close"] and self._word() != "OR":
            if self._word() == "AND":
                self.at += 1
            left = Both(left, self._without())
        return left

    def _without(self):
        left = self._near()
        while self._word() == "NOT":
            self.at += 1
            left = Without(left, self._near())
        return left

    def _near(self):
        left = last = self._term()
        chain = None
        while (m := re.fullmatch(r"NEAR(?:/(\d+))?", self._word() or "")) is not None:
            self.at += 1
            right = self._term()
            if not isinstance(last, Term) or not isinstance(right, Term):
                raise QueryError("NEAR stands between terms")
            near = Near(last, right, int(m[1]) if m[1] else NEAR_DEFAULT)
            chain, last = near if chain is None else Both(chain, near), right
        return left if chain is None else chain

    def _term(self):
        if self.at >= len(self.items):
            raise QueryError("the search ends where a term is expected")
        m = self.items[self.at]
        self.at += 1
        if m["open"]:
            tree = self._either()
            if self.at >= len(self.items) or not self.items[self.at]["close"]:
                raise QueryError("a parenthesis is not closed")
            self.at += 1
            return tree
        if m["close"] or m["word"] in ("OR", "AND", "NOT"):
            raise QueryError(f"a term is expected, not {m[0].strip()}")
        column, text = (m["pcol"], m["ptext"]) if m["phrase"] else self._column(m["word"])
        if column is not None and column not in self.columns:
            raise QueryError(f"no text column {column}")
        prefix = text.endswith("*")
        return Term(tuple(self.tokenizer.words(text)), prefix, column)

    def _column(self, word: str) -> tuple[str | None, str]:
        name, colon, rest = word.partition(":")
        return (name, rest) if colon and rest and name in self.columns else (None, word)


def _pattern(term: Term) -> str:
    words = [re.escape(x) for x in term.words]
    return " ".join(words) + (r"[^ ]*" if term.prefix else "")


#: What the simple tokenizer takes for a token, and what lies between tokens.
_INSIDE, _BETWEEN = r"[0-9A-Za-z\x{80}-\x{10ffff}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _raw_pattern(term: Term) -> str:
    """A term in a text that is not cut into tokens; ASCII letters of any case."""
    spelled = _BETWEEN.join(rf"\Q{x}\E" for x in term.words)
    return rf"(?<!{_INSIDE}){spelled}" + (rf"{_INSIDE}*" if term.prefix else rf"(?!{_INSIDE})")


def _possible(node, lowered: dict[str, Column]) -> Column:
    """A cheap condition that every match meets: the words are somewhere in the lower-cased text."""
    if isinstance(node, (Both, Near)):
        return _possible(node.left, lowered) & _possible(node.right, lowered)
    if isinstance(node, Either):
        return _possible(node.left, lowered) | _possible(node.right, lowered)
    if isinstance(node, Without):
        return _possible(node.left, lowered)
    words = [x for x in node.words if x.isascii()]
    own = [c for name, c in lowered.items() if node.column in (None, name)]
    return reduce(operator.or_, (reduce(operator.and_, (F.contains(c, F.lit(x)) for x in words)) for c in own)) if words else F.lit(True)


def _holds_raw(node, texts: dict[str, Column]) -> Column:
    """The condition of a search tree on texts cut by the simple tokenizer, without cutting them: patterns read the texts as they are."""
    if isinstance(node, Both):
        return _holds_raw(node.left, texts) & _holds_raw(node.right, texts)
    if isinstance(node, Either):
        return _holds_raw(node.left, texts) | _holds_raw(node.right, texts)
    if isinstance(node, Without):
        return _holds_raw(node.left, texts) & ~_holds_raw(node.right, texts)
    if isinstance(node, Term):
        if not node.words:
            return F.lit(False)
        patterns, terms = [_raw_pattern(node)], (node,)
    else:
        if not node.left.words or not node.right.words:
            return F.lit(False)
        if node.distance > NEAR_PATTERN:
            return positions.holds(node, list(texts), positions.of_tokens({k: token_array(c) for k, c in texts.items()}))
        a, b = _raw_pattern(node.left), _raw_pattern(node.right)
        between = rf"{_BETWEEN}(?:{_INSIDE}+{_BETWEEN}){{0,{node.distance}}}"
        patterns, terms = [f"{a}{between}{b}", f"{b}{between}{a}"], (node.left, node.right)
    own = [c for name, c in texts.items() if all(t.column in (None, name) for t in terms)]
    return reduce(operator.or_, (F.regexp_like(c, F.lit(f"(?i){x}")) for c in own for x in patterns)) if own else F.lit(False)


def _holds(node, tokens: dict[str, Column]) -> Column:
    if isinstance(node, Both):
        return _holds(node.left, tokens) & _holds(node.right, tokens)
    if isinstance(node, Either):
        return _holds(node.left, tokens) | _holds(node.right, tokens)
    if isinstance(node, Without):
        return _holds(node.left, tokens) & ~_holds(node.right, tokens)
    if isinstance(node, Term):
        if not node.words:
            return F.lit(False)
        spelled = " " + " ".join(node.words) + ("" if node.prefix else " ")
        own = [c for name, c in tokens.items() if node.column in (None, name)]
        return reduce(operator.or_, (F.contains(c, F.lit(spelled)) for c in own))
    if isinstance(node, Near):
        if not node.left.words or not node.right.words:
            return F.lit(False)
        if node.distance > NEAR_PATTERN:
            return positions.holds(node, list(tokens), positions.of_tokens({k: token_list(c) for k, c in tokens.items()}))
        a, b = _pattern(node.left), _pattern(node.right)
        between = r"(?: [^ ]+){0,%d} " % node.distance
        own = [c for name, c in tokens.items() if node.left.column in (None, name) and node.right.column in (None, name)]
        return reduce(operator.or_, (F.regexp_like(c, F.lit(f" (?:{a}{between}{b}|{b}{between}{a}) ")) for c in own)) if own else F.lit(False)
    raise TypeError(f"not a search tree: {node!r}")


def word_atoms(node) -> set[tuple[str, bool]]:
    """The (word, is a prefix) that a search tree looks at."""
    if isinstance(node, Term):
        return {(w, node.prefix and k == len(node.words) - 1) for k, w in enumerate(node.words)}
    return word_atoms(node.left) | word_atoms(node.right)


def needs_places(node) -> bool:
    """Whether a search tree asks where words stand, and not only which there are."""
    return len(node.words) > 1 if isinstance(node, Term) else isinstance(node, Near) or needs_places(node.left) or needs_places(node.right)


class TextIndex:
    """Searchable columns of a DataFrame.  Of an array column each element is searched by itself, with the other columns."""

    def __init__(self, df: DataFrame, columns: Sequence[str], tokenizer: Tokenizer | None = None, body: str = "body"):
        if not columns:
            raise QueryError("a text index has at least one field")
        self.tokenizer = tokenizer or Tokenizer()
        names = [*(x for x in ("_id", "_rev") if x in df.columns and x not in columns), *columns]
        resolve = fld.Resolver(df, body)
        self.found = {name: resolve(name) for name in names}
        arrays = [name for name, f in self.found.items() if f.kind == "array"]
        if len(arrays) > 1:
            raise QueryError("a text index has at most one array field")
        self.array = arrays[0] if arrays else None

    def _text(self, field: fld.Field) -> Column:
        if field.kind == "variant":
            return F.when(fld.variant_exists(field.column), F.try_variant_get(field.column, "$", "string"))
        return field.column if isinstance(field.type, T.StringType) else field.column.cast("string")

    def texts(self, plain: bool = False) -> dict[str, Column]:
        """The tokens of each field, as ` token token `, or its plain text."""
        return {name: self._text(f) if plain else self.tokenizer.column(self._text(f)) for name, f in self.found.items()}

    def __call__(self, search: str) -> Column:
        """The condition of a search."""
        tree = Parser(search, list(self.found), self.tokenizer).parse()
        if self.tokenizer == Tokenizer():
            cut, holds = (lambda c: F.coalesce(c, F.lit(""))), lambda texts: _possible(tree, {k: F.lower(c) for k, c in texts.items()}) & _holds_raw(tree, texts)
        else:
            cut, holds = self.tokenizer.column, lambda texts: _holds(tree, texts)
        plain = {name: cut(self._text(f)) for name, f in self.found.items() if name != self.array}
        if self.array is None:
            return holds(plain)
        elements = F.when(F.size(self.found[self.array].column) > 0, self.found[self.array].column).otherwise(F.array(F.lit(None).cast(self.found[self.array].element)))
        return F.exists(elements, lambda e: holds(plain | {self.array: cut(e.cast("string"))}))


def search(df: DataFrame, text: str, columns: Sequence[str], tokenizer: Tokenizer | None = None) -> DataFrame:
    """Rows of df that match a search over columns."""
    return df.where(TextIndex(df, columns, tokenizer)(text))
