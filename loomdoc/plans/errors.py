"""Errors that callers can tell apart."""


class QueryError(ValueError):
    """A selector, index or search that is not well-formed."""


class ConflictError(Exception):
    """A write whose previous revision is not the one that must be extended."""


class NotFoundError(KeyError):
    """No document, revision or attachment of that name."""
