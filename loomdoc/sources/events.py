"""Events: a synchronous bus of typed notifications on the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Event:
    """What all notifications are."""


@dataclass(frozen=True)
class DocumentModified(Event):
    doc_id: str
    previous: str | None
    revision: str | None


class DocumentCreated(DocumentModified):
    pass


class DocumentUpdated(DocumentModified):
    pass


class DocumentDeleted(DocumentModified):
    pass


@dataclass(frozen=True)
class StoreEvent(Event):
    path: str


class StoreCreated(StoreEvent):
    pass


class StoreOpened(StoreEvent):
    pass


class StoreClosed(StoreEvent):
    pass


class StoreDeleted(StoreEvent):
    pass


@dataclass(frozen=True)
class ReplicationCompleted(Event):
    replication_id: str
    documents: int
    batches: int


@dataclass(frozen=True)
class ReplicationErrored(Event):
    replication_id: str
    error: Any = field(compare=False)


class EventBus:
    """Calls subscribers of a notification's type or a supertype, in order of subscription; their errors are logged."""

    def __init__(self):
        self._subscribers: list[tuple[type, Callable]] = []

    def register(self, kind: type, subscriber: Callable[[Any], None]) -> None:
        if (kind, subscriber) not in self._subscribers:
            self._subscribers.append((kind, subscriber))

    def unregister(self, subscriber: Callable) -> None:
        self._subscribers = [x for x in self._subscribers if x[1] != subscriber]

    def post(self, event: Any) -> None:
        for kind, subscriber in list(self._subscribers):
            if isinstance(event, kind):
                try:
                    subscriber(event)
                except Exception:  # a subscriber's error must not reach the writer
                    log.exception("a subscriber failed on %r", event)
