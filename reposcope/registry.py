"""Indexes that are held in a session: built once however many ask, the least lately used given up."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

CAPACITY = 8


@dataclass(frozen=True)
class Entry:
    root: str
    index: Any
    built_at: float = field(default_factory=time.time)


class Registry:
    """An index of each root. ``build()`` gives anything; if that has ``release``, it is called when the
    entry is given up, so that what Spark has persisted for it goes. A failed build is not kept: the
    next one to ask builds anew. While a root is refreshed its old index is served."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.entries: OrderedDict[str, Entry] = OrderedDict()
        self.pending: dict[str, Future] = {}
        self.lock = threading.Lock()
        self.users: dict[int, int] = {}
        self.doomed: dict[int, Entry] = {}
        self.released: dict[int, Entry] = {}

    def ensure(self, root: str, build: Callable[[], Any]) -> Entry:
        return self._made(root, build, False)

    def refresh(self, root: str, build: Callable[[], Any]) -> Entry:
        return self._made(root, build, True)

    def _made(self, root: str, build: Callable[[], Any], anew: bool) -> Entry:
        """What is there, or what a running or an own build gives: looked up and claimed under one lock, so that
        a build that ended meanwhile is not made again."""
        with self.lock:
            if not anew and root in self.entries:
                self.entries.move_to_end(root)
                return self.entries[root]
            running = self.pending.get(root)
            if running is None:
                mine = self.pending[root] = Future()
        if running is not None:
            return running.result()
        try:
            entry = Entry(root, build())
        except BaseException as e:
            with self.lock:
                del self.pending[root]
            mine.set_exception(e)
            raise
        with self.lock:
            gone = [self.entries.pop(root)] if root in self.entries else []
            self.entries[root] = entry
            while len(self.entries) > self.capacity:
                gone.append(self.entries.popitem(last=False)[1])
            del self.pending[root]
        mine.set_result(entry)
        for old in gone:
            self._give_up(old)
        return entry

    @contextmanager
    def use(self, root: str, build: Callable[[], Any]) -> Iterator[Any]:
        """The index of a root for as long as the block lasts: it may be given up meanwhile, but is released
        only when the last one has done with it."""
        while True:
            entry = self.ensure(root, build)
            with self.lock:
                if id(entry) not in self.released:
                    self.users[id(entry)] = self.users.get(id(entry), 0) + 1
                    break
        try:
            yield entry.index
        finally:
            with self.lock:
                self.users[id(entry)] -= 1
                last = not self.users[id(entry)]
                if last:
                    del self.users[id(entry)]
                doomed = last and self.doomed.pop(id(entry), None) is not None
            if doomed:
                _release(entry.index)

    def _give_up(self, entry: Entry) -> None:
        with self.lock:
            if id(entry) in self.users:
                self.doomed[id(entry)] = entry
                return
            self.released[id(entry)] = entry
        _release(entry.index)
        with self.lock:
            del self.released[id(entry)]

    def get(self, root: str) -> Entry | None:
        return self.entries.get(root)

    def drop(self, root: str) -> None:
        with self.lock:
            entry = self.entries.pop(root, None)
        if entry is not None:
            self._give_up(entry)

    def list(self) -> list[Entry]:
        """By root, so that what is asked does not move what is shown."""
        with self.lock:
            return sorted(self.entries.values(), key=lambda e: e.root)

    def clear(self) -> None:
        for entry in self.list():
            self.drop(entry.root)


def _release(index: Any) -> None:
    release = getattr(index, "release", None)
    if callable(release):
        release()
