"""The activity log of a service as a Spark data source, for batches and streams.

``spark.dataSource.register(EventSource)``, then ``read`` or ``readStream`` of format ``thread_events`` with
the options ``url`` (with {thread}, {after} and {limit} to be filled in), ``threads`` (a JSON list) and
``page`` (500). A page is a JSON list of events, or an object with ``events`` and perhaps ``last``, the
greatest sequence there is. Every thread is a partition that tasks read page by page; of a stream each
batch is the sequences between two offsets, so that a batch that is played again reads the same.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "thread string, seq bigint, type string, data string"
#: Fixed value: events of a page.
PAGE = 500


@dataclass
class Span(InputPartition):
    """A thread's sequences above ``after``, up to ``upto`` (or all)."""

    thread: str
    after: int
    upto: int | None = None


class Pages:
    """Pages of a thread behind a sequence."""

    def __init__(self, options: dict):
        self.url, self.page = options["url"], int(options.get("page", PAGE))
        self.threads = [str(t) for t in json.loads(options["threads"])]
        if self.page < 1:
            raise ValueError("a page has 1 event or more")

    def fetch(self, thread: str, after: int) -> tuple[list[dict], int | None]:
        url = self.url.format(thread=urllib.parse.quote(thread, safe=""), after=after, limit=self.page)
        with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310: the URL is the user's own
            found = json.load(answer)
        if isinstance(found, dict):
            return found.get("events", []), found.get("last")
        return found, None

    def events(self, span: Span) -> Iterator[tuple]:
        """Rows of ``SCHEMA`` in the order of their sequence. Events without a whole seq or a type are left
        out; a full page that does not lead beyond the one before is an error, as it would never end."""
        after = span.after
        while span.upto is None or after < span.upto:
            found, _ = self.fetch(span.thread, after)
            rows = [e for e in found if isinstance(e, dict) and type(e.get("seq")) is int and isinstance(e.get("type"), str)]
            last = max((e["seq"] for e in rows), default=after)
            for e in sorted(rows, key=lambda e: e["seq"]):
                if e["seq"] > after and (span.upto is None or e["seq"] <= span.upto):
                    yield span.thread, e["seq"], e["type"], json.dumps(e.get("data"), ensure_ascii=False)
            if len(found) < self.page:
                return
            if last <= after:
                raise RuntimeError(f"events of {span.thread} do not lead beyond {after}")
            after = last

    def last(self, thread: str, after: int) -> int:
        """The greatest sequence of a thread, as the service says or as its pages end."""
        found, last = self.fetch(thread, after)
        if isinstance(last, int):
            return max(last, after)
        return max((r[1] for r in self.events(Span(thread, after))), default=after) if found else after


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "thread_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EventReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventStreamReader(self.options)


class EventReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)

    def partitions(self) -> list[Span]:
        return [Span(t, 0) for t in self.pages.threads]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.pages.events(partition)


class EventStreamReader(DataSourceStreamReader):
    """Offsets are the greatest sequence read of each thread."""

    def __init__(self, options: dict):
        self.pages = Pages(options)
        self.seen = {t: 0 for t in self.pages.threads}

    def initialOffset(self) -> dict:
        return {t: 0 for t in self.pages.threads}

    def latestOffset(self) -> dict:
        self.seen = {t: self.pages.last(t, self.seen.get(t, 0)) for t in self.pages.threads}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = [Span(t, int(start.get(t, 0)), int(n)) for t, n in end.items() if int(n) > int(start.get(t, 0))]
        return spans or [Span(t, int(n), int(n)) for t, n in list(end.items())[:1]]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.pages.events(partition)

    def commit(self, end: dict) -> None:
        self.seen = {t: max(int(n), self.seen.get(t, 0)) for t, n in end.items()}
