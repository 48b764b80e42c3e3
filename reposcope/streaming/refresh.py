"""Streams: files that change, the activity log in windows of event time, answers that wait for silence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reposcope.operators.mining import freshness, merge_incremental

#: Limits of the time between two looks.
SECONDS = (5, 3600)


def merge_batch(stored: DataFrame, batch: DataFrame, swept: bool) -> tuple[DataFrame, DataFrame]:
    """The report of what differs, and the merged table. A batch that is a whole sweep also tells what is
    gone; otherwise ``gone`` rows of the batch do, and files it does not name stay as they are."""
    gone = batch.where("gone").select("file").distinct() if "gone" in batch.columns else None
    seen = batch.where("not gone").drop("gone") if gone is not None else batch
    if swept:
        report = freshness(stored, seen)
    else:
        named = seen.select("file") if gone is None else seen.select("file").union(gone).distinct()
        report = freshness(stored.join(named, "file", "left_semi"), seen)
    return report, merge_incremental(stored, seen, report)


def refresh_on(stream: DataFrame, read_stored: Callable[[], DataFrame], write_merged: Callable[[DataFrame, int], None], seconds: int = 30, swept: bool = False):
    """A writer that, for each batch of (file, hash, ...[, gone]) rows seen, merges what changed and drops what
    is gone; ``swept`` if every batch is a whole sweep of the files. A file seen more than once in a
    batch counts as last seen (``seen_at``, if there is such a column). ``read_stored()`` gives the stored
    table, ``write_merged(df, batch_id)`` must be safe to repeat."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        if "seen_at" in batch.columns:
            rest = [c for c in batch.columns if c != "file"]
            batch = batch.groupBy("file").agg(F.max_by(F.struct(*rest), "seen_at").alias("x")).select("file", "x.*").drop("seen_at")
        report, merged = merge_batch(read_stored(), batch, swept)
        if report.limit(1).count():
            write_merged(merged, batch_id)

    return stream.writeStream.foreachBatch(merge).trigger(processingTime=f"{min(max(seconds, SECONDS[0]), SECONDS[1])} seconds")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(thread, start, end, n, last_seq): idle gaps end a thread's session. ``ts`` must be a timestamp with
    zone; the watermark bounds the state."""
    watched = events.withWatermark("ts", late)
    grouped = watched.groupBy("thread", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
    return grouped.select("thread", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last_seq")


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, kind, n): counts of events (ts, kind) in tumbling windows, or sliding ones."""
    watched = events.withWatermark("ts", late)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return watched.groupBy(span.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


OUTCOME = "thread string, answer_seq bigint, surface string, searches_after bigint, changed array<string>, hit array<string>, missed array<string>, recall double"
#: Class of the state store that keeps lists, maps and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Outcomes(StatefulProcessor):
    """A thread's open answers (map by sequence and number), sequences of searches (list) and last changes of
    values (map), and the idle event that waits to close answers (value). A row of state is written for
    what arrives; nothing else is read until answers are closed. What stays open without any event for
    ``minutes`` is closed by a timer, and a time to live ends whatever may be left."""

    def __init__(self, minutes: int, grace: int):
        self.wait, self.grace, self.live = minutes * 60_000, grace * 1000, max(4 * minutes, 1) * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "seq bigint, n int", "surface string, files array<string>", self.live)
        self.searches = handle.getListState("searches", "seq bigint", self.live)
        self.changes = handle.getMapState("changes", "value string", "seq bigint", self.live)
        self.idle = handle.getValueState("idle", "seq bigint", self.live)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idle = self.idle.get()[0] if self.idle.exists() else None
        for batch in rows:
            found = batch[batch["kind"] == "search"]["seq"]
            if len(found):
                self.searches.appendList([(int(s),) for s in found])
            for r in batch.itertuples(index=False):
                seq = int(r.seq)
                if r.kind == "answer":
                    n = 0
                    while self.answers.containsKey((seq, n)):
                        n += 1
                    self.answers.updateValue((seq, n), (r.surface, [str(f) for f in r.files] if r.files is not None else []))
                elif r.kind == "change" and r.value:
                    known = self.changes.getValue((r.value,)) if self.changes.containsKey((r.value,)) else None
                    if known is None or known[0] < seq:
                        self.changes.updateValue((r.value,), (seq,))
                elif r.kind == "idle":
                    idle = seq if idle is None else max(idle, seq)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        now = timerValues.getCurrentProcessingTimeInMs()
        if idle is not None and not self.grace:
            yield from self.closed(key, idle)
        elif idle is not None:
            self.idle.update((idle,))
            self.handle.registerTimer(now + self.grace)
        if self.answers.exists() or self.searches.exists() or self.changes.exists():
            self.handle.registerTimer(now + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.idle.exists():
            yield from self.closed(key, self.idle.get()[0])
        else:
            yield from self.closed(key, None)

    def closed(self, key, upto: int | None) -> Iterator[pd.DataFrame]:
        """Outcomes of the answers up to a sequence (or all), by what happened between; that is then let go."""
        inside = (lambda s: True) if upto is None else (lambda s: s <= upto)
        searches = [s for (s,) in self.searches.get()] if self.searches.exists() else []
        changes = {k[0]: v[0] for k, v in self.changes.iterator()} if self.changes.exists() else {}
        out, done = [], []
        for (seq, n), (surface, files) in list(self.answers.iterator()) if self.answers.exists() else []:
            if inside(seq):
                changed = sorted(v for v, s in changes.items() if s > seq)
                hit = sorted(set(changed) & set(files))
                out.append((key[0], seq, surface, sum(1 for s in searches if s > seq and inside(s)), changed, hit, sorted(set(changed) - set(files)), len(hit) / len(changed) if changed else None))
                done.append((seq, n))
        for k in done:
            self.answers.removeKey(k)
        rest = [(s,) for s in searches if not inside(s)]
        if rest:
            self.searches.put(rest)
        else:
            self.searches.clear()
        for v, s in changes.items():
            if inside(s):
                self.changes.removeKey((v,))
        self.idle.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def outcomes_on_idle(log: DataFrame, minutes: int = 30, grace: int = 0) -> DataFrame:
    """Outcomes of answers as their threads fall silent, from a stream of (thread, seq, kind, value, surface,
    files): kind is answer, search, change or idle. An idle event closes all answers before it, ``grace``
    seconds after it came, so that events that are under way still count; so does ``minutes`` without
    any event. What counts is the sequence, not the order of arrival: searches between an answer and the
    idle event, and values whose last change is after the answer. The session's state store becomes the
    one that keeps lists, maps and timers."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return log.groupBy("thread").transformWithStateInPandas(Outcomes(minutes, grace), OUTCOME, "append", "processingTime")


def record_on(outcomes: DataFrame, ledger) -> DataStreamWriter:
    """A writer that puts each batch of outcomes into a ledger (``snapshots.Ledger``), with the ids of the open
    answers that they belong to. A batch that is played again changes nothing."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.count()  # the state is kept only if every partition is read, also of a batch that the ledger has
        known = ledger.answers().select("answer_id", "thread", F.col("seq").alias("answer_seq"), "surface")
        rows = batch.join(known, ["thread", "answer_seq", "surface"]).withColumn("recorded_at", F.unix_millis(F.current_timestamp()))
        ledger.put("outcomes", rows, batch_id)
        batch.unpersist()

    return outcomes.writeStream.foreachBatch(put)


def stop(query: StreamingQuery, seconds: int = 60) -> bool:
    """Ends a stream after the batch it is in; whether it ended in time."""
    query.stop()
    return query.awaitTermination(seconds)
