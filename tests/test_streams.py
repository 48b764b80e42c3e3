"""Streams: outcomes by state and timers, refresh by batches, windows, the event source."""

import json
import random
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from reposcope.operators import mining
from reposcope.operators.feedback import ANSWERS
from reposcope.sources import events as source
from reposcope.sources.snapshots import Ledger
from reposcope.streaming import refresh

LOG = "thread string, seq bigint, kind string, value string, surface string, files array<string>"


def log_rows(rng, threads=4):
    rows = []
    for t in range(threads):
        for seq in range(1, 40):
            kind = rng.choice(["answer", "search", "change", "other"])
            rows.append((f"t{t}", seq, kind, rng.choice("abcd") if kind == "change" else None, f"s{seq % 2}" if kind == "answer" else None, rng.sample("abcd", 2) if kind == "answer" else None))
    return rows


def written(tmp_path, spark, rows, name):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(str(tmp_path / name))


def until(true, seconds=60):
    """Waits for what a running stream brings about: with timers it always has a batch to run."""
    end = time.time() + seconds
    while not true():
        assert time.time() < end, "the stream did not come to it"
        time.sleep(0.3)


def read(query, rows):
    """Waits until a stream has taken in so many rows."""
    until(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= rows)


def closed(spark, name):
    return sorted((r.thread, r.answer_seq, r.surface, r.searches_after, r.changed, r.hit, r.missed, r.recall) for r in spark.table(name).collect())


def batch_outcomes(spark, rows):
    log = spark.createDataFrame(rows, LOG)
    answers = log.where("kind = 'answer'").select("thread", "seq", "surface", "files")
    found = mining.outcomes(answers, log.select("thread", "seq", "kind", "value"))
    return sorted((r.thread, r.answer_seq, r.surface, r.searches_after, r.changed, r.hit, r.missed, r.recall) for r in found.collect())


def test_outcomes_of_shuffled_arrivals_equal_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = log_rows(rng)
    late = list(rows)
    rng.shuffle(late)
    for i in range(4):  # a file is a batch
        written(tmp_path, spark, late[i::4], "log")
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    query = refresh.outcomes_on_idle(log).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        read(query, len(rows))
        assert closed(spark, "outcomes") == []
        written(tmp_path, spark, [(f"t{t}", 99, "idle", None, None, None) for t in range(4)], "log")
        until(lambda: len(closed(spark, "outcomes")) >= sum(r[2] == "answer" for r in rows))
        assert closed(spark, "outcomes") == batch_outcomes(spark, rows)
        read(query, len(rows) + 4)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
        written(tmp_path, spark, [("t0", 120, "answer", None, "s", ["a"]), ("t0", 125, "change", "a", None, None), ("t0", 110, "idle", None, None, None)], "log")
        read(query, len(rows) + 7)
        assert len(closed(spark, "outcomes")) == len(batch_outcomes(spark, rows))  # answers after the idle event stay open
    finally:
        assert refresh.stop(query)


def test_grace_waits_for_what_is_under_way(spark, tmp_path):
    written(tmp_path, spark, [("t", 1, "answer", None, "s", ["a"]), ("t", 9, "idle", None, None, None)], "log")
    log = spark.readStream.schema(LOG).json(str(tmp_path / "log"))
    query = refresh.outcomes_on_idle(log, grace=20).writeStream.format("memory").queryName("graced").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        read(query, 2)
        written(tmp_path, spark, [("t", 5, "change", "a", None, None), ("t", 6, "search", None, None, None)], "log")
        until(lambda: closed(spark, "graced"))
        assert closed(spark, "graced") == [("t", 1, "s", 1, ["a"], ["a"], [], 1.0)]
    finally:
        assert refresh.stop(query)


def test_outcomes_into_the_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.put("answers", spark.createDataFrame([("x", "t", "q", [], 1, ["a"], [], 1, 5, 1, "s"), ("y", "u", "q", [], 1, ["a"], [], 1, 5, 1, "s")], ANSWERS), 0)
    written(tmp_path, spark, [("t", 1, "answer", None, "s", ["a"]), ("t", 3, "change", "a", None, None), ("t", 9, "idle", None, None, None), ("u", 1, "answer", None, "s", ["a"])], "log")
    log = spark.readStream.schema(LOG).json(str(tmp_path / "log"))
    for run in range(2):  # the second plays the same batch again, with a state of its own
        query = refresh.record_on(refresh.outcomes_on_idle(log), ledger).option("checkpointLocation", str(tmp_path / f"state{run}")).start()
        read(query, 4)
        until(lambda: ledger.outcomes().count())
        assert refresh.stop(query)
        assert [(r.answer_id, r.recall) for r in ledger.outcomes().collect()] == [("x", 1.0)] and [r.answer_id for r in ledger.open().collect()] == ["y"]


def test_refresh_by_batches(spark, tmp_path):
    schema = "file string, hash string, seen_at bigint, gone boolean"
    stored = {"now": spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, hash string")}
    done = []

    def write(merged, batch_id):
        done.append(batch_id)
        stored["now"] = spark.createDataFrame([tuple(r) for r in merged.select("file", "hash").collect()], "file string, hash string")

    for rows in ([("a", "2", 1, False), ("a", "3", 2, False), ("d", "1", 1, False)], [("b", None, 3, True), ("c", "1", 3, False)], [("c", "1", 4, False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "seen"))
    seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "seen"))
    query = refresh.refresh_on(seen, lambda: stored["now"], write, 1).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    assert refresh.stop(query)
    assert sorted(map(tuple, stored["now"].collect())) == [("a", "3"), ("c", "1"), ("d", "1")] and done == [0, 1]


def test_windows_count_and_let_go_of_late_events(spark, tmp_path):
    schema = "ts timestamp, kind string"
    (tmp_path / "ev").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "ev"))
    query = refresh.windows(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    for rows in (["2026-01-01 10:05:00", "2026-01-01 10:50:00", "2026-01-01 11:10:00"], ["2026-01-01 15:00:00"], ["2026-01-01 10:06:00", "2026-01-01 15:30:00"], ["2026-01-01 22:00:00"]):
        spark.createDataFrame([(t, "k") for t in rows], "ts string, kind string").coalesce(1).write.mode("append").json(str(tmp_path / "ev"))
        query.processAllAvailable()  # one batch after another, the third with a late event
    assert refresh.stop(query)
    got = {(str(r.start)[11:16], r.n) for r in spark.table("windows").collect()}
    assert got == {("10:00", 2), ("11:00", 1), ("15:00", 2)}
    slid = refresh.windows(spark.createDataFrame([("2026-01-01 10:05:00", "k")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts")), "1 hour", "30 minutes")
    assert {str(r.start)[11:16] for r in slid.collect()} == {"09:30", "10:00"}


@pytest.fixture
def service():
    """Threads a (1,203 events), b (none) and stuck (a full page that leads nowhere)."""
    held = {"a": [{"seq": i, "type": "t", "data": {"i": i}} for i in range(1, 1204)] + [{"seq": 1204}, {"seq": True, "type": "t"}, {"type": "t"}, "x"], "b": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            thread, after, limit = re.fullmatch(r"/(\w+)/(\d+)/(\d+)", self.path).groups()
            if thread == "stuck":
                page = [{"seq": 1, "type": "t"}] * int(limit)
            else:
                page = [e for e in held[thread] if not isinstance(e, dict) or not isinstance(e.get("seq"), int) or e["seq"] > int(after)][: int(limit)]
            body = json.dumps(page if thread != "b" else {"events": page, "last": len(held["b"])}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{thread}}/{{after}}/{{limit}}", held
    server.shutdown()


def test_event_source(spark, tmp_path, service):
    url, held = service
    spark.dataSource.register(source.EventSource)
    rows = spark.read.format("thread_events").options(url=url, threads='["a", "b"]').load()
    assert rows.count() == 1203 and rows.select("seq").distinct().count() == 1203 and rows.where("seq = 5").first()["data"] == '{"i": 5}'
    with pytest.raises(Exception, match="do not lead beyond 1"):
        spark.read.format("thread_events").options(url=url, threads='["stuck"]').load().count()
    stream = spark.readStream.format("thread_events").options(url=url, threads='["a", "b"]', page="100").load()
    query = stream.writeStream.format("memory").queryName("events").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert spark.table("events").count() == 1203
        held["b"] += [{"seq": i, "type": "t", "data": None} for i in range(1, 8)]
        query.processAllAvailable()
        assert spark.table("events").where("thread = 'b'").count() == 7 and spark.table("events").count() == 1210
    finally:
        assert refresh.stop(query)
