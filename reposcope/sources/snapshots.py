"""Snapshots of relations: a log of manifests over immutable data, and the outcome ledger on the same log.

A save writes its Parquet files into a folder of its own and then publishes one manifest, a small JSON
file with a number and a digest of itself. Only a whole manifest counts, and no file is ever written
over, so that a save that dies at any step changes nothing for readers; those who have opened a version
go on reading it until it is cleared by age.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that what no manifest names, or an old manifest, is left for those who still write or read it.
KEEP_SECONDS = 24 * 3600


class Store:
    """Files below a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.disk = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> dict[str, tuple[int, int]]:
        """(length, time of change in seconds) of what is in a folder; nothing if there is none."""
        at = self.path(folder)
        if not self.disk.exists(at):
            return {}
        return {s.getPath().getName(): (s.getLen(), s.getModificationTime() // 1000) for s in self.disk.listStatus(at)}

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name."""
        from py4j.protocol import Py4JJavaError

        self.disk.mkdirs(self.path(name).getParent())
        if self.disk.exists(self.path(name)):
            return False
        try:
            out = self.disk.create(self.path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.toString()) or self.disk.exists(self.path(name)):
                return False
            raise
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str | None:
        from py4j.protocol import Py4JJavaError

        try:
            source = self.disk.open(self.path(name))
            try:
                return bytes(source.readAllBytes()).decode("utf-8")
            finally:
                source.close()
        except (Py4JJavaError, UnicodeDecodeError):
            return None

    def remove(self, name: str) -> None:
        self.disk.delete(self.path(name), True)


def _sealed(body: dict) -> str:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"digest": hashlib.sha256(text.encode()).hexdigest(), "body": text})


def _opened(text: str | None) -> dict | None:
    """A manifest's body, or None if it is not whole."""
    try:
        outer = json.loads(text or "")
        body = outer["body"]
        return json.loads(body) if hashlib.sha256(body.encode()).hexdigest() == outer["digest"] else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@dataclass
class Log:
    """Manifests by number, below ``<path>/log``."""

    store: Store
    folder: str = "log"
    known: dict[int, dict] = field(default_factory=dict)

    def numbers(self) -> list[int]:
        found = (re.fullmatch(r"(\d{20})\.json", n) for n in self.store.names(self.folder))
        return sorted(int(m[1]) for m in found if m)

    def read(self, number: int) -> dict | None:
        if number not in self.known:
            body = _opened(self.store.read(f"{self.folder}/{number:020d}.json"))
            if body is None:
                return None
            self.known[number] = body  # manifests never change
        return self.known[number]

    def last(self) -> tuple[int, dict] | None:
        """The newest whole manifest."""
        for number in reversed(self.numbers()):
            body = self.read(number)
            if body is not None:
                return number, body
        return None

    def publish(self, body: dict) -> int:
        """Under the next free number; two writers never share one."""
        while True:
            number = max(self.numbers(), default=-1) + 1
            if self.store.create(f"{self.folder}/{number:020d}.json", _sealed(body)):
                return number


def _files(store: Store, folder: str) -> dict[str, int]:
    return {n: length for n, (length, _) in store.names(folder).items() if not n.startswith(("_", "."))}


def _digests(store: Store, folders: list[str]) -> dict[str, str]:
    """sha256 of each file of the folders, by its path below the store; made by tasks, a row a file."""
    rows = []
    for f in folders:
        if _files(store, f):
            found = store.spark.read.format("binaryFile").load(f"{store.root}/{f}")
            rows += [(f"{f}/{r['n']}", r["d"]) for r in found.select(F.element_at(F.split("path", "/"), -1).alias("n"), F.sha2("content", 256).alias("d")).collect()]
    return dict(rows)


def _unchanged(store: Store, kept: dict) -> bool:
    """Whether a relation's files have the digests that were kept; a file that cannot be read has not."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return _digests(store, [kept["folder"]]) == {f"{kept['folder']}/{n}": d for n, d in kept["digests"].items()}
    except (Py4JJavaError, PySparkException):
        return False


def save(relations: dict[str, DataFrame], path: str, version: int, health: dict | None = None, note: dict | None = None, digests: bool = False) -> int | None:
    """Publishes the relations as one snapshot of engine ``version`` and gives its number. With ``health`` (what
    ``extract.health`` says) of a scan that failed (nothing parsed, or more files failed than were parsed)
    nothing is saved: None. ``digests`` also keeps each file's sha256, for ``load`` to compare. ``note``
    is kept beside them."""
    if health is not None and not (health["parsed"] > 0 and health["failed"] <= health["parsed"]):
        return None
    store = Store(next(iter(relations.values())).sparkSession, path)
    folder = f"data/{uuid.uuid4().hex}"
    kept = {}
    for name, df in relations.items():
        df.write.option("compression", "zstd").parquet(f"{store.root}/{folder}/{name}")
        kept[name] = {"folder": f"{folder}/{name}", "schema": df.schema.jsonValue(), "files": _files(store, f"{folder}/{name}")}
    sums = _digests(store, [k["folder"] for k in kept.values()]) if digests else {}
    for k in kept.values():
        k["digests"] = {n: sums[f"{k['folder']}/{n}"] for n in k["files"]} if digests else {}
    return Log(store).publish({"version": version, "at": time.time(), "relations": kept, "note": note or {}})


def load(spark: SparkSession, path: str, names: list[str] | None, version: int, number: int | None = None, verify: bool = False) -> dict[str, DataFrame] | None:
    """The newest whole snapshot's relations (of ``number``: that one's); None if there is none, it is not of
    exactly this engine version, a relation is missing, or a data file is missing or not as long as it
    was written; with ``verify`` also if a file's digest differs from the one that was kept. The files
    are those of one manifest, whatever is saved meanwhile."""
    store = Store(spark, path)
    log = Log(store)
    body = log.read(number) if number is not None else (log.last() or (0, None))[1]
    if body is None or body.get("version") != version:
        return None
    found = {}
    for name in names if names is not None else body["relations"]:
        kept = body["relations"].get(name)
        if kept is None or _files(store, kept["folder"]) != kept["files"]:
            return None
        if verify and kept["digests"] and not _unchanged(store, kept):
            return None
        schema = T.StructType.fromJson(kept["schema"])
        found[name] = spark.read.schema(schema).parquet(f"{store.root}/{kept['folder']}") if kept["files"] else spark.createDataFrame([], schema)
    return found


def note(spark: SparkSession, path: str) -> dict | None:
    """What was kept beside the newest snapshot."""
    found = Log(Store(spark, path)).last()
    return found[1]["note"] if found else None


def clear(spark: SparkSession, path: str, keep: int = 2, seconds: float = KEEP_SECONDS) -> list[str]:
    """Removes manifests older than ``seconds`` but for the newest ``keep`` whole ones, then data folders as old
    that no manifest names; gives the names of what went."""
    store, now, gone = Store(spark, path), time.time(), []
    log = Log(store)
    whole = [n for n in log.numbers() if log.read(n) is not None]
    times = store.names(log.folder)
    for n in log.numbers():
        name = f"{n:020d}.json"
        if n not in whole[-keep:] and now - times[name][1] > seconds:
            store.remove(f"{log.folder}/{name}")
            gone.append(name)
    named = {k["folder"].split("/")[1] for n in log.numbers() for k in (log.read(n) or {"relations": {}})["relations"].values()}
    for name, (_, changed) in store.names("data").items():
        if name not in named and now - changed > seconds:
            store.remove(f"data/{name}")
            gone.append(name)
    return gone


class Ledger:
    """Answers and their outcomes, written by batches that may come again.

    Each batch is a folder of its own and a manifest named after its table and batch id, so that a batch
    that is played again finds itself done, and one that died leaves nothing. An answer has one outcome:
    the one of the earliest batch (of several in a batch, the earliest recorded); ``resolved`` is
    derived from that and stored nowhere."""

    TABLES = ("answers", "outcomes")

    def __init__(self, spark: SparkSession, path: str):
        from reposcope.operators.feedback import ANSWERS, OUTCOMES

        self.spark, self.store = spark, Store(spark, path)
        self.schemas = {"answers": ANSWERS, "outcomes": OUTCOMES}

    def put(self, table: str, rows: DataFrame, batch_id: int | str) -> bool:
        """Adds the rows of a batch; False if that batch is there. Columns are taken by name and made to fit
        the table's types; a missing one, or a null answer_id, is an error."""
        schema = self.spark.createDataFrame([], self.schemas[table]).schema
        missing = [f.name for f in schema if f.name not in rows.columns]
        if missing:
            raise ValueError(f"{table} lacks {missing}")
        name = f"{table}/{_batch(batch_id)}.json"
        if _opened(self.store.read(name)) is not None:
            return False
        self.store.remove(name)  # of a writer that died
        named = F.when(F.col("answer_id").isNull(), F.raise_error(F.lit("answer_id is null")).cast("string")).otherwise(F.col("answer_id"))
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("answer_id", named).select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.parquet(f"{self.store.root}/{folder}")
        return self.store.create(name, _sealed({"batch": str(batch_id), "folder": folder}))

    def table(self, table: str) -> DataFrame:
        """All rows of finished batches, with ``batch``."""
        found = [_opened(self.store.read(f"{table}/{n}")) for n in self.store.names(table)]
        folders = {m["folder"]: m["batch"] for m in found if m}
        schema = self.spark.createDataFrame([], self.schemas[table]).schema
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.store.root}/{f}" for f in folders))
        names = self.spark.createDataFrame([(f.split("/")[1], b) for f, b in folders.items()], "_folder string, batch string")
        own = rows.withColumn("_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return own.join(F.broadcast(names), "_folder").drop("_folder")  # a row for each batch

    def answers(self) -> DataFrame:
        """Rows of answers, one for each answer_id, with resolved."""
        first = F.min_by(F.struct(*(c.split()[0] for c in self.schemas["answers"].split(", "))), F.struct("answered_at", "batch"))
        rows = self.table("answers").groupBy("answer_id").agg(first.alias("x")).select("x.*")
        done = self.outcomes().select("answer_id", F.lit(True).alias("resolved"))
        return rows.join(done, "answer_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))

    def outcomes(self) -> DataFrame:
        """One row for each answer that has an outcome."""
        number = F.try_to_number(F.col("batch"), F.lit("9" * 18))
        first = F.min_by(F.struct(*(c.split()[0] for c in self.schemas["outcomes"].split(", "))), F.struct(number, "batch", "recorded_at"))
        return self.table("outcomes").groupBy("answer_id").agg(first.alias("x")).select("x.*")

    def open(self) -> DataFrame:
        return self.answers().where("not resolved")

    def close(self, events: DataFrame, batch_id: int | str, recorded_at: int) -> bool:
        """Outcomes of all open answers from events (thread, seq, type, data), as one batch."""
        from reposcope.operators.feedback import close_answers

        return self.put("outcomes", close_answers(self.open(), events, recorded_at), batch_id)


def _batch(batch_id: int | str) -> str:
    text = str(batch_id)
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,120}", text):
        raise ValueError("a batch id is 1 to 120 letters, digits, dots, hyphens or underscores")
    return text
