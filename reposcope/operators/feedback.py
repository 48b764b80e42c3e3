"""The life of answers: recorded with the sequence they were given at, closed by what happened after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.operators.mining import by_surface, looks_like_search, outcomes

#: Surface of answers that name none, keys under which an item names paths.
DEFAULT_SURFACE = "code_graph_context"
PATH_KEYS, LIST_KEYS = ("path", "filePath", "file"), ("paths", "files")

ANSWERS = "answer_id string, thread string, query string, seeds array<string>, budget_tokens int, files array<string>, symbols array<string>, tokens_used int, answered_at bigint, seq bigint, surface string"
OUTCOMES = "answer_id string, thread string, searches_after bigint, changed array<string>, hit array<string>, missed array<string>, recall double, recorded_at bigint"


def record_answers(given: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of ``ANSWERS`` from given answers (all but seq): seq is the greatest of their thread's events,
    0 without any; a missing surface is the default one."""
    last = events.groupBy("thread").agg(F.max("seq").alias("seq"))
    columns = [c.split()[0] for c in ANSWERS.split(", ")]
    rows = given.drop("seq").join(last, "thread", "left").withColumn("seq", F.coalesce("seq", F.lit(0).cast("bigint")))
    surface = F.coalesce("surface", F.lit(DEFAULT_SURFACE)) if "surface" in given.columns else F.lit(DEFAULT_SURFACE)
    return rows.withColumn("surface", surface).select(*columns)


def item(data: Column) -> tuple[Column, Column, Column]:
    """kind, command and paths of an event's JSON data: of its ``item``, or of itself if it has none."""
    def at(key):
        return F.coalesce(F.get_json_object(data, f"$.item.{key}"), F.when(F.get_json_object(data, "$.item").isNull(), F.get_json_object(data, f"$.{key}")))

    def list_of(key):
        return F.coalesce(F.from_json(at(key), "array<string>"), F.array().cast("array<string>"))

    changes = F.transform(F.coalesce(F.from_json(at("changes"), "array<struct<path string>>"), F.array().cast("array<struct<path string>>")), lambda c: c["path"])
    one = F.array(*(at(k) for k in PATH_KEYS))
    many = F.when(at(LIST_KEYS[0]).isNotNull(), list_of(LIST_KEYS[0])).otherwise(list_of(LIST_KEYS[1]))
    paths = F.filter(F.concat(changes, one, many), lambda p: p.isNotNull() & (p != ""))
    return at("type"), F.coalesce(at("command"), F.lit("")), paths


def signals(events: DataFrame) -> DataFrame:
    """(thread, seq, kind, value) from events (thread, seq, type, data): a search for each started command that
    looks like one, a change for each path of a completed or started file change."""
    kind, command, paths = item(F.col("data"))
    rows = events.select("thread", "seq", "type", kind.alias("item"), command.alias("command"), paths.alias("paths"))
    found = rows.where((F.col("type") == "item/started") & (F.col("item") == "commandExecution") & looks_like_search(F.col("command")))
    changed = rows.where("item = 'fileChange'").select("thread", "seq", F.lit("change").alias("kind"), F.explode("paths").alias("value"))
    return found.select("thread", "seq", F.lit("search").alias("kind"), F.lit(None).cast("string").alias("value")).union(changed)


def close_answers(answers: DataFrame, events: DataFrame, recorded_at: int = 0) -> DataFrame:
    """Rows of ``OUTCOMES`` for answers, from their threads' events after them."""
    found = outcomes(answers.select("thread", "seq", "surface", "files").distinct(), signals(events))
    rows = answers.select("answer_id", "thread", F.col("seq").alias("answer_seq"), "surface", "files").join(found, ["thread", "answer_seq", "surface", "files"])
    return rows.select("answer_id", "thread", "searches_after", "changed", "hit", "missed", "recall", F.lit(recorded_at).cast("bigint").alias("recorded_at"))


def surfaces(answers: DataFrame, closed: DataFrame) -> DataFrame:
    """``by_surface`` of answers left-joined to their outcomes: open answers count as answers alone."""
    rows = answers.select("answer_id", "surface").join(closed.select("answer_id", "searches_after", "recall"), "answer_id", "left")
    return by_surface(rows)


def totals(answers: DataFrame, closed: DataFrame) -> DataFrame:
    """One row: answers, outcomes and the mean recall of those that have one."""
    a, o = answers.agg(F.count("*").alias("answers")), closed.agg(F.count("*").alias("outcomes"), F.avg("recall").alias("mean_recall"))
    return a.crossJoin(F.broadcast(o))  # one row each


def append(rows: DataFrame, path: str) -> None:
    """Appends answers or outcomes to a table; files of finished jobs only are ever seen."""
    rows.write.mode("append").parquet(path)
