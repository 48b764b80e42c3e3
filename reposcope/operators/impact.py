"""What an edit touches directly: callers, imports and tests of targets that are named without a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions.text import is_test_file
from reposcope.operators.retrieval import Index, resolve_targets


def targets_of(index: Index, requested: list[str]) -> DataFrame:
    """(target, status, id) as ``resolve_targets`` has it, for a list of requests."""
    spark = index.symbols.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(requested)], "target string")
    return resolve_targets(asked, index.symbols)


def callers(calls: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, name, file, line, targets, via) of production symbols that call targets(id); via is a map from
    target to strategy."""
    met = calls.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    named = met.join(symbols.select(F.col("id").alias("src"), "name", "file", "start"), "src").where(~is_test_file(F.col("file")))
    rows = F.array_sort(F.collect_set(F.struct("dst", "strategy")))
    grouped = named.groupBy(F.col("src").alias("id"), "name", "file", (F.col("start") + 1).alias("line")).agg(rows.alias("rows"))
    return grouped.select("id", "name", "file", "line", F.transform("rows", lambda r: r["dst"]).alias("targets"), F.map_from_entries("rows").alias("via"))


def imports(file_imports: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, targets) of production files that import targets(id)."""
    met = file_imports.join(targets.select(F.col("id").alias("symbol")).distinct(), "symbol", "left_semi").where(~is_test_file(F.col("file")))
    return met.groupBy("file").agg(F.array_sort(F.collect_set("symbol")).alias("targets"))


def test_references(calls: DataFrame, symbols: DataFrame, file_imports: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, targets, evidence) of test files that call or import targets(id)."""
    ids = targets.select("id").distinct()
    called = calls.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(symbols.select(F.col("id").alias("src"), "file"), "src").select("file", F.col("dst").alias("id"), F.lit("call").alias("evidence"))
    imported = file_imports.join(ids.withColumnRenamed("id", "symbol"), "symbol", "left_semi").select("file", F.col("symbol").alias("id"), F.lit("import").alias("evidence"))
    rows = called.union(imported).where(is_test_file(F.col("file")))
    return rows.groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("targets"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def analyze(index: Index, requested: list[str]) -> dict[str, DataFrame]:
    """resolution (target, status, id), targets, direct_callers, production_imports, test_references: only
    what resolution has confirmed, nothing ranked, nothing guessed."""
    resolution = targets_of(index, requested)
    targets = index.symbols.join(resolution.where("status = 'resolved'").select("id").distinct(), "id", "left_semi").select("id", "name", "kind", "file", (F.col("start") + 1).alias("line"))
    calls = index.calls()
    return {
        "resolution": resolution, "targets": targets, "direct_callers": callers(calls, index.symbols, targets),
        "production_imports": imports(index.file_imports, targets), "test_references": test_references(calls, index.symbols, index.file_imports, targets),
    }


def ambiguous_matches(resolution: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, id, file, line) of the symbols that an ambiguous request may mean."""
    asked = resolution.where("status = 'ambiguous'").select("target").distinct()
    return symbols.join(asked, symbols["name"] == asked["target"]).select("target", "id", "file", (F.col("start") + 1).alias("line"))


def lookup_symbols(index: Index, requested: list[str]) -> dict[str, DataFrame]:
    """``analyze`` with ambiguous requests' matches, and of each caller the strategy of its first target."""
    found = analyze(index, requested)
    first = F.element_at(F.map_values("via"), 1)
    return found | {"ambiguous": ambiguous_matches(found["resolution"], index.symbols), "direct_callers": found["direct_callers"].select("id", "file", "line", first.alias("via"))}


class UnclearTargets(ValueError):
    """Requests that name nothing, or more than one symbol."""

    def __init__(self, unresolved: list[str], ambiguous: list[str]):
        super().__init__(f"unresolved: {unresolved}; ambiguous: {ambiguous}")
        self.unresolved, self.ambiguous = unresolved, ambiguous


def prechange(index: Index, requested: list[str], sources: DataFrame | None = None, blind_spots: list[str] | None = None, staleness: str | None = None) -> dict:
    """The gate before an edit: ``analyze``'s report with dynamic boundaries in the targets' bodies, what is
    known to be unseen and how stale the index is. Raises UnclearTargets unless every request names
    what it means."""
    from reposcope.operators import code

    found = analyze(index, requested)
    unclear = {r["target"]: r["status"] for r in found["resolution"].where("status <> 'resolved'").select("target", "status").distinct().collect()}  # requests
    if unclear or not requested:
        raise UnclearTargets(sorted(t for t, s in unclear.items() if s == "unresolved"), sorted(t for t, s in unclear.items() if s == "ambiguous"))
    bodies = index.symbols.join(found["targets"].select("id"), "id", "left_semi").select(F.col("file"), F.col("body").alias("source"), "start")
    spots = list(blind_spots or [])
    spots.append("Reflection and dynamic dispatch are invisible to static analysis.")
    if index.ambiguous_calls:
        spots.append(f"{index.ambiguous_calls} ambiguous calls gave no edge.")
    return found | {"boundaries": code.boundaries_at(bodies), "blind_spots": spots, "staleness": staleness, "completeness": index.completeness if index.reliable else None}
