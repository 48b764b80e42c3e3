"""Traces: from a question to one anchor, its exact hits, the symbols they mean and what touches these."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.text import query_patterns
from reposcope.operators import retrieval, search, spans
from reposcope.operators.retrieval import Index
from reposcope.shared import Scratch

#: Hits of each pattern, lines after a trace's hits, symbols of a trace, rows of each relation.
HITS, AFTER, NODES, RELATIONS = 8, 12, 3, 12
#: Lists of a trace: name, relation it is read from, whether from the subtype's side.
_TYPED = (
    ("supertypes", "extends", True), ("subtypes", "extends", False), ("implements", "implements", True),
    ("implementations", "implements", False), ("overrides", "overrides", True), ("overridden_by", "overrides", False),
)


@dataclass(frozen=True)
class Target:
    anchor: str
    owner: str | None = None


def trace_target(candidates: list[str]) -> Target | None:
    """What the first candidate names: the last step of a dotted or ``::`` path with the step before it as
    its owner, else the name before an opening bracket, else the candidate itself."""
    if not candidates:
        return None
    text = candidates[0]
    steps = re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*|::|[.(]|\s+|.", text)
    names: list[str] = []
    for i, step in enumerate(steps):
        if re.match(r"[A-Za-z_$]", step):
            joined = i >= 2 and steps[i - 1] in ("::", ".") and names and names[-1] == steps[i - 2]
            names = [*names, step] if joined else [step]
            rest = "".join(steps[i + 1 :]).lstrip()
            if len(names) > 1 and (not rest or rest[0] == "("):
                return Target(names[-1], names[-2])
    called = re.search(r"(?:^|[.:])([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", text)
    return Target(called[1] if called else text)


def searches(patterns: list[str], trace: bool = False) -> list[search.Search]:
    """Whole words, sensitive to case if a pattern has a capital letter."""
    return [search.Search(p, case_sensitive=bool(re.search("[A-Z]", p)), word=True, limit=HITS, after=AFTER if trace else 0) for p in patterns]


def exact_hits(lines: DataFrame, patterns: list[str], trace: bool = False) -> DataFrame:
    """(pattern, file, line, text) of the first hits of each pattern."""
    if not patterns:
        return lines.where("false").select(F.lit("").alias("pattern"), "file", "line", "text")
    found = search.batch(lines, searches(patterns, trace))
    return found.select(F.element_at(F.array(*(F.lit(p) for p in patterns)), F.col("idx") + 1).alias("pattern"), "file", "line", "text")


def candidates(index: Index, hits: DataFrame, target: Target | None) -> DataFrame:
    """(id, rank) of the symbols that a trace may start from, of the best rank that has any:
    1 named as the anchor and its owner's in files with hits, 2 named as a hit's pattern in its file,
    3 the anchor and its owner's anywhere, 4 named as the anchor anywhere, 5 around a hit."""
    path = F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^\./", "")
    at = hits.select("pattern", path.alias("file"), "line")
    s = index.symbols.select("id", "name", "container", "file", "start", "end")
    named = s.join(at.select("file", F.col("pattern").alias("name")).distinct(), ["file", "name"], "left_semi")
    around = spans.containing(at.select("file", "line").distinct(), s.select("id", "file", "start", "end"))
    ways = [named.select("id", F.lit(2).alias("rank")), around.select("id", F.lit(5).alias("rank"))]
    if target is not None:
        anchored = s.where(F.col("name") == target.anchor)
        ways.append(anchored.select("id", F.lit(4).alias("rank")))
        if target.owner is not None:
            ways.append(named.where((F.col("name") == target.anchor) & (F.col("container") == target.owner)).select("id", F.lit(1).alias("rank")))
            ways.append(anchored.where(F.col("container") == target.owner).select("id", F.lit(3).alias("rank")))
    every = reduce(DataFrame.union, ways).groupBy("id").agg(F.min("rank").alias("rank"))
    best = F.broadcast(every.agg(F.min("rank").alias("_best")))  # one row
    return every.crossJoin(best).where("rank = _best").drop("_best")


def related(index: Index, nodes: DataFrame, most: int = RELATIONS) -> DataFrame:
    """(node, relation, id, name, file, line, via) of nodes(node): callers, callees and the six lists of
    type relations; distinct, the first ``most`` of each by file and line."""
    calls = index.calls()
    rows = [
        calls.select(F.col("dst").alias("node"), F.lit("callers").alias("relation"), F.col("src").alias("id"), F.col("strategy").alias("via")),
        calls.select(F.col("src").alias("node"), F.lit("callees").alias("relation"), F.col("dst").alias("id"), F.col("strategy").alias("via")),
    ]
    for name, kind, up in _TYPED:
        own, other = ("subtype", "supertype") if up else ("supertype", "subtype")
        rows.append(index.type_relations.where(F.col("kind") == kind).select(F.col(own).alias("node"), F.lit(name).alias("relation"), F.col(other).alias("id"), F.lit(kind).alias("via")))
    known = index.symbols.select("id", "name", "file", (F.col("start") + 1).alias("line"))
    found = reduce(DataFrame.union, rows).join(nodes.select("node").distinct(), "node", "left_semi").distinct().join(known, "id")
    order = Window.partitionBy("node", "relation").orderBy("file", "line", "id", "via")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("node", "relation", "id", "name", "file", "line", "via")


def direct_trace(index: Index, hits: DataFrame, target: Target | None) -> tuple[DataFrame, DataFrame]:
    """The first NODES candidates (id, name, file, first, last; lines from 1) by file and line, and what is
    related to them."""
    found = index.symbols.join(candidates(index, hits, target), "id").orderBy("file", "start", "id").limit(NODES)
    nodes = found.select("id", "name", "file", (F.col("start") + 1).alias("first"), (F.col("end") + 1).alias("last"))
    return nodes, related(index, nodes.select(F.col("id").alias("node")))


def evidence(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits within the traced symbols; all hits if there are none."""
    path = F.regexp_replace(F.regexp_replace("file", r"\\", "/"), r"^\./", "")
    near = F.broadcast(nodes.select(F.col("file").alias("_f"), "first", "last"))  # NODES rows
    inside = hits.join(near, (path == F.col("_f")) & F.col("line").between(F.col("first"), F.col("last")), "left_semi")
    any_ = F.broadcast(nodes.agg(F.count("*").alias("_n")))  # one row
    return inside.union(hits.crossJoin(any_).where("_n = 0").drop("_n"))


def query_codebase(index: Index, lines: DataFrame, query: str, mode: str = "explore", budget: int = 4000, scratch: Scratch | None = None) -> dict:
    """explore: exact hits of up to three patterns beside ranked context; trace: hits of one anchor, the
    symbols they mean and their direct relations. What is made on the way is written to ``scratch``."""
    scratch = scratch or Scratch()
    if mode not in ("explore", "trace"):
        raise ValueError("mode must be explore or trace")
    found = query_patterns(query)
    target = trace_target(found) if mode == "trace" else None
    patterns = found if mode == "explore" else [target.anchor] if target else []
    hits = exact_hits(lines, patterns, mode == "trace")
    out = {"query": query, "mode": mode, "patterns": patterns}
    if mode == "explore":
        return out | {"exact_matches": hits, "context": retrieval.retrieve(index, question=query, budget=budget, scratch=scratch)}
    hits = scratch.written(hits, "hits")
    nodes, relations = direct_trace(index, hits, target)
    nodes = scratch.written(nodes, "nodes")
    return out | {"exact_matches": evidence(hits, nodes), "symbols": nodes, "relations": relations}
