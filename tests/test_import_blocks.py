"""Import edges as sets: counted, dealt to tasks and diffused along without making each, as if each were made."""

import random
import re

import pytest

from reposcope.operators import graph, resolve
from reposcope.plans import project as index
from reposcope.shared import Scratch


@pytest.fixture(scope="module")
def project(spark):
    rng = random.Random(7)
    symbols = [(i, f"n{rng.randrange(12)}", rng.choice("abcd")) for i in range(90)] + [(None, "n1", "a"), (200, None, "a"), (201, "n2", None)]
    imports = [(rng.choice("abcd"), f"n{rng.randrange(14)}", rng.choice("abcd")) for _ in range(30)]
    imports += imports[:4] + [("a", "n1", None), (None, "n1", "a"), ("e", "n1", "a")]
    want = [(s, d) for f, n, t in imports if f and t for d, dn, df in symbols for s, _, sf in symbols if dn == n and df == t and sf == f and s is not None and d is not None and s != d]
    return spark.createDataFrame(imports, "file string, local string, target string"), spark.createDataFrame(symbols, "id int, name string, file string"), sorted(want)


def test_import_edges_are_made_from_arrays_and_counted_without(spark, project, monkeypatch):
    imports, symbols, want = project
    monkeypatch.setattr(resolve, "SIDE", 5)
    made = resolve.import_edges(imports, symbols)
    assert sorted((r.src, r.dst) for r in made.collect()) == want and len(want) > 300
    assert [tuple(r) for r in resolve.import_edge_count(imports, symbols).collect()] == [("importEdge", len(want))]
    assert [tuple(r) for r in resolve.import_edge_count(imports.limit(0), symbols).collect()] == [("importEdge", 0)]


def test_import_edges_of_a_pair_of_arrays_are_not_kept_in_memory_at_once(spark, project, monkeypatch):
    """Arrays that are cut into pieces give the same edges; no generated stage takes two arrays of a row apart."""
    imports, symbols, want = project
    monkeypatch.setattr(resolve, "PIECE", 2)
    made = resolve.import_edges(imports, symbols)
    assert sorted((r.src, r.dst) for r in made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    stages = re.findall(r"\*\((\d+)\) Generate explode", plan)
    assert plan.count("Generate explode") == 3 and len(stages) == len(set(stages)) == 1


def test_edges_of_a_project_are_not_kept_in_memory_at_once(spark):
    """The import edges among all edges come from pieces as well."""
    made = index.project_edges(spark, "/root/testdata/sf0.001")
    found = made.groupBy("strategy").count().collect()
    assert next(r["count"] for r in found if r.strategy == "importEdge") > 100
    assert made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    stages = re.findall(r"\*\((\d+)\) Generate explode", plan)
    assert plan.count("Generate explode") == 3 and len(stages) == len(set(stages)) == 1


def test_diffusion_along_sets_equals_that_along_edges(spark, project):
    imports, symbols, _ = project
    calls = spark.createDataFrame([(i, (i * 7) % 90, 0.5) for i in range(40)] + [(300, 301, 1.0)], "src int, dst int, weight double")
    seeds = spark.createDataFrame([(3, 1.0), (60, 0.5), (300, 1.0), (999, 1.0)], "node int, x double")
    every = calls.union(resolve.import_edges(imports, symbols).select("src", "dst", "weight"))
    with Scratch() as scratch:
        one = {r.node: (r.mass, r.relevance) for r in graph.diffuse(every, seeds, 1.5, scratch=scratch).collect()}
        ready = graph.laid_out(calls, resolve.import_blocks(imports, symbols))
        two = {r.node: (r.mass, r.relevance) for r in graph.diffuse(ready, seeds, 1.5, scratch=scratch).collect()}
        ready.release()
    assert one.keys() == two.keys() and len(one) > 60
    assert all(abs(a - b) < 1e-9 for k in one for a, b in zip(one[k], two[k], strict=True))


def test_large_frontiers_do_not_shuffle_steps(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40) + 1, 1.0) for _ in range(200)], "src int, dst int, weight double").where("src <> dst")
    x = spark.createDataFrame([(i, 1.0 + i) for i in range(30)] + [(999, 2.0)], "node int, x double")
    monkeypatch.setattr(graph, "FEW", 0)
    want = {r.node: r.x for r in graph.spread(x, graph.transition(graph.adjacency(edges))).collect()}
    for most in (graph.BROADCAST_NODES, 0):
        monkeypatch.setattr(graph, "BROADCAST_NODES", most)
        ready = graph.laid_out(edges, tasks=3)
        with Scratch() as scratch:
            moved = ready.moved(scratch.written(x, "x"), 31, scratch)
            assert {r.node: r.x for r in moved.collect()} == pytest.approx(want) and want[999] == 2.0
            if most:  # a left join before, which can only broadcast the steps
                assert "LeftOuter" not in moved._jdf.queryExecution().executedPlan().toString() and "rightHint=(strategy=broadcast)" in moved._jdf.queryExecution().analyzed().toString() + moved._jdf.queryExecution().optimizedPlan().toString()
        assert ready.tasks and ready.steps.rdd.getNumPartitions()
        ready.release()
