"""Ordered scans, spans and diffusion against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposcope.operators import graph, mining, ordered, spans
from reposcope.shared import Scratch
from reposcope.sources import repository


@pytest.fixture(params=[250_000, 7])
def long(request, monkeypatch):
    """Groups that are one window each, and groups that are cut into ranges."""
    monkeypatch.setattr(ordered, "LONG", request.param)
    monkeypatch.setattr(ordered, "PIECES", 5)


def test_union_of_intervals(spark, long):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), s := rng.randrange(400), s + rng.randrange(-1, 9)) for _ in range(500)] + [("long", 3, 3), ("a", 50, 200)]
    got = {r[0]: r[1] for r in mining.merged_length(spark.createDataFrame(rows, "k string, start int, end int"), "k").collect()}
    assert got == {k: len({x for a, s, e in rows if a == k for x in range(s, e)}) for k in {r[0] for r in rows}}


def test_log_of_many_ranges(spark, long):
    rng, lines = random.Random(2), []
    for log in ("x", "y"):
        for i in range(rng.randrange(40, 60)):
            lines.append((log, len(lines), f"{i:07x}\r"))
            lines += [(log, len(lines) + j, f"src/{i}.{j}") for j in range(rng.randrange(4))]
            lines.append((log, len(lines), ""))
    lines = [("x", -1, "no commit yet"), *lines]
    want, now = [], {}
    for log, _, text in sorted(lines, key=lambda r: r[:2]):
        if len(text) == 8 and text.endswith("\r"):
            now[log] = text[:-1]
        elif text and log in now:
            want.append((log, now[log], text))
    got = repository.parse_git_log(spark.createDataFrame(lines, "log string, pos int, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_running_sums(spark, long):
    rows = [(i % 3 if i % 4 else None, i, None if i % 7 == 0 else i) for i in range(120)]
    got = {(r.k, r.at): r.s for r in ordered.running_sum(spark.createDataFrame(rows, "k int, at int, v int"), ["k"], ["at"], "v", "s").collect()}
    assert got == {(k, at): sum(v or 0 for a, b, v in rows if a == k and b <= at) for k, at, _ in rows}
    assert ordered.running_sum(spark.createDataFrame([], "k int, at int, v int"), ["k"], ["at"], "v", "s").count() == 0


def test_a_million_intervals_of_one_thread(spark):
    """One thread that is cut: its ranges go to many tasks and meet at their borders."""
    iv = spark.range(1_000_000).selectExpr("'t' as thread", "id * 3 as start", "id * 3 + 1 + (id % 4) as end")
    n = 250_000
    assert mining.merged_length(iv, "thread").first()["total"] == n * (1 + 2 + 3 + 4) - (n - 1)  # the last has none behind it


def test_lines_in_spans(spark):
    rng = random.Random(3)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(1, 100_000)])) for _ in range(400)] + [("a", 1), ("a", 256), ("a", 257)]
    rows = [(i, rng.choice(["a", "b"]), s := rng.randrange(99_000), s + int(10 ** rng.uniform(-1, 7))) for i in range(300)] + [(900, "a", 0, 255), (901, "a", 256, 256), (902, "a", 5, 4), (903, None, 0, 9), (904, "a", None, None)]
    got = spans.containing(spark.createDataFrame(points, "file string, line int"), spark.createDataFrame(rows, "id int, file string, start int, end int"))
    want = sorted((f, line, i) for f, line in points if f and line is not None for i, g, s, e in rows if f == g and s is not None and s <= line - 1 <= e)
    assert sorted((r.file, r.line, r.id) for r in got.collect()) == want and len(want) > 1000


def test_pairs_of_hits_and_spans_are_counted(spark):
    """Repeated lines and spans, hits with several lines of a file, ids with several spans; lines in a dense place meet only spans around them."""
    rng = random.Random(5)
    points = [(rng.randrange(60), rng.choice(["a", "b", None]), rng.randrange(1, 400)) for _ in range(500)]
    points += points[:50]
    rows = [(rng.randrange(80), rng.choice(["a", "b"]), s := rng.randrange(400), s + rng.choice([0, 1, 3, 40, 300])) for _ in range(120)]
    rows += rows[:20]
    got = spans.pair_counts(spark.createDataFrame(points, "hit int, file string, line int"), spark.createDataFrame(rows, "id int, file string, start int, end int")).collect()
    want = Counter((h, i) for h, f, line in points for i, g, s, e in rows if f == g and s <= line - 1 <= e)
    assert {(r.hit, r.id): r.n for r in got} == dict(want) and len(got) == len(want)
    lone = spans.containing(spark.createDataFrame([("a", i + 1) for i in range(256)], "file string, line int"), spark.range(256).selectExpr("'a' as file", "id as start", "id as end"))
    assert lone.count() == 256
    assert spans.BITS * (spans.LEVELS - 1) < 63


@pytest.mark.parametrize("single", [True, False])
def test_pairs_of_hits_with_one_line_are_counted_where_they_meet(spark, monkeypatch, single):
    """Lines that are made of hits, repeated rows, ids with several spans or none, arrays that are cut."""
    monkeypatch.setattr(spans, "SIDE", 2)
    rng = random.Random(8)
    points = [(h := rng.choice([None, *range(90)]), rng.choice(["a", "b", None]), None if h is None else h % 30 + 1) for _ in range(300)]
    rows = [(rng.choice([None, *range(70)]), rng.choice(["a", "b", None]), s := rng.randrange(30), s + rng.choice([-1, 0, 0, 2, 20, 300])) for _ in range(90)]
    rows += rows[:20] + [(80 + i, "a", 3, 3) for i in range(9)] + [(None, "a", 3, 3), (99, "a", None, 4), (99, "a", 4, None)]
    made = spans.pair_counts(spark.createDataFrame(points, "hit int, file string, line int"), spark.createDataFrame(rows, "id int, file string, start int, end int"), single=single, tasks=5)
    got = made.collect()
    want = Counter((h, i) for h, f, line in points for i, g, s, e in rows if None not in (f, line, s, e) and f == g and s <= line - 1 <= e)
    assert {(r.hit, r.id): r.n for r in got} == dict(want) and len(got) == len(want) and any(i is None for _, i in want)


def test_lines_of_orders_are_dealt_to_their_bins_at_once(spark):
    """The points' table is shuffled once, to its bins, and spans come to them as arrays of ids."""
    from reposcope.plans import catalog

    plan = re.sub(r"#\d+L?", "", catalog.lines_in_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert {k for k in keys if "hit" in k} == {"hit, id"} and "file, _l, _b" in keys and "collect_list(id" in plan


def test_pairs_are_summed_up_once_in_tasks_by_rows(spark, monkeypatch):
    """Both directions come from one sum; the tasks grow with the rows."""
    from reposcope import shared

    rng = random.Random(6)
    edges = [(rng.randrange(9), rng.randrange(9), 1.0) for _ in range(200)]
    want: Counter = Counter()
    for a, b, w in edges:
        if a != b:
            want[a, b] += w
            want[b, a] += w
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    assert shared.tasks_for(df) == 20
    made = graph.adjacency(df, shared.tasks_for(df))
    assert made.rdd.getNumPartitions() == 20 and {(r.src, r.dst): r.w for r in made.collect()} == dict(want) and made.count() == len(want)
    commits = spark.createDataFrame([(c, f) for c in range(20) for f in rng.sample(range(8), 4)], "commit int, file int")
    one, two = ({(r.file, r.other): round(r.score, 9) for r in mining.cochange(commits, tasks=n).collect()} for n in (None, 7))
    assert one == two and all(one[b, a] == v for (a, b), v in one.items())


def random_graph(rng):
    return [(i, i + 1, 1.0) for i in range(120)] + [(rng.randrange(120), rng.randrange(120), rng.random() + 0.1) for _ in range(40)] + [(0, 200 + i, 0.01) for i in range(30)]


@pytest.mark.parametrize("lost", [0.0, 1e-7, 1e-3, 0.3])
def test_residual_push_equals_the_sum(spark, lost):
    edges, seeds, t = random_graph(random.Random(4)), {5: 2.0, 299: 1.0}, 1.5
    a = np.zeros((300, 300))
    for i, j, w in edges:
        if i != j:
            a[i, j] += w
            a[j, i] += w
    d = a.sum(axis=1)
    p = np.where(d[:, None] > 0, a / np.maximum(d, 1e-300)[:, None], np.eye(300))
    x, mass = np.array([seeds.get(i, 0.0) for i in range(300)]), np.zeros(300)
    for c in graph.coefficients(t, 1e-6):
        mass += c * x
        x = x @ p
    trace: list = []
    with Scratch() as scratch:
        ready = graph.laid_out(spark.createDataFrame(edges, "src int, dst int, weight double"))
        rows = graph.diffuse(ready, spark.createDataFrame(list(seeds.items()), "node int, x double"), t, 1e-6, lost=lost, scratch=scratch, trace=trace).collect()
        ready.release()
    got = {r.node: r.mass for r in rows}
    assert abs(sum(got.values()) - mass.sum()) < 1e-9
    apart = np.array([got.get(i, 0.0) - mass[i] for i in range(300)])
    assert np.abs(apart).sum() <= 2 * 3 * lost + 1e-12 and trace[-1][3] <= 3 * lost + 1e-15
    assert all(abs(r.relevance - (r.mass / d[r.node] ** 0.5 if d[r.node] else r.mass)) < 1e-12 for r in rows)
    pushed = [n for _, _, n, _ in trace]
    assert (pushed == [n for _, n, _, _ in trace]) if not lost else pushed[-1] < trace[-1][1] or lost < 1e-6


def test_diffusion_refuses_what_it_cannot_do(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)], "src int, dst int, weight double")
    seed = spark.createDataFrame([(1, 1.0)], "node int, x double")
    for bad in (seed.limit(0), spark.createDataFrame([(1, -1.0), (2, 3.0)], seed.schema), spark.createDataFrame([(1, 0.0)], seed.schema)):
        with pytest.raises(ValueError):
            graph.diffuse(edges, bad)
    for options in ({"beta": 2}, {"t": -1}):
        with pytest.raises(ValueError):
            graph.diffuse(edges, seed, **options)
    with pytest.raises(Exception, match="weights positive"):
        graph.diffuse(spark.createDataFrame([(1, 2, 0.0)], "src int, dst int, weight double"), seed).count()
    assert abs(graph.residual(1.5, 1e-6, 2.0) - 2 * 5.52e-7) < 1e-8 and graph.residual(0, 1e-6) == 0


def test_rows_are_held_against_few_of_the_cuts(spark):
    rng = random.Random(5)
    for n in (0, 1, 11, 12, 13, 40, 127):
        bounds = sorted(rng.randrange(90) for _ in range(n))
        held = spark.range(-1, 92).withColumn("_cuts", F.array(*map(F.lit, bounds)).cast("array<long>")).withColumn("_coarse", F.filter("_cuts", lambda c, i: (i + 1) % ordered.STRIDE == 0))
        got = {r.id: r.n for r in held.select("id", ordered._below(F.col("id")).alias("n")).collect()}
        assert got == {x: sum(c < x for c in bounds) for x in range(-1, 92)}


def test_long_groups_are_made_once_and_logs_without_blank_lines(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LONG", 7)
    kept, write = [], ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, label: kept.append((label, df.count())) or write(df, label))
    lines = [("x", i, f"{i:07x}" if i % 3 == 0 else "" if i % 3 == 1 else f"f{i}") for i in range(60)]
    got = repository.parse_git_log(spark.createDataFrame(lines, "log string, pos int, text string"))
    assert sorted((r.commit, r.file) for r in got.collect()) == [(f"{i - 2:07x}", f"f{i}") for i in range(2, 60, 3)]
    assert ("ordered", 40) in kept
