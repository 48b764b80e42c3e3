"""Every query against its DuckDB SQL on the smallest tables, and expected facts of single operators."""

import duckdb
import pytest

from reposcope.functions import text as tx
from reposcope.operators import code, extract, graph, metrics, mining, resolve, search, trace
from reposcope.plans import catalog
from reposcope.sources import repository

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())


def test_query_patterns():
    assert tx.query_patterns("Where is `PaymentFailedError` handled by the payment service?") == ["PaymentFailedError", "payment", "service"]


def test_globs_and_limits(spark):
    files = spark.createDataFrame([("a/B.java", "x\na+b\n"), ("src/c/d.ts", "a+b"), ("e.ts", None)], "file string, source string")
    rows = search.lines(files)
    assert rows.count() == 4
    assert [r.file for r in search.files_with_matches(rows, search.Search("a+b", glob="*.java")).collect()] == ["a/B.java"]
    assert [r.line for r in search.content(rows, search.Search("a+b", glob="src/**")).collect()] == [1]
    for bad in ({"pattern": ""}, {"pattern": "a", "limit": 0}, {"pattern": "a", "glob": "-x"}, {"pattern": "a", "before": 33}):
        with pytest.raises(ValueError):
            search.Search(**bad)


@pytest.mark.parametrize("row,expected", [((100, 40, 10, 0), (180, 133.841379, 289.11759, 0.34588, True)), ((10, 4, 0, 0), (16, 10, 16, 0.625, False)), ((319, 317, 2, 636), (26077.25, 8074.645787, 89600.905143, 0.00356, False)), ((0, 0, 0, 0), (0, 0, 0, 1, True))])
def test_chao1(spark, row, expected):
    from pyspark.sql import functions as F

    r = mining.chao1(spark.createDataFrame([row], "observed int, f1 int, f2 int, k int"), F.col("k")).first()
    assert [round(r[c], 6) for c in ("estimated", "ci_lower", "ci_upper", "completeness")] == list(expected[:4]) and r["reliable"] == expected[4]


def test_diffusion_keeps_mass(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (3, 4, 1.0)], "src int, dst int, weight double")
    rows = graph.diffuse(edges, spark.createDataFrame([(1, 1.0), (9, 1.0)], "node int, x double"), 1.0).collect()
    assert abs(sum(r.mass for r in rows) - 2) < 1e-5 and len(graph.coefficients(1, 1e-6)) == 10
    assert {r.node: r.mass for r in rows}[9] > 0.999


def test_recursion_is_dropped(spark):
    symbols = spark.createDataFrame([(1, "f", "function", None, "a.ts")], "id int, name string, kind string, container string, file string")
    calls = spark.createDataFrame([(1, 1, "a.ts", "f", None), (2, 1, "a.ts", "g", None)], "call int, caller int, caller_file string, name string, receiver string")
    none = spark.createDataFrame([], "file string, local string, target string, ord int"), spark.createDataFrame([], "file string, name string, type string, ord int")
    got = {r.call: r.status for r in resolve.resolve(resolve.proposals(calls, symbols, *none)).collect()}
    assert got == {1: "self", 2: "unknown"}


def test_module_paths(spark):
    imports = spark.createDataFrame([("src/a.ts", "./util", 0), ("src/a.ts", "./x.js", 1), ("src/b/c.ts", "../util", 2), ("src/a.ts", "react", 3), ("src/a.ts", "./lib", 4)], "file string, specifier string, ord int")
    files = spark.createDataFrame([("src/util.ts",), ("src/x.ts",), ("src/lib/index.ts",)], "file string")
    got = {r.ord: r.target for r in resolve.module_path(imports, files, list(repository.LANGUAGES)).collect()}
    assert got == {0: "src/util.ts", 1: "src/x.ts", 2: "src/util.ts", 4: "src/lib/index.ts"}


def test_git_log_and_scan_rules(spark):
    log = enumerate(["abc1234", "a.ts\r", "", "b.ts", "def5678", "a.ts"])
    rows = repository.parse_git_log(spark.createDataFrame(list(log), "pos int, text string"))
    assert sorted(map(tuple, rows.collect())) == [("abc1234", "a.ts"), ("abc1234", "b.ts"), ("def5678", "a.ts")]
    files = spark.createDataFrame([("src/a.ts", 1), ("node_modules/b.ts", 1), ("x.bin", 1), ("big.py", 10**7), ("gen/c.go", 1), (".d/e.go", 1)], "file string, size_bytes bigint")
    assert [r.status for r in repository.classify(files, "gen/\n").orderBy("file").collect()] == ["skipped", "tooLarge", "ignored", "skipped", "indexed", "unsupported"]


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.range(3)
    repository.save_snapshot({"symbols": df}, str(tmp_path))
    assert repository.load_snapshot(spark, str(tmp_path), ["symbols"])["symbols"].count() == 3
    assert repository.load_snapshot(spark, str(tmp_path), ["symbols"], 505) is None and repository.load_snapshot(spark, str(tmp_path / "no"), []) is None


def test_boundaries_and_facts():
    assert code.boundaries_in("bus.emit('save')\n// bus.emit('x')\nimport('m'); import(m)\n") == [(1, "event-dispatch", "save"), (3, "dynamic-import", None)]
    facts, problem = extract.extract("a.py", "python", "class A:\n    def f(self):\n        g()\n")
    assert [s["id"] for s in facts.symbols] == ["a.py#A@1:1", "a.py#A.f@2:5"] and [(c["symbol"], c["name"], c["receiver"], c["line"]) for c in facts.calls] == [("a.py#A.f@2:5", "g", None, 2)] and problem is None


def test_corpus_operators_may_be_absent(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "corpus_pipeline" else real(name, *a))
    assert not [n for n in __spark_entry__.queries() if n.startswith("op")] and __spark_entry__.entry


def test_lifecycle_roles(spark):
    log = [
        ("a", 1, "started", "x", 10), ("a", 2, "started", "x", 11), ("a", 3, "completed", "x", 15), ("a", 4, "completed", "x", 16),
        ("b", 5, "started", "x", 20), ("b", 6, "completed", "y", 21), ("c", 7, "started", "x", 30), ("c", 8, "completed", "x", 29),
        ("d", 9, "started", "x", 40), ("d", 10, "started", "x", 41), ("e", 11, "started", "x", None), ("e", 12, "completed", "x", 50), (None, 13, "started", "x", 1), ("f", 14, "other", "x", 1),
    ]
    events = spark.createDataFrame([("t", *r) for r in log], "thread string, item string, seq int, kind string, type string, at int")
    marked = metrics.lifecycle(events, "thread")
    rows = {r["seq"]: r for r in marked.collect()}
    assert [rows[i]["role"] for i in range(1, 13)] == ["open", "duplicate", "pair", "orphan", "open", "mismatch", "open", "invalid", "open", "duplicate", "open", "invalid"]
    assert (rows[3]["start"], rows[3]["end"]) == (10, 15) and rows[10]["left_open"] and not rows[2]["left_open"]
    summed = metrics.timing(marked, "thread").first()
    assert (summed["pairs"], summed["unmatched"], summed["duplicates"], summed["orphans"], summed["mismatches"], summed["invalid"], summed["status"]) == (3, 1, 2, 1, 1, 2, "invalid")
    assert metrics.timing(metrics.lifecycle(events.limit(0), "thread"), "thread").count() == 0


def test_trace_targets():
    assert trace.trace_target(["Gson.fromJson"]) == trace.Target("fromJson", "Gson") and trace.trace_target(["Error::new(x)"]) == trace.Target("new", "Error")
    assert trace.trace_target(["environment.provision"]) == trace.Target("provision", "environment") and trace.trace_target(["parse"]) == trace.Target("parse") and trace.trace_target([]) is None
    plain, mixed = trace.searches(["parse", "Parse"], True)
    assert not plain.case_sensitive and mixed.case_sensitive and plain.word and plain.after == trace.AFTER


def test_event_files(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"thread":"t","seq":1,"type":"a","data":"{}"}\nbroken\n{"thread":"t","type":"b"}\n{"thread":"t","seq":3,"type":"c"}\n')
    assert [r.seq for r in repository.read_events(spark, str(tmp_path)).orderBy("seq").collect()] == [1, 3]
    assert repository.read_events(spark, str(tmp_path / "absent")).count() == 0


def test_exported_snapshots_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.5], None), (2, None, "x")], "a int, b array<double>, c string")
    repository.export_snapshot({"rows": rows, "none": rows.limit(0)}, str(tmp_path / "out"))
    back = repository.import_snapshot(spark, str(tmp_path / "out"))
    assert back["rows"].schema == rows.schema and sorted(map(tuple, back["rows"].collect())) == sorted(map(tuple, rows.collect())) and back["none"].count() == 0
    assert repository.import_snapshot(spark, str(tmp_path / "out"), 1) is None and repository.import_snapshot(spark, str(tmp_path / "no")) is None
