"""Resolution kept up to date equals a rebuild; snapshots, and the ledger that batches may write twice."""

import random

import pytest

from reposcope.operators import incremental
from reposcope.operators.feedback import ANSWERS, OUTCOMES
from reposcope.sources import snapshots

SYMBOLS = "id string, name string, kind string, container string, file string"
CALLS = "call string, caller string, caller_file string, name string, receiver string"
IMPORTS = "file string, local string, target string, ord int"
TYPES = "file string, name string, type string, container string, ord int"
NAMES = ("symbols", "calls", "imports", "types")


def project(rng, files):
    out = {n: [] for n in NAMES}
    for f in files:
        version, own = rng.randrange(1000), []
        for k in range(rng.randrange(5)):
            name, kind = f"n{rng.randrange(12)}", rng.choice(["function", "method"])
            own.append(f"{f}#{name}@{version}:{k}")
            out["symbols"].append((own[-1], name, kind, rng.choice(["K1", "K2"]) if kind == "method" else None, f))
        out["calls"] += [(f"{f}#{version}.{k}", rng.choice([*own, None]), f, f"n{rng.randrange(13)}", rng.choice([None, "x", "this.x"])) for k in range(rng.randrange(6)) if own]
        out["imports"] += [(f, f"n{rng.randrange(12)}", rng.choice(files), k) for k in range(rng.randrange(3))]
        out["types"] += [(f, "x", rng.choice(["K1", "K2"]), rng.choice([None, "K1"]), k) for k in range(rng.randrange(3))]
    return out


def frames(spark, rows):
    return {n: spark.createDataFrame(rows[n], s) for n, s in zip(NAMES, (SYMBOLS, CALLS, IMPORTS, TYPES), strict=True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    old = project(rng, [f"f{i}" for i in range(9)])
    changed = {f"f{i}" for i in rng.sample(range(9), 3)} | {"f9"}
    new = project(rng, [f for f in sorted(changed) if f != min(changed)])  # one is gone, one is new
    moved = [(f, local, rng.choice([None, "f1", "f9"]), o) for f, local, _, o in old["imports"] if f not in changed and rng.random() < 0.4]
    made = incremental.update(incremental.build(**frames(spark, old)).kept(), spark.createDataFrame([(f,) for f in changed], "file string"), frames(spark, new), spark.createDataFrame(moved, IMPORTS))
    at = {"symbols": 4, "calls": 2, "imports": 0, "types": 0}
    whole = {n: [r for r in old[n] if r[at[n]] not in changed] + new[n] for n in NAMES}
    gone = {(m[0], m[1], m[3]) for m in moved}
    whole["imports"] = [r for r in whole["imports"] if r[0] in changed or (r[0], r[1], r[3]) not in gone] + [m for m in moved if m[2]]
    again = incremental.build(**frames(spark, whole))
    for part in ("edges", "captures", "imports_of_files"):
        assert sorted(map(tuple, getattr(made, part)().collect())) == sorted(map(tuple, getattr(again, part)().collect())), part
    assert sorted(map(tuple, made.stats.collect())) == sorted(map(tuple, again.stats.collect()))
    plan = made.proposed._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan  # calls that nothing touches are held against keys, not resolved


def test_imports_that_come_to_mean_another_file(spark):
    imports = [("src/a.ts", "x", "./util", 0), ("src/a.ts", "y", "./lib", 1), ("src/b/c.ts", "z", "..", 2), ("src/a.ts", "w", "./same", 3)]
    given = spark.createDataFrame(imports, "file string, local string, specifier string, ord int")
    old = spark.createDataFrame([("src/util.ts",), ("src/same.ts",)], "file string")
    new = spark.createDataFrame([("src/util/index.ts",), ("src/lib/index.ts",), ("src/index.ts",), ("src/same.ts",)], "file string")
    was = spark.createDataFrame([("src/a.ts", "x", "src/util.ts", 0), ("src/a.ts", "w", "src/same.ts", 3)], IMPORTS)
    got = incremental.retargeted(given, was, old, new, [".ts"]).collect()
    assert sorted((r.local, r.target) for r in got) == [("x", "src/util/index.ts"), ("y", "src/lib/index.ts"), ("z", "src/index.ts")]


def test_snapshots_survive_what_kills_a_save(spark, tmp_path):
    path = str(tmp_path)

    def held():
        found = snapshots.load(spark, path, ["a", "none"], 504, verify=True)
        return found and (found["a"].count(), found["none"].count())

    assert held() is None
    assert snapshots.save({"a": spark.range(3), "none": spark.range(0)}, path, 504, digests=True, note={"by": "test"}) == 0 and held() == (3, 0)
    first = snapshots.load(spark, path, ["a"], 504)["a"]
    with pytest.raises(Exception, match="stop"):  # while data is written
        snapshots.save({"a": spark.range(4), "none": spark.range(1).selectExpr("raise_error('stop') as x")}, path, 504)
    assert held() == (3, 0)
    (tmp_path / "log" / f"{1:020d}.json").write_text('{"digest": "half a mani')  # while the manifest is written
    assert held() == (3, 0)
    assert snapshots.save({"a": spark.range(5), "none": spark.range(0)}, path, 504, digests=True) == 2 and held() == (5, 0) and first.count() == 3
    assert snapshots.load(spark, path, ["a"], 504, number=0)["a"].count() == 3 and snapshots.note(spark, path) == {}
    assert snapshots.load(spark, path, ["a"], 505) is None and snapshots.load(spark, path, ["b"], 504) is None
    assert snapshots.save({"a": spark.range(9)}, path, 504, {"parsed": 1, "failed": 2}) is None and held() == (5, 0)
    store = snapshots.Store(spark, path)
    assert store.create("log/x", "1") and not store.create("log/x", "2") and store.read("log/x") == "1"
    assert snapshots.clear(spark, path) == [] and first.count() == 3
    gone = snapshots.clear(spark, path, keep=1, seconds=-5)
    assert f"{0:020d}.json" in gone and held() == (5, 0) and len(list((tmp_path / "data").iterdir())) == 1


def test_damaged_snapshots_are_none(spark, tmp_path):
    for damage in ("short", "gone", "other"):
        path = tmp_path / damage
        snapshots.save({"a": spark.range(100).coalesce(1)}, str(path), 504, digests=True)
        file = next(p for p in path.rglob("part-*") if p.suffix == ".parquet")
        whole = file.read_bytes()
        if damage == "gone":
            file.unlink()
        else:
            file.write_bytes(whole[:-9] if damage == "short" else bytes([whole[0] ^ 1]) + whole[1:])
        assert snapshots.load(spark, str(path), ["a"], 504, verify=damage == "other") is None


def test_ledger_takes_a_batch_once(spark, tmp_path):
    ledger = snapshots.Ledger(spark, str(tmp_path))
    assert ledger.answers().count() == 0 and ledger.outcomes().count() == 0
    answers = spark.createDataFrame([(i, "t", "q", ["s"], 1, ["f"], ["y"], 1, 5 + k, 3, "sf") for k, i in enumerate("xyz")], ANSWERS)
    assert ledger.put("answers", answers.withColumnRenamed("seq", "Seq").withColumnRenamed("Seq", "seq"), 0) and not ledger.put("answers", answers, 0)
    first = spark.createDataFrame([("x", "t", 1, ["f"], ["f"], [], 1.0, 9)], OUTCOMES)
    later = spark.createDataFrame([("x", "t", 7, ["g"], [], ["g"], 0.0, 99), ("y", "t", 0, [], [], [], None, 99)], OUTCOMES)
    assert ledger.put("outcomes", later, 10) and ledger.put("outcomes", first, 9) and not ledger.put("outcomes", later, 9)
    assert sorted((r.answer_id, r.searches_after) for r in ledger.outcomes().collect()) == [("x", 1), ("y", 0)]
    assert [r.answer_id for r in ledger.open().collect()] == ["z"] and ledger.answers().count() == 3
    (tmp_path / "outcomes" / "11.json").write_text("half")  # of a writer that died
    assert ledger.outcomes().count() == 2
    events = spark.createDataFrame([("t", 4, "item/completed", '{"item":{"type":"fileChange","path":"f"}}')], "thread string, seq bigint, type string, data string")
    assert ledger.close(events, 11, 5) and not ledger.close(events, 11, 6)
    assert {r.answer_id: r.recall for r in ledger.outcomes().collect()} == {"x": 1.0, "y": None, "z": 1.0} and ledger.open().count() == 0
    with pytest.raises(ValueError, match="lacks"):
        ledger.put("answers", first, 1)
    with pytest.raises(Exception, match="answer_id is null"):
        ledger.put("outcomes", spark.createDataFrame([(None, "t", 1, ["f"], ["f"], [], 1.0, 9)], OUTCOMES), 77)
    with pytest.raises(ValueError, match="batch id"):
        ledger.put("outcomes", first, "../x")


def test_an_update_makes_only_what_is_asked_for(spark, monkeypatch):
    """Edges take no counts, and calls that an update resolves anew are not resolved in the old state before."""
    from reposcope.operators import resolve

    rng, proposed, made = random.Random(3), [], resolve.proposals
    old = project(rng, [f"f{i}" for i in range(6)])
    new = project(rng, ["f1", "f2"])

    def counted(calls, *others):
        proposed.append(sorted(r.call for r in calls.select("call").collect()))
        return made(calls, *others)

    monkeypatch.setattr(resolve, "proposals", counted)
    given = frames(spark, old)
    changed = spark.createDataFrame([("f1",), ("f2",)], "file string")
    state = incremental.update(incremental.build(**given, keep=True), changed, frames(spark, new))
    edges = sorted(map(tuple, state.edges().collect()))
    every = [c for calls in proposed for c in calls]
    whole = {n: [r for r in old[n] if r[{"symbols": 4, "calls": 2, "imports": 0, "types": 0}[n]] not in ("f1", "f2")] + new[n] for n in NAMES}
    assert sorted(every) == sorted(r[0] for r in whole["calls"])  # each call once; those of the old state as well before
    assert isinstance(vars(state)["counts"], incremental.Later) and isinstance(vars(state)["stats"], incremental.Later)
    again = incremental.build(**frames(spark, whole))
    assert edges == sorted(map(tuple, again.edges().collect()))
    assert sorted(map(tuple, state.stats.collect())) == sorted(map(tuple, again.stats.collect()))
    assert sorted(map(tuple, state.captures().collect())) == sorted(map(tuple, again.captures().collect()))
    assert sorted(map(tuple, state.imports_of_files().collect())) == sorted(map(tuple, again.imports_of_files().collect()))
