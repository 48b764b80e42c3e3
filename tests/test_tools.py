"""A project opened as a workspace: all tools, the service, snapshots and refresh, the command line."""

import json
import subprocess
import threading

import pytest

from reposcope import cli, tools
from reposcope.config import Config
from reposcope.registry import Registry

FILES = {
    "src/payment.ts": "export class PaymentService {\n  private repo: Repo;\n  charge(amount: number) {\n    this.repo.store(amount);\n    return formatMoney(amount);\n  }\n}\nexport class CardService extends PaymentService {\n  charge(amount: number) {\n    return validate(amount);\n  }\n}\n",
    "src/repo.ts": "export class Repo {\n  store(amount: number) {\n    return validate(amount);\n  }\n}\nexport function validate(amount: number) {\n  return amount > 0;\n}\n",
    "src/money.ts": "export function formatMoney(amount: number) {\n  return String(amount);\n}\n",
    "src/order.ts": "import { formatMoney } from './money';\nimport { validate } from './repo';\nexport function createOrder(total: number) {\n  bus.emit('created');\n  if (validate(total)) return formatMoney(total);\n}\n",
    "src/order.test.ts": "import { createOrder } from './order';\nfunction coversOrder() {\n  return createOrder(3);\n}\n",
    "package.json": '{"scripts": {"test": "vitest run", "lint": "eslint .", "build": "x"}}',
    "package-lock.json": "{}", "AGENTS.md": "Be brief.", "README.md": "# Shop", ".gitignore": "gen/\n", "gen/made.ts": "export function made() {}\n", "node_modules/x/i.ts": "export function dep() {}\n",
    "src/large.ts": "// " + "x" * 600_000,
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    run = ["git", "-C", str(path), "-c", "user.name=n", "-c", "user.email=e@x"]
    subprocess.run([*run, "init", "-q"], check=True)
    for names in (["src/payment.ts", "src/repo.ts"], ["src/money.ts", "src/order.ts", "src/order.test.ts"]):
        subprocess.run([*run, "add", *names], check=True)
        subprocess.run([*run, "commit", "-qm", "c"], check=True)
    return path


@pytest.fixture(scope="module")
def workspace(spark, root):
    return tools.open_workspace(spark, str(root))


def ids(rows):
    return {r["id"].split("#")[-1].split("@")[0] for r in rows}


def test_workspace_of_a_project(workspace):
    edges = {(r.src.split("#")[-1].split("@")[0], r.dst.split("#")[-1].split("@")[0], r.strategy) for r in workspace.index.edges.where("strategy <> 'importEdge'").collect()}
    assert {("PaymentService.charge", "Repo.store", "typedReceiver"), ("createOrder", "validate", "importMap"), ("createOrder", "formatMoney", "importMap"), ("coversOrder", "createOrder", "importMap"), ("Repo.store", "validate", "sameFile"), ("PaymentService.charge", "formatMoney", "uniqueName")} <= edges
    assert {r.kind for r in workspace.index.type_relations.collect()} == {"extends", "overrides"}
    captured = {(r.src.split("#")[-1].split("@")[0], r.dst.split("#")[-1].split("@")[0]): r.n for r in tools.resolve.project_of(tools.incremental.State(**{n: workspace.relations[n] for n in tools.incremental.State.__dataclass_fields__}), workspace.relations["declared"])["captures"].collect()}
    assert captured["createOrder", "validate"] == 2 and captured["PaymentService.charge", "formatMoney"] == 1
    assert {(r.file, r.other) for r in workspace.index.cochange.collect()} >= {("src/payment.ts", "src/repo.ts"), ("src/order.ts", "src/money.ts")}
    assert workspace.health["parsed"] == 5 and workspace.blind_spots == ["The snapshot left out 1 readable files (tooLarge=1, nonUtf8=0); a missing match, symbol or caller may be in them."]
    assert not {"gen/made.ts", "node_modules/x/i.ts"} & {r.file for r in workspace.files.select("file").collect()}


def test_grep(workspace):
    page = json.loads(tools.instant_grep(workspace, ["amount"], limit=3, before=1))
    assert [(m["file"], m["line"]) for m in page["matches"]] == [("src/money.ts", 1), ("src/money.ts", 2), ("src/payment.ts", 3)] and page["truncated"] and page["next_offset"] == 3
    assert json.loads(tools.instant_grep(workspace, ["validate"], mode="count"))["matches"] == [{"file": "src/order.ts", "n": 2}, {"file": "src/payment.ts", "n": 1}, {"file": "src/repo.ts", "n": 2}]
    assert [r["pattern"] for r in json.loads(tools.instant_grep(workspace, ["charge", "store"]))["results"]] == ["charge", "store"]
    with pytest.raises(ValueError):
        tools.instant_grep(workspace, ["x"], mode="other")


def test_questions(workspace):
    found = json.loads(tools.codebase_query(workspace, "Where is `createOrder` handled?"))
    assert {"symbols", "tokens_used", "files", "edges", "blast_radius"} <= set(found) and found["exact_hits"][0]["file"] == "src/order.test.ts"
    assert found["symbols"] == []  # its words are in too many of these few symbols
    found = json.loads(tools.codebase_query(workspace, "What is emitted on the bus?", budget=60))
    assert ids(found["symbols"]) >= {"createOrder"} and 0 < found["tokens_used"] <= 60 and found["files"]
    traced = json.loads(tools.codebase_query(workspace, "`PaymentService.charge`", mode="trace"))["trace"]
    assert ids(traced) == {"PaymentService.charge"} and ids(traced[0]["callees"]) == {"Repo.store", "formatMoney"} and ids(traced[0]["overridden_by"]) == {"CardService.charge"}
    context = json.loads(tools.code_graph_context(workspace, ["createOrder"], explain=True))
    assert {"createOrder", "validate", "formatMoney", "coversOrder"} <= ids(context["symbols"]) and context["scores"]
    radius = {r["symbol"].split("#")[1].split("@")[0]: r for r in context["blast_radius"]}
    assert radius["createOrder"]["tests"] == ["src/order.test.ts"] and "warning" in radius["validate"]
    assert [b["form"] for b in context["dynamic_boundaries"]] == ["event-dispatch"]
    assert json.loads(tools.code_graph_context(workspace, ["nowhere"]))["symbols"] == []
    only = json.loads(tools.code_graph_context(workspace, ["src/payment.ts"], cochange_weight=5.0))
    assert not {"PaymentService", "PaymentService.charge"} & ids(only["symbols"]) and "Repo" in ids(only["symbols"])


def test_impact_and_verification(workspace, root):
    found = json.loads(tools.prechange_impact(workspace, ["createOrder"]))
    assert found["staleness"] is None and ids(found["targets"]) == {"createOrder"} and found["direct_callers"] == [] and [r["file"] for r in found["test_references"]] == ["src/order.test.ts"]
    assert found["blind_spots"][0].startswith("The snapshot left out 1") and [b["form"] for b in found["boundaries"]] == ["event-dispatch"]
    unclear = json.loads(tools.prechange_impact(workspace, ["charge", "missing"]))
    assert unclear["ambiguous"] == ["charge"] and unclear["unresolved"] == ["missing"]
    looked = json.loads(tools.symbol_lookup(workspace, ["validate", "charge", "none"]))
    assert looked["unresolved"] == ["none"] and len(looked["ambiguous"]) == 2 and "createOrder" in ids(looked["direct_callers"]) and looked["production_imports"][0]["file"] == "src/order.ts" and looked["truncated"] == []
    checks = json.loads(tools.verify_change(workspace, ["createOrder"]))
    assert [(c["kind"], c["command"], c["args"]) for c in checks["checks"]] == [("test", "npm", ["run", "test", "--", "src/order.test.ts"]), ("lint", "npm", ["run", "lint"])] and checks["skipped"] == ["typecheck"]
    told = json.loads(tools.repository_context(workspace))
    assert told["package_manager"] == "npm" and told["manifests"] == ["package.json", "package-lock.json"] and told["languages"] == {"typescript": 5} and told["rules"][0]["content"] == "Be brief." and "checks: test,lint" in told["summary"]


def test_service_refreshes_from_snapshots(spark, tmp_path):
    for name in ("src/repo.ts", "src/money.ts", "src/order.ts"):
        (tmp_path / "code" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "code" / name).write_text(FILES[name])
    root, kept = str(tmp_path / "code"), str(tmp_path / "kept")
    config = Config(tool_surface="full", warm_limit=2)
    first = tools.Service(spark, config, snapshots=kept, ledger=str(tmp_path / "ledger"))
    assert first.warm([root, str(tmp_path / "absent"), "never"]) == [root] and list(first.failed) == [str(tmp_path / "absent")]
    assert first.status()["repositories"][0]["refreshed"] == 3 and first.sweep() == []
    events = spark.createDataFrame([("t", 7, "x", "{}")], "thread string, seq bigint, type string, data string")
    asked = json.loads(first.call("code_graph_context", root, thread="t", events=events, seeds=["validate"]))
    assert [r.seq for r in first.ledger.open().collect()] == [7] and asked["files"]
    later = spark.createDataFrame([("t", 9, "item/completed", json.dumps({"item": {"type": "fileChange", "path": asked["files"][0]}}))], events.schema)
    assert first.close(later, 1) and not first.close(later, 1) and first.ledger.outcomes().first()["recall"] == 1.0

    (tmp_path / "code/src/money.ts").write_text("\n" + FILES["src/money.ts"].replace("formatMoney", "formatCash") + "export function validate2() {\n  return validate(1);\n}\n")
    (tmp_path / "code/src/repo.ts").rename(tmp_path / "code/src/store.ts")
    (tmp_path / "code/src/repo").mkdir()
    (tmp_path / "code/src/repo/index.ts").write_text(FILES["src/repo.ts"])
    assert first.workspace(root).staleness() == "1 changed, 2 added, 1 removed"
    assert json.loads(first.call("prechange_impact", root, names=["createOrder"]))["staleness"] == "1 changed, 2 added, 1 removed"
    second = tools.Service(spark, config, snapshots=kept)
    w = second.workspace(root)
    whole = tools.open_workspace(spark, root, config)
    assert w.refreshed == 4 and whole.refreshed == 4
    for part in ("edges", "file_imports", "type_relations"):
        assert sorted(map(tuple, getattr(w.index, part).collect())) == sorted(map(tuple, getattr(whole.index, part).collect())), part
    assert w.stats == whole.stats and w.index.completeness == whole.index.completeness and w.health == whole.health
    assert tools.Service(spark, config, snapshots=kept).workspace(root).refreshed == 0
    assert first.sweep() == [root] and first.workspace(root).staleness() is None
    with pytest.raises(ValueError, match="not among"):
        tools.Service(spark).call("symbol_lookup", root, names=["x"])
    assert second.update_settings({"tool_surface": "lean", "warm_limit": 99})["warm_limit"] == 50 and second.reindex(root)["refreshed"] == 0


def test_command_line(spark, root, tmp_path, capsys):
    def run(*argv):
        code = cli.main(["--snapshots", str(tmp_path / "kept"), *argv])
        return code, capsys.readouterr().out

    assert run("grep", str(root), "formatMoney", "--mode", "files_with_matches")[0] == 0
    code, out = run("status", str(root))
    assert code == 0 and json.loads(out)["repositories"][0]["stats"]["importMap"] == 3
    assert "src/order.ts" in run("context", "--root", str(root), "createOrder")[1]
    assert run("index", str(root))[0] == 0 and "1 call should do" in run("instruction", str(root))[1]
    assert run("export", str(root), str(tmp_path / "out"))[0] == 0 and run("import", str(tmp_path / "again"), str(tmp_path / "out"))[0] == 0
    held = tools.snapshots.load(spark, str(tmp_path / "again"), None, tools.repository.ENGINE_VERSION)
    assert held["symbols"].count() == tools.snapshots.load(spark, str(next((tmp_path / "kept").iterdir())), ["symbols"], tools.repository.ENGINE_VERSION)["symbols"].count() > 8
    assert run("tool-surface")[1].split() == list(Config().tools())


class Held:
    def __init__(self):
        self.released = 0

    def release(self):
        self.released += 1


def test_registry_releases_after_the_last_use():
    registry, made = Registry(1), []

    def build():
        made.append(Held())
        return made[-1]

    with registry.use("a", build) as a:
        with registry.use("a", build) as same:
            assert same is a
            registry.ensure("b", build)
        assert registry.get("a") is None and not a.released
    assert a.released == 1 and not registry.users and not registry.doomed
    registry.refresh("b", build)
    assert made[1].released == 1 and len(made) == 3
    registry.clear()
    assert made[2].released == 1


def test_registry_builds_once_for_many():
    registry, made, gate = Registry(), [], threading.Event()

    def build():
        gate.wait(10)
        made.append(1)
        return len(made)

    threads = [threading.Thread(target=lambda: registry.ensure("a", build)) for _ in range(8)]
    for t in threads:
        t.start()
    gate.set()
    for t in threads:
        t.join()
    assert made == [1]
    with pytest.raises(RuntimeError):
        registry.ensure("c", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert registry.get("c") is None and not registry.pending
