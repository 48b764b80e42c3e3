"""The tools' surface: what each tool answers, as JSON, over one repository's files and index."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.config import Config
from reposcope.operators import context, extract, feedback, impact, incremental, mining, resolve, retrieval, search, trace
from reposcope.operators.retrieval import Index
from reposcope.registry import Registry
from reposcope.shared import Scratch
from reposcope.sources import repository, snapshots
from reposcope.sources.snapshots import Ledger

#: Rows of an answer's lists, and of those of callers, imports and tests, which say if there are more.
ROWS, MOST = 12, 200
#: Files that are read for what a repository says of itself, whatever their language.
LISTED = (*context.MANIFESTS, *context.RULE_FILES, *context.OVERVIEW_FILES)


@dataclass
class Workspace:
    """One repository: its files(file, source, language, hash), lines and index, and what is known of them.
    ``listed`` are manifests, rules and overviews; ``blind_spots`` says what was not read; ``relations``
    is what a snapshot of it holds; ``refreshed`` is how many files were read anew."""

    root: str
    files: DataFrame
    lines: DataFrame
    index: Index
    config: Config = field(default_factory=Config)
    health: dict | None = None
    stats: dict | None = None
    listed: DataFrame | None = None
    blind_spots: list[str] = field(default_factory=list)
    relations: dict[str, DataFrame] = field(default_factory=dict)
    refreshed: int = 0
    scratch: Scratch = field(default_factory=Scratch)
    rescan: Callable[[], DataFrame] | None = None

    def release(self) -> None:
        self.index.release()
        self.lines.unpersist()
        self.scratch.release()

    def staleness(self) -> str | None:
        """What differs now from what was indexed; null if nothing does."""
        if self.rescan is None:
            return None
        report = mining.freshness(self.files.select("file", "hash"), self.rescan().select("file", "hash"))
        return mining.staleness_note(report).first()["note"]


def _problems(found: DataFrame) -> DataFrame:
    return found.where("fact in ('error', 'truncated')").select("file", "fact").distinct()


def _relations(found: DataFrame) -> dict[str, DataFrame]:
    own = extract.relations(found)
    return own | {"problems": _problems(found)}


def _built(files: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """The relations of a project that is read whole."""
    own = _relations(scratch.written(extract.facts(files), "facts"))
    targets = resolve.module_path(own["imports"], files, list(repository.LANGUAGES))
    imports = own["imports"].join(targets, ["file", "ord"]).select("file", "local", "target", "ord")
    state = incremental.build(own["symbols"], own["calls"], imports, own["types"])
    return state.relations() | {"specifiers": own["imports"], "declared": own["type_relations"], "problems": own["problems"], "files": files.select("file", "hash")}


def _updated(old: dict[str, DataFrame], files: DataFrame, report: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """The relations after the files of a freshness report: only these are extracted, and only what they touch
    is resolved."""
    named = report.select("file")
    own = _relations(scratch.written(extract.facts(files.join(F.broadcast(named), "file", "left_semi")), "facts"))
    targets = resolve.module_path(own["imports"], files, list(repository.LANGUAGES))
    fresh = own | {"imports": own["imports"].join(targets, ["file", "ord"]).select("file", "local", "target", "ord")}
    state = incremental.State(**{n: old[n] for n in incremental.State.__dataclass_fields__})

    def merged(name: str, new: DataFrame) -> DataFrame:
        return old[name].join(F.broadcast(named), "file", "left_anti").unionByName(new.select(*old[name].columns))

    moved = incremental.retargeted(old["specifiers"], state.imports, old["files"], files, list(repository.LANGUAGES), scratch)
    state = incremental.update(state, named, fresh, moved, scratch)
    return state.relations() | {"specifiers": merged("specifiers", own["imports"]), "declared": merged("declared", own["type_relations"]), "problems": merged("problems", own["problems"]), "files": files.select("file", "hash")}


def open_workspace(spark: SparkSession, root: str, config: Config | None = None, commits: DataFrame | None = None, files: DataFrame | None = None, snapshot: str | None = None) -> Workspace:
    """Scans, extracts, resolves and indexes a repository; ``files`` may stand for the scan, ``commits(commit,
    file)`` for its git log. With ``snapshot``, a path, the relations kept there are taken up: files that
    are as they were are not read again, the others are resolved beside them, and what comes of it is
    saved, unless the scan failed."""
    config = config or Config()
    scratch = Scratch()
    scanned = files is None
    gitignore = ""
    if scanned:
        gitignore = (snapshots.Store(spark, root).read(".gitignore") or "") if config.respect_gitignore else ""  # Spark's readers skip hidden files

    def scan() -> DataFrame:
        return repository.scan(spark, root, gitignore, config.include_hidden_directories)

    files = scratch.written(scan() if scanned else files, "files")  # persisted, a later scan would be answered from it
    old = snapshots.load(spark, snapshot, None, repository.ENGINE_VERSION) if snapshot else None
    report = scratch.written(mining.freshness(old["files"], files.select("file", "hash")), "report") if old else None
    if report is None:
        relations, refreshed = _built(files, scratch), files.count()
    else:
        refreshed = report.count()
        relations = _updated(old, files, report, scratch) if refreshed else old
    if relations is not old:
        relations = {n: scratch.written(df, n) for n, df in relations.items()}
    health = extract.health(relations["problems"], files).first().asDict()
    if snapshot and relations is not old:
        repository.save_snapshot(relations, snapshot, health=health)
    state = incremental.State(**{n: relations[n] for n in incremental.State.__dataclass_fields__})
    project = resolve.project_of(state, relations["declared"])
    stats = {r["what"]: r["n"] for r in project["stats"].collect()}  # a row for each strategy and status
    if commits is None and scanned and config.use_cochange:
        commits = repository.read_git_log(spark, root)
    history = scratch.written(mining.cochange(commits), "cochange") if commits is not None and config.use_cochange else None
    bodies = extract.bodies(project["symbols"], files).select("id", "body")
    index = retrieval.build_index(project["symbols"], project["edges"], project["file_imports"], project["type_relations"], bodies, project["captures"], stats.get("ambiguous", 0), history).persist()
    index.reliable = index.reliable and health["reliable"]
    spots = _unread(spark, root, gitignore, config) if scanned else []
    if health["failed"]:
        spots.append(f"{health['failed']} files could not be parsed; their symbols and calls are not in the index.")
    if health["truncated"]:
        spots.append(f"Of {health['truncated']} files only a part was parsed.")
    listed = repository.read_listed(spark, root, LISTED) if scanned else files.where(F.col("file").isin(*LISTED)).select("file", "source")
    return Workspace(root, files, search.prepare(files), index, config, health, stats, listed, spots, relations, refreshed, scratch, scan if scanned else None)


def _unread(spark: SparkSession, root: str, gitignore: str, config: Config) -> list[str]:
    """What a scan leaves out by size, as a sentence."""
    counts = repository.scan_counts(repository.listing(spark, root, gitignore, config.include_hidden_directories))
    named = counts.select((F.col("indexed") + F.col("too_large")).alias("enumerated"), "too_large", F.lit(0).alias("non_utf8"))
    return named.select(repository.blind_spots().alias("spots")).first()["spots"]


def _rows(df: DataFrame, most: int | None = None) -> list[dict]:
    """Rows of an answer, which its operator bounds, or the first ``most``."""
    return [json.loads(r["value"]) for r in repository.to_json_lines(df.limit(most) if most else df).collect()]


def _lists(found: dict[str, DataFrame], names: dict[str, tuple[str, ...]]) -> dict:
    """The first MOST rows of each relation by the columns named for it, and which of them have more."""
    out, more = {}, []
    for name, order in names.items():
        rows = _rows(found[name].orderBy(*order), MOST + 1)
        out[name] = rows[:MOST]
        if len(rows) > MOST:
            more.append(name)
    return out | {"truncated": more}


def _json(answer: dict) -> str:
    return json.dumps(answer, indent=2, ensure_ascii=False)


def _completeness(index: Index) -> str:
    return f">= {index.completeness * 100:.0f}%" if index.reliable else "not estimable: too few edges were found by more than one strategy"


def instant_grep(w: Workspace, patterns: list[str], mode: str = "content", **options) -> str:
    """content (with context, paged), files_with_matches or count of one pattern; content of up to ten."""
    if len(patterns) != 1:
        found = search.batch(w.lines, [search.Search(p, **options) for p in patterns])
        rows = _rows(found.orderBy("idx", "file", "line"))
        return _json({"root": w.root, "results": [{"pattern": p, "matches": [{k: v for k, v in r.items() if k != "idx"} for r in rows if r["idx"] == i]} for i, p in enumerate(patterns)]})
    s = search.Search(patterns[0], **options)
    if mode == "content":
        page = search.content(w.lines, s)
        if s.before or s.after:
            page = search.with_context(w.lines, page, s.before, s.after)
    elif mode in ("files_with_matches", "count"):
        page = search.files_with_matches(w.lines, s) if mode == "files_with_matches" else search.counts(w.lines, s)
    else:
        raise ValueError("mode must be content, files_with_matches or count")
    rows = _rows(page.orderBy("file", "line") if mode == "content" else page.orderBy("file"))
    more = any(r.pop("truncated") for r in rows)
    return _json({"root": w.root, "pattern": s.pattern, "mode": mode, "matches": rows, "truncated": more, "next_offset": s.offset + len(rows) if more and mode == "content" else None})


def _context(w: Workspace, found: dict, budget: int) -> dict:
    symbols = found["symbols"].orderBy("running")
    if w.config.include_snippets:
        symbols = retrieval.snippets(symbols, w.files).orderBy("running")
    shown = [{"id": r["id"], "file": r["file"], "lines": [r["start"] + 1, r["end"] + 1], "tokens": r["tokens"], "via": r.get("via"), **({"snippet": r.get("snippet", "")} if w.config.include_snippets else {})} for r in _rows(symbols, ROWS)]
    radius = [{"symbol": r["id"], "at": f"{r['file']}:{r['start'] + 1}", "callers": r["callers"], "caller_files": r["caller_file_list"], "tests": r["test_file_list"], **({} if r["test_file_list"] else {"warning": "no covering tests found"})} for r in _rows(found["blast_radius"].orderBy("id"), ROWS)]
    from reposcope.operators import code

    edge = code.boundaries_at(w.index.symbols.join(found["symbols"].select("id"), "id", "left_semi").select("file", F.col("body").alias("source"), "start"))
    return {
        "symbols": shown, "tokens_used": found["tokens_used"], "budget_tokens": budget, "files": found["files"][:ROWS],
        "edges": [{"from": r["src"], "to": r["dst"], "via": r["strategy"]} for r in _rows(found["edges"].orderBy("src", "dst"))], "blast_radius": radius,
        "dynamic_boundaries": [{"at": f"{r['file']}:{r['line']}", "form": r["form"], **({"key": r["key"]} if r.get("key") else {})} for r in _rows(edge.distinct().orderBy("file", "line"), 4 * ROWS)],
    }


def codebase_query(w: Workspace, query: str, mode: str = "explore", budget: int | None = None) -> str:
    budget = budget or w.config.default_budget_tokens
    with Scratch() as scratch:
        return _json(_asked(w, query, mode, budget, scratch))


def _asked(w: Workspace, query: str, mode: str, budget: int, scratch: Scratch) -> dict:
    found = trace.query_codebase(w.index, w.lines, query, mode, budget, scratch)
    answer = {"root": w.root, "query": query, "mode": mode, "patterns": found["patterns"], "exact_hits": _rows(found["exact_matches"].orderBy("pattern", "file", "line"), ROWS), "graph_completeness": _completeness(w.index)}
    if mode == "explore":
        return answer | _context(w, found["context"], budget)
    related: dict[str, dict[str, list]] = {}
    for r in _rows(found["relations"].orderBy("node", "relation", "file", "line")):
        related.setdefault(r.pop("node"), {}).setdefault(r.pop("relation"), []).append(r)
    symbols = [{"id": r["id"], "name": r["name"], "file": r["file"], "lines": [r["first"], r["last"]], **related.get(r["id"], {})} for r in _rows(found["symbols"].orderBy("file", "first"))]
    return answer | {"trace": symbols}


def code_graph_context(w: Workspace, seeds: list[str] | None = None, question: str | None = None, budget: int | None = None, explain: bool = False, **weights) -> str:
    budget = budget or w.config.default_budget_tokens
    with Scratch() as scratch:
        found = retrieval.retrieve(w.index, seeds, question, budget, scratch, **weights)
        answer = {"root": w.root, "seeds": seeds or [], "question": question} | _context(w, found, budget) | {"graph_completeness": _completeness(w.index), "ambiguous_calls": w.index.ambiguous_calls}
        if explain:
            answer["scores"] = _rows(found["symbols"].select("id", *(c for c in ("score", "structural", "lexical", "cochange") if c in found["symbols"].columns)).orderBy("id"))
        return _json(answer)


def _of_itself(w: Workspace) -> DataFrame:
    root = F.lit(w.root).alias("repo")
    own = w.listed.select(root, "file", "source")
    if not own.limit(1).count():  # a repository without any of them still has languages
        own = w.files.limit(1).select(root, F.lit("").alias("file"), F.lit("").alias("source"))
    return context.repository_context(own, w.index.symbols.select(root, "file"))


def repository_context(w: Workspace) -> str:
    made = _of_itself(w)
    rows, text = _rows(made), _rows(context.summary(made))
    return _json((rows[0] if rows else {"repo": w.root}) | {"summary": text[0]["summary"] if text else ""})


_BY = {"targets": ("file", "line", "id"), "direct_callers": ("file", "line", "id"), "production_imports": ("file",), "test_references": ("file",)}


def symbol_lookup(w: Workspace, names: list[str]) -> str:
    found = impact.lookup_symbols(w.index, names)
    missing = sorted(r["target"] for r in _rows(found["resolution"].where("status = 'unresolved'")))  # of those asked for
    return _json({"root": w.root, "unresolved": missing, **_lists(found, _BY | {"ambiguous": ("target", "file", "line", "id")})})


def prechange_impact(w: Workspace, names: list[str], staleness: str | None = None) -> str:
    """The gate before an edit. ``staleness`` is looked up unless it is given."""
    note = w.staleness() if staleness is None else staleness
    try:
        found = impact.prechange(w.index, names, blind_spots=w.blind_spots, staleness=note)
    except impact.UnclearTargets as e:
        return _json({"root": w.root, "error": "name every target by its id, its file or a name that is its own", "unresolved": e.unresolved, "ambiguous": e.ambiguous})
    return _json({"root": w.root, **_lists(found, _BY | {"boundaries": ("file", "line")}), "blind_spots": found["blind_spots"], "staleness": note, "graph_completeness": _completeness(w.index)})


def verify_change(w: Workspace, names: list[str], affected: bool = True) -> str:
    """The checks to run after a change of ``names``, and those that there are not; nothing is run here."""
    found = impact.analyze(w.index, names)
    rows = _rows(context.plan_verification(_of_itself(w), found["test_references"].select(F.lit(w.root).alias("repo"), "file"), affected).orderBy("ord"))
    return _json({"root": w.root, "checks": [{k: r[k] for k in ("kind", "command", "args")} for r in rows if r.get("command")], "skipped": [r["kind"] for r in rows if not r.get("command")]})


TOOLS = {f.__name__: f for f in (instant_grep, codebase_query, code_graph_context, repository_context, symbol_lookup, prechange_impact, verify_change)}


#: Tools whose answers name files that an edit may then change: they are recorded.
RECORDED = ("codebase_query", "code_graph_context")


class Service:
    """Status, settings and indexes of several repositories, and the tools that the settings offer. With
    ``snapshots`` (a path) indexes are taken up from there and saved to it; with ``ledger`` (a path)
    answers are recorded and closed there."""

    def __init__(self, spark: SparkSession, config: Config | None = None, capacity: int = 8, snapshots: str | None = None, ledger: str | None = None):
        self.spark, self.config, self.registry, self.snapshots = spark, config or Config(), Registry(capacity), snapshots
        self.ledger = Ledger(spark, ledger) if ledger else None
        self.failed: dict[str, str] = {}

    def _open(self, root: str) -> Workspace:
        kept = f"{self.snapshots.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:32]}" if self.snapshots else None
        return open_workspace(self.spark, root, self.config, snapshot=kept)

    def workspace(self, root: str) -> Workspace:
        return self.registry.ensure(root, lambda: self._open(root)).index

    def warm(self, roots: list[str]) -> list[str]:
        """Builds the first roots that the settings allow for before anyone asks; those that fail are named,
        with why, in ``failed``."""
        done = []
        for root in roots[: self.config.warm_limit]:
            try:
                self.workspace(root)
                done.append(root)
                self.failed.pop(root, None)
            except Exception as e:  # noqa: BLE001: warming one root must not keep the others cold
                self.failed[root] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        return done

    def call(self, tool: str, root: str, thread: str | None = None, events: DataFrame | None = None, **arguments) -> str:
        """A tool's answer. With a ``thread`` and its ``events(thread, seq, ...)`` an answer that names files is
        recorded in the ledger, with the sequence it was given at."""
        if tool not in self.config.tools():
            raise ValueError(f"{tool} is not among the tools {self.config.tools()}")
        with self.registry.use(root, lambda: self._open(root)) as workspace:
            answer = TOOLS[tool](workspace, **arguments)
        if self.ledger is not None and thread is not None and events is not None and tool in RECORDED:
            self._record(tool, thread, events, arguments, json.loads(answer))
        return answer

    def _record(self, tool: str, thread: str, events: DataFrame, arguments: dict, answer: dict) -> None:
        asked = str(arguments.get("query") or arguments.get("question") or "")
        files = answer.get("files") or sorted({r["file"] for r in answer.get("trace", [])} | {r["file"] for r in answer.get("exact_hits", [])})
        ids = [r["id"] for r in answer.get("symbols") or answer.get("trace") or []]
        name = uuid.uuid4().hex
        row = (name, thread, asked, list(arguments.get("seeds") or []), int(answer.get("budget_tokens") or 0), files, ids, int(answer.get("tokens_used") or 0), int(time.time() * 1000), tool)
        schema = "answer_id string, thread string, query string, seeds array<string>, budget_tokens int, files array<string>, symbols array<string>, tokens_used int, answered_at bigint, surface string"
        own = events.where(F.col("thread") == thread)
        self.ledger.put("answers", feedback.record_answers(self.spark.createDataFrame([row], schema), own), name)

    def close(self, events: DataFrame, batch_id: int | str) -> bool:
        """Closes all open answers by what their threads' events say happened after them; a batch counts once."""
        if self.ledger is None:
            raise ValueError("there is no ledger")
        return self.ledger.close(events, batch_id, int(time.time() * 1000))

    def status(self) -> dict:
        return {"repositories": [{"root": e.root, "built_at": e.built_at, "symbols": e.index.index.size(), "completeness": _completeness(e.index.index), "health": e.index.health, "stats": e.index.stats, "refreshed": e.index.refreshed} for e in self.registry.list()], "failed": self.failed, "tools": list(self.config.tools())}

    def settings(self) -> dict:
        return asdict(self.config)

    def update_settings(self, patch: dict) -> dict:
        self.config = self.config.merge(patch)
        return self.settings()

    def reindex(self, root: str) -> dict:
        """Builds anew; the old index serves until the new one is there."""
        entry = self.registry.refresh(root, lambda: self._open(root))
        return {"root": root, "symbols": entry.index.index.size(), "refreshed": entry.index.refreshed}

    def sweep(self) -> list[str]:
        """Refreshes the indexes whose files have changed; gives their roots."""
        stale = [e.root for e in self.registry.list() if e.index.staleness() is not None]
        for root in stale:
            self.reindex(root)
        return stale
