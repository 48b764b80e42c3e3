"""Resolution that is kept up to date: edges, captures and statistics from changed files alone.

What a change of files can touch is known from keys: calls of the files themselves, calls whose name any
of their old or new symbols has, and calls by an import that now means another file. Only these are
proposed anew, against the symbols of their names; every other call keeps its row and is never joined
but to the touched keys, which are broadcast while their number is checked to be small. Captures and
statistics are kept as counts, to which the touched calls' old rows are a loss and their new ones a gain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.operators import resolve
from reposcope.shared import Scratch, written

#: Touched keys up to this number are broadcast; beyond it the join is Spark's to plan.
BROADCAST_KEYS = 1_000_000


@dataclass
class Later:
    """A relation that jobs are run for once it is asked for, and not before: whoever asks for edges alone does not
    wait for counts. ``of`` makes the rows of some of the calls or imports alone."""

    make: Callable[[], DataFrame]
    of: Callable[[DataFrame, Scratch], DataFrame] | None = None


@dataclass
class State:
    """Base relations as ``resolve`` takes them (symbols, calls, imports with targets, types), and what is made
    of them: proposed calls, counts(src, dst, strategy, n) of proposals, stats(what, n), imported(file,
    local, target, src, dst) edges and file_imports(file, target, symbol). Any may be given as ``Later``."""

    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    types: DataFrame
    proposed: DataFrame
    counts: DataFrame
    stats: DataFrame
    imported: DataFrame
    file_imports: DataFrame

    def edges(self) -> DataFrame:
        """(src, dst, weight, strategy): call edges and import edges as one bag."""
        weight = F.lit(resolve.IMPORT_WEIGHT).alias("weight")
        return resolve.all_edges(resolve.call_edges(resolve.resolve(self.proposed)), self.imported.select("src", "dst", weight, F.lit("importEdge").alias("strategy")))

    def captures(self) -> DataFrame:
        """(src, dst, n) as ``resolve.captures`` has it."""
        return self.counts.groupBy("src", "dst").agg(F.count("*").alias("n"))

    def imports_of_files(self) -> DataFrame:
        return self.file_imports.select("file", "symbol").distinct()

    def __getattribute__(self, name: str):
        found = object.__getattribute__(self, name)
        if isinstance(found, Later):
            found = found.make()
            setattr(self, name, found)
        return found

    def outside(self, name: str, rows: Callable[[], DataFrame], tests: list[tuple[_Keys, dict[str, str]]], scratch: Scratch) -> DataFrame:
        """The rows of a relation that none of the keys touches; if it was not asked for yet, those made of ``rows``, its
        calls or imports, that none of them touches, so that what an update replaces is not made for it."""
        found = object.__getattribute__(self, name)
        if isinstance(found, Later) and found.of:
            return found.of(_split(rows(), tests)[1], scratch)
        return _split(getattr(self, name), tests)[1]

    def relations(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def kept(self) -> State:
        """The same, every relation written once, as an update should find it (a snapshot does so too)."""
        return State(**{name: written(df, name) for name, df in self.relations().items()})


def _last(imports: DataFrame) -> DataFrame:
    return imports.groupBy("file", "local").agg(F.max_by("target", "ord").alias("target"))


def _imported(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    named = symbols.select(F.col("id").alias("dst"), F.col("name").alias("local"), F.col("file").alias("target"))
    own = symbols.select(F.col("id").alias("src"), "file")
    return imports.select("file", "local", "target").join(named, ["local", "target"]).join(own, "file").where("src <> dst").select("file", "local", "target", "src", "dst")


def _file_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    named = symbols.select(F.col("id").alias("symbol"), F.col("name").alias("local"), F.col("file").alias("target"))
    return imports.select("file", "local", "target").join(named, ["local", "target"]).select("file", "local", "target", "symbol")


def _each(proposed: DataFrame, sign: int) -> DataFrame:
    """(src, dst, strategy, n) of every proposal but those to the caller itself."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("dst")) for s in resolve.STRATEGIES)))
    rows = proposed.select("caller", each.alias("p")).where("p.dst is not null and p.dst <> caller")
    return rows.select(F.col("caller").alias("src"), F.col("p.dst").alias("dst"), F.col("p.strategy").alias("strategy"), F.lit(sign).cast("bigint").alias("n"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst", "strategy").agg(F.sum("n").alias("n")).where("n > 0")


def build(symbols: DataFrame, calls: DataFrame, imports: DataFrame, types: DataFrame, keep: bool = False, base: bool = True) -> State:
    """The state of a whole project. With ``keep`` every relation is written, as ``kept`` does, when it is first asked
    for, and those made of it read it, so that calls are proposed once. Base relations that are little more
    than tables already need no writing: ``base`` is False for them."""
    if not keep:
        proposed, last = resolve.proposals(calls, symbols, imports, types), _last(imports)
        imported = _imported(last, symbols)
        return State(symbols, calls, imports, types, proposed, _summed(_each(proposed, 1)), resolve.stats(resolve.resolve(proposed), imported), imported, _file_imports(last, symbols))

    def held(make: Callable[[], DataFrame], name: str, of: Callable[[DataFrame, Scratch], DataFrame] | None = None) -> Later:
        return Later(lambda: written(make(), name), of)

    if base:
        symbols, calls, imports, types = (written(df, name) for df, name in ((symbols, "symbols"), (calls, "calls"), (imports, "imports"), (types, "types")))
    state = State(
        symbols, calls, imports, types, held(lambda: resolve.proposals(calls, symbols, imports, types), "proposed", lambda some, scratch: _proposed(scratch.written(some, "calls"), symbols, imports, types, scratch)),
        held(lambda: _summed(_each(state.proposed, 1)), "counts"), held(lambda: resolve.stats(resolve.resolve(state.proposed), state.imported), "stats"),
        held(lambda: _imported(_last(imports), symbols), "imported", lambda some, _: _imported(some, symbols)), held(lambda: _file_imports(_last(imports), symbols), "file_imports"),
    )
    return state


class _Keys:
    """A set of keys that rows are held against, without a shuffle of the rows while it is small; written
    once, as many plans read it."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        self.keys = scratch.written(keys.distinct(), "keys")
        self.n = self.keys.count()

    def _side(self, names: dict[str, str]) -> DataFrame:
        own = self.keys.select(*(F.col(a).alias(f"_{a}") for a in names.values()))
        return F.broadcast(own) if self.n <= BROADCAST_KEYS else own

    def _on(self, rows: DataFrame, side: DataFrame, names: dict[str, str]) -> Column:
        return reduce(lambda a, b: a & b, (rows[c] == side[f"_{k}"] for c, k in names.items()))

    def inside(self, rows: DataFrame, **names: str) -> DataFrame:
        """Rows whose columns are a key: names maps a column to its part of the key."""
        side = self._side(names)
        return rows.join(side, self._on(rows, side, names), "left_semi")

    def outside(self, rows: DataFrame, **names: str) -> DataFrame:
        if not self.n:
            return rows
        side = self._side(names)
        return rows.join(side, self._on(rows, side, names), "left_anti")


def _split(rows: DataFrame, tests: list[tuple[_Keys, dict[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """Rows that any of the key sets touches, each once, and the others."""
    touched, rest = [], rows
    for keys, names in tests:
        if keys.n:
            touched.append(keys.inside(rest, **names))
            rest = keys.outside(rest, **names)
    return reduce(DataFrame.unionByName, touched) if touched else rows.where("false"), rest


def _proposed(calls: DataFrame, symbols: DataFrame, imports: DataFrame, types: DataFrame, scratch: Scratch) -> DataFrame:
    """Proposals of written ``calls``, made of the symbols of their names and of their files' imports and types alone."""
    asked = _Keys(calls.select("name"), scratch)
    callers = _Keys(calls.select(F.col("caller_file").alias("file")), scratch)
    return scratch.written(resolve.proposals(calls, asked.inside(symbols, name="name"), callers.inside(imports, file="file"), callers.inside(types, file="file")), "proposed")


def update(state: State, changed: DataFrame, fresh: dict[str, DataFrame], retargeted: DataFrame | None = None, scratch: Scratch | None = None) -> State:
    """The state after the files ``changed(file)`` (edited, added or gone) have come to hold ``fresh``: symbols,
    calls, imports and types of these files. ``retargeted(file, local, target, ord)`` are imports of
    other files that now mean another file (target null: none), as when one was added or went.
    What is made on the way is written to ``scratch``, and read by the state. Counts, statistics and imports
    of files are made once they are asked for."""
    scratch = scratch or Scratch()
    files = _Keys(changed.select("file"), scratch)
    moved = retargeted if retargeted is not None else state.imports.where("false").select("file", "local", "target", "ord")
    moved = scratch.written(files.outside(moved, file="file"), "moved")
    turned = _Keys(moved.select("file", "local"), scratch)

    def merged(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
        return files.outside(old, **{column: "file"}).unionByName(new.select(*old.columns))

    symbols = merged(state.symbols, fresh["symbols"], "file")
    calls = merged(state.calls, fresh["calls"], "caller_file")
    types = merged(state.types, fresh["types"], "file")
    imports = merged(state.imports, fresh["imports"], "file")
    if turned.n:
        kept = imports.join(F.broadcast(moved.select("file", "local", "ord")) if turned.n <= BROADCAST_KEYS else moved.select("file", "local", "ord"), ["file", "local", "ord"], "left_anti")
        imports = kept.unionByName(moved.where("target is not null").select(*imports.columns))
    names = _Keys(files.inside(state.symbols, file="file").select("name").unionByName(fresh["symbols"].select("name")), scratch)
    tests = [(files, {"caller_file": "file"}), (names, {"name": "name"}), (turned, {"caller_file": "file", "name": "local"})]

    gained = _proposed(scratch.written(_split(calls, tests)[0], "touched"), symbols, imports, types, scratch)

    def proposed() -> DataFrame:
        return state.outside("proposed", lambda: state.calls, tests, scratch).unionByName(gained)

    def lost() -> DataFrame:
        return _split(state.proposed, tests)[0]

    def counts() -> DataFrame:
        delta = scratch.written(_each(lost(), -1).unionByName(_each(gained, 1)).groupBy("src", "dst", "strategy").agg(F.sum("n").alias("n")).where("n <> 0"), "delta")
        pairs = _Keys(delta.select("src", "dst", "strategy"), scratch)
        pair = {"src": "src", "dst": "dst", "strategy": "strategy"}
        return pairs.outside(state.counts, **pair).unionByName(_summed(pairs.inside(state.counts, **pair).unionByName(delta)))

    # import edges: of imports that are in, lead to, or came to lead to a touched file
    reach = [(files, {"file": "file"}), (files, {"target": "file"}), (turned, {"file": "file", "local": "local"})]
    now, _ = _split(_last(imports), reach)
    now = scratch.written(now, "imports")
    ends = _Keys(now.select("file").unionByName(now.select(F.col("target").alias("file"))), scratch)
    near = ends.inside(symbols, file="file")
    came = scratch.written(_imported(now, near), "links")

    def told(rows: DataFrame, sign: int) -> DataFrame:
        return resolve.stats(resolve.resolve(rows)).select("what", (F.col("n") * sign).alias("n"))

    def imported() -> DataFrame:
        return state.outside("imported", lambda: _last(state.imports), reach, scratch).unionByName(came)

    def stats() -> DataFrame:
        went = _split(state.imported, reach)[0]
        links = went.select(F.lit(-1).alias("n")).unionByName(came.select(F.lit(1).alias("n"))).agg(F.sum("n").alias("n")).select(F.lit("importEdge").alias("what"), F.coalesce("n", F.lit(0)).alias("n"))
        return reduce(DataFrame.unionByName, [state.stats, told(lost(), -1), told(gained, 1), links]).groupBy("what").agg(F.sum("n").alias("n")).where("n <> 0")

    def file_imports() -> DataFrame:
        return _split(state.file_imports, reach)[1].unionByName(_file_imports(now, near))

    return State(symbols, calls, imports, types, Later(proposed), Later(counts), Later(stats), Later(imported), Later(file_imports))


def retargeted(specifiers: DataFrame, imports: DataFrame, old_files: DataFrame, new_files: DataFrame, extensions: list[str], scratch: Scratch | None = None) -> DataFrame:
    """(file, local, target, ord) of imports(file, local, specifier, ord) whose target among ``new_files`` is not
    the one in ``imports``. Only imports that may name an added or removed file are looked at: those whose
    path's last part, without extension, is such a file's name or, for an index, its folder's."""
    known, now = old_files.select("file").distinct(), new_files.select("file").distinct()
    differ = known.join(now, "file", "left_anti").unionByName(now.join(known, "file", "left_anti"))

    def stem(path: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"\.[^.]*$", "")

    parts = F.split("file", "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("."))
    stems = _Keys(differ.select(F.explode(F.array(stem(F.col("file")), folder, stem(folder))).alias("stem")), scratch or Scratch())
    rows = specifiers.withColumn("_stem", stem(F.col("specifier")))
    dots = rows.where(F.col("specifier").rlike(r"(^|/)\.{1,2}/?$"))
    near = stems.inside(rows.where(~F.col("specifier").rlike(r"(^|/)\.{1,2}/?$")), _stem="stem").unionByName(dots).drop("_stem")
    found = resolve.module_path(near, now, extensions)
    after = near.join(found, ["file", "ord"], "left").select("file", "local", "ord", "target")
    before = imports.select("file", "local", "ord", F.col("target").alias("_old"))
    return after.join(before, ["file", "local", "ord"], "left").where(~F.col("target").eqNullSafe(F.col("_old"))).select("file", "local", "target", "ord")
