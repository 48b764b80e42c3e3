"""Call resolution: ranked strategies over symbols summed up by key, classes and their relations.

calls(call, caller, caller_file, name, receiver), symbols(id, name, kind, container, file), imports
(file, local, target), types(file, name, type, ord). Symbols come to calls as a count and one id for each
name, (name, file) and (name, container): every strategy is a left join on a key with at most one row
on the right, so a call stays one row however many symbols share its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.operators import graph

#: Strategies from strongest to weakest, and their weights.
STRATEGIES = {"importMap": 0.95, "sameFile": 0.9, "typedReceiver": 0.85, "uniqueName": 0.75, "uniqueMethod": 0.55}
IMPORT_WEIGHT = 0.2
#: Symbols of one array, two of which are taken apart to SIDE * SIDE import edges; a task has PIECE of these at once.
SIDE, PIECE = 2048, 512


def receiver_types(types: DataFrame) -> DataFrame:
    """(file, name, type): the last binding of each name counts, also as ``this.`` name; where the bindings
    know their class (``container``), only those of a class do."""
    own = types.where("container is not null") if "container" in types.columns else types
    both = types.select("file", "name", "type", "ord").unionByName(own.select("file", F.concat(F.lit("this."), F.col("name")).alias("name"), "type", "ord"))
    return both.groupBy("file", "name").agg(F.max_by("type", "ord").alias("type"))


def _single(symbols: DataFrame, *by: str) -> DataFrame:
    """How many symbols each key has, and the id and kind of one; both are its own if it is the only."""
    return symbols.groupBy(*by).agg(F.count("*").alias("n"), F.max("id").alias("one"), F.max("kind").alias("kind"))


def proposals(calls: DataFrame, symbols: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """One row for each call: candidates, and for each strategy its symbol or null. Calls without a caller
    (top-level ones) are left out."""
    bound = imports.groupBy(F.col("file").alias("caller_file"), F.col("local").alias("name")).agg(F.max_by("target", "ord").alias("target"))
    typed = receiver_types(types).select(F.col("file").alias("caller_file"), F.col("name").alias("receiver"), "type")
    rows = calls.where("caller is not null").join(bound, ["caller_file", "name"], "left").join(typed, ["caller_file", "receiver"], "left")
    every = _single(symbols, "name").select("name", F.col("n").alias("candidates"), F.col("one").alias("only"), "kind")
    by_file = _single(symbols, "name", "file").where("n = 1")
    by_class = _single(symbols.where("kind = 'method' and container is not null"), "name", "container").where("n = 1")
    rows = rows.join(every, "name", "left")
    rows = rows.join(by_file.select("name", F.col("file").alias("target"), F.col("one").alias("importMap")), ["name", "target"], "left")
    rows = rows.join(by_file.select("name", F.col("file").alias("caller_file"), F.col("one").alias("sameFile")), ["name", "caller_file"], "left")
    rows = rows.join(by_class.select("name", F.col("container").alias("type"), F.col("one").alias("typedReceiver")), ["name", "type"], "left")
    unique = F.when(F.col("candidates") == 1, F.col("only"))
    method = F.col("receiver").isNotNull() & (F.col("kind") == "method")
    return rows.select(
        "call", "caller", "caller_file", "name", "receiver", F.coalesce("candidates", F.lit(0)).alias("candidates"), "importMap", "sameFile", "typedReceiver",
        F.when(~method, unique).alias("uniqueName"), F.when(method, unique).alias("uniqueMethod"),
    )


def resolve(proposed: DataFrame) -> DataFrame:
    """(call, caller, callee, strategy, status): the strongest proposal; status is resolved, self (a
    call of its own caller, dropped without trying on), ambiguous or unknown."""
    strategy = F.coalesce(*(F.when(F.col(s).isNotNull(), F.lit(s)) for s in STRATEGIES))
    callee = F.coalesce(*(F.col(s) for s in STRATEGIES))
    status = F.when(F.col("candidates") == 0, "unknown").when(callee.isNull(), "ambiguous").when(callee == F.col("caller"), "self").otherwise("resolved")
    return proposed.select("call", "caller", callee.alias("callee"), strategy.alias("strategy"), status.alias("status"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, weight, strategy): a bag, one row for each call."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in STRATEGIES.items() for x in kv)), F.col("strategy"))
    return resolved.where("status = 'resolved'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), weight.alias("weight"), "strategy")


def captures(proposed: DataFrame) -> DataFrame:
    """(src, dst, n): distinct strategies that propose each pair, own caller left out."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("dst")) for s in STRATEGIES)))
    rows = proposed.select("caller", each.alias("p")).where("p.dst is not null and p.dst <> caller")
    return rows.groupBy(F.col("caller").alias("src"), F.col("p.dst").alias("dst")).agg(F.count_distinct("p.s").alias("n"))


def import_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every symbol of the importing file to each symbol of the imported name in the target file.

    These grow with the square of a file's symbols. Both ends come in arrays of about SIDE for each file; only
    pairs of arrays are joined and dealt to tasks, and are taken apart there, so that no edge is shuffled
    and a file is many tasks. Generated code keeps all rows that it makes of one row until the row is done;
    ``transform`` is not generated, so that only the PIECE edges of the last step are kept, not the SIDE * SIDE
    of a pair."""
    named = symbols.select(F.col("id").alias("dst"), F.col("name").alias("local"), F.col("file").alias("target"))
    ends = _dealt(imports.select("file", "local", "target").join(named, ["local", "target"]), "file", "dst")
    own = _dealt(symbols.select(F.col("id").alias("src"), "file"), "file", "src")
    tasks = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = ends.join(own, "file").select("src", "dst").repartition(tasks)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("dst") - 1) / PIECE).cast("int")), lambda i: F.slice("dst", i * PIECE + 1, F.lit(PIECE)))
    starts = pairs.select("src", F.explode(pieces).alias("dst")).select(F.explode(F.transform("src", lambda x: x)).alias("src"), "dst")
    each = starts.select("src", F.explode("dst").alias("dst"))
    return each.where("src <> dst").select("src", "dst", F.lit(IMPORT_WEIGHT).alias("weight"), F.lit("importEdge").alias("strategy"))


def _dealt(rows: DataFrame, by: str, column: str) -> DataFrame:
    """The column's values of each key in arrays of about SIDE; nulls are left out."""
    rows = rows.select(by, column).where(F.col(column).isNotNull())
    arrays = rows.groupBy(by).agg(F.ceil(F.count("*") / SIDE).alias("_n"))
    return rows.join(arrays, by).groupBy(by, F.pmod(F.xxhash64(column), "_n").alias("_at")).agg(F.collect_list(column).alias(column)).drop("_at")


def import_edge_count(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row (what, n): how many ``import_edges`` there are, by the sizes of both ends, without making them."""
    rows, s = imports.groupBy("file", "local", "target").agg(F.count("*").alias("m")), symbols.where("id is not null")
    named = s.groupBy(F.col("name").alias("local"), F.col("file").alias("target")).agg(F.count("*").alias("ends"))
    own = s.groupBy("file").agg(F.count("*").alias("starts"))
    every = rows.join(named, ["local", "target"]).join(own, "file").select((F.col("m") * F.col("ends") * F.col("starts")).alias("n"))
    same = s.select("id", F.col("name").alias("local"), F.col("file").alias("target")).join(s.select("id", "file"), "id")
    loops = same.join(rows, ["file", "local", "target"]).select((-F.col("m")).alias("n"))
    return every.unionByName(loops).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("importEdge").alias("what"), "n")


def import_blocks(imports: DataFrame, symbols: DataFrame) -> graph.Blocks:
    """``import_edges`` as edges between whole sets: symbols of files, and symbols of names in files."""
    s = symbols.where("id is not null").withColumnRenamed("id", "node")
    name = F.struct(F.col("file").alias("target"), F.col("name").alias("local"))
    links = imports.groupBy("file", "local", "target").agg((F.count("*") * IMPORT_WEIGHT).alias("w"))
    return graph.Blocks(
        s.where("file is not null").select(F.col("file").alias("l"), "node"), s.where("file is not null and name is not null").select(name.alias("r"), "node"),
        links.where("file is not null and local is not null and target is not null").select(F.col("file").alias("l"), F.struct("target", "local").alias("r"), "w"),
    )


def file_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    named = symbols.select(F.col("id").alias("symbol"), F.col("name").alias("local"), F.col("file").alias("target"))
    return imports.join(named, ["local", "target"]).select("file", "symbol").distinct()


def stats(resolved: DataFrame, imported: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(what, n): calls by strategy or by status, and import edges if they are given, or ``counted(what, n)``."""
    what = F.when(F.col("status") == "resolved", F.col("strategy")).otherwise(F.col("status"))
    rows = resolved.select(what.alias("what"))
    if imported is not None:
        rows = rows.union(imported.select(F.lit("importEdge").alias("what")))
    told = rows.groupBy("what").agg(F.count("*").alias("n"))
    return told if counted is None else told.unionByName(counted)


def all_edges(calls: DataFrame, imported: DataFrame) -> DataFrame:
    """Call edges and import edges as one bag."""
    return calls.unionByName(imported)


def class_resolution(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds the class that each (file, name) means: the only one of the name in the file, else the only
    one of all, else null."""
    classes = symbols.where("kind = 'class'")
    own = _single(classes, "file", "name").where("n = 1").select("file", "name", F.col("one").alias("_own"))
    every = _single(classes, "name").where("n = 1").select("name", F.col("one").alias("_every"))
    return names.join(own, ["file", "name"], "left").join(every, "name", "left").withColumn("class", F.coalesce("_own", "_every")).drop("_own", "_every")


def type_relations(declared: DataFrame, symbols: DataFrame) -> DataFrame:
    """(subtype, supertype, kind) by ids, from declared(file, subtype, supertype, kind): extends and
    implements between classes that are resolved and differ; overrides of methods whose class extends
    another with exactly one method of the name. A bag, as declared."""
    sub = class_resolution(declared.withColumnRenamed("subtype", "name"), symbols).select("file", "supertype", "kind", F.col("class").alias("_sub"))
    both = class_resolution(sub.withColumnRenamed("supertype", "name"), symbols).select(F.col("_sub").alias("subtype"), F.col("class").alias("supertype"), "kind")
    known = both.where("subtype is not null and supertype is not null and subtype <> supertype")
    methods = symbols.where("kind = 'method' and container is not null").select("id", F.col("name").alias("method"), "file", F.col("container").alias("name"))
    owned = class_resolution(methods, symbols).where("class is not null").select("id", F.col("class").alias("container"), F.col("method").alias("name"))
    extends = known.where("kind = 'extends'").select(F.col("subtype").alias("sub"), F.col("supertype").alias("super"))
    return known.unionByName(overrides(owned, extends).withColumn("kind", F.lit("overrides")))


def overrides(methods: DataFrame, extends: DataFrame) -> DataFrame:
    """(subtype, supertype): methods (id, container, name) whose class extends another that has exactly
    one method of the name."""
    one = methods.groupBy("container", "name").agg(F.count("*").alias("n"), F.max("id").alias("supertype")).where("n = 1")
    up = extends.join(one, extends["super"] == one["container"]).select("sub", "name", "supertype")
    own = methods.select(F.col("id").alias("subtype"), F.col("container").alias("sub"), "name")
    return own.join(up, ["sub", "name"]).select("subtype", "supertype")


def module_path(imports: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """(file, ord, target): the first existing candidate of each relative import (file, specifier, ord):
    itself, a TypeScript twin of .js, with an extension, as an index of a folder."""
    from reposcope.functions.text import join_path

    base = join_path(F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("specifier")))
    twins = F.when(F.col("base").endswith(".js"), F.array(F.regexp_replace("base", r"\.js$", ".ts"), F.regexp_replace("base", r"\.js$", ".tsx"))).otherwise(F.array().cast("array<string>"))
    ways = F.flatten(F.array(F.array("base"), twins, F.array(*(F.concat("base", F.lit(e)) for e in extensions)), F.array(*(F.concat("base", F.lit("/index" + e)) for e in extensions))))
    rows = imports.where(F.col("specifier").startswith(".")).withColumn("base", base)
    asked = rows.select("file", "ord", F.posexplode(ways).alias("pos", "target"))
    known = asked.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    return known.groupBy("file", "ord").agg(F.min_by("target", "pos").alias("target"))


def resolve_project(found: dict[str, DataFrame], files: DataFrame, extensions: list[str]) -> dict[str, DataFrame]:
    """All relations of a project from ``extract.relations``: symbols, edges (calls and imports), captures,
    file_imports, type_relations, stats, and the state they can be kept up to date from."""
    from reposcope.operators import incremental

    symbols = found["symbols"]
    targets = module_path(found["imports"], files, extensions)
    imports = found["imports"].join(targets, ["file", "ord"]).select("file", "local", "target", "ord")
    state = incremental.build(symbols, found["calls"], imports, found["types"])
    return project_of(state, found["type_relations"]) | {"state": state}


def project_of(state, declared: DataFrame) -> dict[str, DataFrame]:
    """What an index is made of, from a state of ``incremental`` and the declared type relations."""
    return {
        "symbols": state.symbols, "edges": state.edges(), "captures": state.captures(), "file_imports": state.imports_of_files(),
        "type_relations": type_relations(declared, state.symbols), "stats": state.stats,
    }
