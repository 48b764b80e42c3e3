"""Ranked retrieval: TF-IDF seeds, diffusion, fusion with co-change, budget, blast radius, snippets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.text import identifier_terms, identifiers, is_test_file
from reposcope.operators import graph, mining, spans
from reposcope.shared import Scratch

#: Terms in more than this share of the symbols say nothing.
MOST_SHARE = 0.15
#: Diffusion time, and how many symbols that a question finds by its words start it.
TIME, QUESTION_SEEDS = 1.5, 5
#: What a diffusion leaves out of the kernel, and what residual it leaves where it is, as shares of the mass.
TOLERANCE, LOST = 1e-6, 1e-9
#: Weight of co-change beside seeds that were given; beside a question it is 0.
COCHANGE_WEIGHT = 0.5
#: Strategies in the order in which they explain a symbol.
VIA = ("importMap", "sameFile", "typedReceiver", "uniqueName", "uniqueMethod")


def term_table(symbols: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id, term, tf)."""
    return symbols.select(F.col(id_col).alias("id"), F.explode(identifier_terms(F.col(body_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf_table(terms: DataFrame, n: int, most_share: float = MOST_SHARE) -> DataFrame:
    """(term, df, idf) of terms in at most that share of the symbols."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return df.where(F.col("df") <= most_share * n).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))


def _weight() -> Column:
    return (1 + F.log("tf")) * F.col("idf")


def norms(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, norm) of each symbol's weights over all its kept terms."""
    return terms.join(idf, "term").groupBy("id").agg(F.sqrt(F.sum(_weight() * _weight())).alias("norm"))


def question_scores(terms: DataFrame, idf: DataFrame, question: list[str], norm: DataFrame | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """(id, score): cosine of the question's weights (each term once) and the symbol's. The few symbols
    that hold a term of the question are found first; only theirs are the norms that are summed, unless
    ``norm`` has them already. With ``bodies(id, body)``, which the terms are of, only their bodies are
    taken apart for that, and no other term is shuffled for the norms."""
    asked = F.broadcast(idf.where(F.col("term").isin(question)))  # a row for each asked term
    hit = terms.where(F.col("term").isin(question)).join(asked, "term").groupBy("id").agg(F.sum(_weight() * F.col("idf")).alias("dot"))
    if norm is not None:
        own = norm
    elif bodies is not None:
        own = norms(term_table(bodies.join(hit.select("id"), "id", "left_semi")), idf)
    else:
        own = norms(terms.join(hit.select("id"), "id", "left_semi"), idf)
    length = F.broadcast(asked.agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("length")))  # one row
    scored = hit.join(own, "id").crossJoin(length)
    return scored.select("id", F.when(F.col("norm") * F.col("length") > 0, F.col("dot") / (F.col("norm") * F.col("length"))).otherwise(0.0).alias("score")).where("score > 0")


def fuse(lexical: DataFrame, structural: DataFrame, cochange: DataFrame, structural_weight: float = 1.0, cochange_weight: float = 0.0) -> DataFrame:
    """(id, score, structural, lexical, cochange): weighted sum of tables (id, score), co-change over its
    maximum; zero scores drop out."""
    top = F.broadcast(cochange.agg(F.max("score").alias("_top")))  # one row
    scaled = cochange.crossJoin(top).select("id", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0).alias("cochange"))
    rows = structural.select("id", F.col("score").alias("structural")).join(lexical.select("id", F.col("score").alias("lexical")), "id", "full_outer").join(scaled, "id", "full_outer")
    parts = {c: F.coalesce(c, F.lit(0.0)) for c in ("structural", "lexical", "cochange")}
    rows = rows.select("id", *(x.alias(c) for c, x in parts.items()))
    total = structural_weight * F.col("structural") + F.col("lexical") + cochange_weight * F.col("cochange")
    return rows.select("id", total.alias("score"), "structural", "lexical", "cochange").where("score > 0")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The best symbols (id, score, tokens) whose running tokens stay within the budget. Each takes one
    token or more, so no more than ``budget`` rows can fit and are ranked on one task."""
    best = ranked.orderBy(F.desc("score"), "id").limit(budget)
    running = F.sum("tokens").over(Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("running", running).where(F.col("running") <= budget)


def edges_among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return edges.where("src <> dst").join(a, "src", "left_semi").join(b, "dst", "left_semi")


def blast_radius(edges: DataFrame, symbols: DataFrame, file_imports: DataFrame) -> DataFrame:
    """(id, callers, caller_files, test_files, caller_file_list, test_file_list) of every symbol with
    callers; a test file counts by a call or an import."""
    calls = edges.where("strategy <> 'importEdge'").select(F.col("src").alias("caller"), F.col("dst").alias("id")).distinct()
    at = symbols.select(F.col("id").alias("caller"), "file")
    called = calls.join(at, "caller")
    imported = file_imports.where(is_test_file(F.col("file"))).select(F.lit(None).cast(symbols.schema["id"].dataType).alias("caller"), F.col("symbol").alias("id"), "file")
    test = is_test_file(F.col("file"))
    sets = called.select("caller", "id", "file").unionByName(imported).groupBy("id").agg(
        F.count_distinct("caller").alias("callers"), F.array_sort(F.collect_set(F.when(~test, F.col("file")))).alias("caller_file_list"), F.array_sort(F.collect_set(F.when(test, F.col("file")))).alias("test_file_list")
    ).where("callers > 0")
    return sets.select("id", "callers", F.size("caller_file_list").cast("bigint").alias("caller_files"), F.size("test_file_list").cast("bigint").alias("test_files"), "caller_file_list", "test_file_list")


@dataclass
class Index:
    """What retrieval, trace and impact read. symbols(id, name, kind, container, file, start, end, tokens,
    body), edges(src, dst, weight, strategy), file_imports(file, symbol), type_relations(subtype,
    supertype, kind), cochange(file, other, score) or None. ``blocks`` are the import edges as edges between
    sets; with them the graph is laid out without making each."""

    symbols: DataFrame
    edges: DataFrame
    file_imports: DataFrame
    type_relations: DataFrame
    cochange: DataFrame | None = None
    completeness: float = 0.0
    reliable: bool = False
    ambiguous_calls: int = 0
    blocks: graph.Blocks | None = None

    def __post_init__(self):
        self.terms = term_table(self.symbols)
        self.n = None
        self.graph = None

    def size(self) -> int:
        if self.n is None:
            self.n = self.symbols.count()
        return self.n

    def transition(self) -> graph.Transition:
        """The graph of all edges, laid out once for all questions."""
        if self.graph is None:
            edges = self.edges if self.blocks is None else self.edges.where("strategy <> 'importEdge'")
            self.graph = graph.laid_out(edges.select("src", "dst", "weight"), self.blocks)
        return self.graph

    def persist(self) -> Index:
        """Keeps what every question reads, until ``release``."""
        for name in ("symbols", "edges", "file_imports", "type_relations", "terms"):
            setattr(self, name, getattr(self, name).persist())
        return self

    def release(self) -> None:
        for name in ("symbols", "edges", "file_imports", "type_relations", "terms"):
            getattr(self, name).unpersist()
        if self.graph is not None:
            self.graph.release()
            self.graph = None

    def calls(self) -> DataFrame:
        """(src, dst, strategy): each pair's strongest strategy; import edges are no calls."""
        rank = F.array_position(F.array(*(F.lit(v) for v in VIA)), F.col("strategy"))
        return self.edges.where("strategy <> 'importEdge'").groupBy("src", "dst").agg(F.min_by("strategy", rank).alias("strategy"))


def build_index(symbols: DataFrame, edges: DataFrame, file_imports: DataFrame, type_relations: DataFrame, bodies: DataFrame, captures: DataFrame | None = None, ambiguous_calls: int = 0, cochange: DataFrame | None = None) -> Index:
    """The index over symbols with their bodies(id, body). How complete the graph is comes from the
    captures(src, dst, n) of call edges: ambiguous calls are missing edges that are known of."""
    completeness, reliable = 0.0, False
    if captures is not None:
        found = mining.chao1(mining.frequencies(captures), ambiguous_calls).first()
        completeness, reliable = float(found["completeness"]), bool(found["reliable"])
    return Index(symbols.join(bodies, "id", "left").withColumn("body", F.coalesce("body", F.lit(""))), edges, file_imports, type_relations, cochange, completeness, reliable, ambiguous_calls)


def seeds_of(index: Index, seeds: list[str]) -> DataFrame:
    """(id, file, by_file) of the symbols that names, files or ids ask for; blank seeds ask for none."""
    asked = [s.strip() for s in seeds if s.strip()]
    hit = F.col("name").isin(asked) | F.col("file").isin(asked) | F.col("id").cast("string").isin(asked)
    return index.symbols.where(hit).select("id", "file", F.col("file").isin(asked).alias("by_file"))


def _via(index: Index, near: DataFrame, found: DataFrame) -> DataFrame:
    """Adds via to found: the strongest strategy of an edge to a seed, else cochange, else null."""
    both = index.calls()
    ways = both.select(F.col("src").alias("seed"), F.col("dst").alias("id"), "strategy").union(both.select("dst", "src", "strategy"))
    rank = F.array_position(F.array(*(F.lit(v) for v in VIA)), F.col("strategy"))
    best = ways.join(near.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi").groupBy("id").agg(F.min_by("strategy", rank).alias("via"))
    return found.join(best, "id", "left").withColumn("via", F.coalesce("via", F.when(F.col("cochange") > 0, "cochange")))


def _cochange_scores(index: Index, seeds: DataFrame) -> DataFrame | None:
    """(id, score) of the symbols in files that change with the seeds' files."""
    if index.cochange is None:
        return None
    files = mining.cochange_for_seeds(index.cochange, seeds.select("file").distinct())
    return index.symbols.select("id", "file").join(files.withColumnRenamed("other", "file"), "file").select("id", "score")


def _none(index: Index) -> DataFrame:
    return index.symbols.where("false").select("id", F.lit(0.0).alias("score"))


def rank(index: Index, seeds: list[str] | None = None, question: str | None = None, structural_weight: float = 1.0, cochange_weight: float | None = None, question_seeds: int = QUESTION_SEEDS, scratch: Scratch | None = None) -> DataFrame | None:
    """(id, score, structural, lexical, cochange, via) of what is relevant; None if nothing is asked.

    Seeds go before a question. With seeds, symbols of seed files are withheld, as the asker has them;
    a symbol asked for by its name stays. With a question the best symbols by words are the seeds and stay.
    What is made on the way is written to ``scratch``, which its owner releases."""
    scratch = scratch or Scratch()
    asked = [s for s in seeds or [] if s.strip()]
    terms = identifiers(question or "")
    if not asked and not terms:
        return None
    idf = idf_table(index.terms, index.size())
    if asked:
        near = scratch.written(seeds_of(index, asked), "seeds")
        words = _none(index)
        weight = COCHANGE_WEIGHT if cochange_weight is None else cochange_weight
    else:
        words = scratch.written(question_scores(index.terms, idf, terms), "words")
        best = words.orderBy(F.desc("score"), "id").limit(question_seeds)
        near = scratch.written(index.symbols.select("id", "file").join(F.broadcast(best), "id").select("id", "file", F.lit(False).alias("by_file"), "score"), "seeds")  # question_seeds rows
        weight = 0.0 if cochange_weight is None else cochange_weight
    if not near.count():
        return _via(index, near, fuse(words, _none(index), _none(index)))
    mass = near.select(F.col("id").alias("node"), (F.col("score") if "score" in near.columns else F.lit(1.0)).alias("x"))
    structural = graph.diffuse(index.transition(), mass, TIME, TOLERANCE, lost=LOST, scratch=scratch).select(F.col("node").alias("id"), F.col("relevance").alias("score"))
    history = _cochange_scores(index, near) if weight > 0 else None
    found = fuse(words, structural, history if history is not None else _none(index), structural_weight, weight)
    if asked:
        files = near.where("by_file").select("file").distinct()
        held = index.symbols.join(files, "file", "left_semi").select("id")
        found = found.join(held, "id", "left_anti")
    return _via(index, near, found)


def snippets(symbols: DataFrame, sources: DataFrame, lines: int = 40) -> DataFrame:
    """Adds snippet: numbered lines of each symbol(file, start, end), at most ``lines``, and how many more."""
    split = sources.select(F.col("file").alias("_f"), F.split("source", "\n", -1).alias("_lines"))
    size = F.least(F.col("end"), F.size("_lines") - 1) - F.col("start") + 1
    body = F.transform(F.slice("_lines", F.col("start") + 1, F.greatest(F.least(size, F.lit(lines)), F.lit(0))), lambda x, i: F.concat((F.col("start") + i + 1).cast("string"), F.lit("|"), x))
    more = F.when(size > lines, F.concat(F.lit("\n… "), (size - lines).cast("string"), F.lit(" more lines"))).otherwise("")
    return symbols.join(split, F.col("file") == F.col("_f"), "left").withColumn("snippet", F.concat(F.array_join(body, "\n"), more)).drop("_f", "_lines")


def retrieve(index: Index, seeds: list[str] | None = None, question: str | None = None, budget: int = 4000, scratch: Scratch | None = None, **options) -> dict:
    """symbols (ranked within the budget), tokens_used, files, edges (among the symbols), blast_radius (of
    symbols returned or asked for by name). All five are there, and empty, if nothing is asked or found."""
    scratch = scratch or Scratch()
    found = rank(index, seeds, question, scratch=scratch, **options)
    every = index.symbols.select("id", "name", "file", "start", "end", "tokens")
    if found is None:
        empty = every.where("false")
        return {"symbols": empty, "tokens_used": 0, "files": [], "edges": index.edges.where("false"), "blast_radius": blast_radius(index.edges.where("false"), index.symbols, index.file_imports.where("false"))}
    packed = scratch.written(within_budget(every.join(found, "id"), budget), "packed")
    rows = packed.orderBy("running").select("file", "running").collect()  # budget rows at most
    near = packed.select("id")
    asked = near.union(seeds_of(index, seeds or []).where("not by_file").select("id")).distinct()
    radius = blast_radius(index.edges.join(asked.withColumnRenamed("id", "dst"), "dst", "left_semi"), index.symbols, index.file_imports.join(asked.withColumnRenamed("id", "symbol"), "symbol", "left_semi"))
    return {"symbols": packed, "tokens_used": rows[-1]["running"] if rows else 0, "files": list(dict.fromkeys(r["file"] for r in rows)), "edges": edges_among(index.edges, near), "blast_radius": radius.join(every.select("id", "name", "file", "start"), "id")}


def one_hop(edges: DataFrame, nodes: DataFrame, most: int = 12) -> DataFrame:
    """(node, relation, other, via): distinct callers and callees of each node, at most ``most`` each."""
    down = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.lit("callee").alias("relation"), F.col("dst").alias("other"), F.col("strategy").alias("via"))
    up = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.lit("caller").alias("relation"), F.col("src").alias("other"), F.col("strategy").alias("via"))
    w = Window.partitionBy("node", "relation").orderBy("other", "via")
    return down.union(up).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def resolve_targets(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, status, id): by id, else all of a file, else a name that only one symbol has; else
    ambiguous or unresolved. Never a guess."""
    by_id = targets.join(symbols.select(F.col("id").alias("_id")), F.col("target") == F.col("_id").cast("string")).select("target", F.lit(1).alias("rank"), F.col("_id").alias("id"))
    by_file = targets.join(symbols.select("id", F.col("file").alias("_f")), F.col("target") == F.col("_f")).select("target", F.lit(2).alias("rank"), "id")
    by_name = targets.join(symbols.select("id", F.col("name").alias("_n")), F.col("target") == F.col("_n")).select("target", F.lit(3).alias("rank"), "id")
    found = by_id.union(by_file).union(by_name)
    w = Window.partitionBy("target")
    best = found.withColumn("_r", F.min("rank").over(w)).where("rank = _r").withColumn("_n", F.count("*").over(w))
    status = F.when((F.col("rank") == 3) & (F.col("_n") > 1), "ambiguous").otherwise("resolved")
    rows = best.select("target", status.alias("status"), F.when(status == "resolved", F.col("id")).alias("id")).distinct()
    return targets.join(rows, "target", "left").select("target", F.coalesce("status", F.lit("unresolved")).alias("status"), "id")


def direct_callers(edges: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(caller, file, is_test, targets, via): callers of ``targets(id)``, production and test."""
    calls = edges.where("strategy <> 'importEdge'").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    named = calls.join(symbols.select(F.col("id").alias("src"), "file"), "src")
    return named.groupBy(F.col("src").alias("caller"), "file").agg(F.array_sort(F.collect_set("dst")).alias("targets"), F.array_sort(F.collect_set("strategy")).alias("via")).withColumn("is_test", is_test_file(F.col("file")))


def inside(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits (file, line from 1) within spans of symbols (id, file, start, end from 0): see ``spans``."""
    return spans.containing(hits, symbols.select("id", "file", "start", "end"))
