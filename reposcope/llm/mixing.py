"""Mixing to target weights with soft membership, in DataFrame operations only.

A classifier of hashed tokens gives each document a posterior over the labels' domains. It is fitted on
the labelled rows: one half of them counts in how many documents of each domain a cell of tokens
stands, which gives log-odds with a Dirichlet prior; on the other half linear discriminants are fitted
to the documents' mean log-odds. Rates are fitted by accelerated projected gradient: least squares
between the expected tokens of each domain (rate * posterior * tokens, summed) and the targets, with
a small pull towards 1, all rates being 0 or more. Documents whose posteriors fall into the same cell
(1 / GRID wide) share a rate; a cell carries the exact sums of its documents, so every step is one
aggregation over cells. These are (GRID + 1) ^ (domains - 1) at most, and never more than documents;
rates come back to the documents by a join on the cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import free_name, materialize

#: Labelled rows to fit on, at most: those with the smallest hashes of their ids.
SAMPLE = 200_000
#: Cells of hashed tokens, and documents seen beforehand with each cell, of domains as all documents are.
CELLS, PRIOR = 16_384, 10.0
GRID, PULL, RIDGE = 200, 1e-3, 1e-4
#: Steps end when rates move less than this on average (by tokens); that they do not is an error.
STILL, MOST_STEPS = 1e-6, 400
#: Rates of this many cells at most are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 200_000
#: So many cells or fewer take all steps in one job, as one array; of more each step is a job.
FEW_CELLS = 20_000
#: Runs of letters, of digits, of other signs.
TOKEN = r"\p{L}+|[0-9]+|[^\p{L}0-9\s]+"

#: Log-odds of the cells and, for each domain, the discriminant's constant and weights.
Model = tuple[list[list[float]], dict[str, list[float]]]


def tokens(text: Column) -> Column:
    """Words: runs without white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def cells(text: Column) -> Column:
    """array<int>: the cell of each token."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(CELLS)).cast("int"))


def _let(value: Column, body) -> Column:
    """body(value), the value being taken once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_odds(text: Column, odds: list[list[float]]) -> Column:
    """array<double>: for each domain the mean log-odds of the text's tokens; 0 without tokens."""
    known = [F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in own) + "]"), "array<double>") for own in odds]

    def mean(found: Column, own: Column) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda total, c: total + F.get(own, c)) / F.greatest(F.size(found), F.lit(1))

    def means(found: Column) -> Column:
        return F.array(*(mean(found, own) for own in known))

    return _let(cells(text), means)


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots, for a matrix with a row for each domain."""
    rows = [[*r, b] for r, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for k in range(n):
            if k != i:
                f = rows[k][i] / rows[i][i]
                rows[k] = [a - f * b for a, b in zip(rows[k], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Model | None:
    """The model from the labelled rows (doc_id, domain); None without rows in either half. Of several
    labels of an id the least counts; other domains, null ids and ids without a document teach nothing.
    A domain without rows gets no discriminant."""
    sample = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", "text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"))
    first = rows.where("half = 0")
    counted = first.select("domain", F.explode(F.array_append(F.array_distinct(cells(F.col("text"))), F.lit(-1))).alias("cell")).groupBy("domain", "cell").agg(F.count("*").alias("n")).collect()
    size = {r["domain"]: r["n"] for r in counted if r["cell"] < 0}
    total = sum(size.values())
    if not total:
        return None
    seen = {d: [0] * CELLS for d in domains}
    for r in counted:
        if r["cell"] >= 0:
            seen[r["domain"]][r["cell"]] = r["n"]
    of_all = [sum(seen[o][c] for o in domains) / total for c in range(CELLS)]
    odds = []
    for d in domains:
        odds.append([math.log((seen[d][c] + PRIOR * (p + 1e-4)) / (size.get(d, 0) + PRIOR)) - math.log(p + 1e-4) for c, p in enumerate(of_all)])
    k = len(domains)
    x = rows.where("half = 1").select("domain", log_odds(F.col("text"), odds).alias("x")).select("domain", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(k)))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(k)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]
    found = x.groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()
    total = sum(r["n"] for r in found)
    if not total:
        return None
    mean = {r["domain"]: [r[f"s{i}"] / r["n"] for i in range(k)] for r in found}
    cov = [[sum(r[f"q{min(i, j)}_{max(i, j)}"] - r["n"] * mean[r["domain"]][i] * mean[r["domain"]][j] for r in found) / total + RIDGE * (i == j) for j in range(k)] for i in range(k)]
    lines = {}
    for r in found:
        m = mean[r["domain"]]
        w = _solve(cov, m)
        lines[r["domain"]] = [math.log(r["n"] / total) - sum(a * b for a, b in zip(w, m, strict=True)) / 2, *w]
    return odds, lines


def posteriors(text: Column, model: Model | None, domains: list[str]) -> Column:
    """array<double> in the order of ``domains``; equal shares without a model."""
    if not model:
        return F.array(*(F.lit(1.0 / len(domains)) for _ in domains))
    odds, lines = model

    def raw(x: Column) -> Column:
        return F.array(*(sum((F.get(x, F.lit(i)) * w for i, w in enumerate(lines[d][1:])), F.lit(lines[d][0])) if d in lines else F.lit(-1e9) for d in domains))

    up = _let(_let(log_odds(text, odds), raw), lambda s: F.transform(s, lambda x: F.exp(F.greatest(x - F.array_max(s), F.lit(-60.0)))))
    return _let(up, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def _steps(cell: Column, history: list[list[float]]) -> Column:
    """Struct of a cell's rate r, the rate before, and the point y at which the next gradient is taken,
    after the steps whose residuals are given."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"), F.lit(1.0).alias("y"), F.lit(1.0).alias("t"))
    if not history:
        return start
    eta = 1 / (1 + PULL)

    def step(s, e):
        push = F.aggregate(F.zip_with(cell, e, lambda p, x: p / GRID * x), F.lit(0.0), lambda a, b: a + b)
        r = F.greatest(F.lit(0.0), s["y"] - eta * (push + PULL * (s["y"] - 1)))
        t = (1 + F.sqrt(1 + 4 * s["t"] * s["t"])) / 2
        return F.struct(r.alias("r"), s["r"].alias("before"), (r + (s["t"] - 1) / t * (r - s["r"])).alias("y"), t.alias("t"))

    return F.aggregate(F.from_json(F.lit(str(history)), "array<array<double>>"), start, step)


def _gradient(cells: Column, total: int, targets: list[float]) -> Column:
    """Struct of the rates r of ``cells`` (array of cell, n and sums e), the residual where the steps ended, by
    how much rates moved in the last one, and whether they came to rest: what the steps of
    ``_steps`` give, one after the other within one row."""
    eta, ones = 1 / (1 + PULL), F.transform(cells, lambda c: F.lit(1.0))
    zero = F.array(*(F.lit(0.0) for _ in targets))
    start = F.struct(ones.alias("r"), ones.alias("y"), F.lit(1.0).alias("t"), zero.alias("residual"), F.lit(0.0).alias("moved"), F.lit(False).alias("still"))

    def total_of(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def share(s: Column, i: int) -> Column:
        return total_of(F.zip_with(cells, s["y"], lambda c, y: c["e"][i] * y)) / total

    def moved(s: Column, j: Column) -> Column:
        residual = F.array(*(share(s, i) - x for i, x in enumerate(targets)))
        return _let(residual, lambda e: F.when((j > 1) & (s["moved"] < STILL), ended(s, e)).otherwise(stepped(s, e)))

    def ended(s: Column, e: Column) -> Column:
        return F.struct(s["r"], s["y"], s["t"], e.alias("residual"), s["moved"], F.lit(True).alias("still"))

    def stepped(s: Column, e: Column) -> Column:
        def rate(c: Column, y: Column) -> Column:
            return F.greatest(F.lit(0.0), y - eta * (total_of(F.zip_with(c["cell"], e, lambda p, x: p / GRID * x)) + PULL * (y - 1)))

        t = (1 + F.sqrt(1 + 4 * s["t"] * s["t"])) / 2
        return _let(F.zip_with(cells, s["y"], rate), lambda r: F.struct(
            r.alias("r"), F.zip_with(r, s["r"], lambda now, before: now + (s["t"] - 1) / t * (now - before)).alias("y"), t.alias("t"), e.alias("residual"),
            (total_of(F.zip_with(cells, F.zip_with(r, s["r"], lambda now, before: F.abs(now - before)), lambda c, d: c["n"] * d)) / total).alias("moved"), F.lit(False).alias("still"),
        ))

    return F.aggregate(F.sequence(F.lit(0), F.lit(MOST_STEPS)), start, lambda s, j: F.when(s["still"], s).otherwise(moved(s, j)))


def _unsettled(moved: float, residual: list[float]) -> RuntimeError:
    return RuntimeError(f"rates still move by {moved} after {MOST_STEPS} steps; shares are off by {residual}")


def fit_rates(scored: DataFrame, targets: list[float]) -> DataFrame:
    """(cell, rate, residual) from ``scored(n, cell, posterior)``. residual is the greatest difference of
    a domain's expected share from its target at the end: more than 0 where no rates of 0 or more
    reach the targets. Rates that do not come to rest are an error."""
    k = len(targets)
    sums = [F.sum(F.col("n") * F.get("posterior", F.lit(i))).alias(f"e{i}") for i in range(k)]
    held = materialize(scored.groupBy("cell").agg(F.sum("n").alias("n"), *sums), "cells")
    total, cells = held.agg(F.sum("n"), F.count("*")).first()
    if total and cells <= FEW_CELLS:
        each = F.array_sort(F.collect_list(F.struct("cell", F.col("n").cast("double").alias("n"), F.array(*(f"e{i}" for i in range(k))).alias("e"))))  # FEW_CELLS at most
        found = materialize(held.agg(each.alias("cells")).select("cells", _gradient(F.col("cells"), total, targets).alias("s")), "steps")
        end = found.select("s.still", "s.moved", "s.residual").first()
        if not end["still"]:
            raise _unsettled(end["moved"], end["residual"])
        rows = found.select(F.explode(F.arrays_zip(F.col("cells.cell").alias("cell"), F.col("s.r").alias("rate"))).alias("x"))
        return rows.select("x.cell", "x.rate", F.lit(max(map(abs, end["residual"]))).alias("residual"))
    history: list[list[float]] = []
    residual = [0.0] * k
    while total:
        at = held.withColumn("s", _steps(F.col("cell"), history))
        now = at.agg(*(F.sum(F.col("s.y") * F.col(f"e{i}")) for i in range(k)), F.sum(F.abs(F.col("s.r") - F.col("s.before")) * F.col("n"))).first()
        residual = [now[i] / total - targets[i] for i in range(k)]
        if len(history) > 1 and now[k] / total < STILL:
            break
        if len(history) == MOST_STEPS:
            raise _unsettled(now[k] / total, residual)
        history.append(residual)
    return materialize(held.select("cell", _steps(F.col("cell"), history)["r"].alias("rate"), F.lit(max(map(abs, residual), default=0.0)).alias("residual")), "rates")


def _with_rates(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Adds rate, residual and copies: the rate rounded up or down by ``draw``."""
    joined = scored.join(F.broadcast(found) if found.count() <= BROADCAST_CELLS else found, "cell")
    drawn = F.pmod("draw", F.lit(1 << 31)) / float(1 << 31)
    return joined.withColumn("copies", (F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("int")).cast("bigint"))


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, posterior array<double>, rate, copies, residual, draw) of every row. ``weights``
    are the target shares of the domains; the tokens in all stay as many as they are. copies is the
    rate rounded up or down by a hash of the document, so that the expected copies are the rate.

    Null and empty texts have no tokens and the rate of their posterior; where no text has a token all
    rates are 1. Null ids are kept. Rows with equal ids and texts get equal rates and copies; other
    columns are not read. Without labelled rows posteriors are equal shares. An empty table gives no
    rows.
    """
    domains = sorted(weights)
    whole = sum(weights.values())
    model = fit_classifier(docs, labelled, domains)
    base = docs.select("doc_id", tokens(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("draw"), posteriors(F.col("text"), model, domains).alias("posterior"))
    scored = materialize(base.withColumn("cell", F.transform("posterior", lambda p: F.round(p * GRID).cast("int"))), "posteriors")
    out = _with_rates(scored, fit_rates(scored, [weights[d] / whole for d in domains]))
    return out.select("doc_id", F.col("n").alias("n_tokens"), "posterior", "rate", "copies", "residual", "draw")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The documents, each as many times as ``rates`` says, all columns, whatever they are called. Texts
    are scored twice, once for the sums and once on their way out, and never shuffled."""
    domains = sorted(weights)
    whole = sum(weights.values())
    model = fit_classifier(docs, labelled, domains)
    row = free_name("row", docs.columns)
    posterior = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), tokens(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("draw"), posteriors(F.col("text"), model, domains).alias("posterior"))
    scored = posterior.withColumn("cell", F.transform("posterior", lambda p: F.round(p * GRID).cast("int")))
    found = fit_rates(scored.select("n", "posterior", "cell"), [weights[d] / whole for d in domains])
    out = _with_rates(scored.select(row, "draw", "cell"), found).where("copies > 0")
    return out.select(row, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(f"{row}.*")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels: high or low quality; others than 0 and 1 are left out."""
    return labels.where("quality in (0, 1)").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))
