"""Metrics of activity logs: paired item events, channels, timing, answers' correctness, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.operators.mining import merged_length

#: Fewest symbols of a repository for each larger number of calls; names of the own tools;
#: commands that count as a search in a shell.
CALLS_FROM_SYMBOLS = {500: 2, 5_000: 3, 20_000: 4}
TOOLS = ("instant_grep", "codebase_query", "repository_context", "symbol_lookup", "code_graph_context", "prechange_impact", "verify_change")
SHELL_SEARCH = r"\b(?:rg|grep|find|fd|sed|awk|git\s+grep)\b"
CHANNELS = ("native", "shell", "reasoning")


def lifecycle(events: DataFrame, *thread: str) -> DataFrame:
    """What each event of an item means, from (thread, item, seq, kind 'started' or 'completed', type, at).

    An item is open after a start and closed after a completion, whatever came before; so one look
    back tells a second start (``duplicate``) and a completion of nothing (``orphan``). A completion
    of an open item is a ``pair`` with the start that opened it, or ``mismatch`` if the types differ,
    or ``invalid`` if a time is missing or it ends before it starts; a start that nothing follows is
    ``unmatched``, another opening start is ``open``. ``left_open`` marks the last start of an item
    that no completion follows, be it a duplicate or not. Events without item, type or kind are left
    out. One shuffle by (thread, item).
    """
    kept = events.where("item is not null and type is not null and kind in ('started', 'completed')")
    order = Window.partitionBy(*thread, "item").orderBy("seq")
    before = F.lag("kind").over(order)
    was_open = F.coalesce(before == "started", F.lit(False))
    marked = kept.withColumns({"was_open": was_open, "left_open": F.lead("kind").over(order).isNull() & (F.col("kind") == "started")})
    opening = F.when((F.col("kind") == "started") & ~F.col("was_open"), F.struct("type", "at"))
    opened = marked.withColumn("opened", F.last(opening, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("opened.at")
    role = (
        F.when((F.col("kind") == "started") & F.col("was_open"), "duplicate")
        .when((F.col("kind") == "started") & F.col("left_open"), "unmatched")
        .when(F.col("kind") == "started", "open")
        .when(~F.col("was_open"), "orphan")
        .when(F.col("opened.type") != F.col("type"), "mismatch")
        .when(start.isNull() | F.col("at").isNull() | (F.col("at") < start), "invalid")
        .otherwise("pair")
    )
    paired = role.isin("pair", "invalid")
    kept_too = [c for c in ("channel",) if c in events.columns]
    return opened.select(*thread, "item", "seq", "type", *kept_too, role.alias("role"), "left_open", F.when(paired, start).alias("start"), F.when(paired, F.col("at")).alias("end"))


def timing(marked: DataFrame, *thread: str) -> DataFrame:
    """One row for each thread of ``lifecycle``'s rows: counts of pairs and of each fault, items of no
    length in the known channels (in all, if rows have no channel), and status ``complete`` or
    ``invalid``. Partial sums go before the shuffle."""
    faults = {"duplicates": "duplicate", "orphans": "orphan", "mismatches": "mismatch", "invalid": "invalid"}
    known = F.col("channel").isNotNull() if "channel" in marked.columns else F.lit(True)
    counts = marked.groupBy(*thread).agg(
        F.count_if(F.col("role").isin("pair", "invalid")).alias("pairs"),
        F.count_if("left_open").alias("unmatched"),
        *(F.count_if(F.col("role") == role).alias(name) for name, role in faults.items()),
        F.count_if((F.col("role") == "pair") & (F.col("start") == F.col("end")) & known).alias("no_length"),
    )
    wrong = F.col("unmatched") + sum((F.col(c) for c in faults), F.lit(0))
    return counts.withColumn("status", F.when(wrong > 0, "invalid").otherwise("complete"))


def channel(kind: Column, names: Column, command: Column) -> Column:
    """native: a tool call by one of the own names; shell: a command that searches; reasoning; else null."""
    return (
        F.when((kind == "toolCall") & F.coalesce(F.arrays_overlap(names, F.array(*(F.lit(t) for t in TOOLS))), F.lit(False)), "native")
        .when((kind == "commandExecution") & F.coalesce(command, F.lit("")).rlike(SHELL_SEARCH), "shell")
        .when(kind == "reasoning", "reasoning")
    )


def latest_turn_of(events: DataFrame, *thread: str) -> DataFrame:
    """The events of each thread's last completed turn; a thread without one keeps no event."""
    last = events.where("kind = 'turn/completed' and turn is not null").groupBy(*thread).agg(F.max_by("turn", "seq").alias("turn"))
    return events.join(last, [*thread, "turn"], "left_semi")


def channel_lengths(pairs: DataFrame, *thread: str) -> DataFrame:
    """One row for each thread of pairs(start, end, channel): the length of the union of each channel's
    intervals and of all of them (0 without any); null for a channel with an interval of no length, and
    then for all."""
    keyed = pairs.where(F.col("channel").isNotNull())
    each = merged_length(keyed.select(*thread, "start", "end", "channel"), *thread, "channel")
    every = merged_length(keyed.select(*thread, "start", "end"), *thread).withColumn("channel", F.lit("classified"))
    flat = keyed.groupBy(*thread, "channel").agg(F.max((F.col("start") == F.col("end")).cast("int")).alias("flat"))
    each = each.join(flat, [*thread, "channel"]).withColumn("total", F.when(F.col("flat") == 0, F.col("total"))).drop("flat")
    whole = flat.groupBy(*thread).agg(F.max("flat").alias("flat"))
    every = every.join(whole, list(thread)).withColumn("total", F.when(F.col("flat") == 0, F.col("total"))).drop("flat")
    rows = each.unionByName(every.select(*thread, "channel", "total"))
    named = rows.groupBy(*thread).pivot("channel", [*CHANNELS, "classified"]).agg(F.first(F.struct("total")))
    return named.select(*thread, F.lit(True).alias("timed"), *(F.when(F.col(c).isNull(), 0).otherwise(F.col(f"{c}.total")).alias(c) for c in (*CHANNELS, "classified")))


def metrics_v4(events: DataFrame, *thread: str, path: str | None = None, terms: list[str] | None = None) -> DataFrame:
    """One row for each thread of events(thread, seq, turn, kind, item, type, names, command, text, at) over
    its last completed turn: counts, faults, status, lengths, and whether the answer is right.

    Status is ``incomplete`` without a completed turn that has a start, ``invalid`` with any fault or a
    turn that ends before it starts or has no times, else ``complete``; lengths are null unless it is."""
    every = events.select(*thread).distinct()
    turn = latest_turn_of(events, *thread)
    items = turn.where("kind in ('item/started', 'item/completed')").select(*thread, "item", "seq", F.regexp_extract("kind", "([a-z]+)$", 1).alias("kind"), "type", "at", channel(F.col("type"), F.col("names"), F.col("command")).alias("channel"))
    marked = lifecycle(items, *thread)
    counts = timing(marked, *thread).drop("status")
    pairs = marked.where("role in ('pair', 'invalid')")
    calls = pairs.groupBy(*thread).agg(F.count_if(F.col("channel") == "native").alias("native_calls"), F.count_if(F.col("channel") == "shell").alias("shell_calls"))
    message = turn.where("kind = 'item/completed' and type = 'agentMessage' and text is not null").groupBy(*thread).agg(F.max_by("text", "seq").alias("answer"))
    times = turn.groupBy(*thread).agg(
        F.min_by(F.struct("at"), F.when(F.col("kind") == "turn/started", F.col("seq"))).alias("began"),
        F.min_by(F.struct("at"), F.when(F.col("kind") == "turn/completed", F.col("seq"))).alias("ended"),
        F.count_if(F.col("kind") == "turn/started").alias("starts"), F.max("turn").alias("turn"),
    )
    lengths = channel_lengths(marked.where("role = 'pair'"), *thread)
    keys = list(thread)
    rows = every.join(times, keys, "left").join(counts, keys, "left").join(calls, keys, "left").join(message, keys, "left").join(lengths, keys, "left")
    faults = ("unmatched", "duplicates", "orphans", "mismatches", "invalid")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pairs", *faults, "no_length", "native_calls", "shell_calls")})
    began, ended = F.col("began.at"), F.col("ended.at")
    wrong = sum((F.col(c) for c in faults), F.lit(0)) > 0
    status = F.when(F.col("turn").isNull() | (F.coalesce("starts", F.lit(0)) == 0), "incomplete").when(wrong | began.isNull() | ended.isNull() | (ended < began), "invalid").otherwise("complete")
    rows = rows.withColumn("status", status)
    complete = F.col("status") == "complete"
    rows = rows.withColumns({f"{c}_ms": F.when(complete, F.when(F.col("timed").isNull(), 0).otherwise(F.col(c))) for c in (*CHANNELS, "classified")})
    right = correct(F.col("answer"), F.lit(path), F.array(*(F.lit(t) for t in terms or []))) if path is not None else F.lit(False)
    return rows.select(
        *thread, "turn", "status", "pairs", *faults, "no_length", "native_calls", "shell_calls", (F.col("native_calls") + F.col("shell_calls")).alias("operations"),
        F.coalesce(F.length("answer") > 0, F.lit(False)).alias("answered"), right.alias("correct"),
        F.when(complete, ended - began).alias("turn_ms"), *(f"{c}_ms" for c in (*CHANNELS, "classified")), F.when(complete, ended - began - F.col("classified_ms")).alias("unaccounted_ms"),
    )


def metrics_v2(events: DataFrame, *thread: str, path: str = "", terms: list[str] | None = None) -> DataFrame:
    """One row for each thread over all its completed items: own calls of any type, searching commands, the
    time from the first turn's start to the last one's end, and whether the last answer is right."""
    done = F.col("kind") == "item/completed"
    own = F.coalesce(F.arrays_overlap("names", F.array(*(F.lit(t) for t in TOOLS))), F.lit(False))
    shell = (F.col("type") == "commandExecution") & F.coalesce("command", F.lit("")).rlike(SHELL_SEARCH)
    spoken = done & (F.col("type") == "agentMessage") & F.col("text").isNotNull()
    rows = events.groupBy(*thread).agg(
        F.count_if(done & own).alias("native_calls"), F.count_if(done & F.coalesce(shell, F.lit(False))).alias("shell_calls"),
        F.min_by("at", F.when(F.col("kind") == "turn/started", F.col("seq"))).alias("_began"), F.max_by("at", F.when(F.col("kind") == "turn/completed", F.col("seq"))).alias("_ended"),
        F.max_by("text", F.when(spoken, F.col("seq"))).alias("_answer"),
    )
    right = correct(F.coalesce("_answer", F.lit("")), F.lit(path), F.array(*(F.lit(t) for t in terms or [])).cast("array<string>"))
    return rows.select(*thread, "native_calls", "shell_calls", (F.col("native_calls") + F.col("shell_calls")).alias("operations"), (F.col("_ended") - F.col("_began")).alias("wall_ms"), F.coalesce(F.length("_answer") > 0, F.lit(False)).alias("answered"), right.alias("correct"))


def correct(answer: Column, path: Column, terms: Column) -> Column:
    """Whether the answer holds the path and every term, in any case of letters; nulls are wrong."""
    text = F.lower(answer)
    return F.coalesce(F.contains(text, F.lower(path)) & F.forall(terms, lambda t: F.contains(text, F.lower(t))), F.lit(False))


def median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., median): the middle value, or the mean of the two middle ones; exact."""
    return df.groupBy(*by).agg(F.expr(f"percentile(`{value}`, 0.5)").alias("median"))


def call_budget(symbols: Column) -> Column:
    budget = F.lit(1)
    for least, calls in CALLS_FROM_SYMBOLS.items():
        budget = F.when(symbols >= least, calls).otherwise(budget)
    return budget


def report_line(*values: Column) -> Column:
    """Values parted by tabs, nulls as n/a."""
    return F.concat_ws("\t", *(F.coalesce(v.cast("string"), F.lit("n/a")) for v in values))


def surface_report(by_surface: DataFrame) -> DataFrame:
    """(surface, report): a line for each surface of ``mining.by_surface``, means with two digits."""
    def fixed(c):
        return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c).cast("double")))

    return by_surface.select("surface", report_line(F.col("surface"), F.col("answers"), F.col("outcomes"), fixed("mean_searches"), F.col("recall_samples"), fixed("mean_recall")).alias("report"))
