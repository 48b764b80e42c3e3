"""Queries over logs and repositories' own facts: metrics of turns, feedback, git logs, inventories, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.operators import context, feedback, metrics, mining
from reposcope.plans.catalog import _OUTCOMES, _outcomes, _t, query
from reposcope.sources import repository

# --- metrics ------------------------------------------------------------------------------------------
#: An event of a user is one of a turn: of a hundredth of the log.
_EVENTS = """ev AS (SELECT user_id AS thread, event_id AS seq, 't' || (event_id // 1000) AS turn, CASE event_type WHEN 'signup' THEN 'turn/started' WHEN 'error' THEN 'turn/completed' WHEN 'click' THEN 'item/started' ELSE 'item/completed' END AS kind,
CASE WHEN event_type = 'view' THEN NULL ELSE 'i' || (k % 3) END AS item, CASE WHEN event_type = 'view' THEN 'agentMessage' WHEN k % 3 = 0 THEN 'toolCall' WHEN k % 3 = 1 THEN 'commandExecution' ELSE 'reasoning' END AS type,
CASE WHEN k % 2 = 0 THEN 'symbol_lookup' ELSE 'other' END AS nm, CASE WHEN k % 4 < 2 THEN 'git  grep x' ELSE 'npm test' END AS command, CASE WHEN event_type = 'view' THEN 'see Path/' || k || ' and Term' END AS text, event_id - event_id % 3 AS ms
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _events(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.selectExpr(
        "user_id as thread", "event_id as seq", "concat('t', event_id div 1000) as turn", "case event_type when 'signup' then 'turn/started' when 'error' then 'turn/completed' when 'click' then 'item/started' else 'item/completed' end as kind",
        "case when event_type = 'view' then null else concat('i', k % 3) end as item", "case when event_type = 'view' then 'agentMessage' when k % 3 = 0 then 'toolCall' when k % 3 = 1 then 'commandExecution' else 'reasoning' end as type",
        "array(case when k % 2 = 0 then 'symbol_lookup' else 'other' end) as names", "case when k % 4 < 2 then 'git  grep x' else 'npm test' end as command", "case when event_type = 'view' then concat('see Path/', k, ' and Term') end as text", "event_id - event_id % 3 as at",
    )


_V4 = """tl AS (SELECT thread, max_by(turn, seq) AS turn FROM ev WHERE kind = 'turn/completed' GROUP BY 1), sel AS (SELECT ev.* FROM ev JOIN tl USING (thread, turn)),
it AS (SELECT thread, item, seq, kind = 'item/started' AS s, type, ms, CASE WHEN type = 'toolCall' AND nm = 'symbol_lookup' THEN 'native' WHEN type = 'commandExecution' AND regexp_matches(command, '\\b(?:rg|grep|find|fd|sed|awk|git\\s+grep)\\b') THEN 'shell' WHEN type = 'reasoning' THEN 'reasoning' END AS ch
FROM sel WHERE kind IN ('item/started', 'item/completed') AND item IS NOT NULL),
n AS (SELECT *, coalesce(lag(s) OVER w, false) AS b, lead(s) OVER w IS NULL AND s AS lo FROM it WINDOW w AS (PARTITION BY thread, item ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN s AND NOT b THEN 1 ELSE 0 END) OVER (PARTITION BY thread, item ORDER BY seq) AS run FROM n),
o AS (SELECT thread, item, run, type AS ot, ms AS oa FROM g WHERE s AND NOT b), j AS (SELECT g.*, ot, oa FROM g LEFT JOIN o USING (thread, item, run)),
l AS (SELECT *, CASE WHEN s AND b THEN 'duplicate' WHEN s AND lo THEN 'unmatched' WHEN s THEN 'open' WHEN NOT b THEN 'orphan' WHEN ot <> type THEN 'mismatch' WHEN ms < oa THEN 'invalid' ELSE 'pair' END AS role FROM j),
c AS (SELECT thread, count(*) FILTER (role IN ('pair', 'invalid')) AS pairs, count(*) FILTER (lo) AS unmatched, count(*) FILTER (role = 'duplicate') AS duplicates, count(*) FILTER (role = 'orphan') AS orphans, count(*) FILTER (role = 'mismatch') AS mismatches,
count(*) FILTER (role = 'invalid') AS invalid, count(*) FILTER (role = 'pair' AND oa = ms AND ch IS NOT NULL) AS no_length, count(*) FILTER (role IN ('pair', 'invalid') AND ch = 'native') AS native_calls, count(*) FILTER (role IN ('pair', 'invalid') AND ch = 'shell') AS shell_calls FROM l GROUP BY thread),
iv AS (SELECT thread, ch, oa AS a, ms AS z FROM l WHERE role = 'pair' AND ch IS NOT NULL UNION ALL SELECT thread, 'classified', oa, ms FROM l WHERE role = 'pair' AND ch IS NOT NULL),
im AS (SELECT *, max(z) OVER (PARTITION BY thread, ch ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv), ig AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY thread, ch ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS q FROM im),
il AS (SELECT thread, ch, q, max(z) - min(a) AS len, max(CASE WHEN a = z THEN 1 ELSE 0 END) AS flat FROM ig GROUP BY 1, 2, 3), ln AS (SELECT thread, ch, CASE WHEN max(flat) = 0 THEN CAST(sum(len) AS BIGINT) END AS total FROM il GROUP BY 1, 2),
lp AS (SELECT thread, max(total) FILTER (ch = 'native') AS native, count(*) FILTER (ch = 'native') AS cn, max(total) FILTER (ch = 'shell') AS shell, count(*) FILTER (ch = 'shell') AS cs, max(total) FILTER (ch = 'reasoning') AS reasoning, count(*) FILTER (ch = 'reasoning') AS cr, max(total) FILTER (ch = 'classified') AS classified FROM ln GROUP BY 1),
tm AS (SELECT thread, min_by(ms, seq) FILTER (kind = 'turn/started') AS began, min_by(ms, seq) FILTER (kind = 'turn/completed') AS ended, count(*) FILTER (kind = 'turn/started') AS starts FROM sel GROUP BY 1),
an AS (SELECT thread, max_by(text, seq) AS answer FROM sel WHERE kind = 'item/completed' AND type = 'agentMessage' AND text IS NOT NULL GROUP BY 1),
a AS (SELECT th.thread, tl.turn, coalesce(pairs, 0) AS pairs, coalesce(unmatched, 0) AS unmatched, coalesce(duplicates, 0) AS duplicates, coalesce(orphans, 0) AS orphans, coalesce(mismatches, 0) AS mismatches, coalesce(invalid, 0) AS invalid, coalesce(no_length, 0) AS no_length, coalesce(native_calls, 0) AS native_calls, coalesce(shell_calls, 0) AS shell_calls,
began, ended, starts, answer, lp.* EXCLUDE thread, lp.thread IS NOT NULL AS timed FROM (SELECT DISTINCT thread FROM ev) th LEFT JOIN tl USING (thread) LEFT JOIN c USING (thread) LEFT JOIN lp USING (thread) LEFT JOIN tm USING (thread) LEFT JOIN an USING (thread)),
st AS (SELECT *, CASE WHEN turn IS NULL OR coalesce(starts, 0) = 0 THEN 'incomplete' WHEN unmatched + duplicates + orphans + mismatches + invalid > 0 OR ended < began THEN 'invalid' ELSE 'complete' END AS status FROM a)
SELECT thread, turn, status, pairs, unmatched, duplicates, orphans, mismatches, invalid, no_length, native_calls, shell_calls, native_calls + shell_calls AS operations, coalesce(length(answer) > 0, false) AS answered,
coalesce(contains(lower(answer), 'path/1') AND contains(lower(answer), 'term'), false) AS correct, CASE WHEN status = 'complete' THEN ended - began END AS turn_ms, CASE WHEN status = 'complete' THEN CASE WHEN NOT timed OR cn = 0 THEN 0 ELSE native END END AS native_ms,
CASE WHEN status = 'complete' THEN CASE WHEN NOT timed OR cs = 0 THEN 0 ELSE shell END END AS shell_ms, CASE WHEN status = 'complete' THEN CASE WHEN NOT timed OR cr = 0 THEN 0 ELSE reasoning END END AS reasoning_ms,
CASE WHEN status = 'complete' THEN CASE WHEN NOT timed THEN 0 ELSE classified END END AS classified_ms, CASE WHEN status = 'complete' THEN ended - began - CASE WHEN NOT timed THEN 0 ELSE classified END END AS unaccounted_ms FROM st"""


@query(f"WITH {_EVENTS}, {_V4}")
def v4_metrics(spark, sf_dir):
    return metrics.metrics_v4(_events(spark, sf_dir), "thread", path="PATH/1", terms=["term"])


@query(f"""WITH {_EVENTS}, m AS (SELECT thread, count(*) FILTER (kind = 'item/completed' AND nm = 'symbol_lookup') AS native_calls, count(*) FILTER (kind = 'item/completed' AND type = 'commandExecution' AND regexp_matches(command, '\\b(?:rg|grep|find|fd|sed|awk|git\\s+grep)\\b')) AS shell_calls,
min_by(ms, seq) FILTER (kind = 'turn/started') AS began, max_by(ms, seq) FILTER (kind = 'turn/completed') AS ended, max_by(text, seq) FILTER (text IS NOT NULL) AS answer FROM ev GROUP BY thread)
SELECT thread, native_calls, shell_calls, native_calls + shell_calls AS operations, ended - began AS wall_ms, coalesce(length(answer) > 0, false) AS answered, coalesce(contains(lower(answer), 'path/') AND contains(lower(answer), 'term'), false) AS correct FROM m""")
def v2_metrics(spark, sf_dir):
    return metrics.metrics_v2(_events(spark, sf_dir), "thread", path="Path/", terms=["TERM"])


# --- feedback -----------------------------------------------------------------------------------------
@query(f"WITH {_OUTCOMES} SELECT (SELECT count(*) FROM a) AS answers, count(*) AS outcomes, round(avg(CASE WHEN changed > 0 THEN hits / changed::DOUBLE END), 6) AS mean_recall FROM o")
def feedback_totals(spark, sf_dir):
    found = _outcomes(spark, sf_dir)
    return feedback.totals(found, found).withColumn("mean_recall", F.round("mean_recall", 6))


_JSON = {
    "click": '{"item":{"type":"commandExecution","command":"rg -n x","path":""}}', "view": '{"item":{"type":"fileChange","changes":[{"path":"a","kind":"x"},{"path":""},{"kind":"y"}],"file":"b"}}',
    "purchase": '{"type":"fileChange","filePath":"c","paths":["d","e"]}', "error": '{"item":{"type":"fileChange","files":["f"]}}', "signup": "not json",
}
_FOUND = {"click": ("commandExecution", "rg -n x", ""), "view": ("fileChange", "", "a,b"), "purchase": ("fileChange", "", "c,d,e"), "error": ("fileChange", "", "f"), "signup": (None, "", "")}


@query("SELECT event_id AS seq, " + ", ".join("CASE event_type " + " ".join(f"WHEN '{k}' THEN {'NULL' if v[i] is None else repr(v[i])}" for k, v in _FOUND.items()) + f" END AS {name}" for i, name in enumerate(("item", "command", "paths"))) + " FROM events")
def feedback_items(spark, sf_dir):
    data = F.lit(None).cast("string")
    for kind, text in _JSON.items():
        data = F.when(F.col("event_type") == kind, text).otherwise(data)
    kind, command, paths = feedback.item(F.col("data"))
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), data.alias("data")).select("seq", kind.alias("item"), command.alias("command"), F.array_join(paths, ",").alias("paths"))


@query("WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') SELECT conv_id || ':' || turn AS answer_id, a.conv_id::VARCHAR AS thread, coalesce(m.seq, 0) AS seq, 'code_graph_context' AS surface, length(a.text) AS tokens_used FROM a LEFT JOIN (SELECT user_id, max(event_id) AS seq FROM events GROUP BY 1) m ON m.user_id = a.conv_id")
def answers_recorded(spark, sf_dir):
    given = _t(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr("concat(conv_id, ':', turn) as answer_id", "cast(conv_id as string) as thread", "text as query", "array() as seeds", "4000 as budget_tokens", "array() as files", "array() as symbols", "length(text) as tokens_used", "0L as answered_at")
    events = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread"), F.col("event_id").alias("seq"))
    return feedback.record_answers(given, events).select("answer_id", "thread", "seq", "surface", F.col("tokens_used").cast("bigint").alias("tokens_used"))


# --- git logs -----------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT DISTINCT l_orderkey AS o, l_orderkey % 5 AS log FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY o) AS n FROM c)
SELECT 'log' || log AS log, lpad(to_hex(o), 8, '0') AS commit, 'src/p' || l_partkey || '.ts' AS file FROM r JOIN lineitem ON l_orderkey = o""")
def git_log(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    log = F.concat(F.lit("log"), (F.col("l_orderkey") % 5).cast("string")).alias("log")
    heads = li.select("l_orderkey").distinct().select(log, (F.col("l_orderkey") * 1000).alias("pos"), F.concat(F.lpad(F.hex("l_orderkey"), 8, "0"), F.lit("\r")).alias("text"))
    names = li.select(log, (F.col("l_orderkey") * 1000 + 1 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("text"))
    blanks = heads.select("log", (F.col("pos") + 900).alias("pos"), F.lit("").alias("text"))
    return repository.parse_git_log(heads.union(names).union(blanks)).select("log", F.upper("commit").alias("commit"), "file")


# --- inventories and scans ------------------------------------------------------------------------------
_STATUS = "CASE WHEN source = 'src3' THEN 'ignored' WHEN source = 'src5' THEN 'excluded' WHEN lang = 'es' THEN 'nonUtf8' WHEN n_chars > 5000 THEN 'tooLarge' ELSE 'indexed' END"


def _inventory(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src5", ".hidden/x.ts").otherwise("src/x.ts").alias("file"), F.col("text").alias("content"), F.when(F.col("lang") == "es", "base64").otherwise("utf8").alias("encoding"), F.col("n_chars").alias("size_bytes"), (F.col("source") == "src3").alias("ig"))
    return repository.collect_sources(d, F.col("ig"), 5000)[1]


_COUNTS = f"s AS (SELECT {_STATUS} AS status FROM documents), c AS (SELECT count(*) AS enumerated, " + ", ".join(f"count(*) FILTER (status = '{k}') AS {n}" for k, n in (("indexed", "indexed"), ("ignored", "ignored"), ("excluded", "excluded"), ("tooLarge", "too_large"), ("nonUtf8", "non_utf8"))) + " FROM s)"


@query(f"WITH {_COUNTS} SELECT 'remote inventory: indexed ' || indexed || '/' || enumerated || ' enumerated; skipped ignored=' || ignored || ', excluded=' || excluded || ', tooLarge=' || too_large || ', nonUtf8=' || non_utf8 || '; host listing truncated, remaining paths unknown' AS line FROM c")
def inventory_text(spark, sf_dir):
    counts = _inventory(spark, sf_dir)
    return counts.select(repository.inventory_text(counts, True).alias("line"))


@query(f"""WITH {_COUNTS} SELECT unnest(['The host''s listing was cut after ' || enumerated || ' paths; of the others nothing is known, so a missing match, symbol or caller proves nothing.',
'The snapshot left out ' || (too_large + non_utf8) || ' readable files (tooLarge=' || too_large || ', nonUtf8=' || non_utf8 || '); a missing match, symbol or caller may be in them.']) AS spot FROM c""")
def inventory_blind_spots(spark, sf_dir):
    return _inventory(spark, sf_dir).select(F.explode(repository.blind_spots(True)).alias("spot"))


_FOLDERS = {"en": "src/", "fr": "node_modules/", "de": ".cache/", "es": "gen[1]/"}
_ENDINGS = "CASE WHEN n_chars % 3 = 0 THEN '.TS' WHEN n_chars % 3 = 1 THEN '.py' ELSE '.txt' END"


@query("""WITH f AS (SELECT lang, """ + _ENDINGS + """ AS e, n_chars FROM documents), s AS (SELECT CASE WHEN lang IN ('fr', 'de') THEN 'skipped' WHEN lang = 'es' THEN CASE WHEN e = '.py' THEN CASE WHEN n_chars > 2000 THEN 'tooLarge' ELSE 'indexed' END ELSE 'ignored' END WHEN e = '.txt' THEN 'unsupported' WHEN n_chars > 2000 THEN 'tooLarge' ELSE 'indexed' END AS status FROM f)
SELECT """ + ", ".join(f"count(*) FILTER (status = '{k}') AS {n}" for k, n in (("indexed", "indexed"), ("skipped", "skipped"), ("ignored", "ignored"), ("unsupported", "unsupported"), ("tooLarge", "too_large"))) + " FROM s")
def scan_counts(spark, sf_dir):
    folder = F.create_map(*(F.lit(x) for kv in _FOLDERS.items() for x in kv))
    d = _t(spark, sf_dir, "documents").select(F.concat(folder[F.col("lang")], F.col("doc_id").cast("string"), F.expr(_ENDINGS)).alias("file"), F.col("n_chars").alias("size_bytes"))
    return repository.scan_counts(repository.classify(d, "# rules\ngen[[]1]/\n!*.py\n", max_bytes=2000))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN '/' || source || '/x' ELSE './' || source || '/x' END AS file FROM documents")
def path_normalise(spark, sf_dir):
    raw = F.when(F.col("lang") == "en", F.concat(F.col("source"), F.lit("\\x"))).when(F.col("lang") == "fr", F.concat(F.lit("./"), "source", F.lit("/x"))).when(F.col("lang") == "de", F.concat(F.lit("/"), "source", F.lit("/x"))).otherwise(F.concat("source", F.lit("/x")))
    return _t(spark, sf_dir, "documents").select("doc_id", repository.normal_path(raw).alias("file"))


# --- repository context ---------------------------------------------------------------------------------
_PACKAGE = '{"name":"x","scripts":{"test":" vitest run ","lint":"  ","typecheck":"tsc","build":"y"}}'


def _repositories(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("repo"), "n_regionkey", "n_name")
    files = F.array(
        F.when(F.col("n_regionkey") != 0, F.struct(F.lit("package.json").alias("file"), F.lit(_PACKAGE).alias("source"))), F.when(F.col("n_regionkey") == 1, F.struct(F.lit("yarn.lock").alias("file"), F.lit("").alias("source"))),
        F.when(F.col("n_regionkey") == 2, F.struct(F.lit("pnpm-lock.yaml").alias("file"), F.lit("").alias("source"))), F.when(F.col("n_regionkey") <= 2, F.struct(F.lit("AGENTS.md").alias("file"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("source"))),
        F.struct(F.lit("README.md").alias("file"), F.col("n_name").alias("source")), F.struct(F.lit(".env").alias("file"), F.lit("SECRET").alias("source")),
    )
    rows = n.select("repo", F.explode(F.array_compact(files)).alias("x")).select("repo", "x.file", "x.source")
    symbols = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("repo"), F.concat(F.lit("src/"), F.col("s_suppkey").cast("string"), F.lit(".tsx")).alias("file"))
    return rows, symbols


_MANAGER = "CASE n_regionkey WHEN 0 THEN 'unknown' WHEN 1 THEN 'yarn' WHEN 2 THEN 'pnpm' ELSE 'npm' END"


@query(f"""SELECT n_nationkey::VARCHAR AS repo, concat_ws('; ', 'repo: ' || {_MANAGER}, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'languages: typescript' END, CASE WHEN n_regionkey <> 0 THEN 'checks: test,typecheck' END, CASE WHEN n_regionkey <= 2 THEN 'rules: AGENTS.md' END, 'overview: README.md') AS summary FROM nation""")
def repository_summary(spark, sf_dir):
    return context.summary(context.repository_context(*_repositories(spark, sf_dir)))


@query("SELECT n_nationkey::VARCHAR AS repo, coalesce(n, 0) AS typescript, CASE WHEN n_regionkey <= 2 THEN n_name ELSE '' END AS rules, n_name AS overview, CASE WHEN n_regionkey <> 0 THEN 'vitest run' ELSE '' END AS test FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def repository_context(spark, sf_dir):
    found = context.repository_context(*_repositories(spark, sf_dir))
    return found.select(
        "repo", F.coalesce(F.try_element_at("languages", F.lit("typescript")), F.lit(0)).cast("bigint").alias("typescript"), F.array_join(F.transform("rules", lambda r: r["content"]), "|").alias("rules"),
        F.array_join(F.transform("overview", lambda r: r["content"]), "|").alias("overview"), F.coalesce(F.try_element_at("scripts", F.lit("test")), F.lit("")).alias("test"),
    )


@query(f"""WITH t AS (SELECT s_nationkey AS k, string_agg(DISTINCT 'tests/' || s_suppkey || '.ts', ' ' ORDER BY 'tests/' || s_suppkey || '.ts') AS tests FROM supplier GROUP BY 1), c AS (SELECT * FROM nation CROSS JOIN (VALUES (0, 'test'), (1, 'typecheck'), (2, 'lint')) AS v(ord, kind) LEFT JOIN t ON k = n_nationkey)
SELECT n_nationkey::VARCHAR AS repo, ord::INT AS ord, kind, CASE WHEN n_regionkey <> 0 AND kind <> 'lint' THEN {_MANAGER} END AS command, CASE WHEN n_regionkey <> 0 AND kind <> 'lint' THEN 'run ' || kind || CASE WHEN kind = 'test' AND tests IS NOT NULL THEN ' -- ' || tests ELSE '' END END AS args FROM c""")
def verification_plan(spark, sf_dir):
    tests = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("repo"), F.concat(F.lit("tests/"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("file"))
    return context.plan_verification(context.repository_context(*_repositories(spark, sf_dir)), tests).withColumn("args", F.array_join("args", " "))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300 - 13) || chr(10) || '…[truncated]' END AS output FROM documents")
def output_truncated(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", context.truncated(F.col("text"), 300).alias("output"))


@query("SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(spark, sf_dir):
    from reposcope.streaming.refresh import windows

    e = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return windows(e, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


@query("SELECT user_id AS thread, event_id AS seq, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events")
def events_after(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"))
    return mining.after(e, e, name="later")
