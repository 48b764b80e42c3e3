"""Registered queries over the star schema and documents, with the DuckDB SQL that gives the same rows.

Embeddings of the engine's relations (SURVEY §7.3): documents are files, orders are commits of parts,
parts are symbols, consecutive order lines are calls, events are the activity log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.functions import text as tx
from reposcope.operators import context, graph, metrics, mining, resolve, retrieval, search
from reposcope.operators.search import Search
from reposcope.shared import tasks_for, written
from reposcope.sources import repository

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    """The modules that register queries beside this one."""
    from reposcope.plans import logs, project  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search -----------------------------------------------------------------------------------------
_FILE = "concat(source, '/', lang, '/', doc_id, '.txt')"
_LINES = f"""files AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file, text AS source FROM documents),
lines AS (SELECT file, unnest(range(1, len(string_split(source, chr(10))) + 1))::INT AS line, unnest(string_split(source, chr(10))) AS text FROM files)"""


def _files(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.expr(_FILE).alias("file"), F.col("text").alias("source"))


def _lines(spark, sf_dir):
    return search.lines(_files(spark, sf_dir))


def _page(where, limit=30, offset=0):
    return f"""WITH {_LINES}, hit AS (SELECT * FROM lines WHERE {where})
SELECT file, line, text, (SELECT count(*) FROM hit) > {offset + limit} AS truncated FROM hit ORDER BY file, line LIMIT {limit} OFFSET {offset}"""


@query(_page("contains(text, 'shea')"))
def grep_content(spark, sf_dir):
    return search.content(_lines(spark, sf_dir), Search("shea", case_sensitive=True))


@query(_page("contains(lower(text), 'shea')", 200))
def grep_pruned(spark, sf_dir):
    from reposcope.operators import ngrams
    from reposcope.shared import Scratch

    s = Search("SheA", limit=200)
    return search.content(ngrams.write(_files(spark, sf_dir), Scratch().path(spark, "blocks")).near(s), s)


@query(_page("regexp_matches(text, 'th(er|in)[a-z]+[.] [A-Z]')"))
def grep_regex(spark, sf_dir):
    return search.content(_lines(spark, sf_dir), Search("th(er|in)[a-z]+[.] [A-Z]", regex=True, case_sensitive=True))


@query(_page(r"regexp_matches(text, '\b(?:en)\b')"))
def grep_word(spark, sf_dir):
    return search.content(_lines(spark, sf_dir), Search("en", case_sensitive=True, word=True))


@query(_page("regexp_matches(text, '(?i)THE A')", 30, 30))
def grep_icase_page2(spark, sf_dir):
    return search.content(_lines(spark, sf_dir), search.next_page(Search("THE A")))


@query(f"""WITH {_LINES}, hit AS (SELECT * FROM lines WHERE contains(text, 'idiot') ORDER BY file, line LIMIT 30)
SELECT h.file, h.line, h.text, coalesce(string_agg(CASE WHEN n.line < h.line THEN n.line || ':' || n.text END, chr(10) ORDER BY n.line), '') AS before_text,
coalesce(string_agg(CASE WHEN n.line > h.line THEN n.line || ':' || n.text END, chr(10) ORDER BY n.line), '') AS after_text
FROM hit h JOIN lines n ON n.file = h.file AND n.line BETWEEN h.line - 2 AND h.line + 1 GROUP BY h.file, h.line, h.text""")
def grep_context(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    page = search.content(rows, Search("idiot", case_sensitive=True)).drop("truncated")
    found = search.with_context(rows, page, 2, 1)

    def flat(c):
        return F.array_join(F.transform(c, lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["text"])), "\n")

    return found.select("file", "line", "text", flat("before").alias("before_text"), flat("after").alias("after_text"))


@query(f"WITH {_LINES}, hit AS (SELECT DISTINCT file FROM lines WHERE contains(text, 'moron')) SELECT file, (SELECT count(*) FROM hit) > 100 AS truncated FROM hit ORDER BY file LIMIT 100")
def grep_files(spark, sf_dir):
    return search.files_with_matches(_lines(spark, sf_dir), Search("moron", case_sensitive=True, limit=100))


@query(f"WITH {_LINES}, hit AS (SELECT file, count(*) AS n FROM lines WHERE contains(text, 'the ') GROUP BY file) SELECT file, n, (SELECT count(*) FROM hit) > 500 AS truncated FROM hit ORDER BY file LIMIT 500")
def grep_count(spark, sf_dir):
    return search.counts(_lines(spark, sf_dir), Search("the ", case_sensitive=True, limit=500))


@query(f"WITH {_LINES} SELECT file, line, text, (SELECT count(*) FROM lines WHERE regexp_matches(file, '^src1/.*[.]txt$') AND contains(text, 'er ')) > 50 AS truncated FROM lines WHERE regexp_matches(file, '^src1/.*[.]txt$') AND contains(text, 'er ') ORDER BY file, line LIMIT 50")
def grep_glob(spark, sf_dir):
    return search.content(_lines(spark, sf_dir), Search("er ", case_sensitive=True, glob="src1/**.txt", limit=50))


@query(f"""WITH {_LINES}, hit AS (
SELECT 0 AS idx, * FROM lines WHERE contains(text, 'scum') UNION ALL SELECT 1, * FROM lines WHERE regexp_matches(text, '(?i)clown') UNION ALL
SELECT 2, * FROM lines WHERE regexp_matches(text, '\\b(?:la)\\b')), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY file, line) AS n FROM hit)
SELECT idx, file, line, text FROM r WHERE n <= CASE idx WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 5 END""".replace("\\\\b", "\\b"))
def grep_batch(spark, sf_dir):
    own = [Search("scum", case_sensitive=True, limit=8), Search("clown", limit=12), Search("la", case_sensitive=True, word=True, limit=5)]
    return search.batch(_lines(spark, sf_dir), own)


@query("""SELECT CASE WHEN source = 'src3' THEN 'ignored' WHEN source IN ('src5') THEN 'excluded' WHEN lang = 'es' THEN 'nonUtf8' WHEN n_chars > 5000 THEN 'tooLarge' ELSE 'indexed' END AS status, count(*) AS n FROM documents GROUP BY 1""")
def inventory_status(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    file = F.when(F.col("source") == "src5", "build/x.ts").otherwise("src/x.ts")
    encoding = F.when(F.col("lang") == "es", "base64").otherwise("utf8")
    return repository.inventory(d.select(repository.remote_status(file, encoding, F.col("n_chars"), F.col("source") == "src3", 5000).alias("status")))


@query("SELECT CASE lang WHEN 'de' THEN 'python' ELSE 'typescript' END AS language, count(DISTINCT source || lang) AS files FROM documents WHERE lang <> 'es' GROUP BY 1")
def language_count(spark, sf_dir):
    ending = F.create_map(F.lit("en"), F.lit(".tsx"), F.lit("fr"), F.lit(".ts"), F.lit("de"), F.lit(".py"), F.lit("es"), F.lit(".txt"))
    return context.languages(_t(spark, sf_dir, "documents").select(F.concat("source", ending[F.col("lang")]).alias("file")))


# --- co-change, completeness, feedback ----------------------------------------------------------------
_COMMITS = """sized AS (SELECT l_orderkey AS c, l_partkey AS f, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
files AS (SELECT DISTINCT c, f, 1 / ln(1 + size) AS e FROM sized WHERE size BETWEEN 2 AND {most}),
pairs AS (SELECT a.f AS file, b.f AS other, sum(a.e) AS score FROM files a JOIN files b ON a.c = b.c AND a.f <> b.f GROUP BY 1, 2)"""


def _commits(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


@query("WITH " + _COMMITS.format(most=30) + " SELECT file, other, round(score, 6) AS score FROM pairs")
def cochange_pairs(spark, sf_dir):
    commits = _commits(spark, sf_dir)
    return mining.cochange(commits, tasks=tasks_for(commits)).withColumn("score", F.round("score", 6))


@query("WITH " + _COMMITS.format(most=30) + " SELECT other, round(sum(score), 6) AS score FROM pairs WHERE file <= 5 AND other > 5 GROUP BY other")
def cochange_seeds(spark, sf_dir):
    seeds = _t(spark, sf_dir, "part").where("p_partkey <= 5").select(F.col("p_partkey").alias("file"))
    return mining.cochange_for_seeds(mining.cochange(_commits(spark, sf_dir)), seeds).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS commits FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 30)")
def cochange_commits(spark, sf_dir):
    return mining.sized_commits(_commits(spark, sf_dir)).agg(F.count_distinct("commit").alias("commits"))


_CHAO = """, u AS (SELECT *, CASE WHEN f2 > 0 THEN f1::DOUBLE * f1 / (2 * f2) ELSE f1::DOUBLE * (f1 - 1) / 2 END AS un,
CASE WHEN f2 > 0 THEN f2 * (pow(f1 / f2::DOUBLE, 4) / 4 + pow(f1 / f2::DOUBLE, 3) + pow(f1 / f2::DOUBLE, 2) / 2) ELSE 0 END AS v FROM f),
c AS (SELECT *, CASE WHEN un > 0 AND v > 0 THEN exp(1.959963984540054 * sqrt(ln(1 + v / (un * un)))) END AS k FROM u)
SELECT {by} observed, f1, f2, round(observed + un, 6) AS estimated, round(CASE WHEN k IS NULL THEN observed ELSE observed + un / k END, 6) AS ci_lower,
round(CASE WHEN k IS NULL THEN observed + un ELSE observed + un * k END, 6) AS ci_upper,
round(CASE WHEN (CASE WHEN k IS NULL THEN observed + un ELSE observed + un * k END) = 0 THEN 1 ELSE least(1, observed / (CASE WHEN k IS NULL THEN observed + un ELSE observed + un * k END)) END, 6) AS completeness,
observed = 0 OR (f2 >= 10 AND un <= 3 * observed) AS reliable FROM c"""
_CAPTURES = "cap AS (SELECT user_id, date_trunc('day', ts) AS d, count(DISTINCT event_type) AS n FROM events GROUP BY 1, 2)"
_ROUNDED = ("estimated", "ci_lower", "ci_upper", "completeness")


def _captures(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count_distinct("event_type").alias("n"))


@query(f"WITH {_CAPTURES}, f AS (SELECT count(*) AS observed, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2 FROM cap)" + _CHAO.format(by=""))
def chao1_global(spark, sf_dir):
    out = mining.chao1(mining.frequencies(_captures(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(f"WITH {_CAPTURES}, f AS (SELECT user_id, count(*) AS observed, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2 FROM cap GROUP BY user_id)" + _CHAO.format(by="user_id,"))
def chao1_by_group(spark, sf_dir):
    out = mining.chao1(mining.frequencies(_captures(spark, sf_dir), "user_id"))
    return out.withColumns({c: F.round(c, 6) for c in _ROUNDED})


_OUTCOMES = """ev AS (SELECT user_id AS thread, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k FROM events),
a AS (SELECT thread, seq, 's' || (k % 3) AS surface, k FROM ev WHERE event_type = 'view'),
o AS (SELECT a.thread, a.seq AS answer_seq, a.surface, a.k, count(*) FILTER (e.event_type = 'click' AND e.seq > a.seq) AS searches_after,
count(DISTINCT CASE WHEN e.event_type = 'purchase' AND e.seq > a.seq THEN e.k END) AS changed,
count(DISTINCT CASE WHEN e.event_type = 'purchase' AND e.seq > a.seq AND e.k IN (a.k, (a.k + 1) % 10) THEN e.k END) AS hits
FROM a JOIN ev e ON e.thread = a.thread GROUP BY 1, 2, 3, 4)"""


def _outcomes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), "event_type", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("k"))
    answers = e.where("event_type = 'view'").select("thread", "seq", F.concat(F.lit("s"), (F.col("k") % 3).cast("string")).alias("surface"), F.array("k", (F.col("k") + 1) % 10).alias("files"))
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "change").otherwise("other")
    return mining.outcomes(answers, e.select("thread", "seq", kind.alias("kind"), F.col("k").alias("value")))


@query(f"WITH {_OUTCOMES} SELECT thread, answer_seq, surface, searches_after, changed AS n_changed, hits AS n_hit, round(CASE WHEN changed > 0 THEN hits / changed::DOUBLE END, 6) AS recall FROM o")
def feedback_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("thread", "answer_seq", "surface", "searches_after", F.size("changed").cast("bigint").alias("n_changed"), F.size("hit").cast("bigint").alias("n_hit"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_OUTCOMES}, r AS (SELECT *, CASE WHEN changed > 0 THEN hits / changed::DOUBLE END AS recall FROM o) SELECT surface, count(*) AS answers, count(searches_after) AS outcomes, round(avg(searches_after), 6) AS mean_searches, count(recall) AS recall_samples, round(avg(recall), 6) AS mean_recall FROM r GROUP BY surface")
def feedback_by_surface(spark, sf_dir):
    return mining.by_surface(_outcomes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_searches", "mean_recall")})


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents")
def hash_content(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", mining.content_hash(F.col("text")).alias("hash"))


def _stored_current(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), mining.content_hash(F.col("text")).alias("hash"))
    stored = d.where("file % 7 <> 0").withColumn("hash", F.when(F.col("file") % 5 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return stored, d.where("file % 11 <> 0")


_FRESH = """SELECT doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS status FROM documents
WHERE (doc_id % 7 = 0 AND doc_id % 11 <> 0) OR (doc_id % 7 <> 0 AND doc_id % 11 = 0) OR (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 = 0)"""


@query(_FRESH)
def freshness(spark, sf_dir):
    return mining.freshness(*_stored_current(spark, sf_dir))


@query(f"WITH f AS ({_FRESH}) SELECT count(*) FILTER (status = 'changed') || ' changed, ' || count(*) FILTER (status = 'added') || ' added, ' || count(*) FILTER (status = 'removed') || ' removed' AS note FROM f")
def staleness_note(spark, sf_dir):
    return mining.staleness_note(mining.freshness(*_stored_current(spark, sf_dir)))


@query("""SELECT doc_id AS file, substr(sha256(text), 1, 32) AS hash FROM documents WHERE doc_id % 11 <> 0""")
def incremental_merge(spark, sf_dir):
    stored, current = _stored_current(spark, sf_dir)
    return mining.merge_incremental(stored, current, mining.freshness(stored, current))


@query("""WITH c AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'rg -n k src' WHEN 'view' THEN 'npm test' WHEN 'error' THEN 'cd /r && grep -r k .' ELSE 'echo ripgrepping' END AS command FROM events)
SELECT event_type, regexp_matches(command, '(^|[\\s|;&(])(rg|grep|ag|ack|fd|find)\\s') AS is_search, count(*) AS n FROM c GROUP BY 1, 2""")
def looks_like_search(spark, sf_dir):
    command = F.when(F.col("event_type") == "click", "rg -n k src").when(F.col("event_type") == "view", "npm test").when(F.col("event_type") == "error", "cd /r && grep -r k .").otherwise("echo ripgrepping")
    return _t(spark, sf_dir, "events").groupBy("event_type", mining.looks_like_search(command).alias("is_search")).agg(F.count("*").alias("n"))


_INTERVALS = """iv AS (SELECT user_id, event_id AS s, event_id + 50 + (user_id % 7) * 40 AS e FROM events WHERE event_type = 'click')"""


@query(f"""WITH {_INTERVALS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
i AS (SELECT user_id, g, max(e) - min(s) AS len FROM n GROUP BY 1, 2) SELECT user_id, CAST(sum(len) AS BIGINT) AS total FROM i GROUP BY user_id""")
def interval_union(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("event_type = 'click'")
    iv = e.select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 50 + (F.col("user_id") % 7) * 40).alias("end"))
    return mining.merged_length(iv, "user_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, text FROM r WHERE n = 1")
def latest_turn(spark, sf_dir):
    return search.latest_per(_t(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "turn", "turn", "text")


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_value(spark, sf_dir):
    return metrics.median(_t(spark, sf_dir, "events"), "value", "event_type").withColumn("median", F.round("median", 6))


_LIFE = """e AS (SELECT user_id AS thread, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS item, event_id AS seq, event_type = 'click' AS s,
CASE WHEN value < 30 THEN 'tool' ELSE 'shell' END AS type, event_id - event_id % 7 AS moment FROM events WHERE event_type IN ('click', 'purchase')),
n AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w IS NULL AND s AS left_open FROM e WINDOW w AS (PARTITION BY thread, item ORDER BY seq)),
g AS (SELECT *, sum(CASE WHEN s AND NOT coalesce(b, false) THEN 1 ELSE 0 END) OVER (PARTITION BY thread, item ORDER BY seq) AS run FROM n),
o AS (SELECT thread, item, run, type AS o_type, moment AS o_at FROM g WHERE s AND NOT coalesce(b, false)),
j AS (SELECT g.*, o.o_type, o.o_at FROM g LEFT JOIN o USING (thread, item, run)),
life AS (SELECT thread, item, seq, type, left_open, CASE WHEN s AND b THEN 'duplicate' WHEN s AND left_open THEN 'unmatched' WHEN s THEN 'open' WHEN NOT coalesce(b, false) THEN 'orphan'
WHEN o_type <> type THEN 'mismatch' WHEN moment < o_at THEN 'invalid' ELSE 'pair' END AS role, o_at, moment FROM j)"""


def _lifecycle(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    log = e.select(
        F.col("user_id").alias("thread"), (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("item"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "started").otherwise("completed").alias("kind"),
        F.when(F.col("value") < 30, "tool").otherwise("shell").alias("type"), (F.col("event_id") - F.col("event_id") % 7).alias("at"),
    )
    return metrics.lifecycle(log, "thread")


@query(f"WITH {_LIFE} SELECT thread, item, seq, type, role, left_open, CASE WHEN role IN ('pair', 'invalid') THEN o_at END AS start, CASE WHEN role IN ('pair', 'invalid') THEN moment END AS \"end\" FROM life")
def lifecycle_pairs(spark, sf_dir):
    return _lifecycle(spark, sf_dir)


@query(f"""WITH {_LIFE}, c AS (SELECT thread, count(*) FILTER (role IN ('pair', 'invalid')) AS pairs, count(*) FILTER (left_open) AS unmatched, count(*) FILTER (role = 'duplicate') AS duplicates,
count(*) FILTER (role = 'orphan') AS orphans, count(*) FILTER (role = 'mismatch') AS mismatches, count(*) FILTER (role = 'invalid') AS invalid, count(*) FILTER (role = 'pair' AND o_at = moment) AS no_length FROM life GROUP BY thread)
SELECT *, CASE WHEN unmatched + duplicates + orphans + mismatches + invalid > 0 THEN 'invalid' ELSE 'complete' END AS status FROM c""")
def thread_timing(spark, sf_dir):
    return metrics.timing(_lifecycle(spark, sf_dir), "thread")


@query("SELECT doc_id, coalesce(contains(lower(text), 'the') AND contains(lower(text), 'shea'), false) AS correct FROM documents")
def answer_correct(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", metrics.correct(F.col("text"), F.lit("The"), F.array(F.lit("SHEA"))).alias("correct"))


@query("SELECT c_custkey, n, CAST(CASE WHEN n >= 20000 THEN 4 WHEN n >= 5000 THEN 3 WHEN n >= 500 THEN 2 ELSE 1 END AS INTEGER) AS calls FROM (SELECT c_custkey, c_custkey * 17 AS n FROM customer)")
def call_budget(spark, sf_dir):
    n = (F.col("c_custkey") * 17).cast("bigint")
    return _t(spark, sf_dir, "customer").select("c_custkey", n.alias("n"), metrics.call_budget(n).alias("calls"))


@query(f"""WITH {_OUTCOMES}, r AS (SELECT *, CASE WHEN changed > 0 THEN hits / changed::DOUBLE END AS recall FROM o)
SELECT surface, surface || chr(9) || count(*) || chr(9) || count(searches_after) || chr(9) || printf('%.2f', avg(searches_after)) || chr(9) || count(recall) || chr(9) || coalesce(printf('%.2f', avg(recall)), 'n/a') AS report FROM r GROUP BY surface""")
def feedback_report(spark, sf_dir):
    return metrics.surface_report(mining.by_surface(_outcomes(spark, sf_dir)))


# --- graph ------------------------------------------------------------------------------------------
_GRAPH = """e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2),
adj AS (SELECT src, dst, sum(weight) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2),
deg AS (SELECT src AS node, sum(w) AS degree FROM adj GROUP BY 1), p AS (SELECT a.src, a.dst, a.w / d.degree AS p FROM adj a JOIN deg d ON d.node = a.src)"""


def _edges(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return li.select(s.alias("src"), p.alias("dst"), F.lit(1.0).alias("weight"))  # parallels are summed up once, by adjacency


def _adjacency(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.adjacency(edges, tasks_for(edges))


@query(f"WITH {_GRAPH} SELECT src, dst, w FROM adj")
def adjacency(spark, sf_dir):
    return _adjacency(spark, sf_dir)


@query(f"WITH {_GRAPH} SELECT node, degree FROM deg")
def degrees(spark, sf_dir):
    return graph.degrees(_adjacency(spark, sf_dir))


_STEP = "x{k} AS (SELECT dst AS node, sum(x * p) AS x FROM x{j} JOIN p ON p.src = x{j}.node GROUP BY 1)"


@query(f"WITH {_GRAPH}, x0 AS (SELECT 'S1' AS node, 1.0::DOUBLE AS x), {_STEP.format(k=1, j=0)} SELECT node, round(x, 9) AS x FROM x1")
def matvec(spark, sf_dir):
    seed = spark.createDataFrame([("S1", 1.0)], "node string, x double")
    steps = graph.transition(_adjacency(spark, sf_dir))
    return graph.spread(seed, steps).withColumn("x", F.round("x", 9))


_COEF = graph.coefficients(1.0, 1e-6)


@query(f"WITH {_GRAPH}, x0 AS (SELECT 'S1' AS node, 1.0::DOUBLE AS x), " + ", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, len(_COEF))) + ", u AS (" + " UNION ALL ".join(f"SELECT node, x * {c!r} AS m FROM x{k}" for k, c in enumerate(_COEF)) + "), g AS (SELECT node, sum(m) AS mass FROM u GROUP BY 1) SELECT g.node, round(mass, 9) AS mass, round(mass / sqrt(degree), 9) AS relevance FROM g JOIN deg USING (node)")
def diffuse_t1(spark, sf_dir):
    seed = spark.createDataFrame([("S1", 1.0)], "node string, x double")
    edges = _edges(spark, sf_dir)
    out = graph.diffuse(graph.laid_out(edges, tasks=tasks_for(edges)), seed, 1.0, 1e-6)
    return out.select("node", F.round("mass", 9).alias("mass"), F.round("relevance", 9).alias("relevance"))


# --- resolution -------------------------------------------------------------------------------------
_SYMBOLS = """sym AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 'method' ELSE 'function' END AS kind, p_type AS container, p_brand AS file FROM part),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos FROM lineitem),
calls AS (SELECT a.l_orderkey * 100 + a.pos AS call, a.l_partkey AS caller, s.file AS caller_file, t.name || CASE WHEN (a.l_orderkey + a.pos) % 9 = 0 THEN '_x' ELSE '' END AS name,
CASE WHEN a.pos % 2 = 0 THEN 'r' || t.id END AS receiver, CASE WHEN a.l_orderkey % 30 = 0 THEN t.container ELSE 'none' END AS rtype
FROM li a JOIN li b ON b.l_orderkey = a.l_orderkey AND b.pos = a.pos + 1 JOIN sym s ON s.id = a.l_partkey JOIN sym t ON t.id = b.l_partkey),
imports AS (SELECT DISTINCT file, name AS local, 'Brand#' || (CAST(substr(file, 7) AS INT) % 25 + 1) AS target FROM (SELECT caller_file AS file, name FROM calls)),
types AS (SELECT caller_file AS file, receiver AS name, max_by(rtype, call) AS type FROM calls WHERE receiver IS NOT NULL GROUP BY 1, 2),
cand AS (SELECT c.*, i.target, t.type, s.id, s.kind, s.container, s.file AS sfile FROM calls c LEFT JOIN imports i ON i.file = c.caller_file AND i.local = c.name LEFT JOIN types t ON t.file = c.caller_file AND t.name = c.receiver LEFT JOIN sym s ON s.name = c.name),
prop AS (SELECT call, caller, receiver, count(id) AS candidates,
CASE WHEN count(*) FILTER (sfile = target) = 1 THEN max(id) FILTER (sfile = target) END AS im,
CASE WHEN count(*) FILTER (sfile = caller_file) = 1 THEN max(id) FILTER (sfile = caller_file) END AS sf,
CASE WHEN count(*) FILTER (container = type AND kind = 'method') = 1 THEN max(id) FILTER (container = type AND kind = 'method') END AS tr,
CASE WHEN count(id) = 1 AND NOT (receiver IS NOT NULL AND max(kind) = 'method') THEN max(id) END AS un,
CASE WHEN count(id) = 1 AND receiver IS NOT NULL AND max(kind) = 'method' THEN max(id) END AS um FROM cand GROUP BY call, caller, receiver),
res AS (SELECT call, caller, coalesce(im, sf, tr, un, um) AS callee, CASE WHEN im IS NOT NULL THEN 'importMap' WHEN sf IS NOT NULL THEN 'sameFile' WHEN tr IS NOT NULL THEN 'typedReceiver' WHEN un IS NOT NULL THEN 'uniqueName' WHEN um IS NOT NULL THEN 'uniqueMethod' END AS strategy,
CASE WHEN candidates = 0 THEN 'unknown' WHEN coalesce(im, sf, tr, un, um) IS NULL THEN 'ambiguous' WHEN coalesce(im, sf, tr, un, um) = caller THEN 'self' ELSE 'resolved' END AS status FROM prop)"""
_IMPORTED = "SELECT a.id AS src, b.id AS dst, 0.2::DOUBLE AS weight, 'importEdge' AS strategy FROM imports i JOIN sym b ON b.name = i.local AND b.file = i.target JOIN sym a ON a.file = i.file WHERE a.id <> b.id"
_EDGES = "edges AS (SELECT caller AS src, callee AS dst, CASE strategy WHEN 'importMap' THEN 0.95 WHEN 'sameFile' THEN 0.9 WHEN 'typedReceiver' THEN 0.85 WHEN 'uniqueName' THEN 0.75 ELSE 0.55 END::DOUBLE AS weight, strategy FROM res WHERE status = 'resolved')"


def _symbols(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.expr("concat(replace(p_name, ' ', '_'), '_', p_size)").alias("name"), F.expr("case when p_size % 2 = 0 then 'method' else 'function' end").alias("kind"), F.col("p_type").alias("container"), F.col("p_brand").alias("file"))


def _calls(spark, sf_dir, symbols):
    """Calls with their receivers' types."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee")).where("callee is not null")
    own = symbols.select(F.col("id").alias("caller"), F.col("file").alias("caller_file"))
    other = symbols.select(F.col("id").alias("callee"), F.col("name").alias("_n"), F.col("container").alias("_c"))
    return li.join(own, "caller").join(other, "callee").selectExpr("l_orderkey * 100 + pos as call", "caller", "caller_file", "concat(_n, case when (l_orderkey + pos) % 9 = 0 then '_x' else '' end) as name", "case when pos % 2 = 0 then concat('r', callee) end as receiver", "case when l_orderkey % 30 = 0 then _c else 'none' end as rtype")


def _code(spark, sf_dir, once=False):
    """Symbols, calls, imports and types. With ``once`` the calls, which imports and types are made of as well, are
    written and read by all three, and so are the imports."""
    symbols = _symbols(spark, sf_dir)
    rows = _calls(spark, sf_dir, symbols)
    rows = written(rows, "calls") if once else rows
    imports = rows.selectExpr("caller_file as file", "name as local", "concat('Brand#', cast(substr(caller_file, 7) as int) % 25 + 1) as target", "0 as ord").distinct()
    imports = written(imports, "imports") if once else imports
    types = rows.where("receiver is not null").selectExpr("caller_file as file", "receiver as name", "rtype as type", "call as ord")
    return symbols, rows.drop("rtype"), imports, types


def _proposed(spark, sf_dir, code=None):
    symbols, calls, imports, types = code or _code(spark, sf_dir, once=True)
    return resolve.proposals(calls, symbols, imports, types)


@query(f"WITH {_SYMBOLS}, {_EDGES} SELECT src, dst, weight, strategy FROM edges")
def resolve_edges(spark, sf_dir, code=None):
    return resolve.call_edges(resolve.resolve(_proposed(spark, sf_dir, code)))


@query(f"WITH {_SYMBOLS} SELECT CASE WHEN status = 'resolved' THEN strategy ELSE status END AS what, count(*) AS n FROM res GROUP BY 1 UNION ALL SELECT 'importEdge', count(*) FROM ({_IMPORTED})")
def resolve_stats(spark, sf_dir):
    code = symbols, _, imports, _ = _code(spark, sf_dir, once=True)
    return resolve.stats(resolve.resolve(_proposed(spark, sf_dir, code)), counted=resolve.import_edge_count(imports, symbols))


@query(f"WITH {_SYMBOLS}, u AS (SELECT caller, 1 AS s, im AS dst FROM prop UNION ALL SELECT caller, 2, sf FROM prop UNION ALL SELECT caller, 3, tr FROM prop UNION ALL SELECT caller, 4, un FROM prop UNION ALL SELECT caller, 5, um FROM prop) SELECT caller AS src, dst, count(DISTINCT s) AS n FROM u WHERE dst IS NOT NULL AND dst <> caller GROUP BY 1, 2")
def captures(spark, sf_dir):
    return resolve.captures(_proposed(spark, sf_dir))


@query(f"WITH {_SYMBOLS} {_IMPORTED}")
def import_edges(spark, sf_dir):
    symbols, _, imports, _ = _code(spark, sf_dir)
    return resolve.import_edges(imports, symbols)


@query(f"WITH {_SYMBOLS} SELECT DISTINCT i.file, b.id AS symbol FROM imports i JOIN sym b ON b.name = i.local AND b.file = i.target")
def file_imports(spark, sf_dir):
    symbols, _, imports, _ = _code(spark, sf_dir)
    return resolve.file_imports(imports, symbols)


@query("""WITH m AS (SELECT p_partkey AS id, p_brand AS c, p_size AS n FROM part), one AS (SELECT c, n, max(id) AS id FROM m GROUP BY 1, 2 HAVING count(*) = 1)
SELECT m.id AS subtype, one.id AS supertype FROM m JOIN one ON one.n = m.n AND one.c = 'Brand#' || (CAST(substr(m.c, 7) AS INT) % 25 + 1)""")
def overrides(spark, sf_dir):
    methods = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("container"), F.col("p_size").alias("name"))
    extends = methods.select(F.col("container").alias("sub")).distinct().select("sub", F.expr("concat('Brand#', cast(substr(sub, 7) as int) % 25 + 1)").alias("super"))
    return resolve.overrides(methods, extends)


# --- resolution after an edit -------------------------------------------------------------------------
#: Modules of twenty parts. One in five was edited (its symbols had other names and ids), one in seven is new, and
#: for each tenth there was one more that is gone; imports lead to the next module.
_MODULE = "('m' || (p_partkey // 20))"
_MODULES = _SYMBOLS.replace("p_brand AS file", f"{_MODULE} AS file").replace("'Brand#' || (CAST(substr(file, 7) AS INT) % 25 + 1)", "'m' || (CAST(substr(file, 2) AS INT) + 1)")
_MODULE_IMPORTED = "SELECT a.id AS src, b.id AS dst, 0.2::DOUBLE AS weight, 'importEdge' AS strategy FROM imports i JOIN sym b ON b.name = i.local AND b.file = i.target JOIN sym a ON a.file = i.file WHERE a.id <> b.id"


def _edited(spark, sf_dir):
    """The state before an edit brought up to date: what was then is made from the tables, with other symbols and
    calls in the modules that were edited."""
    from reposcope.operators import incremental

    symbols = _symbols(spark, sf_dir)
    module = F.concat(F.lit("m"), F.floor(F.col("id") / 20).cast("string"))
    at = F.concat(F.lit("m"), F.floor(F.col("caller") / 20).cast("string"))
    typed = written(_calls(spark, sf_dir, symbols).withColumn("caller_file", at), "calls")  # what follows is made of them
    symbols, calls = written(symbols.withColumn("file", module), "symbols"), typed.drop("rtype")
    imports = calls.select(F.col("caller_file").alias("file"), F.col("name").alias("local")).distinct().withColumn("target", F.concat(F.lit("m"), (F.substring("file", 2, 20).cast("int") + 1).cast("string"))).withColumn("ord", F.lit(0))
    types = typed.where("receiver is not null").select(F.col("caller_file").alias("file"), F.col("receiver").alias("name"), F.col("rtype").alias("type"), F.col("call").alias("ord"))
    now = {"symbols": symbols, "calls": calls, "imports": written(imports, "imports"), "types": types}
    number = {n: F.substring(c, 2, 20).try_cast("int") for n, c in (("symbols", "file"), ("calls", "caller_file"), ("imports", "file"), ("types", "file"))}
    edited, added = {n: c % 5 == 0 for n, c in number.items()}, {n: c % 7 == 0 for n, c in number.items()}
    then = {n: df.where(~added[n]) for n, df in now.items()}
    then["symbols"] = then["symbols"].withColumn("name", F.when(edited["symbols"], F.concat("name", F.lit("_v0"))).otherwise(F.col("name"))).withColumn("id", F.when(edited["symbols"], F.col("id") + 10**9).otherwise(F.col("id")))
    then["calls"] = then["calls"].withColumn("caller", F.when(edited["calls"], F.col("caller") + 10**9).otherwise(F.col("caller")))
    gone = {"symbols": now["symbols"].where(number["symbols"] % 10 == 0).withColumn("id", F.col("id") + 2 * 10**9).withColumn("file", F.concat("file", F.lit("_gone"))), "calls": now["calls"].where(number["calls"] % 10 == 0).withColumn("call", F.col("call") + 10**12).withColumn("caller", F.col("caller") + 2 * 10**9).withColumn("caller_file", F.concat("caller_file", F.lit("_gone")))}
    then |= {n: then[n].unionByName(df) for n, df in gone.items()}
    state = incremental.build(**then, keep=True, base=False)  # then is now, read from tables, with other names and ids
    changed = now["symbols"].where(edited["symbols"] | added["symbols"]).select("file").union(now["calls"].where(edited["calls"] | added["calls"]).select("caller_file")).union(gone["symbols"].select("file"))
    fresh = {n: df.where(edited[n] | added[n]) for n, df in now.items()}
    return incremental.update(state, changed, fresh)


@query(f"WITH {_MODULES}, {_EDGES} SELECT src, dst, weight, strategy FROM edges UNION ALL {_MODULE_IMPORTED}")
def incremental_edges(spark, sf_dir):
    return _edited(spark, sf_dir).edges()


@query(f"WITH {_MODULES}, u AS (SELECT caller, 1 AS s, im AS dst FROM prop UNION ALL SELECT caller, 2, sf FROM prop UNION ALL SELECT caller, 3, tr FROM prop UNION ALL SELECT caller, 4, un FROM prop UNION ALL SELECT caller, 5, um FROM prop) SELECT caller AS src, dst, count(DISTINCT s) AS n FROM u WHERE dst IS NOT NULL AND dst <> caller GROUP BY 1, 2")
def incremental_captures(spark, sf_dir):
    return _edited(spark, sf_dir).captures()


@query(f"WITH {_MODULES} SELECT CASE WHEN status = 'resolved' THEN strategy ELSE status END AS what, count(*) AS n FROM res GROUP BY 1 UNION ALL SELECT 'importEdge', count(*) AS n FROM ({_MODULE_IMPORTED}) HAVING count(*) > 0")
def incremental_stats(spark, sf_dir):
    return _edited(spark, sf_dir).stats


# --- spans ----------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT l_orderkey AS hit, 'f' || (l_suppkey % 4) AS file, l_orderkey % 20000 AS line FROM lineitem), s AS (SELECT o_orderkey AS id, 'f' || (o_custkey % 4) AS file, o_orderkey % 20000 AS first, o_orderkey % 20000 + CAST(floor(o_totalprice / 100000) AS BIGINT) AS last FROM orders)
SELECT hit, id, count(*) AS n FROM p JOIN s ON s.file = p.file AND p.line - 1 BETWEEN s.first AND s.last GROUP BY 1, 2""")
def lines_in_spans(spark, sf_dir):
    from reposcope.operators import spans

    points = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hit"), F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")).alias("file"), (F.col("l_orderkey") % 20000).alias("line"))
    o = _t(spark, sf_dir, "orders")
    own = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), (F.col("o_custkey") % 4).cast("string")).alias("file"), (F.col("o_orderkey") % 20000).alias("start"), (F.col("o_orderkey") % 20000 + F.floor(F.col("o_totalprice") / 100000)).alias("end"))
    return spans.pair_counts(points, own, single=True, tasks=tasks_for(points))  # the line is the order's key modulo 20,000


# --- trace, impact, retrieval -------------------------------------------------------------------------
@query(f"""WITH {_SYMBOLS}, {_EDGES}, r AS (SELECT DISTINCT src AS node, 'callee' AS relation, dst AS other, strategy AS via FROM edges UNION SELECT DISTINCT dst, 'caller', src, strategy FROM edges),
k AS (SELECT *, row_number() OVER (PARTITION BY node, relation ORDER BY other, via) AS n FROM r) SELECT node, relation, other, via FROM k WHERE n <= 12""")
def trace_onehop(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return retrieval.one_hop(resolve_edges(spark, sf_dir), nodes)


@query(f"WITH {_SYMBOLS}, {_EDGES} SELECT e.src AS caller, s.file, string_agg(DISTINCT e.dst::VARCHAR, ',' ORDER BY e.dst::VARCHAR) AS targets, string_agg(DISTINCT e.strategy, ',' ORDER BY e.strategy) AS via FROM edges e JOIN sym s ON s.id = e.src GROUP BY 1, 2")
def impact_callers(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    found = retrieval.direct_callers(resolve_edges(spark, sf_dir), symbols, symbols)
    return found.select("caller", "file", F.array_join(F.array_sort(F.col("targets").cast("array<string>")), ",").alias("targets"), F.array_join("via", ",").alias("via"))


_PATHED = "path AS (SELECT id, CASE WHEN file IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'tests/' || file || '.ts' ELSE file END AS file FROM sym)"


@query(f"""WITH {_SYMBOLS}, {_EDGES}, {_PATHED}, c AS (SELECT e.src::BIGINT AS caller, e.dst AS id, p.file FROM edges e JOIN path p ON p.id = e.src),
ft AS (SELECT 'tests/' || i.file || '.ts' AS file, b.id FROM imports i JOIN sym b ON b.name = i.local AND b.file = i.target WHERE i.file IN ('Brand#1', 'Brand#2', 'Brand#3')),
u AS (SELECT caller, id, file FROM c UNION ALL SELECT NULL, id, file FROM ft)
SELECT id, count(DISTINCT caller) AS callers, count(DISTINCT CASE WHEN NOT starts_with(file, 'tests/') THEN file END) AS caller_files, count(DISTINCT CASE WHEN starts_with(file, 'tests/') THEN file END) AS test_files FROM u GROUP BY id HAVING count(DISTINCT caller) > 0""")
def blast_radius(spark, sf_dir):
    code = symbols, _, imports, _ = _code(spark, sf_dir, once=True)
    moved = F.when(F.col("file").isin("Brand#1", "Brand#2", "Brand#3"), F.concat(F.lit("tests/"), F.col("file"), F.lit(".ts"))).otherwise(F.col("file"))
    imported = resolve.file_imports(imports, symbols).withColumn("file", moved)
    return retrieval.blast_radius(resolve_edges(spark, sf_dir, code), symbols.withColumn("file", moved), imported).select("id", "callers", "caller_files", "test_files")


@query(f"WITH {_SYMBOLS}, {_EDGES} SELECT src, dst, weight, strategy FROM edges e WHERE src <> dst AND src IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') AND dst IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')")
def result_edges(spark, sf_dir):
    ids = _t(spark, sf_dir, "part").where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id"))
    return retrieval.edges_among(resolve_edges(spark, sf_dir), ids)


@query(f"""WITH {_SYMBOLS}, t AS (SELECT '7' AS target UNION SELECT 'Brand#4' UNION SELECT 'absent' UNION SELECT min(name) FROM sym UNION SELECT name FROM (SELECT name FROM sym GROUP BY name HAVING count(*) = 1 ORDER BY name LIMIT 1)),
f AS (SELECT target, 1 AS r, id FROM t JOIN sym ON target = id::VARCHAR UNION ALL SELECT target, 2, id FROM t JOIN sym ON target = file UNION ALL SELECT target, 3, id FROM t JOIN sym ON target = name),
b AS (SELECT *, min(r) OVER (PARTITION BY target) AS m FROM f), c AS (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM b WHERE r = m),
d AS (SELECT DISTINCT target, CASE WHEN r = 3 AND n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN r = 3 AND n > 1 THEN NULL ELSE id END AS id FROM c)
SELECT DISTINCT t.target, coalesce(d.status, 'unresolved') AS status, d.id FROM t LEFT JOIN d USING (target)""")
def target_resolution(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    fixed = spark.createDataFrame([("7",), ("Brand#4",), ("absent",)], "target string")
    least = symbols.agg(F.min("name").alias("target"))
    single = symbols.groupBy("name").count().where("count = 1").orderBy("name").limit(1).select("name")
    return retrieval.resolve_targets(fixed.union(least).union(single).distinct(), symbols)


_TERMS = r"""tok AS (SELECT doc_id AS id, unnest(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')) AS term FROM documents),
terms AS (SELECT id, term, count(*) AS tf FROM tok WHERE length(term) >= 3 GROUP BY 1, 2), nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, count(*) AS df, ln((SELECT n FROM nd) / count(*)) AS idf FROM terms GROUP BY term HAVING count(*) <= 0.15 * (SELECT n FROM nd))"""


def _terms(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return retrieval.term_table(d, "doc_id", "text"), d.count()


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_terms(spark, sf_dir):
    terms, n = _terms(spark, sf_dir)
    return retrieval.idf_table(terms, n).withColumn("idf", F.round("idf", 6))


_QUESTION = ["idiot", "clown", "moron", "trash", "the"]
_ASKED = f"term IN ({', '.join(repr(t) for t in _QUESTION)})"
_SCORES = f"""nrm AS (SELECT id, sqrt(sum((1 + ln(tf)) * idf * (1 + ln(tf)) * idf)) AS norm FROM terms JOIN idf USING (term) GROUP BY id),
dot AS (SELECT id, sum((1 + ln(tf)) * idf * idf) AS dot FROM terms JOIN idf USING (term) WHERE {_ASKED} GROUP BY id), len AS (SELECT sqrt(sum(idf * idf)) AS length FROM idf WHERE {_ASKED}),
sc AS (SELECT id, dot / (norm * length) AS score FROM dot JOIN nrm USING (id), len)"""


def _scores(spark, sf_dir):
    terms, n = _terms(spark, sf_dir)
    bodies = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return retrieval.question_scores(terms, retrieval.idf_table(terms, n), _QUESTION, bodies=bodies)


@query(f"WITH {_TERMS}, {_SCORES} SELECT id, round(score, 6) AS score FROM sc WHERE score > 0")
def question_rank(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {_TERMS}, {_SCORES}, r AS (SELECT id, round(score, 6) AS score, greatest(1, ceil(n_chars / 4))::BIGINT AS tokens FROM sc JOIN documents ON doc_id = id),
w AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM r) SELECT id, score, tokens, running FROM w WHERE running <= 4000""")
def budget_pack(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.token_estimate(F.col("n_chars")).alias("tokens"))
    return retrieval.within_budget(question_rank(spark, sf_dir).join(d, "id"), 4000)


@query("""WITH r AS (SELECT n_nationkey AS project, s_suppkey AS source, row_number() OVER (PARTITION BY n_nationkey ORDER BY (s_acctbal = max_bal) DESC, s_suppkey) AS k FROM (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS max_bal FROM supplier) JOIN nation ON n_nationkey = s_nationkey) SELECT project, source FROM r WHERE k = 1""")
def project_default_source(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    top = s.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"))
    rows = s.join(top, "s_nationkey").select(F.col("s_nationkey").alias("project"), F.lit("h").alias("host"), F.lit("local_path").alias("type"), F.col("s_suppkey").cast("string").alias("path"), (F.col("s_acctbal") == F.col("top")).alias("is_default"), F.col("s_suppkey").alias("ord"))
    return context.project_paths(rows, "h").select("project", F.col("path").cast("bigint").alias("source"))


@query("WITH s AS (SELECT user_id AS thread, event_id AS seq, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY thread ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT thread, count(*) AS n, max(seq) AS last_seq FROM g GROUP BY thread, k")
def sessions(spark, sf_dir):
    from reposcope.streaming.refresh import sessions as windows

    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return windows(e).select("thread", "n", "last_seq")
