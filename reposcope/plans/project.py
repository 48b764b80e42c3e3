"""Queries over one project: extraction, class relations, retrieval, traces, impact.

Parts are symbols as in ``catalog``: their sizes give lines, kinds and classes, their names are bodies.
Sources for extraction are written from the rows of ``part``, so that SQL can say what is in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.operators import code, extract, graph, impact, mining, resolve, retrieval, trace
from reposcope.operators.retrieval import Index
from reposcope.plans.catalog import _EDGES, _FILE, _IMPORTED, _SYMBOLS, _code, _commits, _proposed, _symbols, _t, query
from reposcope.shared import written

# --- extraction ---------------------------------------------------------------------------------------
#: A source for each language; {k} is the part's key, {s} its size, {b} the number of its brand.
_SOURCES = {
    "typescript": "import {{ h{s} as g{k} }} from './b{b}';\nexport class C{k}<T extends U> extends B{s} implements I{b} {{\n  private r: R{b};\n  m{k}(p: P{s}) {{ g{k}(1); this.r.q{s}(`x ${{f{b}()}}`); }}\n}}\n",
    "python": "from .b{b} import h{s} as g{k}\n\nclass C{k}(ns.B{s}, metaclass=M):\n    def m{k}(self, p: P{s}):\n        g{k}(1)\n        self.r.q{s}('x()')\n",
    "go": "package p\nimport b{b} \"x/b{b}\"\ntype C{k} struct {{ r R{b} }}\nfunc (c *C{k}) m{k}(p P{s}) {{\n  g{k}(1)\n  c.r.q{s}()\n}}\n",
    "rust": "use b{b}::h{s};\npub struct C{k} {{ r: R{b} }}\nimpl C{k} {{\n    pub fn m{k}(&self, p: P{s}) {{ g{k}(1); println!(\"{{}}\", no()); }}\n}}\n",
    "cpp": "#include \"b{b}.h\"\nclass C{k} : public B{s} {{\npublic:\n  int m{k}(P{s} p) {{ return g{k}(1); }} // q()\n}};\n",
    "java": "import x.b{b}.H{s};\npublic class C{k} extends B{s} implements I{b} {{\n  private R{b} r;\n  int m{k}(P{s} p) {{ g{k}(1); return r.q{s}(\"x()\"); }}\n}}\n",
}
#: language -> extension; lines of class and method (first, last), their columns; calls beside g: (name, receiver, line).
_SHAPES = {
    "typescript": ("ts", (1, 4, 8), (3, 3, 3), [("q{s}", "this.r", 3), ("f{b}", None, 3)]),
    "python": ("py", (2, 5, 1), (3, 5, 5), [("q{s}", "self.r", 5)]),
    "go": ("go", (2, 2, 6), (3, 6, 1), [("q{s}", "c.r", 5)]),
    "rust": ("rs", (1, 1, 1), (3, 3, 5), []),
    "cpp": ("cpp", (1, 4, 1), (3, 3, 3), []),
    "java": ("java", (1, 4, 1), (3, 3, 3), [("q{s}", "r", 3)]),
}


def _sql(template: str) -> str:
    """A template as SQL concatenation."""
    text = template.replace("'", "''").replace("{{", "\x01").replace("}}", "\x02")
    for name, column in (("k", "p_partkey"), ("s", "p_size"), ("b", "substr(p_brand, 7)")):
        text = text.replace(f"{{{name}}}", f"' || {column} || '")
    return "'" + text.replace("\x01", "{").replace("\x02", "}").replace("\n", "' || chr(10) || '") + "'"


_PARTS = "part CROSS JOIN (SELECT unnest(['" + "', '".join(_SOURCES) + "']) AS language)"


def _case(values: dict[str, str]) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_PATH = _case({k: f"'f' || p_partkey || '.{v[0]}'" for k, v in _SHAPES.items()})
_CALL_LINE = {"typescript": 3, "python": 4, "go": 4, "rust": 3, "cpp": 3, "java": 3}


def _files(spark, sf_dir):
    """Every part in every language."""
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"), F.substring("p_brand", 7, 9).alias("b"))
    part = extract.spread(part, len(_SOURCES))
    each = part.withColumn("language", F.explode(F.array(*(F.lit(x) for x in _SOURCES))))
    source, ending = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, template in _SOURCES.items():
        made = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
        for c in "ksb":
            made = F.replace(made, F.lit(f"{{{c}}}"), F.col(c))
        made = F.translate(made, "\x01\x02", "{}")
        source = F.when(F.col("language") == name, made).otherwise(source)
        ending = F.when(F.col("language") == name, F.lit(_SHAPES[name][0])).otherwise(ending)
    return each.select(F.concat(F.lit("f"), "k", F.lit("."), ending).alias("file"), "language", source.alias("source"))


def _symbol_sql(at: int, name: str, kind: str, owner: str) -> str:
    first, last, column = (_case({k: str(v[at][i]) for k, v in _SHAPES.items()}) for i in range(3))
    qualified = f"{owner} || '.' || {name}" if kind == "method" else name
    container = owner if kind == "method" else "NULL"
    return f"SELECT {_PATH} || '#' || {qualified} || '@' || ({first} + 1) || ':' || {column} AS id, {name} AS name, '{kind}' AS kind, {container} AS container, {_PATH} AS file, {first} AS first, {last} AS last FROM {_PARTS}"


_CLASS, _METHOD = _symbol_sql(1, "'C' || p_partkey", "class", "'C' || p_partkey"), _symbol_sql(2, "'m' || p_partkey", "method", "'C' || p_partkey")


@query(f"{_CLASS} UNION ALL {_METHOD}")
def extract_symbols(spark, sf_dir):
    found = extract.relations(extract.facts(_files(spark, sf_dir), "symbol"))["symbols"]
    return found.select("id", "name", "kind", "container", "file", F.col("start").alias("first"), F.col("end").alias("last"))


_OTHER_CALLS = " UNION ALL ".join(f"SELECT {_PATH} AS file, {_sql(name)} AS name, {f'{chr(39)}{receiver}{chr(39)}' if receiver else 'NULL'} AS receiver, {line} AS line FROM {_PARTS} WHERE language = '{language}'" for language, shape in _SHAPES.items() for name, receiver, line in shape[3])


@query(f"WITH m AS ({_METHOD}) SELECT m.id AS caller, c.file, c.name, c.receiver, c.line FROM (SELECT {_PATH} AS file, 'g' || p_partkey AS name, NULL AS receiver, {_case({k: str(v) for k, v in _CALL_LINE.items()})} AS line FROM {_PARTS} UNION ALL {_OTHER_CALLS}) c JOIN m USING (file)")
def extract_calls(spark, sf_dir):
    found = extract.relations(extract.facts(_files(spark, sf_dir), "call"))["calls"]
    return found.select("caller", F.col("caller_file").alias("file"), "name", "receiver", "line")


_LOCALS = {"typescript": "'g' || p_partkey", "python": "'g' || p_partkey", "go": _sql("b{b}"), "rust": _sql("h{s}"), "cpp": _sql("b{b}"), "java": _sql("H{s}")}
_MODULES = {"typescript": _sql("./b{b}"), "python": _sql(".b{b}"), "go": _sql("x/b{b}"), "rust": _sql("b{b}::h{s}"), "cpp": _sql("./b{b}.h"), "java": _sql("x.b{b}.H{s}")}


@query(f"SELECT {_PATH} AS file, {_case(_LOCALS)} AS local, {_case(_MODULES)} AS specifier FROM {_PARTS}")
def extract_imports(spark, sf_dir):
    return extract.relations(extract.facts(_files(spark, sf_dir), "import"))["imports"].select("file", "local", "specifier")


_HEIRS = "language IN ('typescript', 'python', 'java')"


@query(f"SELECT {_PATH} AS file, 'C' || p_partkey AS subtype, 'B' || p_size AS supertype, 'extends' AS kind FROM {_PARTS} WHERE {_HEIRS} UNION ALL SELECT {_PATH}, 'C' || p_partkey, {_sql('I{b}')}, 'implements' FROM {_PARTS} WHERE language IN ('typescript', 'java')")
def extract_type_relations(spark, sf_dir):
    return extract.relations(extract.facts(_files(spark, sf_dir), "relation"))["type_relations"]


@query(f"SELECT {_PATH} AS file, 'p' AS name, 'P' || p_size AS type, 'C' || p_partkey AS container FROM {_PARTS} WHERE {_HEIRS} UNION ALL SELECT {_PATH}, 'r', {_sql('R{b}')}, 'C' || p_partkey FROM {_PARTS} WHERE language IN ('typescript', 'java')")
def extract_types(spark, sf_dir):
    return extract.relations(extract.facts(_files(spark, sf_dir), "type"))["types"].select("file", "name", "type", "container")


@query("SELECT 6 * count(*) AS files, 6 * count(*) AS parsed, 0::BIGINT AS failed, 0::BIGINT AS truncated, count(*) > 0 AS reliable FROM part")
def extract_health(spark, sf_dir):
    files = _files(spark, sf_dir)
    return extract.health(extract.facts(files, "error", "truncated"), files)


_TRICKS = "a[b.c](x)\nbus.emit('k{s}', 1) // emit('no')\ns = 'open\nbus.emit(''x'')\n' + getattr(y, z)\nimport('fixed')\nt[\"w{b}\"](v)\n"


@query("SELECT 'f' || p_partkey || '.x' AS file, line, form, key FROM part CROSS JOIN LATERAL (VALUES (1, 'computed-call', NULL), (2, 'event-dispatch', 'k' || p_size), (5, 'reflective-access', NULL), (7, 'computed-call', 'w' || substr(p_brand, 7))) AS v(line, form, key)")
def boundaries(spark, sf_dir):
    """Sources with quotes over several lines, a source for each part."""
    text = _TRICKS.replace("''x''", "x")
    source = F.replace(F.replace(F.lit(text), F.lit("{s}"), F.col("p_size").cast("string")), F.lit("{b}"), F.substring("p_brand", 7, 9))
    return code.boundaries(_t(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".x")).alias("file"), source.alias("source")))


@query()
def boundaries_of_documents(spark, sf_dir):
    """Prose has next to none; every document is read."""
    return code.boundaries(_t(spark, sf_dir, "documents").select(F.expr(_FILE).alias("file"), F.col("text").alias("source")))


# --- classes ------------------------------------------------------------------------------------------
_KINDS = """sym AS (SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN 'class' ELSE 'method' END AS kind, CASE WHEN p_size <= 20 THEN 'K' || p_size || p_type ELSE 'm' || p_size END AS name,
CASE WHEN p_size > 20 THEN 'K' || (p_size % 20 + 1) || p_type END AS container, p_brand AS file FROM part),
own AS (SELECT file, name, max(id) AS id FROM sym WHERE kind = 'class' GROUP BY 1, 2 HAVING count(*) = 1), evr AS (SELECT name, max(id) AS id FROM sym WHERE kind = 'class' GROUP BY 1 HAVING count(*) = 1),
decl AS (SELECT p_brand AS file, 'K' || p_size || p_type AS subtype, 'K' || (p_size % 20 + 1) || p_type AS supertype, CASE WHEN p_size % 2 = 0 THEN 'extends' ELSE 'implements' END AS kind FROM part WHERE p_size <= 20)"""


def _kinds(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    symbols = part.selectExpr("p_partkey as id", "case when p_size <= 20 then 'class' else 'method' end as kind", "case when p_size <= 20 then concat('K', p_size, p_type) else concat('m', p_size) end as name", "case when p_size > 20 then concat('K', p_size % 20 + 1, p_type) end as container", "p_brand as file")
    declared = part.where("p_size <= 20").selectExpr("p_brand as file", "concat('K', p_size, p_type) as subtype", "concat('K', p_size % 20 + 1, p_type) as supertype", "case when p_size % 2 = 0 then 'extends' else 'implements' end as kind")
    return symbols, declared


@query(f"WITH {_KINDS} SELECT s.file, s.name, coalesce(own.id, evr.id) AS class FROM (SELECT file, subtype AS name FROM decl UNION ALL SELECT file, supertype FROM decl) s LEFT JOIN own USING (file, name) LEFT JOIN evr USING (name)")
def class_resolution(spark, sf_dir):
    symbols, declared = _kinds(spark, sf_dir)
    names = declared.select("file", F.col("subtype").alias("name")).union(declared.select("file", "supertype"))
    return resolve.class_resolution(names, symbols)


@query(f"""WITH {_KINDS}, r AS (SELECT coalesce(a.id, b.id) AS subtype, coalesce(c.id, d.id) AS supertype, decl.kind FROM decl LEFT JOIN own a ON a.file = decl.file AND a.name = subtype LEFT JOIN evr b ON b.name = subtype
LEFT JOIN own c ON c.file = decl.file AND c.name = supertype LEFT JOIN evr d ON d.name = supertype), k AS (SELECT * FROM r WHERE subtype IS NOT NULL AND supertype IS NOT NULL AND subtype <> supertype),
m AS (SELECT s.id, s.name, coalesce(own.id, evr.id) AS class FROM sym s LEFT JOIN own ON own.file = s.file AND own.name = s.container LEFT JOIN evr ON evr.name = s.container WHERE s.kind = 'method'),
one AS (SELECT class, name, max(id) AS id FROM m WHERE class IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT subtype, supertype, kind FROM k UNION ALL SELECT m.id, one.id, 'overrides' FROM k JOIN m ON m.class = k.subtype JOIN one ON one.class = k.supertype AND one.name = m.name WHERE k.kind = 'extends'""")
def type_relations(spark, sf_dir):
    symbols, declared = _kinds(spark, sf_dir)
    return resolve.type_relations(declared, symbols)


# --- the index ----------------------------------------------------------------------------------------
_ALL = f"alle AS (SELECT src, dst, weight, strategy FROM edges UNION ALL {_IMPORTED})"
_RANK = "CASE strategy WHEN 'importMap' THEN 1 WHEN 'sameFile' THEN 2 WHEN 'typedReceiver' THEN 3 WHEN 'uniqueName' THEN 4 ELSE 5 END"
_PAIRS = f"pair AS (SELECT src, dst, min_by(strategy, {_RANK}) AS strategy FROM edges GROUP BY 1, 2)"


def _index(spark, sf_dir, history=False, once=True):
    """With ``once`` calls and their edges are written, as a graph and the ways to seeds are made of them."""
    code = symbols, _, imports, _ = _code(spark, sf_dir, once)
    part = _t(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_size as start", "p_size + 3 as end", "p_size * 3 + 1 as tokens", "p_name as body")
    symbols = symbols.join(part, "id")
    calls = resolve.call_edges(resolve.resolve(_proposed(spark, sf_dir, code)))
    calls = written(calls, "edges") if once else calls
    edges = resolve.all_edges(calls, resolve.import_edges(imports, symbols))
    typed = resolve.type_relations(_kinds(spark, sf_dir)[1], _kinds(spark, sf_dir)[0])
    made = Index(symbols, edges, resolve.file_imports(imports, symbols), typed, blocks=resolve.import_blocks(imports, symbols))
    if history:
        brands = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("brand"))
        made.cochange = mining.cochange(_commits(spark, sf_dir).join(brands, "file").select("commit", F.col("brand").alias("file")))
    return made


@query(f"WITH {_SYMBOLS}, {_EDGES}, {_ALL} SELECT * FROM alle")
def project_edges(spark, sf_dir):
    return _index(spark, sf_dir).edges


@query(f"WITH {_SYMBOLS}, {_EDGES}, {_PAIRS} SELECT * FROM pair")
def index_calls(spark, sf_dir):
    return _index(spark, sf_dir).calls()


_TERMS = r"""tok AS (SELECT p_partkey AS id, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS term FROM part), terms AS (SELECT id, term, count(*) AS tf FROM tok WHERE length(term) >= 3 GROUP BY 1, 2),
nd AS (SELECT count(*)::DOUBLE AS n FROM part), idf AS (SELECT term, ln((SELECT n FROM nd) / count(*)) AS idf FROM terms GROUP BY term HAVING count(*) <= 0.15 * (SELECT n FROM nd)),
nrm AS (SELECT id, sqrt(sum((1 + ln(tf)) * idf * (1 + ln(tf)) * idf)) AS norm FROM terms JOIN idf USING (term) GROUP BY id),
asked AS (SELECT * FROM idf WHERE term IN ('small', 'anvil')), lex AS (SELECT id, sum((1 + ln(tf)) * idf * idf) / (any_value(norm) * (SELECT sqrt(sum(idf * idf)) FROM asked)) AS lexical FROM terms JOIN asked USING (term) JOIN nrm USING (id) GROUP BY id)"""
_COEF = graph.coefficients(retrieval.TIME, retrieval.TOLERANCE)
_HEAT = """adj AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM alle UNION ALL SELECT dst, src, weight FROM alle) WHERE src <> dst GROUP BY 1, 2), deg AS (SELECT src AS node, sum(w) AS degree FROM adj GROUP BY 1),
p AS (SELECT a.src, a.dst, a.w / d.degree AS p FROM adj a JOIN deg d ON d.node = a.src), """ + ", ".join(f"x{k} AS (SELECT coalesce(dst, node) AS node, sum(x * coalesce(p, 1)) AS x FROM x{k - 1} LEFT JOIN p ON p.src = x{k - 1}.node GROUP BY 1)" for k in range(1, len(_COEF))) + ", mass AS (SELECT node, sum(m) AS mass FROM (" + " UNION ALL ".join(f"SELECT node, x * {c!r} AS m FROM x{k}" for k, c in enumerate(_COEF)) + ") GROUP BY 1), st AS (SELECT m.node AS id, CASE WHEN degree > 0 THEN mass / sqrt(degree) ELSE mass END AS structural FROM mass m LEFT JOIN deg d ON d.node = m.node WHERE mass > 0)"
_NEAR = f"near AS (SELECT id, min_by(strategy, {_RANK}) AS via FROM (SELECT dst AS id, src AS seed, strategy FROM pair UNION ALL SELECT src, dst, strategy FROM pair) WHERE seed IN (SELECT node FROM x0) GROUP BY 1)"
_SCORED = ("score", "structural", "lexical", "cochange")


def _rounded(df):
    return df.select("id", *(F.round(c, 6).alias(c) for c in _SCORED), "via")


@query(f"""WITH {_SYMBOLS}, {_EDGES}, {_ALL}, {_PAIRS}, {_TERMS}, x0 AS (SELECT id AS node, lexical AS x FROM (SELECT id, lexical FROM lex ORDER BY round(lexical, 9) DESC, id LIMIT 5)), {_HEAT}, {_NEAR}
SELECT id, round(coalesce(structural, 0) + coalesce(lexical, 0), 6) AS score, round(coalesce(structural, 0), 6) AS structural, round(coalesce(lexical, 0), 6) AS lexical, 0.0::DOUBLE AS cochange, via FROM st FULL JOIN lex USING (id) LEFT JOIN near USING (id)""")
def retrieve_question(spark, sf_dir):
    return _rounded(retrieval.rank(_index(spark, sf_dir), question="Where is the small anvil handled?"))


_BRANDS = """cb AS (SELECT l_orderkey AS c, p_brand AS f, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem JOIN part ON p_partkey = l_partkey), cf AS (SELECT DISTINCT c, f, 1 / ln(1 + size) AS e FROM cb WHERE size BETWEEN 2 AND 30),
ch AS (SELECT b.f AS file, sum(a.e) AS score FROM cf a JOIN cf b ON a.c = b.c AND a.f <> b.f WHERE a.f = 'Brand#7' AND b.f <> 'Brand#7' GROUP BY 1),
his AS (SELECT id, score / (SELECT max(score) FROM ch) AS cochange FROM ch JOIN sym USING (file))"""


@query(f"""WITH {_SYMBOLS}, {_EDGES}, {_ALL}, {_PAIRS}, x0 AS (SELECT id AS node, 1.0::DOUBLE AS x FROM sym WHERE file = 'Brand#7'), {_HEAT}, {_NEAR}, {_BRANDS},
f AS (SELECT id, coalesce(structural, 0) + 0.5 * coalesce(cochange, 0) AS score, coalesce(structural, 0) AS structural, coalesce(cochange, 0) AS cochange FROM st FULL JOIN his USING (id))
SELECT id, round(score, 6) AS score, round(structural, 6) AS structural, 0.0::DOUBLE AS lexical, round(cochange, 6) AS cochange, coalesce(via, CASE WHEN cochange > 0 THEN 'cochange' END) AS via FROM f LEFT JOIN near USING (id) WHERE score > 0 AND id NOT IN (SELECT id FROM sym WHERE file = 'Brand#7')""")
def retrieve_seeded(spark, sf_dir):
    return _rounded(retrieval.rank(_index(spark, sf_dir, True), seeds=["Brand#7"], question="is a note only"))


@query("""WITH a AS (SELECT p_partkey AS id, p_size / 50.0 AS lexical FROM part WHERE p_type <> 'SMALL'), b AS (SELECT p_partkey AS id, p_retailprice / 2000 AS structural FROM part WHERE p_type <> 'LARGE'), c AS (SELECT p_partkey AS id, p_size::DOUBLE AS x FROM part WHERE p_size > 25),
d AS (SELECT id, x / (SELECT max(x) FROM c) AS cochange FROM c), f AS (SELECT id, coalesce(lexical, 0) AS lexical, coalesce(structural, 0) AS structural, coalesce(cochange, 0) AS cochange FROM a FULL JOIN b USING (id) FULL JOIN d USING (id))
SELECT id, round(2 * structural + lexical + 0.5 * cochange, 6) AS score, round(structural, 6) AS structural, round(lexical, 6) AS lexical, round(cochange, 6) AS cochange FROM f WHERE 2 * structural + lexical + 0.5 * cochange > 0""")
def fuse_scores(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    lexical = part.where("p_type <> 'SMALL'").selectExpr("p_partkey as id", "p_size / 50.0D as score")
    structural = part.where("p_type <> 'LARGE'").selectExpr("p_partkey as id", "p_retailprice / 2000 as score")
    history = part.where("p_size > 25").selectExpr("p_partkey as id", "cast(p_size as double) as score")
    return retrieval.fuse(lexical, structural, history, 2.0, 0.5).select("id", *(F.round(c, 6).alias(c) for c in _SCORED))


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT id, array_to_string(list_transform(range(1, least(len(l), 5) + 1), lambda i: i || '|' || l[i]), chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '… ' || (len(l) - 5) || ' more lines' ELSE '' END AS snippet FROM f""")
def snippets(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").where("text is not null").select(F.expr(_FILE).alias("file"), F.col("text").alias("source"))
    symbols = files.select(F.col("file").alias("id"), "file", F.lit(0).alias("start"), F.lit(1 << 30).alias("end"))
    return retrieval.snippets(symbols, files, 5).select("id", "snippet")


# --- traces -------------------------------------------------------------------------------------------
_FIRST = "n1 AS (SELECT min(name) AS name FROM sym), o1 AS (SELECT min_by(container, id) AS owner FROM sym JOIN n1 USING (name))"


@query(f"""WITH {_SYMBOLS}, {_FIRST} SELECT 'owned hit' AS what, id, 1 AS rank FROM sym JOIN n1 USING (name), o1 WHERE container = owner UNION ALL SELECT 'named hit', id, 2 FROM sym JOIN n1 USING (name)
UNION ALL SELECT 'owned', id, 3 FROM sym JOIN n1 USING (name), o1 WHERE container = owner UNION ALL SELECT 'named', id, 4 FROM sym JOIN n1 USING (name)
UNION ALL SELECT 'around', p_partkey, 5 FROM part WHERE p_brand = 'Brand#3' AND 4 BETWEEN p_size AND p_size + 3""")
def trace_candidates(spark, sf_dir):
    index = _index(spark, sf_dir, once=False)
    name, owner = index.symbols.groupBy("name").agg(F.min_by("container", "id").alias("o")).orderBy("name").first()
    hits = index.symbols.where(F.col("name") == name).select(F.col("name").alias("pattern"), F.concat(F.lit("./"), "file").alias("file"), (F.col("start") + 1).alias("line"))
    none, around = hits.where("false"), spark.createDataFrame([("zz", "Brand#3", 5)], "pattern string, file string, line int")
    asked = (("owned hit", hits, trace.Target(name, owner)), ("named hit", hits, trace.Target(name, "absent")), ("owned", none, trace.Target(name, owner)), ("named", none, trace.Target(name)), ("around", around, trace.Target("zz")))
    parts = [trace.candidates(index, found, target).select(F.lit(what).alias("what"), "id", "rank") for what, found, target in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_LISTS = " UNION ALL ".join(f"SELECT {a} AS node, '{name}' AS relation, {b} AS id, '{kind}' AS via FROM typed WHERE kind = '{kind}'" for name, kind, up in trace._TYPED for a, b in ((("subtype", "supertype") if up else ("supertype", "subtype")),))
_TYPED_SQL = type_relations.__name__


def _typed_sql() -> str:
    from reposcope.plans.catalog import SQL

    head, _, tail = SQL[_TYPED_SQL].partition("SELECT subtype, supertype, kind FROM k UNION ALL")
    return f"typed AS ({head}SELECT subtype, supertype, kind FROM k UNION ALL{tail})"


@query(f"""WITH {_SYMBOLS}, {_EDGES}, {_PAIRS}, {_typed_sql()}, r AS (SELECT DISTINCT * FROM (SELECT dst AS node, 'callers' AS relation, src AS id, strategy AS via FROM pair UNION ALL SELECT src, 'callees', dst, strategy FROM pair UNION ALL {_LISTS})),
k AS (SELECT r.node, relation, r.id, s.name, s.file, p_size + 1 AS line, via, row_number() OVER (PARTITION BY node, relation ORDER BY s.file, p_size + 1, r.id, via) AS n FROM r JOIN sym s ON s.id = r.id JOIN part ON p_partkey = r.id) SELECT * EXCLUDE n FROM k WHERE n <= 12""")
def trace_relations(spark, sf_dir):
    index = _index(spark, sf_dir)
    return trace.related(index, index.symbols.select(F.col("id").alias("node")))


@query("""WITH n AS (SELECT p_brand AS file, p_size + 1 AS first, p_size + 4 AS last FROM part ORDER BY p_brand, p_size, p_partkey LIMIT 3), h AS (SELECT p_name AS pattern, p_brand AS file, p_size + 2 AS line, p_type AS text FROM part)
SELECT h.* FROM h WHERE EXISTS (SELECT 1 FROM n WHERE n.file = h.file AND h.line BETWEEN n.first AND n.last)""")
def trace_evidence(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    nodes = part.orderBy("p_brand", "p_size", "p_partkey").limit(trace.NODES).selectExpr("p_brand as file", "p_size + 1 as first", "p_size + 4 as last")
    return trace.evidence(part.selectExpr("p_name as pattern", "p_brand as file", "p_size + 2 as line", "p_type as text"), nodes)


# --- impact -------------------------------------------------------------------------------------------
_TESTED = "pth AS (SELECT id, CASE WHEN file IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'tests/' || file || '.ts' ELSE file END AS file FROM sym), fi AS (SELECT DISTINCT CASE WHEN i.file IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'tests/' || i.file || '.ts' ELSE i.file END AS file, b.id FROM imports i JOIN sym b ON b.name = i.local AND b.file = i.target)"


def _tested(spark, sf_dir, once=True):
    index = _index(spark, sf_dir, once=once)
    moved = F.when(F.col("file").isin("Brand#1", "Brand#2", "Brand#3"), F.concat(F.lit("tests/"), F.col("file"), F.lit(".ts"))).otherwise(F.col("file"))
    index.symbols, index.file_imports = index.symbols.withColumn("file", moved), index.file_imports.withColumn("file", moved)
    return index


def _flat(c):
    return F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",").alias(c)


@query(f"""WITH {_SYMBOLS}, {_EDGES}, {_PAIRS}, {_TESTED}, u AS (SELECT p.file, e.dst AS id, 'call' AS evidence FROM pair e JOIN pth p ON p.id = e.src UNION SELECT file, id, 'import' FROM fi)
SELECT file, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS targets, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM u WHERE starts_with(file, 'tests/') GROUP BY file""")
def impact_tests(spark, sf_dir):
    index = _tested(spark, sf_dir)
    return impact.test_references(index.calls(), index.symbols, index.file_imports, index.symbols).select("file", _flat("targets"), _flat("evidence"))


@query(f"WITH {_SYMBOLS}, {_TESTED} SELECT file, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS targets FROM fi WHERE NOT starts_with(file, 'tests/') GROUP BY file")
def impact_imports(spark, sf_dir):
    index = _tested(spark, sf_dir, once=False)
    return impact.imports(index.file_imports, index.symbols).select("file", _flat("targets"))


@query(f"WITH {_SYMBOLS}, {_EDGES}, {_PAIRS}, {_TESTED} SELECT e.src AS id, p.file, p_size + 1 AS line, min_by(e.strategy, e.dst) AS via, count(*) AS targets FROM pair e JOIN pth p ON p.id = e.src JOIN part ON p_partkey = e.src WHERE NOT starts_with(p.file, 'tests/') GROUP BY 1, 2, 3")
def symbol_lookup(spark, sf_dir):
    index = _tested(spark, sf_dir)
    found = impact.callers(index.calls(), index.symbols, index.symbols)
    return found.select("id", "file", "line", F.element_at(F.map_values("via"), 1).alias("via"), F.size("targets").cast("bigint").alias("targets"))


@query(f"WITH {_SYMBOLS}, c AS (SELECT name FROM sym GROUP BY name HAVING count(*) > 1) SELECT name AS target, id, file, p_size + 1 AS line FROM c JOIN sym USING (name) JOIN part ON p_partkey = id")
def ambiguous_matches(spark, sf_dir):
    index = _index(spark, sf_dir, once=False)
    resolution = retrieval.resolve_targets(index.symbols.select(F.col("name").alias("target")).distinct(), index.symbols)
    return impact.ambiguous_matches(resolution, index.symbols)
