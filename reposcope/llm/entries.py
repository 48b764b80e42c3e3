"""Queries and oracle SQL of the corpus operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm import bpe, centroids, html_text, line_dedup, mixing, nearest, pii, simhash, token_output, toxicity, url_filter, whitening, winnow
from reposcope.llm.common import table

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
WEIGHTS = {"high": 0.95, "low": 0.05}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bound=4, distinct=False)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_of(table(spark, sf_dir, "documents"), digests=True)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.beside_next(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), digests=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.rates(table(spark, sf_dir, "documents"), labelled, WEIGHTS).drop("draw")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(*whitening.whiten(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_token_output, op3_url_filter, op4_winnowing, op5_html, op6_bpe, op7_toxicity, op8_pii, op9_nearest, op10_mixing, op11_line_dedup, op12_centroids, op13_whitening, pipeline)
    return {f.__name__: f for f in own}


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
shared AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.top AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _centroid_sql() -> str:
    """The rounds written out, one after another."""
    near = """pairs{i} AS MATERIALIZED (
  SELECT v.row_no, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors v CROSS JOIN cent{i} c
),
near{i} AS MATERIALIZED (SELECT row_no, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance FROM pairs{i} GROUP BY row_no)"""
    move = """long{i} AS (SELECT n.cluster, v.row_no, unnest(v.q) AS x, unnest(range(1, 65)) AS dim FROM near{p} n JOIN vectors v USING (row_no)),
sums{i} AS (SELECT cluster, dim, sum(x) AS s, count(*) AS k FROM long{i} GROUP BY cluster, dim),
means{i} AS (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY dim) AS q FROM sums{i} GROUP BY cluster),
cent{i} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM cent{p} c LEFT JOIN means{i} m USING (cluster))"""
    steps = [near.format(i=0)]
    for i in range(1, centroids.ROUNDS + 1):
        steps += [move.format(i=i, p=i - 1), near.format(i=i)]
    last = centroids.ROUNDS
    return f"""
WITH vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cent0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM vectors ORDER BY h LIMIT 40)),
{','.join(steps)},
by_cluster AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{last} GROUP BY cluster)
SELECT v.vec_id, n.cluster, n.distance, b.cluster_inertia, (SELECT sum(distance)::BIGINT FROM near{last}) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM near{last} n JOIN vectors v USING (row_no) JOIN by_cluster b USING (cluster) JOIN cent{last} c USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op11_line_dedup": LINES_SQL, "op12_centroids": _centroid_sql()}
