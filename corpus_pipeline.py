"""Documents to token ids: toxicity, near copies, personal data, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm import bpe, mixing, pii, simhash, toxicity
from reposcope.llm.common import free_name, scratch_path, table
from reposcope.llm.entries import WEIGHTS

#: SQL cannot express the stages; tests/llm compares them with plain implementations.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the scores are learnt from the whole table's labels.
    Null and empty texts have an empty text's score; repeated rows stay or go together; all columns
    stay, whatever they are called; an empty table stays empty."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name("score", docs.columns)
    return toxicity.score(docs, model, docs.columns, name).where(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: sets of five-word shingles
    of Jaccard similarity 0.8. Null and empty texts are copies of each other; rows without an id stay;
    all columns stay; an empty table stays empty."""
    return simhash.keep_one(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in brackets; null and empty texts as they are; all columns stay."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, all columns. Null and empty texts weigh nothing and go by
    the rate of their posterior; repeated rows are drawn alike; an empty table stays empty."""
    return mixing.mix(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), WEIGHTS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids array<int>): a row for each copy of a document; null and empty texts have no ids."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact_personal),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
