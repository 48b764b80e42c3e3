"""Helpers shared by the corpus operators: shared storage, batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. If none is named, a local one is made on a local
    master (tests); on a cluster, where it would not be shared, that is an error."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="reposcope-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back, so that a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows: what a worker holds as Python objects is one slice's."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores before it until no column is called so in any case of letters."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted = "_" + wanted
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A node that holds more than one in HOT of a round's rows meets them by broadcast; fewer than HOT can.
HOT = 1000


def _met(rows: DataFrame, key: str, hubs: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """``rows`` with the columns of their key: rows of ``hubs``, of which there are fewer than HOT, stay
    where they are, so that no task gets all rows of a hub; the rest are shuffled to ``others``."""
    few = F.broadcast(hubs)
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(others, key, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component is the smallest node reached.

    Alternating large-star / small-star rounds: every round is aggregations and equi-joins, the
    rows never exceed the number of edges, and a hub's neighbours are neither collected nor shuffled to
    one task. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    pairs = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    current, before = materialize(pairs, "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before, share = state, max(state[0] // HOT, 1)
        low = current.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        often = current.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > share).select("v")
        met = _met(current, "v", often.join(low, "v", "left"), low, "left")
        large = materialize(met.select("u", F.coalesce("m", "v").alias("v")), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        others = _met(large, "u", least.where(F.col("n") > share).drop("n"), least.where(F.col("n") <= share).drop("n"), "inner")
        small = others.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
