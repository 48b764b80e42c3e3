"""Centroid clustering of integer vectors by partial-distance search, exact in every sum.

Each round sends the centroids (their number times dimensions, fixed) to all tasks; a task gives back
sums and counts of its clusters, which are added up as integers, so that rounds do not depend on how
rows are dealt. Distances are summed up over the dimensions of highest variance first, a few at a time;
a centroid is left as soon as its part is above the best distance that a vector has so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import materialize

#: Components times SCALE are floored; DIMENSIONS of a vector, CENTROIDS, ROUNDS.
SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 256, 64, 40, 5
#: Dimensions that are summed up before centroids are left, and vectors that are compared at a time.
STEP, BLOCK = 8, 2048
#: Components from here on could give distances that no long holds.
LARGEST = 1 << 27


def integers(rows: DataFrame, id_col: str, vec_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, q): rows whose vector has exactly ``dimensions`` components, none null or not finite."""
    v = F.col("vec")
    df = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.exists(v, lambda x: F.abs(x * scale) >= LARGEST)
    q = F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}: distances would not fit")).cast("array<bigint>")).otherwise(F.transform(v, lambda x: F.floor(x * scale).cast("bigint")))
    return df.where(v.isNotNull() & (F.size(v) == dimensions) & ~bad).select("vec_id", q.alias("q"))


def _matrix(column, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, ties to the smaller number. Centroids come
    in their order; of each only the rows go on whose part is not strictly above their best so far."""
    x, centroids = x[:, order], centroids[:, order]
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int32)
    for c in range(len(centroids)):
        left, part = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for at in range(0, x.shape[1], step):
            d = x[left, at : at + step] - centroids[c, at : at + step]
            part = part + np.einsum("ij,ij->i", d, d)
            stays = part <= best[left]
            left, part = left[stays], part[stays]
            if not len(left):
                break
        nearer = part < best[left]
        best[left[nearer]], number[left[nearer]] = part[nearer], c
    return number, best


def moments(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Count, sums and sums of squares of each dimension, over all vectors: sets the order of dimensions."""

    def run(batches):
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.full(dimensions, float(n))), pa.array(total), pa.array(squares)], ["d", "n", "s", "ss"])

    rows = vectors.select("q").mapInArrow(run, "d int, n double, s double, ss double").groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("d").collect()
    return np.array([r[1:] for r in rows]).reshape(-1, 3)


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors; empty ones stay."""
    k, dimensions = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, order))

    def run(batches):
        c, by = shared.value
        total, n = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK), dimensions)
                number, _ = nearest(x, c, by)
                np.add.at(total, number, x)
                n += np.bincount(number, minlength=k)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(list(total[own]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("q").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("d", "x"))
    sums = each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total")).collect()  # k times dimensions rows
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    return out


def cluster(
    rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2", dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of exactly ``dimensions`` components, none null or not finite, as integers
    floor(scale * x); an error if one is so large that distances would not fit a long. The first
    centroids are the vectors with the smallest sha256 of ``seed:vec_id`` (all, if there are fewer; of rows
    with one id, the smaller vector first; rows without an id last). Repeated rows count as often as they
    are there; other columns are not read; an empty table has no rows and no centroids."""
    spark = rows.sparkSession
    vectors = materialize(integers(rows, id_col, vec_col, dimensions, scale), "integer-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(hashed.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(centroids).collect()
    now = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, dimensions)
    result = "vec_id bigint, cluster int, distance bigint"
    if not len(now):
        return spark.createDataFrame([], result), now
    n, total, squares = moments(vectors, dimensions).T
    order = np.argsort(total * total / (n * n) - squares / n, kind="stable")
    for _ in range(rounds):
        now = moved(vectors, now, order)
    shared = spark.sparkContext.broadcast((now, order))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                number, distance = nearest(_matrix(part.column(1), dimensions), *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, result), now


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (null where no long holds them) and centroid_sha256 to ``cluster``'s rows."""
    spark = assigned.sparkSession
    named = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    held = materialize(assigned, "assigned")
    by = held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    every = by.agg(F.sum("own").alias("every"))
    sums = by.crossJoin(F.broadcast(every)).join(names, "cluster")  # one row beside a row for each cluster
    fits = "bigint"
    return held.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", F.col("own").try_cast(fits).alias("cluster_inertia"), F.col("every").try_cast(fits).alias("inertia"), "centroid_sha256")
