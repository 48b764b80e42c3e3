"""Whitening of embeddings by merged singular value decompositions.

A task keeps of its rows their number, sums (as integers) and the full-rank factor R = diag(s) V' of the
rows around their mean: all there is to know of their covariance. Two summaries are merged by writing
their factors below each other, with one row more for the difference of their means, and decomposing
again; nothing is cut off, so that the order of merging does not matter but for rounding. Summaries
are merged FAN at a time, level by level, until one is left, which every row is then projected with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import materialize

#: Components are floor(SCALE * c) + SHIFT; COMPONENTS of the covariance are kept of each row.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Summaries in a merge, rows in a step of a task's own summary.
FAN, STEP = 16, 4096
#: Components from here on would not fit the integers that sums are kept in.
LARGEST = 1 << 40
_SUMMARY = "part bigint, n bigint, total array<decimal(38,0)>, factor array<double>"


@dataclass
class Summary:
    """Number of rows, their integer sums, and the factor of the rows around their mean."""

    n: int
    total: list[int]
    factor: np.ndarray


@dataclass
class Whitening:
    """n, integer sums, eigenvalues from the largest and unit eigenvectors (columns) of the covariance."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def rank(self, components: int) -> int:
        """How many of the first components have a variance that is not rounding alone."""
        least = len(self.total) * np.finfo(float).eps * self.values[0] if len(self.values) else 0
        return int((self.values[:components] > least).sum())


def reduced(rows: np.ndarray) -> np.ndarray:
    """diag(s) V' of a matrix: as many rows as columns at most, all of them kept."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both's rows: factors, and a row that corrects for the difference of their means."""
    if not a.n or not b.n:
        return b if not a.n else a
    apart = np.array([(y * a.n - x * b.n) / (a.n * b.n) for x, y in zip(a.total, b.total, strict=True)])  # exact until the division
    correction = np.sqrt(a.n * b.n / (a.n + b.n)) * apart
    return Summary(a.n + b.n, [x + y for x, y in zip(a.total, b.total, strict=True)], reduced(np.vstack([a.factor, b.factor, correction])))


def summary(x: np.ndarray) -> Summary:
    """Of integer rows."""
    total = x.sum(axis=0)
    middle = total // len(x)
    near = (x - middle).astype(np.float64)  # small integers, exact
    return Summary(len(x), [int(t) for t in total], reduced(near - near.mean(axis=0)))


def integers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector is not null and holds no null or number that is not finite. Shorter
    vectors end in zeros, as the longest need them."""
    v = F.col("vec")
    df = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vec_col, lambda c: c.cast("double")).alias("vec"))
    df = df.where(v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    too_large = F.exists(v, lambda c: F.abs(c * SCALE) >= LARGEST)
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    return df.select("vec_id", F.when(too_large, F.raise_error(F.lit(f"a component times {SCALE} is not below {LARGEST}")).cast("array<bigint>")).otherwise(x).alias("x"))


def padded(vectors: DataFrame) -> tuple[DataFrame, int]:
    ends = vectors.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if ends[0] == ends[1]:
        return vectors, ends[1] or 0
    more = F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(ends[1]) - F.size("x"))
    return vectors.withColumn("x", F.concat("x", more)), ends[1]


def _matrix(column, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dimensions)


def fit(vectors: DataFrame, dimensions: int) -> Whitening:
    """The whitening of all rows of ``vectors(x)``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own = Summary(0, [], np.empty((0, dimensions)))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                own = merge(own, summary(_matrix(batch.column(0).slice(at, STEP), dimensions)))
        if own.n:
            row = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.n], pa.int64()), pa.array([own.total], pa.list_(pa.decimal128(38, 0))), pa.array([own.factor.ravel()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(row, ["part", "n", "total", "factor"])

    def read(row) -> Summary:
        return Summary(int(row.n), [int(t) for t in row.total], np.asarray(row.factor, dtype=np.float64).reshape(-1, dimensions))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        own = Summary(0, [], np.empty((0, dimensions)))
        for row in group.itertuples(index=False):
            own = merge(own, read(row))
        from decimal import Decimal

        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "n": [own.n], "total": [[Decimal(t) for t in own.total]], "factor": [own.factor.ravel()]})

    level = materialize(vectors.select("x").mapInArrow(local, _SUMMARY), "summaries")
    while level.limit(2).count() > 1:
        level = materialize(level.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(merged, _SUMMARY), "summaries")
    one = read(level.first())
    _, s, vt = np.linalg.svd(one.factor, full_matrices=True)
    values = np.zeros(dimensions)
    values[: len(s)] = s * s / one.n
    at = np.abs(vt).argmax(axis=1)
    return Whitening(one.n, one.total, values, (vt * np.sign(vt[np.arange(dimensions), at])[:, None]).T)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - total) ** 2 of each row, exact."""
    most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    bound = n * most + max((abs(t) for t in total), default=0)
    if bound < 1 << 62:
        d = n * x - np.array(total, dtype=np.int64)
        if d.size == 0 or int(np.abs(d).max()) ** 2 * max(x.shape[1], 1) < 1 << 62:
            return (d * d).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in d.tolist()]
    return [sum((n * v - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x.tolist()]


def project(vectors: DataFrame, w: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, w): each row around the mean, on the first components, in units of their deviations."""
    k = min(components, len(w.total))
    shared = vectors.sparkSession.sparkContext.broadcast((w, w.rank(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rank = shared.value
        middle = np.array([t // own.n for t in own.total], dtype=np.int64)
        rest = np.array([(t - int(m) * own.n) / own.n for t, m in zip(own.total, middle, strict=True)])
        scale = own.vectors[:, :rank] / np.sqrt(own.values[:rank])
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = _matrix(part.column(1), len(own.total))
                made = ((x - middle).astype(np.float64) - rest) @ scale
                lists = [[*row, *[None] * (k - rank)] for row in made.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(x, own.n, own.total), pa.decimal128(38, 0)), pa.array(lists, pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id bigint, deviation decimal(38,0), w array<double>")


def identity_error(projected: DataFrame, rank: int) -> float | None:
    """Largest absolute entry of the covariance of whitened rows (over the first ``rank``) minus the identity."""
    if not rank:
        return None
    pairs = [(i, j) for i in range(rank) for j in range(i + 1)]
    made = projected.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(made, pairs, strict=True))


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Whitening | None, float | None]:
    """(vec_id, deviation, w) of every remaining row, the whitening, and its identity error.

    Rows whose vector is null or holds a null or a number that is not finite are dropped; components are
    floor(SCALE * c) + SHIFT, an error beyond LARGEST. Shorter vectors (an empty one too) end in zeros as
    the longest need them. Directions without variance, as with fewer different rows than dimensions,
    have null in w and do not count for the error; with no variance at all it is null. Repeated rows count
    as often as they are there, rows without an id as any other; an empty table gives no rows and no
    whitening. Other columns are not read."""
    vectors, dimensions = padded(materialize(integers(rows, id_col, vec_col), "integer-vectors"))
    if not dimensions:
        return vectors.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("w")).limit(0), None, None
    made = fit(vectors, dimensions)
    projected = materialize(project(vectors, made, components), "whitened")
    return projected, made, identity_error(projected, made.rank(min(components, dimensions)))


def by_component(projected: DataFrame, w: Whitening | None, error: float | None) -> DataFrame:
    """A row for each row and component, numbered from 1; a deviation that no long holds is null."""
    every = float(w.values.sum()) if w else 0.0
    share = F.lit([float(v / every) for v in w.values[:COMPONENTS]]) if w and every > 0 else F.array().cast("array<double>")
    each = projected.select("vec_id", F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n if w else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
