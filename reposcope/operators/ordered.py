"""Prefix scans over ordered groups of any length: carries of ranges first, then every range by itself.

Groups of up to LONG rows are one window each. A longer one is cut into PIECES ranges of its order, at
quantiles that are found first and written, so that both passes see the same ranges. Each range gives
one value; their running combination over the ranges before is the carry that a range's rows start
from. No task sees more than a range, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.shared import written

#: Rows from which on a group is cut, its ranges, and values of long groups that are broadcast at most.
LONG, PIECES, BROADCAST_ROWS = 250_000, 128, 1_000_000
#: Cuts between two that a row is held against first: about the root of PIECES.
STRIDE = 12


def _same(rows: DataFrame, keys: list[str], side: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, (rows[k].eqNullSafe(side[f"_k{i}"]) for i, k in enumerate(keys)), F.lit(True))


def cuts(rows: DataFrame, keys: list[str], at: str) -> tuple[DataFrame, DataFrame, int] | None:
    """The rows, written, so that no pass makes them again, (_k0, ..., _cuts) of the groups of more than LONG rows, and
    how many they are; None if there are none."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    long = written(rows.groupBy(*named).agg(F.count("*").alias("_n")).where(F.col("_n") > LONG), "long-groups")
    n = long.count()
    if not n:
        return None
    rows = written(rows, "ordered")
    side = F.broadcast(long) if n <= BROADCAST_ROWS else long
    shares = [i / PIECES for i in range(1, PIECES)]
    found = rows.join(side, _same(rows, keys, side)).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.percentile_approx(at, shares, 16 * PIECES).alias("_cuts"))
    return rows, written(found, "cuts"), n


def _below(x: Column) -> Column:
    """How many of the ascending ``_cuts`` are below x: by every STRIDE-th first, then by those between two of them."""
    passed = F.size(F.filter("_coarse", lambda c: c < x)) * STRIDE
    return passed + F.size(F.filter(F.slice("_cuts", passed + 1, STRIDE - 1), lambda c: c < x))


def scan(rows: DataFrame, keys: list[str], order: list[str], total: Column, carry: Callable[[Column], Column], local: Column, join: Callable[[Column, Column], Column], name: str, before: bool, telling: Column | None = None) -> DataFrame:
    """Adds ``name``: the scan of each row's group up to the row (with ``before``: of the rows before it, by
    rows). ``total`` is a range's value, ``carry`` combines them over a window, ``local`` is the scan
    within a range, ``join`` combines carry and local. Long groups are cut by the first column of
    ``order`` (a number, date or time); rows that are equal in it stay in one range. Where only some rows
    make a range's value, ``telling`` says which."""
    last = -1 if before else 0
    found = cuts(rows, keys, order[0])
    if found is None:
        here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return rows.select(*rows.columns, join(F.lit(None), local.over(here)).alias(name))
    rows, bounds, n = found
    small = n * PIECES <= BROADCAST_ROWS
    bounds = bounds.withColumn("_coarse", F.filter("_cuts", lambda c, i: (i + 1) % STRIDE == 0))
    side = F.broadcast(bounds) if small else bounds
    at = F.when(F.col(order[0]).isNull(), 0).otherwise(_below(F.col(order[0])))
    dealt = rows.join(side, _same(rows, keys, side), "left").withColumn("_range", F.when(F.col("_cuts").isNotNull(), at)).select(*rows.columns, "_range")
    named = [f"_k{i}" for i in range(len(keys))]
    every = bounds.select(*named, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_r"))
    valued = dealt.where("_range is not null") if telling is None else dealt.where(F.col("_range").isNotNull() & telling)
    sums = valued.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r")).agg(total.alias("_total"))
    sums = every.unionByName(sums, allowMissingColumns=True).groupBy(*named, "_r").agg(F.first("_total", ignorenulls=True).alias("_total"))  # ranges without a value as well
    past = Window.partitionBy(*named).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carry", carry(F.col("_total")).over(past)).drop("_total")  # PIECES rows a long group
    here = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    inside = dealt.withColumn("_local", local.over(here))
    carried = F.broadcast(carried) if small else carried
    met = inside.join(carried, _same(inside, keys, carried) & (inside["_range"] == carried["_r"]), "left")
    return met.select(*rows.columns, join(F.col("_carry"), F.col("_local")).alias(name))


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that is not null of the rows up to each row."""
    at = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    return scan(rows, keys, order, at, lambda t: F.last(t, ignorenulls=True), F.last(value, ignorenulls=True), lambda c, here: F.coalesce(here, c), name, False, F.col(value).isNotNull())


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the greatest value of the rows before each row; null for the first."""
    return scan(rows, keys, order, F.max(value), F.max, F.max(value), F.greatest, name, True)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of the values up to each row; nulls count as 0."""
    return scan(rows, keys, order, F.sum(value), F.sum, F.sum(value), lambda c, here: F.coalesce(c, F.lit(0)) + F.coalesce(here, F.lit(0)), name, False)


def union_length(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys..., total): length of the union of [start, end) of each key. Intervals by start, one for each,
    add what they reach beyond all before them, so that ranges of starts are merged apart and the
    reach is carried."""
    longest = intervals.groupBy(*keys, start).agg(F.max(end).alias(end))
    reached = running_max(longest, keys, [start], end, "_reach")
    more = F.col(end) - F.greatest(start, F.when(F.col("_reach").isNotNull(), F.least("_reach", end)))
    return reached.groupBy(*keys).agg(F.sum(F.greatest(more, more - more)).alias("total"))
