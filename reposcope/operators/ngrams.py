"""Blocks of lines with a bitmap of their trigrams, so that a search reads only blocks that may hold its literals.

``write`` deals lines to blocks of about ROWS lines, by file, and keeps for every block one bitmap of BITS bits
in a table of its own: a bit for each trigram of ASCII letters in lower case. A literal whose trigrams are
not all in a block's bitmap is in none of its lines; the blocks that are left become a condition on the
sorted ``block`` column, which row groups are pruned by. What is found is the same with and without.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.operators.search import Search, lines

#: Lines of a block, and bits of its bitmap: that of Spark's bitmap functions.
ROWS, BITS = 4096, 32_768
#: A trigram from each place of a line; literals are cut into printable ASCII (see ``_plain``), so no others are asked for.
GRAM = r"(?=([\x20-\x7e]{3}))"
#: Blocks up to this number become a condition on the scan; beyond it pruning would not pay.
MOST_BLOCKS = 10_000


def _hashed(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def write(files: DataFrame, path: str, rows: int = ROWS) -> Prepared:
    """Lines of files(file, source) below ``path``. Blocks follow the order of files: all lines of a file are in
    blocks of their own range, a long file in many."""
    every = lines(files)
    n = every.count()
    blocks = max(1, -(-n // rows))
    ranged = every.repartitionByRange(blocks, "file", "line").sortWithinPartitions("file", "line").withColumn("block", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{path}/lines")
    held = files.sparkSession.read.parquet(f"{path}/lines")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = F.array_distinct(F.regexp_extract_all(low, F.lit(GRAM), F.lit(1)))
    bits = held.select("block", F.explode(grams).alias("gram")).select("block", _hashed(F.col("gram")).alias("bit")).distinct().groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits.coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")
    return read(files.sparkSession, path)


@dataclass
class Prepared:
    """Lines(file, line, text, block) and bitmaps(block, bits)."""

    lines: DataFrame
    bitmaps: DataFrame

    def near(self, *searches: Search) -> DataFrame:
        """The lines of all blocks that may hold a hit of any of the searches, as ``search`` takes them."""
        wanted = [literals(s) for s in searches]
        if not all(wanted):
            return self.lines.drop("block")
        tests = [_may_hold(w) for w in wanted]
        found = self.bitmaps.where(_any(tests)).select("block").limit(MOST_BLOCKS + 1).collect()
        if len(found) > MOST_BLOCKS:
            return self.lines.drop("block")
        return self.lines.where(F.col("block").isin([r[0] for r in found])).drop("block")


def read(spark: SparkSession, path: str) -> Prepared:
    return Prepared(spark.read.parquet(f"{path}/lines"), spark.read.parquet(f"{path}/blocks"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _may_hold(words: list[str]) -> Column:
    """Whether a bitmap has the trigrams of all words."""
    grams = sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})
    bits = F.array_distinct(F.array(*(_hashed(F.lit(g)) for g in grams)))

    def is_set(bit: Column) -> Column:
        at = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(at, F.pmod(bit, F.lit(8)).cast("int")) == 1

    return F.forall(bits, is_set)


def literals(s: Search) -> list[str]:
    """ASCII text of three letters or more, in lower case, that every hit's line must hold; empty if none is
    certain: then nothing is pruned. Of a regex only runs of plain characters outside of groups,
    classes and choices count, without the one that a quantifier belongs to."""
    if not s.regex:
        return _plain([s.pattern])
    if re.search(r"[|\\]|\(\?", s.pattern):
        return []
    runs, now, depth, i = [], "", 0, 0
    while i < len(s.pattern):
        c = s.pattern[i]
        if c == "[":
            end = s.pattern.find("]", i + 2)
            if end < 0 or s.pattern[i + 1 : end] == "^" or "[" in s.pattern[i + 1 : end] or "&&" in s.pattern[i + 1 : end]:
                return []
            runs, now, i = [*runs, now], "", end + 1
            continue
        if c in "*?+{":
            runs, now = [*runs, now[:-1]], ""
            if c == "{":
                end = s.pattern.find("}", i)
                if end < 0:
                    return []
                i = end
        elif c in "()":
            depth += 1 if c == "(" else -1
            runs, now = [*runs, now], ""
        elif c in ".^$":
            runs, now = [*runs, now], ""
        elif depth == 0:
            now += c
        i += 1
    return _plain([*runs, now])


def _plain(runs: list[str]) -> list[str]:
    """ASCII pieces of the runs; a search that minds no case folds ASCII letters only, as the bitmaps do."""
    return [p.lower() for r in runs for p in re.findall(r"[\x20-\x7e]{3,}", r)]
