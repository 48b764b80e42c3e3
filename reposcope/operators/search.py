"""Exact line search over files: content pages, files, counts, context, batches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions.text import glob_regex, line_pattern, matches


@dataclass(frozen=True)
class Search:
    pattern: str
    regex: bool = False
    case_sensitive: bool = False
    word: bool = False
    glob: str | None = None
    limit: int = 30
    offset: int = 0
    before: int = 0
    after: int = 0

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("the pattern is empty")
        if self.glob is not None and (not self.glob or self.glob.startswith("-")):
            raise ValueError("a glob is not empty and starts with no hyphen")
        for value, low, high, name in ((self.limit, 1, 500, "limit"), (self.offset, 0, 100_000, "offset"), (self.before, 0, 32, "before"), (self.after, 0, 32, "after")):
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


def lines(files: DataFrame, file_col: str = "file", text_col: str = "source") -> DataFrame:
    """(file, line from 1, text); an empty end line counts, null sources have no lines."""
    split = F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("at", "text")
    return files.select(F.col(file_col).alias("file"), split).select("file", (F.col("at") + 1).alias("line"), "text")


def hits(rows: DataFrame, s: Search) -> DataFrame:
    """All matching lines; the glob prunes files before the text is looked at."""
    if s.glob is not None:
        rows = rows.where(F.col("file").rlike(glob_regex(s.glob)))
    return rows.where(matches(F.col("text"), s.pattern, s.regex, s.case_sensitive, s.word))


def content(rows: DataFrame, s: Search) -> DataFrame:
    """One page of matching lines by file and line, with ``truncated``: whether more follow."""
    page = hits(rows, s).orderBy("file", "line").offset(s.offset).limit(s.limit + 1)
    order = Window.orderBy("file", "line")  # over a page of limit + 1 rows
    counted = page.withColumns({"_n": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return counted.where(F.col("_n") <= s.limit).select("file", "line", "text", (F.col("_all") > s.limit).alias("truncated"))


def with_context(rows: DataFrame, page: DataFrame, before: int, after: int) -> DataFrame:
    """Adds arrays of (line, text) around each line of a page; only the page's files are read again."""
    near = rows.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("text").alias("_t"))
    keyed = F.broadcast(page)  # a page, 500 rows at most
    around = keyed.join(near, (F.col("file") == F.col("_f")) & F.col("_l").between(F.col("line") - before, F.col("line") + after))
    def side(test):
        return F.array_sort(F.collect_list(F.when(test, F.struct(F.col("_l").alias("line"), F.col("_t").alias("text")))))

    return around.groupBy(*page.columns).agg(side(F.col("_l") < F.col("line")).alias("before"), side(F.col("_l") > F.col("line")).alias("after"))


def _first(found: DataFrame, limit: int) -> DataFrame:
    """The first rows by file, with ``truncated``: whether more follow. Looks at limit + 1 rows."""
    page = found.orderBy("file").limit(limit + 1)
    counted = page.withColumns({"_n": F.row_number().over(Window.orderBy("file")), "_all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return counted.where(F.col("_n") <= limit).withColumn("truncated", F.col("_all") > limit).drop("_n", "_all")


def files_with_matches(rows: DataFrame, s: Search) -> DataFrame:
    """(file, truncated); the offset does not count here."""
    return _first(hits(rows, s).select("file").distinct(), s.limit)


def counts(rows: DataFrame, s: Search) -> DataFrame:
    """(file, n, truncated): matching lines of each file; the offset does not count here."""
    return _first(hits(rows, s).groupBy("file").agg(F.count("*").alias("n")), s.limit)


def prepare(files: DataFrame, path: str | None = None, buckets: int = 64) -> DataFrame:
    """Lines made once for many searches: written to ``path`` by ranges of files, so that a search in some
    folders reads their row groups only; kept in the session without a path."""
    rows = lines(files)
    if path is None:
        return rows.persist()
    rows.repartitionByRange(buckets, "file", "line").sortWithinPartitions("file", "line").write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)


def batch(rows: DataFrame, searches: list[Search]) -> DataFrame:
    """(idx, file, line, text): the first page of each of 1 to 10 searches, in one pass over the lines.
    Each pattern is a literal of the plan; a window with a limit keeps few rows of each partition."""
    if not 1 <= len(searches) <= 10:
        raise ValueError("a batch has 1 to 10 searches")
    def test(s):
        found = F.col("text").rlike(line_pattern(s.pattern, s.regex, s.case_sensitive, s.word))
        return found if s.glob is None else F.col("file").rlike(glob_regex(s.glob)) & found

    tagged = F.explode(F.array_compact(F.array(*(F.when(test(s), F.lit(i)) for i, s in enumerate(searches)))))
    every = rows.select(tagged.alias("idx"), "file", "line", "text")
    order = Window.partitionBy("idx").orderBy("file", "line")
    most = max(s.limit for s in searches)
    limit = F.element_at(F.array(*(F.lit(s.limit) for s in searches)), F.col("idx") + 1)
    return every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).where(F.col("_n") <= limit).drop("_n")


def next_page(s: Search) -> Search:
    return replace(s, offset=s.offset + s.limit)


def latest_per(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, by one aggregation."""
    top = F.max_by(F.struct(*values), order)
    return df.groupBy(key).agg(top.alias("_t")).select(key, *(F.col(f"_t.{v}").alias(v) for v in values))
