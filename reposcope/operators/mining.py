"""Co-change of files in commits, capture-recapture completeness, feedback and its outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.operators import ordered

Z95 = 1.959963984540054
#: Fixed value: commands that look for code.
SEARCHES = r"(^|[\s|;&(])(rg|grep|ag|ack|fd|find)\s"


#: Sequence numbers that are summed up together, so that a thread of any length is many groups.
SEQUENCES = 65_536


def sized_commits(commits: DataFrame, most: int = 30) -> DataFrame:
    """(commit, file, evidence): distinct files of commits of 2 to ``most`` entries; the size counts
    repeated entries. Evidence of a pair is 1 / ln(1 + size)."""
    rows = commits.groupBy("commit", "file").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("commit"))
    return rows.withColumn("size", size).where(F.col("size").between(2, most)).select("commit", "file", (1 / F.log1p("size")).alias("evidence"))


def cochange(commits: DataFrame, most: int = 30, tasks: int | None = None) -> DataFrame:
    """(file, other, score). Pairs come from one array for each commit (``most`` entries at most), so
    commits are shuffled once; a pair is summed up once, for both directions, in as many
    ``tasks`` as are asked for or Spark plans."""
    baskets = sized_commits(commits, most).groupBy("commit").agg(F.collect_list("file").alias("files"), F.first("evidence").alias("e"))
    left = baskets.select("files", "e", F.explode("files").alias("file"))
    found = left.select("file", F.explode("files").alias("other"), "e").where("file < other")
    pairs = (found.repartition(tasks, "file", "other") if tasks else found).groupBy("file", "other").agg(F.sum("e").alias("score"))
    both = F.explode(F.array(F.struct("file", "other"), F.struct(F.col("other").alias("file"), F.col("file").alias("other"))))
    return pairs.select(both.alias("p"), "score").select("p.file", "p.other", "score")


def cochange_for_seeds(scores: DataFrame, seeds: DataFrame) -> DataFrame:
    """(other, score): summed over ``seeds(file)``, seeds left out."""
    own = scores.join(seeds, "file", "left_semi").groupBy("other").agg(F.sum("score").alias("score"))
    return own.join(seeds.withColumnRenamed("file", "other"), "other", "left_anti")


def chao1(frequencies: DataFrame, known_missing: Column | int = 0) -> DataFrame:
    """Adds estimated, ci_lower, ci_upper, completeness and reliable to rows with observed, f1, f2. Counts
    below 0, or f1 and f2 above observed together, are an error."""
    wrong = (F.col("observed") < 0) | (F.col("f1") < 0) | (F.col("f2") < 0) | (F.col("f1") + F.col("f2") > F.col("observed"))
    frequencies = frequencies.withColumn("observed", F.when(wrong, F.raise_error(F.lit("counts must be 0 or more, and those of one and two captures within all")).cast(frequencies.schema["observed"].dataType)).otherwise(F.col("observed")))
    o, f1, f2 = (F.col(c).cast("double") for c in ("observed", "f1", "f2"))
    known = (known_missing if isinstance(known_missing, Column) else F.lit(known_missing)).cast("double")
    unseen = F.when(f2 > 0, f1 * f1 / (2 * f2)).otherwise(f1 * (f1 - 1) / 2)
    ratio = F.when(f2 > 0, f1 / f2)
    variance = F.coalesce(f2 * (F.pow(ratio, 4) / 4 + F.pow(ratio, 3) + F.pow(ratio, 2) / 2), F.lit(0.0))
    df = frequencies.withColumns({"_u": unseen, "_v": variance})
    wide = (F.col("_u") > 0) & (F.col("_v") > 0)
    factor = F.exp(Z95 * F.sqrt(F.log1p(F.col("_v") / (F.col("_u") * F.col("_u")))))
    low = F.when(wide, o + F.col("_u") / factor).otherwise(o)
    high = F.when(wide, o + F.col("_u") * factor).otherwise(o + F.col("_u"))
    df = df.withColumns({"estimated": o + F.col("_u") + known, "ci_lower": low + known, "ci_upper": high + known})
    complete = F.when(F.col("ci_upper") == 0, 1.0).otherwise(F.least(F.lit(1.0), o / F.col("ci_upper")))
    reliable = (o == 0) | (f2 >= 10) & (F.col("_u") + known <= 3 * o)
    return df.withColumns({"completeness": complete, "reliable": reliable}).drop("_u", "_v")


def frequencies(captures: DataFrame, *by: str) -> DataFrame:
    """observed, f1 and f2 of ``captures(n)``, for each group."""
    return captures.groupBy(*by).agg(*(F.count_if(c).alias(a) for a, c in (("observed", F.col("n") > 0), ("f1", F.col("n") == 1), ("f2", F.col("n") == 2))))


def looks_like_search(command: Column) -> Column:
    return command.rlike(SEARCHES)


def after(points: DataFrame, events: DataFrame, key: str = "thread", order: str = "seq", name: str = "n") -> DataFrame:
    """Adds to points(key, order) how many events(key, order) of their key come later. Events are counted
    by spans of SEQUENCES first; a point needs the later spans' sum and its own span's rows, so that
    no key is ever one group."""
    span = F.floor(F.col(order) / SEQUENCES)
    marked = points.select(key, order).distinct().withColumn("_e", F.lit(0)).unionByName(events.select(key, order).withColumn("_e", F.lit(1))).withColumn("_span", span)
    counts = marked.groupBy(key, "_span").agg(F.sum("_e").alias("_in"))
    later = Window.partitionBy(key).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = counts.select(key, "_span", F.coalesce(F.sum("_in").over(later), F.lit(0)).alias("_beyond"))
    here = Window.partitionBy(key, "_span").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("_here", F.coalesce(F.sum("_e").over(here), F.lit(0))).where("_e = 0")
    summed = inside.join(beyond, [key, "_span"]).select(key, order, (F.col("_here") + F.col("_beyond")).alias(name))
    return points.join(summed, [key, order])


def outcomes(answers: DataFrame, events: DataFrame) -> DataFrame:
    """(thread, answer_seq, surface, files, searches_after, changed, hit, missed, recall): what happened in
    a thread after each answer(thread, seq, surface, files). recall is null without changed files.
    Searches are counted (see ``after``); a changed value meets an answer once, by its last change."""
    a = after(answers.select("thread", "seq", "surface", "files"), events.where("kind = 'search'"), name="searches_after")
    last = events.where("kind = 'change' and value is not null").groupBy("thread", "value").agg(F.max("seq").alias("_last"))
    met = a.join(last, (a["thread"] == last["thread"]) & (last["_last"] > a["seq"]), "left").select(a["*"], "value")
    grouped = met.groupBy("thread", F.col("seq").alias("answer_seq"), "surface", "files", "searches_after").agg(F.array_sort(F.collect_set("value")).alias("changed"))
    hit = F.array_sort(F.array_intersect("changed", "files"))
    return grouped.select("thread", "answer_seq", "surface", "files", "searches_after", "changed", hit.alias("hit"), F.array_sort(F.array_except("changed", "files")).alias("missed"), F.when(F.size("changed") > 0, F.size(hit) / F.size("changed")).alias("recall"))


def by_surface(found: DataFrame) -> DataFrame:
    """Answers, outcomes and means for each surface of answers joined to their outcomes; an answer without
    an outcome has null searches_after. Means leave nulls out."""
    return found.groupBy("surface").agg(F.count("*").alias("answers"), F.count("searches_after").alias("outcomes"), F.avg("searches_after").alias("mean_searches"), F.count("recall").alias("recall_samples"), F.avg("recall").alias("mean_recall"))


def content_hash(source: Column) -> Column:
    return F.substring(F.sha2(source, 256), 1, 32)


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file, status) of files that differ between (file, hash) tables: changed, added, removed."""
    a, b = stored.select("file", F.col("hash").alias("old")), current.select("file", F.col("hash").alias("new"))
    both = a.join(b, "file", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("file", status.alias("status")).where("status is not null")


def staleness_note(report: DataFrame) -> DataFrame:
    """One row: a sentence on the changes, null if there are none."""
    n = [F.count_if(F.col("status") == s) for s in ("changed", "added", "removed")]
    return report.agg(F.when(F.count("*") > 0, F.concat(n[0].cast("string"), F.lit(" changed, "), n[1].cast("string"), F.lit(" added, "), n[2].cast("string"), F.lit(" removed"))).alias("note"))


def merge_incremental(old: DataFrame, fresh: DataFrame, report: DataFrame) -> DataFrame:
    """Old rows of files that stay as they are, and the fresh rows of changed and added files."""
    return old.join(report.where("status <> 'added'").select("file"), "file", "left_anti").unionByName(fresh.join(report.where("status <> 'removed'").select("file"), "file", "left_semi"))


def merged_length(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys..., total): length of the union of [start, end) intervals of each key, in many tasks if a key
    has many (see ``ordered``)."""
    return ordered.union_length(intervals, list(keys))
