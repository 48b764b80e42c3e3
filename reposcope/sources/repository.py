"""Sources: repository files, remote inventories, git logs, event logs, snapshots."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reposcope.operators import ordered
from reposcope.sources import snapshots

#: Folders that are never read, folders left out of remote inventories, languages by extension.
ALWAYS_SKIP = (".git", "node_modules", "dist", "build", "out", "target", "vendor", ".venv", "venv", "__pycache__", ".next", ".turbo", "coverage")
REMOTE_SKIP = ("node_modules", "dist", "build", "out", "target", "vendor", "venv", "__pycache__", "coverage")
LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cp": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".java": "java",
}
MAX_FILE_BYTES = 512 * 1024
ENGINE_VERSION = 504


def language(file: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(known, F.lower(F.regexp_extract(file, r"(\.[^./]*)$", 1)))


def gitignore_regexes(text: str) -> list[tuple[str, bool]]:
    """(regex, ignored) of each line of a root .gitignore; the last one that matches decides. A backslash
    takes the next sign as it is; brackets hold classes, ``!`` in them negates; spaces at the end go
    unless escaped."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignored, body = not line.startswith("!"), line.removeprefix("!")
        folder, anchored = body.endswith("/"), "/" in body.rstrip("/")
        regex = ""
        for part in re.findall(r"\\.|\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\]|.", body.strip("/")):
            if part in ("**/", "**", "*", "?"):
                regex += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[part]
            elif len(part) > 2 and part[0] == "[":
                inner = part[1:-1]
                regex += "[" + ("^/" if inner[0] == "!" else "") + re.sub(r"([\[\\&~])", r"\\\1", inner.removeprefix("!")) + "]"
            else:
                regex += re.escape(part[-1])
        out.append(("^" + ("" if anchored else "(?:.*/)?") + regex + ("/.*$" if folder else "(?:/.*)?$"), ignored))
    return out


def ignored(file: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for regex, verdict in rules:
        out = F.when(file.rlike(regex), F.lit(verdict)).otherwise(out)
    return out


def classify(files: DataFrame, gitignore: str = "", hidden: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds status to (file, size_bytes): skipped (folder), ignored, unsupported, tooLarge or indexed."""
    folders = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    skip = F.exists(folders, lambda p: p.isin(*ALWAYS_SKIP) if hidden else p.isin(*ALWAYS_SKIP) | p.startswith("."))
    status = F.when(skip, "skipped").when(ignored(F.col("file"), gitignore_regexes(gitignore)), "ignored").when(language(F.col("file")).isNull(), "unsupported").when(F.col("size_bytes") > max_bytes, "tooLarge").otherwise("indexed")
    return files.withColumn("status", status)


def _below(root: str) -> Column:
    """A read file's path below the root, with slashes."""
    base = root.split("://")[-1].rstrip("/")
    return F.regexp_replace(F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "^[a-z]+:/*(?=/)", ""), "^.*?" + re.escape(base) + "/", "")


def listing(spark: SparkSession, root: str, gitignore: str = "", hidden: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(file, size_bytes, status) of every file below ``root``: see ``classify``. No content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return classify(raw.select(_below(root).alias("file"), F.col("_metadata.file_size").alias("size_bytes")), gitignore, hidden, max_bytes)


def scan(spark: SparkSession, root: str, gitignore: str = "", hidden: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(file, source, size_bytes, hash, language) below ``root``. Sizes and names prune files before
    their text is used; one row is one file of ``max_bytes`` at most."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    rows = raw.select(_below(root).alias("file"), F.col("value").alias("source"), F.col("_metadata.file_size").alias("size_bytes"))
    kept = classify(rows, gitignore, hidden, max_bytes).where("status = 'indexed'").drop("status")
    return kept.withColumns({"hash": F.substring(F.sha2("source", 256), 1, 32), "language": language(F.col("file"))})


def read_listed(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """(file, source) of the named files below ``root`` that are there, whatever their language."""
    store = snapshots.Store(spark, root)
    there = [n for n in names if store.disk.exists(store.path(n))]
    if not there:
        return spark.createDataFrame([], "file string, source string")
    return spark.read.format("text").option("wholetext", True).load([f"{store.root}/{n}" for n in there]).select(_below(root).alias("file"), F.col("value").alias("source"))


def scan_counts(found: DataFrame) -> DataFrame:
    """One row of ``classify``'s rows: indexed, and files left out by each cause."""
    return found.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("indexed", "indexed"), ("skipped", "skipped"), ("ignored", "ignored"), ("unsupported", "unsupported"), ("tooLarge", "too_large"))))


def normal_path(path: Column) -> Column:
    """Slashes, and ``./`` before it."""
    plain = F.translate(path, "\\", "/")
    return F.when(plain.startswith("./") | plain.startswith("/"), plain).otherwise(F.concat(F.lit("./"), plain))


def remote_status(file: Column, encoding: Column, size: Column, is_ignored: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """ignored, excluded, nonUtf8, tooLarge or indexed, in this order."""
    excluded = F.exists(F.split(file, "/"), lambda p: p.startswith(".") | p.isin(*REMOTE_SKIP))
    return F.when(is_ignored, "ignored").when(excluded, "excluded").when(encoding != "utf8", "nonUtf8").when(size > max_bytes, "tooLarge").otherwise("indexed")


def inventory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def collect_sources(files: DataFrame, is_ignored: Column, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """From files(file, content, encoding, size_bytes): (file, source) of what is indexed, and the counts of
    ``inventory_counts``. A file that cannot be read fails the read, so that nothing half known counts."""
    rows = files.withColumn("status", remote_status(F.col("file"), F.col("encoding"), F.col("size_bytes"), is_ignored, max_bytes))
    return rows.where("status = 'indexed'").select("file", F.col("content").alias("source")), inventory_counts(rows)


def inventory_counts(rows: DataFrame, *by: str) -> DataFrame:
    """One row (for each key): files enumerated, indexed and left out by each cause."""
    named = (("indexed", "indexed"), ("ignored", "ignored"), ("excluded", "excluded"), ("tooLarge", "too_large"), ("nonUtf8", "non_utf8"))
    return rows.groupBy(*by).agg(F.count("*").alias("enumerated"), *(F.count_if(F.col("status") == s).alias(n) for s, n in named))


def inventory_text(counts: DataFrame, truncated: bool = False) -> Column:
    """One line on the counts."""
    line = F.format_string("remote inventory: indexed %d/%d enumerated; skipped ignored=%d, excluded=%d, tooLarge=%d, nonUtf8=%d", "indexed", "enumerated", "ignored", "excluded", "too_large", "non_utf8")
    return F.concat(line, F.lit("; host listing truncated, remaining paths unknown")) if truncated else line


def blind_spots(truncated: bool = False) -> Column:
    """array<string>: what cannot be known from an inventory's counts."""
    cut = F.format_string("The host's listing was cut after %d paths; of the others nothing is known, so a missing match, symbol or caller proves nothing.", "enumerated") if truncated else F.lit(None).cast("string")
    out = F.col("too_large") + F.col("non_utf8")
    held = F.when(out > 0, F.format_string("The snapshot left out %d readable files (tooLarge=%d, nonUtf8=%d); a missing match, symbol or caller may be in them.", out, "too_large", "non_utf8"))
    return F.array_compact(F.array(cut, held))


#: Commits that the git command is asked for.
MOST_COMMITS = 5000


def git_log(root: str, commits: int = MOST_COMMITS, seconds: int = 60) -> list[str]:
    """Lines of the log of names of a local repository, newest first; none if git fails or takes too long."""
    import subprocess

    command = ["git", "-C", root, "log", "--name-only", "--pretty=%H", "--diff-filter=ACMR", "--no-merges", f"-{commits}"]
    try:
        done = subprocess.run(command, capture_output=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return []
    return done.stdout.decode("utf-8", "replace").split("\n")


def read_git_log(spark: SparkSession, root: str, commits: int = MOST_COMMITS) -> DataFrame:
    """(log, commit, file) of a local repository's log."""
    return parse_git_log(spark.createDataFrame([(root, i, t) for i, t in enumerate(git_log(root, commits))], "log string, pos int, text string"))


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(log, commit, file) from the lines (log, pos, text) of logs of names (one log, if there is no such
    column): a line of 7 to 40 hexadecimal digits starts a commit. Every log is ordered by itself, in
    many tasks if it is long (see ``ordered``)."""
    if "log" not in lines.columns:
        return parse_git_log(lines.withColumn("log", F.lit(""))).drop("log")
    text = F.regexp_replace("text", "\r$", "")
    head = F.when(text.rlike("^[0-9a-fA-F]{7,40}$"), text)
    told = lines.select("log", "pos", text.alias("text"), head.alias("head")).where(F.trim("text") != "")  # blank lines tell nothing
    rows = ordered.last_known(told, ["log"], ["pos"], "head", "commit")
    return rows.where(F.col("head").isNull() & F.col("commit").isNotNull()).select("log", "commit", F.col("text").alias("file"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(thread, seq, type, data): event objects that have seq and type; broken lines drop out, and where
    nothing can be read there are no events."""
    from pyspark.errors import AnalysisException

    schema = "thread string, seq bigint, type string, data string"
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where("seq is not null and type is not null")


def save_snapshot(relations: dict[str, DataFrame], path: str, version: int = ENGINE_VERSION, health: dict | None = None, note: dict | None = None) -> int | None:
    """See ``snapshots.save``."""
    return snapshots.save(relations, path, version, health, note)


def load_snapshot(spark: SparkSession, path: str, names: list[str] | None = None, version: int = ENGINE_VERSION, verify: bool = False) -> dict[str, DataFrame] | None:
    """See ``snapshots.load``: None unless the snapshot is complete, readable and of exactly this version."""
    return snapshots.load(spark, path, names, version, verify=verify)


def export_snapshot(relations: dict[str, DataFrame], path: str, version: int = ENGINE_VERSION) -> None:
    """All relations as lines of gzipped JSON (relation, row) with their schemas and the version, for
    another place or another tool."""
    spark = next(iter(relations.values())).sparkSession
    head = spark.createDataFrame([("meta", json.dumps({"version": version, "schemas": {n: df.schema.jsonValue() for n, df in relations.items()}}))], "relation string, row string")
    rows = [df.select(F.lit(n).alias("relation"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for n, df in relations.items()]
    reduce(DataFrame.union, rows, head).write.mode("overwrite").option("compression", "gzip").json(path)


def import_snapshot(spark: SparkSession, path: str, version: int = ENGINE_VERSION) -> dict[str, DataFrame] | None:
    """What ``export_snapshot`` wrote; None if it cannot be read or is of another version."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        rows = spark.read.schema("relation string, row string").json(path)
        head = rows.where("relation = 'meta'").first()
        meta = json.loads(head["row"]) if head and head["row"] else {}
    except (PySparkException, Py4JJavaError, ValueError):
        return None
    if meta.get("version") != version:
        return None
    schemas = {n: T.StructType.fromJson(s) for n, s in meta["schemas"].items()}
    return {n: rows.where(F.col("relation") == n).select(F.from_json("row", s).alias("x")).select("x.*") for n, s in schemas.items()}


def to_json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as one JSON object, for a text sink."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
