"""What a repository says of itself: package manager, scripts, languages, rules; checks to run after an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.sources.repository import language

#: Manifests, files of rules and overviews with how much of them is read, checks, and the
#: package manager that a manifest stands for, the first that is there.
MANIFESTS = ("package.json", "pnpm-lock.yaml", "yarn.lock", "package-lock.json", "bun.lockb")
RULE_FILES, RULE_CHARS = ("AGENTS.md", "CONTRIBUTING.md"), 8192
OVERVIEW_FILES, OVERVIEW_CHARS = ("README.md", "docs/repository-overview.md", "docs/system-overview.md"), 6144
CHECKS = ("test", "typecheck", "lint")
MANAGERS = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("package-lock.json", "npm"), ("package.json", "npm"))
MANIFEST_CHARS, SUMMARY_CHARS = 256 * 1024, 700
CUT = "\n…[truncated]"


def read_allowed(files: DataFrame, allowed: tuple[str, ...], chars: int) -> DataFrame:
    """(repo, file, content) of the files that are on the list, nothing else, the start of each."""
    return files.where(F.col("file").isin(*allowed)).select("repo", "file", F.substring("source", 1, chars).alias("content"))


def package_manager(found: Column) -> Column:
    """Of an array of manifests."""
    out = F.lit("unknown")
    for manifest, manager in reversed(MANAGERS):
        out = F.when(F.array_contains(found, manifest), manager).otherwise(out)
    return out


def scripts(package_json: Column) -> Column:
    """map<string, string> of the known checks' scripts, trimmed; empty ones and broken JSON give none."""
    parsed = F.from_json(F.get_json_object(package_json, "$.scripts"), "map<string,string>")
    known = F.map_filter(F.coalesce(parsed, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*CHECKS) & v.isNotNull() & (F.trim(v) != ""))
    return F.transform_values(known, lambda k, v: F.trim(v))


def languages(symbols: DataFrame, *by: str) -> DataFrame:
    """(by..., language, files): files with symbols of each language; tsx counts as typescript."""
    found = language(F.col("file"))
    return symbols.select(*by, "file", F.when(found == "tsx", "typescript").otherwise(found).alias("language")).where("language is not null").groupBy(*by, "language").agg(F.count_distinct("file").alias("files"))


def repository_context(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each repo of files(repo, file, source) and symbols(repo, file): package_manager, scripts,
    languages (map), manifests, rules and overview (arrays of file and content)."""
    present = files.where(F.col("file").isin(*MANIFESTS)).groupBy("repo").agg(F.collect_set("file").alias("_found"), F.max(F.when(F.col("file") == "package.json", F.substring("source", 1, MANIFEST_CHARS))).alias("_package"))

    def listed(names, chars, name):
        rows = read_allowed(files, names, chars)
        place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("file"))
        return rows.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("file"), F.trim("content").alias("content")))).alias(name)).select("repo", F.transform(name, lambda x: F.struct(x["file"].alias("file"), x["content"].alias("content"))).alias(name))

    spoken = languages(symbols, "repo").groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages"))
    rows = files.select("repo").distinct().join(present, "repo", "left").join(spoken, "repo", "left").join(listed(RULE_FILES, RULE_CHARS, "rules"), "repo", "left").join(listed(OVERVIEW_FILES, OVERVIEW_CHARS, "overview"), "repo", "left")
    found = F.coalesce("_found", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<file:string,content:string>>")
    return rows.select(
        "repo", package_manager(found).alias("package_manager"), F.coalesce(scripts(F.col("_package")), F.create_map().cast("map<string,string>")).alias("scripts"),
        F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"), F.filter(F.array(*(F.lit(m) for m in MANIFESTS)), lambda m: F.array_contains(found, m)).alias("manifests"),
        F.coalesce("rules", none).alias("rules"), F.coalesce("overview", none).alias("overview"),
    )


def summary(context: DataFrame) -> DataFrame:
    """(repo, summary): what there is, parted by semicolons, without any text of the repository's own."""
    def part(title, names):
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(names, ",")))

    in_order = F.filter(F.array(*(F.lit(c) for c in CHECKS)), lambda c: F.array_contains(F.map_keys("scripts"), c))
    parts = [
        F.concat(F.lit("repo: "), F.col("package_manager")), part("languages", F.array_sort(F.map_keys("languages"))), part("checks", in_order),
        part("rules", F.transform("rules", lambda r: r["file"])), part("overview", F.transform("overview", lambda r: r["file"])),
    ]
    return context.select("repo", F.substring(F.concat_ws("; ", *parts), 1, SUMMARY_CHARS).alias("summary"))


def plan_verification(context: DataFrame, tests: DataFrame, affected: bool = True) -> DataFrame:
    """(repo, ord, kind, command, args) of the checks, in their order; command is null for those skipped (no
    such script, or no known package manager). With ``affected`` a vitest script gets the test files
    of tests(repo, file)."""
    own = tests.groupBy("repo").agg(F.array_sort(F.collect_set("file")).alias("tests"))
    rows = context.select("repo", "package_manager", "scripts", F.posexplode(F.array(*(F.lit(c) for c in CHECKS))).alias("ord", "kind")).join(own, "repo", "left")
    script = F.try_element_at("scripts", F.col("kind"))
    known = (F.col("package_manager") != "unknown") & script.isNotNull()
    narrowed = F.lit(affected) & (F.col("kind") == "test") & script.rlike(r"(^|\s)vitest(\s|$)") & (F.size(F.coalesce("tests", F.array().cast("array<string>"))) > 0)
    args = F.when(narrowed, F.concat(F.array(F.lit("run"), F.col("kind"), F.lit("--")), F.col("tests"))).otherwise(F.array(F.lit("run"), F.col("kind")))
    return rows.select("repo", "ord", "kind", F.when(known, F.col("package_manager")).alias("command"), F.when(known, args).alias("args"))


def truncated(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, with a mark where it was cut."""
    if limit <= len(CUT):
        return F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - len(CUT)), F.lit(CUT)))


def project_paths(sources: DataFrame, host: str | None = None) -> DataFrame:
    """(project, path): of sources(project, host, type, path, is_default, ord) with a local path the default
    one, else the first; with ``host`` only those on it, never another's."""
    local = sources.where("type = 'local_path' and path is not null and path <> ''")
    if host is not None:
        local = local.where(F.col("host") == host)
    return local.groupBy("project").agg(F.min_by("path", F.struct((~F.coalesce("is_default", F.lit(False))).alias("d"), "ord")).alias("path"))
