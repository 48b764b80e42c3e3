"""Patterns, globs and identifiers as column expressions or plain regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word borders over ASCII word characters: Java's \b would count accented letters.
_BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Question words that are no search terms.
NOISE = (
    "about code creation does execute executes explain find from handled handle handles how implementation into main "
    "orchestrate orchestrates queued server show that this thread where which with work works"
).split()
MOST_PATTERNS = 3


def line_pattern(pattern: str, regex: bool = False, case_sensitive: bool = False, word: bool = False) -> str:
    """Java pattern for a search term."""
    body = pattern if regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", pattern)
    body = f"{_BORDER}(?:{body}){_BORDER}" if word else body
    return body if case_sensitive else f"(?i){body}"


def matches(text: Column, pattern: str, regex: bool = False, case_sensitive: bool = False, word: bool = False) -> Column:
    """Whether a line matches; a plain sensitive literal stays a substring test."""
    if not regex and case_sensitive and not word:
        return text.contains(pattern)
    return text.rlike(line_pattern(pattern, regex, case_sensitive, word))


def glob_regex(glob: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name; without a slash: any base name."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(known.get(p) or re.escape(p) for p in parts)
    return f"^{body}$" if "/" in glob else f"^(?:.*/)?{body}$"


def identifiers(text: str) -> list[str]:
    """Lower-case words of three letters or more, camel case taken apart."""
    parted = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return [t.lower() for t in re.split(r"[^A-Za-z0-9]+", parted) if len(t) >= 3]


def identifier_terms(text: Column) -> Column:
    parted = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(parted, "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


_SPAN = re.compile(r"`(?P<quoted>[^`\n]{2,160})`|(?P<chain>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)", re.A)


def query_patterns(query: str) -> list[str]:
    """At most three search terms of a question: back-ticked text, dotted names, names of mixed case or
    with signs, each in the order of the text; then the longest other words that say something. One
    scan tells what each span is; names within back-ticks count as well."""
    quoted, dotted, mixed, words = [], [], [], []

    def scan(text: str, outer: bool) -> None:
        for m in _SPAN.finditer(text):
            if m["quoted"] is not None:
                quoted.append(m["quoted"].strip())
                scan(m["quoted"], False)
            elif "." in m["chain"]:
                dotted.append(m["chain"])
            elif any(c.isupper() or c in "_$" for c in m["chain"][1:]):
                mixed.append(m["chain"])
            elif outer:
                words.append(m["chain"])

    scan(query, True)
    plain = [w for w in dict.fromkeys(identifiers(" ".join(words))) if w not in NOISE]
    found = dict.fromkeys(x for x in (*quoted, *dotted, *mixed, *sorted(plain, key=len, reverse=True)) if x)
    return list(found)[:MOST_PATTERNS]


def join_path(path: Column) -> Column:
    """Path without empty and ``.`` steps; ``..`` goes up, never above the root."""
    def step(done, s):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s.isin("", "."), done).when(s == "..", up).otherwise(F.array_append(done, s))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[^/]+$|(^|/)test_[^/]*\.py$|_test\.(go|py)$|Tests?\.java$")


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / 4)).cast("bigint")
