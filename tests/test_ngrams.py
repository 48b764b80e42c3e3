"""Searches over prepared blocks find what searches over all lines find, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from reposcope.operators import ngrams, search
from reposcope.operators.search import Search


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "déjà", "a+b", "x", "", "delta.one", "STRASSE", "straße", "Kelvin"]
    rows = [(f"src/{i:03}.txt", "\n".join(" ".join(rng.choice(words[: 3 + i // 8]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(30)))) for i in range(64)] + [("long.txt", "\n".join(f"line {i} needle{i}" for i in range(900))), ("none.txt", None), ("empty.txt", "")]
    files = spark.createDataFrame(rows, "file string, source string")
    return ngrams.write(files, str(tmp_path_factory.mktemp("lines")), 50), search.lines(files)


@pytest.mark.parametrize("pattern,options", [
    ("needle77", {}), ("NEEDLE7", {}), ("needle7", {"word": True}), ("delta.one", {"case_sensitive": True}), ("a+b", {}), ("x", {}), ("déjà", {"case_sensitive": True}), ("strasse", {}), ("kelvin", {}), ("absent", {}),
    ("needle[0-9]7$", {"regex": True}), ("needles*5", {"regex": True}), ("(needle|alpha)", {"regex": True}), ("del(ta)?.one", {"regex": True}), ("gamma{1,2}", {"regex": True}), (r"\bBeta", {"regex": True}), ("line 1.*needle", {"regex": True}),
])
def test_hits_are_the_same(prepared, pattern, options):
    made, every = prepared
    s = Search(pattern, limit=500, **options)

    def found(rows):
        return [tuple(r) for r in search.content(rows, s).collect()]

    assert found(made.near(s)) == found(every)


def test_blocks_are_pruned(prepared):
    made, _ = prepared
    blocks = made.bitmaps.count()
    assert blocks > 15
    near = made.near(Search("needle77"))
    assert near.count() < made.lines.count() / 4 and "PushedFilters: [In(block" in near._jdf.queryExecution().executedPlan().toString()
    assert made.near(Search("absent")).count() <= 100 and made.near(Search("x")).count() == made.lines.count()
    assert made.near(Search("needle5", glob="*.txt"), Search("delta", glob="x")).count() < made.lines.count()


def test_literals_of_patterns():
    def of(pattern, regex=True):
        return ngrams.literals(Search(pattern, regex=regex))

    assert of("a+b", False) == ["a+b"] and of("Über alles", False) == ["ber alles"] and of("ab", False) == []
    assert of("foo.*barn") == ["foo", "barn"] and of("colou?r") == ["colo"] and of("(abc)?def") == ["def"] and of("a|bcd") == [] and of(r"\d+abc") == [] and of("[abc]def{2}x") == [] and of("abc[^]]def") == [] and of("(?i)abc") == []


def test_bitmaps_hold_the_trigrams_that_are_asked_for_and_no_others(spark, tmp_path):
    texts = ["Ab  c\tdef", "xÄyz1 ~", "ÄÖÜäöü", "ab", "", "aaaa"]
    made = ngrams.write(spark.createDataFrame([(f"{i}", t) for i, t in enumerate(texts)], "file string, source string"), str(tmp_path), 1)
    grams = {i: {t[k : k + 3].lower() for k in range(len(t) - 2) if all(" " <= c <= "~" for c in t[k : k + 3])} for i, t in enumerate(texts)}
    hashed = {g: spark.range(1).select(ngrams._hashed(F.lit(g))).first()[0] for g in set().union(*grams.values())}
    held = {r.block: r.file for r in made.lines.collect()}
    got = {int(held[r.block]): {i * 8 + k for i, b in enumerate(r.bits) for k in range(8) if b >> k & 1} for r in made.bitmaps.collect()}
    assert got == {i: {hashed[g] for g in own} for i, own in grams.items() if own}
