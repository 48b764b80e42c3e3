"""What extraction spends on names that tell nothing; that what it leaves out changes no facts."""

import ast

from reposcope.operators import extract
from reposcope.plans.project import _SOURCES


def test_names_that_cannot_be_members_are_not_asked(monkeypatch):
    asked, member = [], extract.Scanner.member

    def counted(self, i, container, in_class):
        asked.append(self.t(i))
        return member(self, i, container, in_class)

    monkeypatch.setattr(extract.Scanner, "member", counted)
    source = _SOURCES["typescript"].format(k=1, s=2, b=3) + "x = a + b + c;\n" * 50
    facts = extract.Scanner("f.ts", "typescript", source).run()
    assert [s["name"] for s in facts.symbols] == ["C1", "m1"]
    assert len(asked) < 15


def test_leaves_of_python_trees_are_not_visited_but_count_in_depth(monkeypatch):
    seen, told = [], extract._TOLD

    class Told:
        def __contains__(self, node):
            seen.append(node)
            return node in told

    monkeypatch.setattr(extract, "_TOLD", Told())
    facts = extract.python_facts_of("f.py", "class A(B):\n    def m(self, p: P):\n        return g(1) + x.y[0]\n")
    assert not {ast.Name, ast.Constant, ast.Load} & set(seen)
    assert [s["name"] for s in facts.symbols] == ["A", "m"] and [c["name"] for c in facts.calls] == ["g"]
    # module, assignment, minuses, name, context: the context is as deep as all above it
    cut = {n: extract.python_facts_of("f.py", "x = " + "-" * n + "a").truncated for n in range(extract.MOST_DEPTH - 5, extract.MOST_DEPTH + 1)}
    assert cut == {n: n + 3 > extract.MOST_DEPTH for n in cut}


def test_facts_of_several_batches_are_whole(spark):
    rows = [(f"f{i}.go", "go", f"package p\nfunc f{i}() {{ g() }}\n") for i in range(extract.ROWS_A_BATCH + 70)]
    files = spark.createDataFrame(rows, "file string, language string, source string").coalesce(1)
    found = extract.facts(files, "symbol").select("file", "name").collect()
    assert sorted(tuple(r) for r in found) == sorted((f, f"f{f[1:-3]}") for f, _, _ in rows)
    assert extract._batch([]).num_rows == 0


def test_only_what_is_asked_for_is_looked_for(monkeypatch):
    sources = {language: template.format(k=1, s=2, b=3) for language, template in _SOURCES.items()}
    whole = {language: extract.rows_of("f", language, source) for language, source in sources.items()}
    for kind in extract._EVERY:
        for language, source in sources.items():
            asked = [r for r in extract.rows_of("f", language, source, (kind,)) if r[1] == kind]
            assert [(r[1], *r[3:]) for r in asked] == [(r[1], *r[3:]) for r in whole[language] if r[1] == kind]
    assert extract.rows_of("f", "java", sources["java"], ("import", "error")) == whole["java"]  # anything may fail

    def never(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(extract.Scanner, "find_calls", never)
    monkeypatch.setattr(extract.Scanner, "annotation", never)
    for language in sources.keys() - {"python", "typescript"}:
        assert any(r[1] == "symbol" for r in extract.rows_of("f", language, sources[language], ("symbol",)))
    monkeypatch.setattr(extract.Scanner, "define", never)
    for language in sources.keys() - {"python"}:
        assert [r[1] for r in extract.rows_of("f", language, sources[language], ("import",))] == ["import"]
    deep = "if a:\n    from .x import y\n" + "elif b:\n    pass\n" * (extract.MOST_DEPTH + 5) + "else:\n    from .x import z\n"
    found = [[(r[1], *r[3:]) for r in extract.rows_of("f", "python", deep, kinds) if r[1] in ("import", "truncated")] for kinds in ((), ("import",))]
    assert found[0] == found[1] and [r[2] for r in found[0]] == ["y", None]
