"""Facts of small sources in every language that is read."""

import pytest

from reposcope.operators import extract as ex


def of(file, language, source):
    return ex.extract(file, language, source)[0]


def names(facts):
    return [f"{s['kind']}:{s['name']}:{s['container']}" for s in facts.symbols]


def calls(facts):
    return {(c["name"], c["receiver"]) for c in facts.calls}


def imports(facts):
    return {(i["local"], i["source"]) for i in facts.imports}


def relations(facts):
    return [(r["subtype"], r["kind"], r["supertype"]) for r in facts.relations]


def types(facts):
    return {(t["name"], t["type"], t["container"]) for t in facts.types}


def test_definitions_and_spans():
    made = of("src/svc.ts", "typescript", "export function alpha(x: number) {\n  return x + 1;\n}\nexport class Svc {\n  run() { return alpha(2); }\n}")
    assert [(s["kind"], s["name"]) for s in made.symbols] == [("function", "alpha"), ("class", "Svc"), ("method", "run")]
    assert [(s["id"], s["start_line"], s["end_line"]) for s in made.symbols] == [("src/svc.ts#alpha@1:8", 0, 2), ("src/svc.ts#Svc@4:8", 3, 5), ("src/svc.ts#Svc.run@5:3", 4, 4)]
    assert made.symbols[0]["tokens"] == 12 and types(made) == {("x", "number", None)}


def test_calls_belong_to_what_is_around_them():
    made = of("src/a.ts", "typescript", "function outer() {\n  helper();\n}\nhelper();\nfunction f() { svc.run(); a.b[0].c(x => x.y()).d?.e(); new Foo(1).go(); super(1); }")
    assert [(c["line"], c["symbol"]) for c in made.calls][:2] == [(1, "src/a.ts#outer@1:1"), (3, None)]
    assert {("run", "svc"), ("c", "a.b[0]"), ("y", "x"), ("e", "a.b[0].c(x => x.y()).d")} <= calls(made)
    assert not {"Foo", "super", "outer"} & {n for n, _ in calls(made)}


def test_script_imports():
    made = of("a.ts", "typescript", 'import { helper, other as alias, type T } from "./util";\nimport def, * as ns from "./def";\nimport "side";\nimport type { Q } from \'q\';\nconst x = import("no");')
    assert imports(made) == {("helper", "./util"), ("alias", "./util"), ("T", "./util"), ("def", "./def"), ("ns", "./def"), ("Q", "q")}


def test_functions_that_are_values():
    source = "export const Toolbar = ({ title }: Props) => {\n  return title;\n};\nconst a = 1, b = async x => x + 1;\nlet c = function () { inner(); };\nconst d = foo(() => 1);\nclass K {\n  onClick = () => { go(); };\n  private n: Repo = new Other();\n  static async *each<T>(x: T): Promise<T> { }\n  get size() { return 1 }\n  later(x: number): void;\n}\nconst o = { run() { go(); }, plain: 1, arrow: () => 2 };"
    made = of("a.tsx", "tsx", source)
    assert names(made) == ["function:Toolbar:None", "function:b:None", "function:c:None", "class:K:None", "method:onClick:K", "method:each:K", "method:size:K", "method:run:None"]
    assert {("n", "Repo", "K"), ("x", "T", "K")} <= types(made)
    assert made.symbols[0]["id"] == "a.tsx#Toolbar@1:14" and made.symbols[0]["end_line"] == 2


def test_type_bindings():
    source = "class A {\n  constructor(private readonly repo: Repo, other?: ns.Other) {}\n  go(list: Array<X>) { const s: Svc = make(); const t = new ns.T(); let u = new U(1); }\n}\nconst f = (q: Query): Res => q.run();"
    assert {("repo", "Repo", "A"), ("other", "ns", "A"), ("list", "Array", "A"), ("s", "Svc", "A"), ("t", "ns.T", "A"), ("u", "U", "A"), ("q", "Query", None)} <= types(of("a.ts", "typescript", source))


def test_components_are_calls():
    made = of("a.tsx", "tsx", "function Page() {\n  return <Layout><Toolbar title=\"x\" /><ui.Button>don't</ui.Button><div/></Layout>;\n}\nconst x = a < B;")
    assert calls(made) == {("Layout", None), ("Toolbar", None), ("Button", "ui")}
    assert {c["symbol"] for c in made.calls} == {"a.tsx#Page@1:1"}


def test_type_relations():
    source = "class Generic<T extends Constraint> extends Base implements Repository<User>, Serializable { run() {} }\nclass Wrapped\n  extends ns.Base\n  implements Reader<User> { read() {} }\ninterface ChildReader extends Reader<User>, Serializable {}\nclass Plain {}"
    assert relations(of("t.ts", "typescript", source)) == [
        ("Generic", "extends", "Base"), ("Generic", "implements", "Repository"), ("Generic", "implements", "Serializable"), ("Wrapped", "extends", "Base"), ("Wrapped", "implements", "Reader"),
        ("ChildReader", "extends", "Reader"), ("ChildReader", "extends", "Serializable"),
    ]
    assert relations(of("T.java", "java", "class A extends B implements C, D<E> {}\ninterface F extends G {}")) == [("A", "extends", "B"), ("A", "implements", "C"), ("A", "implements", "D"), ("F", "extends", "G")]
    assert relations(of("t.py", "python", "class Child(\n    ns.Base,\n    Generic[T],\n    *mixins,\n    metaclass=ABCMeta,\n):\n    pass\n")) == [("Child", "extends", "Base"), ("Child", "extends", "Generic")]


def test_regular_expressions_and_templates():
    source = "const a = /`'[/\"]/g.test(x), b = y / z / w(1);\nfunction f() { return /}/.exec(`a ${g(`in ${h()} ner`)} }`); }\nfunction after() { i(); }"
    made = of("a.ts", "typescript", source)
    assert names(made) == ["function:f:None", "function:after:None"]
    assert {n for n, _ in calls(made)} == {"test", "w", "exec", "g", "h", "i"} and {c["symbol"] for c in made.calls if c["name"] in "gh"} == {"a.ts#f@2:1"}


def test_python():
    source = "from .util import helper as h, other\n\n@route('/é')\nasync def alpha(x: Repo, y=mk()):\n    r = Service()\n    self.é = 1; return h(x.repo.get(1))\nclass A:\n    def f(self):\n        def g(): pass\n        self.db = Db()\n"
    made = of("p.py", "python", source)
    assert [s["id"] for s in made.symbols] == ["p.py#alpha@4:1", "p.py#A@7:1", "p.py#A.f@8:5", "p.py#A.g@9:9"]
    by = {c["name"]: (c["receiver"], c["symbol"]) for c in made.calls}
    assert by["route"] == (None, None) and by["get"] == ("x.repo", "p.py#alpha@4:1") and by["mk"][1] == "p.py#alpha@4:1"
    assert imports(made) == {("h", ".util"), ("other", ".util")} and {("x", "Repo", None), ("r", "Service", None), ("db", "Db", "A")} <= types(made)


def test_python_that_does_not_parse():
    made, error = ex.extract("p.py", "python", "from a import b\nclass A(Base):\n    def f(self):\n        print 'x'\n\ndef g():\n    pass\n")
    assert error == "SyntaxError" and names(made) == ["class:A:None", "method:f:A", "function:g:None"] and imports(made) == {("b", "a")} and relations(made) == [("A", "extends", "Base")]


def test_go():
    source = 'package svc\nimport util "example.com/util"\nimport (\n  "fmt"\n  . "dots"\n  l2 "log/v2"\n)\ntype Service struct{}\ntype (\n  A struct { x int }\n  B interface { M() }\n)\nfunc (s *Service) Run(x interface{}) (int, error) { helper(); util.Log(); go s.Run(nil) }\nfunc helper() {}\n'
    made = of("svc/service.go", "go", source)
    assert names(made) == ["class:Service:None", "class:A:None", "class:B:None", "method:Run:Service", "function:helper:None"]
    assert {("helper", None), ("Log", "util"), ("Run", "s")} <= calls(made) and imports(made) == {("util", "example.com/util"), (".", "dots"), ("l2", "log/v2")}
    made = of("m.go", "go", "func Decode(input any) {}\ntype Decoder struct{}\nfunc (d *Decoder) Decode(input any) { Decode(input) }")
    assert [s["id"] for s in made.symbols] == ["m.go#Decode@1:1", "m.go#Decoder@2:6", "m.go#Decoder.Decode@3:1"] and made.calls[0]["symbol"] == "m.go#Decoder.Decode@3:1"


def test_rust():
    source = "use crate::util::helper;\nuse a::{b, c::d as e, f::*, g::self};\nmod local;\npub struct Service;\nimpl<T> Run for Service where T: X { pub(crate) async fn run(&self) -> Option<u8> { helper(); x.method(); println!(\"{}\", no()); 'a' } }\nfn helper<'a>(x: &'a str) {}\n#[derive(Debug)]\nstruct P { x: i32 }\n"
    made = of("c/lib.rs", "rust", source)
    assert names(made) == ["class:Service:None", "method:run:Service", "function:helper:None", "class:P:None"]
    assert calls(made) == {("helper", None)} and imports(made) == {("helper", "crate::util::helper"), ("b", "a::b"), ("e", "a::c::d"), ("g", "a::g::self"), ("local", "./local")}
    assert made.symbols[1]["id"] == "c/lib.rs#Service.run@5:38"


def test_c_and_cpp():
    made = of("native/main.c", "c", '#include "util.h"\n#include <stdio.h>\n#define F(x) g(x)\nstatic int helper(void) { return 1; }\nint proto(int);\nstruct S { int x; };\nint *run(struct S *s) { if (s) return helper(); }')
    assert names(made) == ["function:helper:None", "class:S:None", "function:run:None"] and calls(made) == {("helper", None)} and imports(made) == {("util", "./util.h")}
    made = of("s.cpp", "cpp", "namespace n {\nclass Service : public Base { public: Service() {} virtual void run() const { helper(); } int x; };\ntemplate<class T> T helper(T t) { return t; }\n}\nvoid Service::stop() { run(); a->b(); n::q(); }")
    assert names(made) == ["class:Service:None", "method:run:Service", "function:helper:None", "method:stop:Service"] and calls(made) == {("helper", None), ("run", None)}


def test_java():
    source = "import app.Util;\nimport static a.B.*;\npublic class Service {\n  private final Map<String, Util> util = new HashMap<>();\n  Service(Repo r) { this(1); }\n  @Override\n  public List<A> run(final Repo repo, int... n) throws E { util.help(); new X(); super.go(); return local(1); }\n  abstract void later();\n}\ninterface I { void m(String s); }\n"
    made = of("app/Service.java", "java", source)
    assert names(made) == ["class:Service:None", "method:run:Service", "method:later:Service", "class:I:None", "method:m:I"]
    assert {("help", "util"), ("go", "super"), ("local", None)} == calls(made) and imports(made) == {("Util", "app.Util")}
    assert {("util", "Map<String, Util>", "Service"), ("repo", "Repo", "Service"), ("s", "String", "I")} <= types(made)


def test_broken_and_deep_sources():
    made = of("src/a.ts", "typescript", "function good() { return 1; }\nfunction broken( {{{\nfunction alsoGood() { good(); }")
    assert "good" in {s["name"] for s in made.symbols} and ("good", None) in calls(made)
    for language in ("typescript", "go", "rust", "c", "java"):
        for source in ("(" * 3000, "}" * 50, "class", "func", "import", "a.b(", "'unclosed", "x => {", "\x00\ud7ff<"):
            ex.extract("f", language, source)
    assert of("f.ts", "typescript", "{" * 500).truncated and not of("f.ts", "typescript", "{" * 50).truncated
    assert ex.extract("f.py", "python", "(" * 500)[1]


def test_rows_and_relations(spark):
    rows = [("a.ts", "typescript", "import { h } from './b';\nclass A extends B { run() { h(); } }"), ("b.ts", "typescript", "export function h() {}"), ("c.py", "python", "def x(:\n"), ("d.bin", "elf", "x"), ("e.go", "go", None)]
    files = spark.createDataFrame(rows, "file string, language string, source string")
    found = ex.facts(files)
    made = {k: [tuple(r) for r in v.collect()] for k, v in ex.relations(found).items()}
    assert [s[1] for s in made["symbols"]] == ["A", "run", "h", "x"] and made["calls"][0][1:5] == ("a.ts#A.run@2:21", "a.ts", "h", None)
    assert made["imports"] == [("a.ts", "h", "./b", 3)] and made["type_relations"] == [("a.ts", "A", "B", "extends")]
    assert tuple(ex.health(found, files).first()) == (5, 4, 1, 0, True)
    body = ex.bodies(ex.relations(found)["symbols"], files).where("name = 'run'").first().body
    assert body == "class A extends B { run() { h(); } }"


def test_files_are_spread_over_tasks(spark, monkeypatch):
    """A small table of parts is one split, which was one task for all sources."""
    from reposcope.plans import project

    monkeypatch.setattr(ex, "FILES_A_TASK", 100)
    files = project._files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() == -(-files.count() // 100) > 1


def test_only_facts_asked_for_leave_tasks(spark):
    files = spark.createDataFrame([("a.go", "go", "package p\nimport b \"x/b\"\nfunc f() { g() }\n"), ("b.py", "python", "def f(:\n")], "file string, language string, source string")
    assert {r.fact for r in ex.facts(files, "import", "error").collect()} == {"import", "error"}
    row = ex.health(ex.facts(files, "error", "truncated"), files).first()
    assert (row.files, row.parsed, row.failed, row.truncated) == (2, 1, 1, 0)
