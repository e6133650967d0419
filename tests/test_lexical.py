"""The lexical readers: declarations, calls and type relations of small files of each language."""

import pytest

from graphloom.operators import resolve
from graphloom.plans.samples import SAMPLES
from graphloom.sources import lexical, python_code

FILES = {path.replace("{K}", ""): (text, *(x.replace("{K}", "") for x in said)) for path, (text, *said) in SAMPLES.items()}


@pytest.mark.parametrize("path", sorted(FILES))
def test_reader(path):
    text, symbols, calls, relations = FILES[path]
    s, c, r, bad = lexical.facts(path, text)
    assert bad == 0
    assert ", ".join(f"{x['kind']} {x['qualified_name']}" for x in s if x["kind"] != "import") == symbols
    assert ", ".join(f"{s[x['caller']]['name']} {x['form']} {x['target_kind']} {x['name']} {x['qualifier']}" for x in c) == calls
    assert ", ".join(f"{x['relation']} {x['names'][0]}" for x in r) == relations


def test_places_and_signatures():
    s, c, _, _ = lexical.facts("a.rs", "/* é */ pub fn f<T>(\n  a: T,\n) -> u8 { g(a) }\n")
    assert [(x["signature"], x["start_line"], x["start_col"], x["end_line"], x["end_col"]) for x in s] == [("pub fn f<T>( a: T, ) -> u8", 1, 9, 3, 17)]
    assert [(x["name"], x["line"], x["col"]) for x in c] == [("g", 3, 11)]


def test_odd_files():
    for path in (*FILES, "no/ending", "a.txt", "b.py"):
        assert lexical.facts(path, None)[1:] == ([], [], 0)
    assert lexical.facts("a.go", "package x\nfunc a() { b( }\n")[3] == 1
    for junk in ("{" * 3000, "}" * 3000, '"' * 3001, "/*" * 3000, "a." * 20000 + "b(", "fn f() { " * 500, "\x00퟿ class { ("):
        for path in FILES:
            lexical.facts(path, junk)


def test_diagnostics_have_places():
    r = lexical.read("a.go", "package x\nfunc a() { b( }\n")
    assert r[3] == 1 and r[4] == [dict(kind="missing", cause="bracket", node_kind="(", start_line=2, start_col=13, end_line=2, end_col=14)]
    r = lexical.read("a.rs", "fn f() {}\n" + ")" * 100)
    assert r[3] == 100 and len(r[4]) == lexical.KEPT and r[4][-1]["start_col"] == lexical.KEPT and r[4][0]["kind"] == "error"
    r = lexical.read("a.py", "x = 1\nif :\n")
    assert r[3] == 1 and (r[4][0]["start_line"], r[4][0]["start_col"]) == (2, 4)


PHP = """<?php
namespace App;
use Lib\\Mail;
use Lib\\Log as L;
class Base { public function up() {} }
class A extends Base {
  private Mail $mail;
  public function __construct(private L $log, Plain $plain) { $plain->a(); }
  public function go(Mail $given, int $n, $free) {
    $this->mail->b(); $this->log->c(); $given->d(); $n->e(); $free->f();
    $made = new Top(); $made->g(); $made = other(); $made->h();
    app(Mail::class)->i(); parent::up(); self::go(); Mail::j(); \\Root\\T::k(); $this->l();
  }
}
"""


def test_php_receivers():
    got = {c["name"]: (c["receiver_type"], c["receiver_type_source"]) for c in lexical.facts("a.php", PHP)[1]}
    assert got["a"] == ("App::Plain", "parameter") and got["b"] == ("Lib::Mail", "property") and got["c"] == ("Lib::Log", "promoted_property") and got["d"] == ("Lib::Mail", "parameter")
    assert got["e"] == got["f"] == got["h"] == (None, None) and got["g"] == ("App::Top", "local_new") and got["i"] == ("Lib::Mail", "service_locator") and got["up"] == ("App::Base", "parent_type")
    assert got["go"] == ("A", "self_type") and got["j"] == ("Lib::Mail", "scoped_type") and got["k"] == ("Root::T", "scoped_type") and got["l"] == ("A", "this")


def test_imports_name_what_is_called():
    call = lambda path, text: {c["name"]: c["qualifier"] for c in lexical.facts(path, text)[1]}
    ts = "import { a as b, c } from './mod';\nimport * as ns from '../x/index';\nimport { out } from 'pkg';\nfunction f() { b(); c(); ns.d(); out(); }\n"
    assert call("src/w/a.ts", ts) == {"a": "w::mod", "c": "w::mod", "d": "x", "out": None}
    js = "const m = require('./m.js');\nconst { p: q } = require('./n');\nfunction f() { m.go(); q(); }\n"
    assert call("lib/a.js", js) == {"go": "lib::m", "p": "lib::n", "require": None} or call("lib/a.js", js) == {"go": "lib::m", "p": "lib::n"}
    assert call("A.java", "package k;\nimport static x.y.Z.make;\nclass A { void f() { make(); own(); } }\n") == {"make": "x::y::Z", "own": None}
    assert call("A.cs", "using static X.Y;\nusing L = M.N;\nclass A { void F() { Go(); L.Do(); Mine(); } void Mine() { } }\n") == {"Go": "X::Y", "Do": "M::N", "Mine": None}


def test_go_groups_and_build_constraints():
    s = lexical.facts("a.go", "//go:build linux && !arm\n\npackage w\n\nconst (\n\tA = 1\n\tB, C\n)\nvar (\n\tx int = 2\n)\nfunc F() {}\n")[0]
    assert {(x["kind"], x["qualified_name"]) for x in s} == {("import", "w::a::build::linux && !arm"), ("constant", "w::a::A"), ("constant", "w::a::B"), ("constant", "w::a::C"), ("property", "w::a::x"), ("function", "w::a::F")}


def test_files_of_all_languages_to_resolved_calls(spark):
    d = spark.createDataFrame([(p, x[0]) for p, x in FILES.items()] + [("p.py", "def one():\n    return one()\n"), ("n.rs", None)], "path string, text string")
    parsed = lexical.parse(d)
    r = resolve.resolve(python_code.call_sites(parsed), resolve.callable_catalog(python_code.symbols(parsed)))
    got = {(x.path, x["name"], x.resolution) for x in r.collect()}
    assert {("p.py", "one", "resolved"), ("src/a/lib.rs", "make", "unresolved"), ("src/w/a.ts", "g", "unresolved")} <= got
    assert {x.relation for x in lexical.relations(parsed).collect()} == {"extends", "implements"}
    assert lexical.parse(d.limit(0)).count() == 0
