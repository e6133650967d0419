"""Registered queries of source readers and of the engine's answers over a stored snapshot.

The sources are samples, one set a nation. The snapshot is published once a session and table folder; the answers read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import engine
from graphloom.operators import search
from graphloom.plans.catalog import query
from graphloom.plans.projects import _values
from graphloom.plans.samples import SAMPLES
from graphloom.sources import framework, graph, lexical, python_code
from graphloom.sources.facts import Facts
from graphloom.sources.store import Store, ensure_checkpoint_dir

_K = "replace({}, '{{K}}', n_nationkey::VARCHAR)"


def _named(c: str) -> str:
    return _K.format(c)


def _filled(g: Facts, rows: list[tuple[str, str]], in_text: bool) -> DataFrame:
    """path, text of each row for each nation, {K} filled in."""
    k = F.col("n_nationkey").cast("string")
    n = g.table("nation").select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in rows])).alias("f"))
    fill = lambda c: F.replace(c, F.lit("{K}"), k)
    return n.select(fill(F.col("f.path")).alias("path"), (fill(F.col("f.text")) if in_text else F.col("f.text")).alias("text"))


# Readers


def _samples(g: Facts) -> DataFrame:
    return lexical.parse(_filled(g, [(p, x[0]) for p, x in SAMPLES.items()], False))


_SYMBOLS = [(p, *s.split(" ", 1)) for p, x in SAMPLES.items() for s in x[1].split(", ")]
_CALLS = [(p, *c.rsplit(" ", 4)) for p, x in SAMPLES.items() for c in x[2].split(", ") if c]
_RELATIONS = [(p, *r.split(" ")) for p, x in SAMPLES.items() for r in x[3].split(", ") if r]


@query(f"SELECT {_named('path')} AS path, kind, {_named('name')} AS qualified_name FROM nation, {_values(_SYMBOLS)} v(path, kind, name)")
def language_symbols(g: Facts) -> DataFrame:
    """Declarations in files of all eleven languages."""
    return python_code.symbols(_samples(g)).filter("kind <> 'import'").select("path", "kind", "qualified_name")


@query(f"SELECT {_named('path')} AS path, caller, form, target_kind, name, {_named('qualifier')} AS qualifier FROM nation, {_values(_CALLS)} v(path, caller, form, target_kind, name, qualifier)")
def language_calls(g: Facts) -> DataFrame:
    """Calls in files of all eleven languages, as they are looked up."""
    p = _samples(g)
    s = python_code.symbols(p).select(F.col("id").alias("caller"), F.col("name").alias("caller_name"))
    c = python_code.call_sites(p).join(s, "caller")
    return c.select("path", F.col("caller_name").alias("caller"), "form", "target_kind", "name", F.coalesce("qualifier", F.lit("None")).alias("qualifier"))


@query(f"SELECT {_named('path')} AS path, relation, {_named('name')} AS name FROM nation, {_values(_RELATIONS)} v(path, relation, name)")
def language_relations(g: Facts) -> DataFrame:
    """What types build on, by the nearest name it may have."""
    r = lexical.relations(_samples(g))
    return r.select(F.substring_index("request", "#", 1).alias("path"), "relation", F.col("names")[0].alias("name"))


_BROKEN = [("a{K}.go", "package x\nfunc a() { b( }\n", [("missing", "(", 2, 13)]), ("b{K}.rs", "fn f() {}\n)]", [("error", ")", 2, 1), ("error", "]", 2, 2)]), ("c{K}.py", "x = 1\nif :\n", [("error", "ERROR", 2, 4)]), ("d{K}.ts", "const a = 1;\n", [])]


@query(f"SELECT {_named('path')} AS path, kind, node_kind, start_line::BIGINT AS start_line, start_col::BIGINT AS start_col FROM nation, {_values([(p, *d) for p, _, ds in _BROKEN for d in ds])} v(path, kind, node_kind, start_line, start_col)")
def language_diagnostics(g: Facts) -> DataFrame:
    p = lexical.parse(_filled(g, [(p, t) for p, t, _ in _BROKEN], False))
    return lexical.diagnostics(p).select("path", "kind", "node_kind", "start_line", "start_col")


_PHP = """<?php
namespace App{K};
use Lib\\Mail;
class Job { public function handle() {} }
class Maker extends Base {
  private Mail $mail;
  public function __construct(private Job $made) {}
  public function make(Job $j, $free) {
    $j->handle(); $this->mail->send(); $this->made->handle(); $free->handle();
    $n = new Job(); $n->handle(); app(Mail::class)->send(); parent::up();
    dispatch(new Job());
  }
}
Route::get('/x', [Maker::class, 'make']);
Event::listen(Job::class, Maker::class);
"""
_RECEIVERS = [("handle", 9, "App{K}::Job", "parameter"), ("send", 9, "Lib::Mail", "property"), ("handle", 9, "App{K}::Job", "promoted_property"), ("handle", 9, "", ""), ("handle", 10, "App{K}::Job", "local_new"), ("send", 10, "Lib::Mail", "service_locator"), ("up", 10, "App{K}::Base", "parent_type")]


@query(f"SELECT 'app/p' || n_nationkey || '.php' AS path, name, line::BIGINT AS line, {_named('t')} AS receiver_type, source AS receiver_type_source FROM nation, {_values(_RECEIVERS)} v(name, line, t, source)")
def php_receivers(g: Facts) -> DataFrame:
    """What PHP receivers' types are known from."""
    c = python_code.call_sites(lexical.parse(_filled(g, [("app/p{K}.php", _PHP)], True)))
    none = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return c.filter("name IN ('handle', 'send', 'up')").select("path", "name", "line", none("receiver_type"), none("receiver_type_source"))


_STATED = [("DEPENDS_ON", "App{K}::Maker", "App{K}::Job", 7), ("RESOLVES", "App{K}::Maker::make", "Lib::Mail", 10), ("DISPATCHES", "App{K}::Maker::make", "App{K}::Job::handle", 11), ("ROUTES_TO", "Laravel::route::app/p{K}.php:14:1", "App{K}::Maker::make", 14), ("LISTENS_TO", "App{K}::Maker::handle|App{K}::Maker::__invoke", "App{K}::Job", 15)]


@query(f"SELECT kind, {_named('a')} AS origin, {_named('b')} AS target, line::BIGINT AS line FROM nation, {_values(_STATED)} v(kind, a, b, line)")
def framework_relations(g: Facts) -> DataFrame:
    r = framework.relations(framework.parse(_filled(g, [("app/p{K}.php", _PHP)], True)))
    return r.select("kind", F.when(F.size("from_names") > 0, F.array_join("from_names", "|")).otherwise(F.col("synthetic")).alias("origin"), F.array_join("to_names", "|").alias("target"), "line")


# Answers over a stored snapshot

_REPOSITORY = [
    ("src/m{K}.py", "def target{K}(x):\n    return x\n\n\ndef caller{K}():\n    target{K}(1)\n    target{K}(2)\n    target{K}(3)\n    target{K}(4)\n\n\ndef shared(x):\n    return x\n\n\ndef uses{K}():\n    shared(1)\n    gone(2)\n"),
    ("tests/test_m{K}.py", "from m{K} import target{K}\n\n\ndef test_it{K}():\n    target{K}(1)\n    target{K}(2)\n"),
    ("app/p{K}.php", _PHP),
    ("lib/q{K}.rs", "pub trait T{K} { fn go(&self); }\npub struct S{K} {}\nimpl T{K} for S{K} {\n    fn go(&self) {}\n}\n"),
    ("lib/z{K}.go", "package z\nfunc broken() { b( }\n"),
]
_MANIFESTS = [("composer.json", '{"name": "v/app", "require": {"laravel/framework": "^11"}, "autoload": {"psr-4": {"App\\\\": "app/"}}}'), ("pyproject.toml", '[project]\nname = "whole"\n'), ("lib/Cargo.toml", '[package]\nname = "lib"\n')]
_engines: dict[tuple[str, str], engine.Engine] = {}


def answers(g: Facts) -> engine.Engine:
    key = (g.spark.sparkContext.applicationId, g.root)
    if key not in _engines:
        files = _filled(g, _REPOSITORY, True)
        files = files.select("path", search.path_language(F.col("path")).alias("language"), search.path_role(F.col("path")).alias("role"), "text")
        store = Store(g.spark, f"{ensure_checkpoint_dir(g.spark)}/snapshot-{uuid.uuid4().hex}")
        graph.publish(store, files, g.spark.createDataFrame(_MANIFESTS, "path string, text string"))
        _engines[key] = engine.Engine(engine.open_store(store, workspace="samples"))
    return _engines[key]


#: kind, from, to, line (0: none), provenance, precision, and how many such edges a nation's files have.
_EDGES = [
    ("CALLS", "m{K}::caller{K}", "m{K}::target{K}", "tree_sitter", "heuristic", 4), ("CALLS", "tests::test_m{K}::test_it{K}", "m{K}::target{K}", "tree_sitter", "heuristic", 2), ("TESTS", "tests::test_m{K}::test_it{K}", "m{K}::target{K}", "heuristic", "heuristic", 1),
    ("CALLS", "App{K}::Maker::make", "App{K}::Job::handle", "resolver", "precise", 3), ("DISPATCHES", "App{K}::Maker::make", "App{K}::Job::handle", "heuristic", "heuristic", 1), ("DEPENDS_ON", "App{K}::Maker", "App{K}::Job", "heuristic", "heuristic", 1),
    ("ROUTES_TO", "Laravel::route::app/p{K}.php:14:1", "App{K}::Maker::make", "heuristic", "heuristic", 1),
    ("CONTAINS", "App{K}", "App{K}::Job", "heuristic", "heuristic", 1), ("CONTAINS", "App{K}", "App{K}::Maker", "heuristic", "heuristic", 1), ("CONTAINS", "App{K}::Job", "App{K}::Job::handle", "heuristic", "heuristic", 1),
    ("CONTAINS", "App{K}::Maker", "App{K}::Maker::mail", "heuristic", "heuristic", 1), ("CONTAINS", "App{K}", "App{K}::use Lib\\Mail", "heuristic", "heuristic", 1), ("CONTAINS", "App{K}::Maker", "App{K}::Maker::__construct", "heuristic", "heuristic", 1), ("CONTAINS", "App{K}::Maker", "App{K}::Maker::make", "heuristic", "heuristic", 1),
    ("CONTAINS", "lib::q{K}::T{K}", "lib::q{K}::T{K}::go", "heuristic", "heuristic", 1), ("IMPLEMENTS", "lib::q{K}::S{K}", "lib::q{K}::T{K}", "heuristic", "heuristic", 1), ("IMPLEMENTS", "lib::q{K}::S{K}::go", "lib::q{K}::T{K}::go", "heuristic", "heuristic", 1),
]


@query(f"SELECT kind, {_named('a')} AS origin, {_named('b')} AS target, provenance, precision, n::BIGINT AS edges FROM nation, {_values(_EDGES)} v(kind, a, b, provenance, precision, n)")
def stored_edges(g: Facts) -> DataFrame:
    """All edges of the stored snapshot: containment, heritage, impl, framework, calls (the strict tier is precise) and tests."""
    s = answers(g).s
    name = lambda c: s.symbols.select(F.col("id").alias(c), F.col("qualified_name").alias(f"{c}_name"))
    e = s.edges.join(name("src"), "src").join(name("dst"), "dst")
    return e.groupBy("kind", F.col("src_name").alias("origin"), F.col("dst_name").alias("target"), "provenance", "precision").agg(F.count("*").alias("edges"))


def _rows(g: Facts, answer: engine.Envelope, sections: list[str], columns: dict[str, str]) -> DataFrame:
    """The rows of sections of an answer, with their place; columns: name in the row to type."""
    out = [(name, i + 1, *[row.get(c) for c in columns]) for name in sections for i, row in enumerate(answer.data[name])]
    return g.spark.createDataFrame(out, "section string, position long, " + ", ".join(f"`{c}` {t}" for c, t in columns.items()))


@query("SELECT 'counts' AS section, 1::BIGINT AS position, 5 * n AS files, 2 * 25 AS diagnostics_files FROM (SELECT count(*) AS n FROM nation) WHERE n = 25")
def engine_status(g: Facts) -> DataFrame:
    a = answers(g).status()
    return g.spark.createDataFrame([("counts", 1, a.data["counts"][0]["files"], 2 * a.data["diagnostics_summary"][0]["files_with_diagnostics"])], "section string, position long, files long, diagnostics_files int")


@query("""SELECT kind, name, language, file_count::BIGINT AS file_count, row_number() OVER (ORDER BY file_count DESC, k, l) AS position FROM (VALUES ('top_level_directory', 'app', 'php', 25, 0, 1), ('top_level_directory', 'src', 'python', 25, 0, 3), ('top_level_directory', 'tests', 'python', 25, 0, 3.5),
  ('top_level_directory', 'lib', 'rust', 25, 0, 0), ('top_level_directory', 'lib', 'go', 25, 0, 10), ('cargo_package', 'lib', 'rust', 25, 1, 0), ('composer_psr4', 'v/app', 'php', 25, 2, 1), ('pyproject_package', 'whole', 'python', 50, 4, 3)) v(kind, name, language, file_count, k, l)""")
def engine_overview(g: Facts) -> DataFrame:
    a = answers(g).repo_map(limit=100)
    return _rows(g, a, ["overview"], {"kind": "string", "name": "string", "language": "string", "file_count": "long"}).drop("section")


@query("""SELECT path, source_role, source_classification, row_number() OVER (ORDER BY path) AS position FROM (SELECT unnest(['src/m3.py', 'tests/test_m3.py']) AS path, unnest(['production', 'test']) AS source_role, 'pyproject_metadata' AS source_classification) WHERE (SELECT count(*) FROM nation WHERE n_nationkey = 3) = 1""")
def engine_symbol_search(g: Facts) -> DataFrame:
    """Best matches with views; the test's file comes after the production file."""
    a = answers(g).symbol_search("m3::t", kinds=["function", "test"])
    return _rows(g, a, ["symbols"], {"path": "string", "source_role": "string", "source_classification": "string"}).drop("section")


@query("""SELECT * FROM (VALUES ('callers', 1::BIGINT, 'm3::caller3', 4::BIGINT, 1::BIGINT, '6,7,8', 'heuristic'), ('callers', 2, 'tests::test_m3::test_it3', 2, 0, '5,6', 'heuristic')) v(section, position, qualified_name, occurrence_count, locations_omitted, said, precision) WHERE (SELECT count(*) FROM nation WHERE n_nationkey = 3) = 1""")
def engine_callers(g: Facts) -> DataFrame:
    a = answers(g).callers("m3::target3")
    r = _rows(g, a, ["callers"], {"qualified_name": "string", "occurrence_count": "long", "locations_omitted": "long", "lines": "array<bigint>", "precision": "string"})
    return r.withColumn("said", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",")).drop("lines")


@query("""SELECT * FROM (VALUES ('callers', 1::BIGINT, 'App3::Maker::make', 'incoming', 'CALLS', 3::BIGINT), ('related_relations', 1, 'App3::Maker::make', 'incoming', 'DISPATCHES', 1)) v(section, position, qualified_name, direction, edge_kind, occurrence_count) WHERE (SELECT count(*) FROM nation WHERE n_nationkey = 3) = 1
  UNION ALL SELECT 'related_files', 1, 'app/p3.php', NULL, NULL, NULL""")
def engine_context(g: Facts) -> DataFrame:
    """Sections of one symbol's context, framework relations among them."""
    a = answers(g).context("App3::Job::handle")
    a.data["related_files"] = [{"qualified_name": r["path"]} for r in a.data["related_files"]]
    return _rows(g, a, ["callers", "callees", "implementations", "tests", "related_relations", "related_files"], {"qualified_name": "string", "direction": "string", "edge_kind": "string", "occurrence_count": "long"})


@query("""SELECT section, row_number() OVER (PARTITION BY section ORDER BY candidate NULLS FIRST, line) AS position, caller, coalesce(candidate, '') AS candidate, name, line FROM (
  SELECT 'syntax_call_candidates' AS section, 'm3::uses3' AS caller, 'm' || n_nationkey || '::shared' AS candidate, '' AS name, 17::BIGINT AS line FROM nation UNION ALL SELECT 'syntax_call_candidates', 'm3::uses3', NULL, 'gone', 18)""")
def engine_candidates(g: Facts) -> DataFrame:
    """What an unresolved caller may mean, all candidates of an ambiguous name among it."""
    a = answers(g).context("m3::uses3", limit=100)
    for r in a.data["syntax_call_candidates"]:
        r.update(caller=r["caller_name"], candidate=r["candidate_name"] or "", name=r["name"] or "", line=r["lines"][0])
    return _rows(g, a, ["syntax_call_candidates"], {"caller": "string", "candidate": "string", "name": "string", "line": "long"})


@query("""SELECT section, row_number() OVER (PARTITION BY section ORDER BY path, line, qualified_name) AS position, qualified_name FROM (
  SELECT 'changed_symbols' AS section, 'src/m' || n_nationkey || '.py' AS path, line, 'm' || n_nationkey || '::' || name || CASE WHEN name = 'shared' THEN '' ELSE n_nationkey::VARCHAR END AS qualified_name FROM nation, (VALUES ('target', 1), ('caller', 5), ('shared', 12), ('uses', 16)) v(name, line) WHERE n_nationkey % 5 = 2
  UNION ALL SELECT 'related_tests', '', 0, 'tests::test_m' || n_nationkey || '::test_it' || n_nationkey FROM nation WHERE n_nationkey % 5 = 2
  UNION ALL SELECT 'related_callers', '', 0, 'm' || n_nationkey || '::caller' || n_nationkey FROM nation WHERE n_nationkey % 5 = 2 UNION ALL SELECT 'related_callers', '', 0, 'tests::test_m' || n_nationkey || '::test_it' || n_nationkey FROM nation WHERE n_nationkey % 5 = 2)""")
def engine_diff_context(g: Facts) -> DataFrame:
    """Symbols, callers and tests of changed files, a deleted one among them."""
    paths = g.table("nation").filter("n_nationkey % 5 = 2").select(F.concat(F.lit("src/m"), "n_nationkey", F.lit(".py")).alias("path"), F.lit("modified").alias("change"))
    a = answers(g).diff_context(paths.unionByName(g.spark.createDataFrame([("src/m1.py", "deleted")], "path string, change string")), limit=100)
    return _rows(g, a, ["changed_symbols", "related_callers", "related_tests"], {"qualified_name": "string"})


@query("SELECT 'src/m' || n_nationkey || '.py' AS path, 17::BIGINT AS line, 5::BIGINT AS start_column FROM nation")
def engine_search(g: Facts) -> DataFrame:
    a = answers(g).search("SHARED(1", limit=100)
    return _rows(g, a, ["matches"], {"path": "string", "line": "long", "start_column": "long"}).drop("section", "position")
