"""Registered queries of sources and projects: routing, manifests, roots, classification, coverage and overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.plans.catalog import query
from graphloom.schema import CLASSIFICATIONS, EXTENSIONS, GROUP_KINDS, LANGUAGES
from graphloom.sources import manifests
from graphloom.sources.facts import Facts

_FOLDERS, _BUILD = ["src/", "target/", "x/targets/", "a/target/b/", ""], [False, True, False, True, False]


def _sql(x) -> str:
    """A list of Python values as DuckDB's."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(one(v) for v in x) + "]"


@query(f"""SELECT p_partkey, path, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR {_sql(_BUILD)}[p_partkey % 5 + 1] THEN '' ELSE lang END AS language, CASE WHEN p_partkey % 11 = 0 THEN 'hcl' ELSE lang END AS query_language
  FROM (SELECT p_partkey, {_sql(EXTENSIONS.values())}[p_partkey % {len(EXTENSIONS)} + 1] AS lang, {_sql(_FOLDERS)}[p_partkey % 5 + 1] || CASE WHEN p_partkey % 11 = 0 THEN '.terraform.lock.hcl' WHEN p_partkey % 13 = 0 THEN '.' || ext ELSE 'f' || p_partkey || '.' || ext END AS path
    FROM (SELECT p_partkey, {_sql(EXTENSIONS)}[p_partkey % {len(EXTENSIONS)} + 1] AS ext FROM part))""")  # fmt: skip
def source_languages(g: Facts) -> DataFrame:
    """Both routing rules over every extension, below build folders, as lock files and as names that begin with a dot."""
    k = F.col("p_partkey")
    at = lambda xs: F.element_at(F.lit(list(xs)), (k % len(list(xs)) + 1).cast("int"))
    ext = at(EXTENSIONS)
    name = F.when(k % 11 == 0, ".terraform.lock.hcl").when(k % 13 == 0, F.concat(F.lit("."), ext)).otherwise(F.concat(F.lit("f"), k, F.lit("."), ext))
    p = g.table("part").select("p_partkey", F.concat(at(_FOLDERS), name).alias("path"))
    return p.select("p_partkey", "path", F.coalesce(search.path_language(F.col("path")), F.lit("")).alias("language"), F.coalesce(search.file_language(F.col("path")), F.lit("")).alias("query_language"))


#: Manifests of a customer's folder by key: name, text, and the roots it gives: family, folder below, name (null: the folder), role, whether of tests.
_PROJECTS = [
    ("package.json", '{"name": "js-K"}', [("npm", "", "js-K", None, False)]),
    ("package.json", '{"name": "  "}', [("npm", "", None, None, False)]),
    ("tsconfig.json", "{}", [("npm", "", None, None, False)]),
    ("pyproject.toml", '[tool]\nname = "no"\n[project]\nversion = "1"\nname = "py-K"\n', [("pyproject", "", "py-K", None, False)]),
    ("setup.py", "setup()", [("pyproject", "", None, None, False)]),
    ("pom.xml", "<project><parent><artifactId>up</artifactId></parent><artifactId> mvn-K </artifactId></project>", [("maven", "", "mvn-K", None, False)]),
    ("settings.gradle", "rootProject.name = 'gr-K'\n", [("gradle", "", "gr-K", None, False)]),
    ("build.gradle.kts", "plugins {}", [("gradle", "", None, None, False)]),
    ("App.csproj", "<Project><AssemblyName>Net.K</AssemblyName><IsTestProject> True </IsTestProject></Project>", [("dotnet", "", "Net.K", None, True)]),
    ("My.Tests.csproj", "<Project/>", [("dotnet", "", "My.Tests", None, True), ("dotnet", "", "Other", None, False)]),
    (".shellcheckrc", "", [("shell", "", None, None, False)]),
    ("CMakeLists.txt", "project(x)", [("cpp", "", None, None, False)]),
    ("go.mod", "// m\nmodule ex.org/mK\n\ngo 1.22\n", [("go", "", "ex.org/mK", None, False)]),
    ("go.work", "use ./a", [("go", "", "go-workspace:sK", None, False)]),
    ("Cargo.toml", '[workspace]\nname = "no"\n[package]\nname = "crate-K"\n', [("cargo", "", "crate-K", None, False)]),
    ("composer.json", '{"name": "v/php-K", "autoload": {"psr-4": {"A\\\\": "src/", "B\\\\": ["lib", "./more"]}}, "autoload-dev": {"psr-4": {"T\\\\": "checks", "L\\\\": "lib", "U\\\\": "../up"}}}',
     [("composer", "/src", "v/php-K", "production", False), ("composer", "/lib", "v/php-K", "production", False), ("composer", "/more", "v/php-K", "production", False), ("composer", "/checks", "v/php-K", "test", False)]),
    ("main.tf", "", [("terraform", "", None, None, False)]),
]
_N = len(_PROJECTS)


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


def _manifests(g: Facts) -> tuple[DataFrame, DataFrame]:
    """Manifests (path, text) and sources (path) of all customers' folders."""
    k = F.col("c_custkey")
    at = lambda xs: F.replace(F.element_at(F.lit(xs), (k % _N + 1).cast("int")), F.lit("K"), k.cast("string"))
    folder = F.concat(F.lit("s"), k, F.lit("/"))
    s = g.table("customer")
    m = s.select(F.concat(folder, at([p[0] for p in _PROJECTS])).alias("path"), at([p[1] for p in _PROJECTS]).alias("text"))
    other = s.filter(k % _N == 9).select(F.concat(folder, F.lit("Other.csproj")).alias("path"), F.lit("").alias("text"))
    both = m.unionByName(other)
    return both.filter("NOT endswith(path, '.tf')"), both.filter("endswith(path, '.tf')").select("path")


_ROOTS = f"""SELECT family, 's' || c_custkey || sub AS root, coalesce(replace(name, 'K', c_custkey::VARCHAR), 's' || c_custkey) AS package_name, coalesce(role, '') AS role, is_test
  FROM customer JOIN {_values([(i, *r) for i, p in enumerate(_PROJECTS) for r in p[2]])} v(i, family, sub, name, role, is_test) ON c_custkey % {_N} = i"""


@query(_ROOTS)
def project_roots(g: Facts) -> DataFrame:
    """Manifests of every family, one folder a customer."""
    return manifests.roots(*_manifests(g)).withColumn("role", F.coalesce("role", F.lit("")))


#: Files of a customer's folder by key: path below, language, role, classification, name and root of their project.
_FILES = [
    (0, "x/f.ts", "typescript", "production", "package_json_metadata", "js-K", ""), (1, "__tests__/f.js", "javascript", "test", "package_json_metadata", "sK", ""), (2, "f.mts", "typescript", "production", "package_json_metadata", "sK", ""),
    (3, "p/f.py", "python", "production", "pyproject_metadata", "py-K", ""), (4, "test_f.pyi", "python", "test", "pyproject_metadata", "sK", ""), (5, "F.java", "java", "production", "maven_metadata", "mvn-K", ""),
    (6, "FTest.java", "java", "test", "gradle_metadata", "gr-K", ""), (7, "bench/F.java", "java", "bench", "gradle_metadata", "sK", ""), (8, "F.cs", "csharp", "test", "dotnet_project_metadata", "Net.K", ""), (8, "Obj/F.cs", "csharp", "generated", "dotnet_project_metadata", "Net.K", ""),
    (9, "F.cs", "csharp", "production", "path_fallback", None, None), (10, "f.zsh", "shell", "production", "shell_project_metadata", "sK", ""), (11, "f_test.cc", "cpp", "test", "cpp_project_metadata", "sK", ""), (11, "f.h", "cpp", "production", "cpp_project_metadata", "sK", ""),
    (12, "tests/f.pb.go", "go", "generated", "go_module_metadata", "ex.org/mK", ""), (13, "f.go", "go", "production", "go_module_metadata", "go-workspace:sK", ""), (14, "src/f.rs", "rust", "production", "cargo_metadata", "crate-K", ""),
    (15, "checks/F.php", "php", "test", "composer_metadata", "v/php-K", "/checks"), (15, "lib/x/F.php", "php", "production", "composer_metadata", "v/php-K", "/lib"), (15, "F.php", "php", "production", "path_fallback", None, None),
    (16, "a/f.tftest.hcl", "hcl", "test", "terraform_module_metadata", "sK", ""), (16, ".terraform/tests/f.tf", "hcl", "vendor", "terraform_module_metadata", "sK", ""),
]


def _files(g: Facts) -> DataFrame:
    k = F.col("c_custkey")
    each = F.create_map(*[x for i in range(_N) for x in (F.lit(i), F.array(*[F.lit(r[1]) for r in _FILES if r[0] == i]))])
    path = g.table("customer").select("c_custkey", F.explode(each[(k % _N).cast("int")]).alias("sub")).select(F.concat(F.lit("s"), k, F.lit("/"), F.col("sub")).alias("path"))
    return path.withColumn("language", search.path_language(F.col("path")))


def _classified(g: Facts) -> DataFrame:
    f = _files(g)
    m, tf = _manifests(g)
    return manifests.classify(f, manifests.roots(m, tf))


_CLASSES = f"""SELECT 's' || c_custkey || '/' || sub AS path, language, role, classification, replace(name, 'K', c_custkey::VARCHAR) AS package_name, 's' || c_custkey || root AS package_root
  FROM customer JOIN {_values(_FILES)} v(i, sub, language, role, classification, name, root) ON c_custkey % {_N} = i"""


@query(f"SELECT path, language, role, classification, coalesce(package_name, '') AS package_name, coalesce(package_root, '-') AS package_root FROM ({_CLASSES})")
def classified_files(g: Facts) -> DataFrame:
    """Nearest project, role and classification of files of every language."""
    return _classified(g).withColumns({"package_name": F.coalesce("package_name", F.lit("")), "package_root": F.coalesce("package_root", F.lit("-"))})


@query(f"SELECT count(*) AS total_files, {', '.join(f'''count(*) FILTER (classification = '{c}') AS {c}_files''' for c in [*CLASSIFICATIONS, 'path_fallback'])} FROM ({_CLASSES})")
def classification_coverage(g: Facts) -> DataFrame:
    return manifests.coverage(_classified(g))


_KINDS = ", ".join(f"('{c}', '{k}')" for c, k in CLASSIFICATIONS.items())


@query(f"""SELECT *, row_number() OVER (ORDER BY file_count DESC, list_position({_sql(GROUP_KINDS)}, kind), list_position({_sql(LANGUAGES)}, language), root NULLS FIRST, name) AS position FROM (
  SELECT kind, name, root, language, count(*) AS file_count, sum(n)::BIGINT AS symbol_count FROM (
    SELECT 'top_level_directory' AS kind, split_part(path, '/', 1) AS name, split_part(path, '/', 1) AS root, language, length(path) AS n FROM ({_CLASSES})
    UNION ALL SELECT k, package_name, package_root, language, length(path) FROM ({_CLASSES}) JOIN (VALUES {_KINDS}) m(c, k) ON c = classification) GROUP BY ALL)""")
def project_overview(g: Facts) -> DataFrame:
    """Groups by top-level folder and by project, in their order. A file has as many symbols here as its path has letters."""
    c = _classified(g)
    symbols = c.select("path", F.explode(F.sequence(F.lit(1), F.length("path"))))
    o = manifests.overview(c, symbols)
    return o.withColumn("position", F.row_number().over(Window.orderBy(*manifests.overview_order())).cast("long"))


_CARGO = '{"packages": [{"name": "c-K", "manifest_path": "/w/sK/Cargo.toml", "targets": [{"kind": ["lib"], "src_path": "/w/sK/src/lib.rs"}, {"kind": ["test"], "src_path": "/w/sK/src/lib.rs"}, {"kind": ["example", "x"], "src_path": "/w/sK/demo.rs"}, {"kind": ["bench"], "src_path": "/elsewhere/b.rs"}]}, {"name": "out", "manifest_path": "/other/Cargo.toml", "targets": []}]}'


@query("SELECT 's' || c_custkey || '/' || sub AS path, role, 'c-' || c_custkey AS package_name FROM customer, (VALUES ('src/lib.rs', 'production'), ('demo.rs', 'example'), ('tests/t.rs', 'test')) v(sub, role)")
def cargo_targets(g: Facts) -> DataFrame:
    """Roles of Rust files by the targets of cargo metadata, else by their paths."""
    k = F.col("c_custkey").cast("string")
    s = g.table("customer")
    found, targets = manifests.cargo_roots(s.select(F.lit("/w").alias("base"), F.replace(F.lit(_CARGO), F.lit("K"), k).alias("json")))
    files = s.select(F.explode(F.transform(F.lit(["src/lib.rs", "demo.rs", "tests/t.rs"]), lambda x: F.concat(F.lit("s"), k, F.lit("/"), x))).alias("path")).withColumn("language", F.lit("rust"))
    none = g.spark.createDataFrame([], "path string, text string")
    return manifests.classify(files, manifests.roots(none, cargo=found), targets).select("path", "role", "package_name")


@query(f"""SELECT path, coalesce(arg_max(name, length(root)), '') AS package_name, coalesce(arg_max(root, length(root)), '-') AS nearest FROM (
    SELECT path, root, name FROM (SELECT 'd' || (p_partkey % 7) || {_sql(['', '/a', '/a/b'])}[p_partkey % 3 + 1] || '/f' || p_partkey AS path FROM part UNION ALL SELECT 'top' || p_partkey FROM part)
    LEFT JOIN (SELECT 'd' || i || '/a' AS root, 'inner-' || i AS name FROM range(4) t(i) UNION ALL SELECT '', 'whole') r ON root = '' OR starts_with(path, root || '/')) GROUP BY path""")  # fmt: skip
def nearest_of_all(g: Facts) -> DataFrame:
    """Nearest roots, with a manifest at the top that owns what no other does, paths without a folder among it."""
    k = F.col("p_partkey")
    sub = F.element_at(F.lit(["", "/a", "/a/b"]), (k % 3 + 1).cast("int"))
    p = g.table("part")
    paths = p.select(F.concat(F.lit("d"), k % 7, sub, F.lit("/f"), k).alias("path")).unionByName(p.select(F.concat(F.lit("top"), k).alias("path")))
    roots = g.spark.createDataFrame([*[(f"d{i}/a", f"inner-{i}") for i in range(4)], ("", "whole")], "root string, package_name string")
    return search.nearest_root(paths, roots).select("path", F.coalesce("package_name", F.lit("")).alias("package_name"), F.coalesce("nearest", F.lit("-")).alias("nearest"))
