"""Projects from manifests, in DataFrame functions: their roots, names and roles, and the project of each source file.

Manifests are few and small beside sources: one row a manifest (path, text) gives one row a root, which sources meet by
an equi-join on their ancestors. A root is a folder, '' for the repository itself.

Cases: a manifest without a name, or one that can't be read, names its project after its folder ('repository' at the
top); several manifests of one folder and family are one project; a file below no root is classified by its path; null
texts are manifests that can't be read; empty tables give empty tables.
"""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.schema import CLASSIFICATIONS, FALLBACK, GROUP_KINDS, LANGUAGES, ROLES, rank

#: A family of projects: its classification, and its manifests, those that name projects first. Fixed values.
FAMILIES = {
    "cargo": ("cargo_metadata", ["Cargo.toml"]),
    "composer": ("composer_metadata", ["composer.json"]),
    "npm": ("package_json_metadata", ["package.json", "tsconfig.json", "jsconfig.json"]),
    "pyproject": ("pyproject_metadata", ["pyproject.toml", "setup.py", "setup.cfg"]),
    "maven": ("maven_metadata", ["pom.xml"]),
    "gradle": ("gradle_metadata", ["settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts"]),
    "dotnet": ("dotnet_project_metadata", ["*.csproj"]),
    "shell": ("shell_project_metadata", [".shellcheckrc", "shellcheckrc"]),
    "cpp": ("cpp_project_metadata", ["compile_commands.json", "compile_flags.txt", "CMakeLists.txt", "meson.build", "BUILD.bazel", "BUILD", ".clangd"]),
    "terraform": ("terraform_module_metadata", []),
    "go": ("go_module_metadata", ["go.mod", "go.work"]),
}
#: The families a language's files belong to; of several at one root the last counts.
LANGUAGE_FAMILIES = {
    "rust": ["cargo"], "php": ["composer"], "typescript": ["npm"], "javascript": ["npm"], "python": ["pyproject"], "java": ["maven", "gradle"],
    "csharp": ["dotnet"], "shell": ["shell"], "cpp": ["cpp"], "hcl": ["terraform"], "go": ["go"],
}
#: cargo metadata: calls at most, seconds and bytes each.
CARGO_CALLS, CARGO_SECONDS, CARGO_BYTES = 64, 30, 8 << 20


def _find(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def _named(file: Column, text: Column) -> Column:
    """The name a manifest states, or null."""
    own = F.when(text.contains("<parent>") & text.contains("</parent>"), F.regexp_replace(text, r"(?s)^.*?</parent>", "")).otherwise(text)
    return (
        F.when(file.isin("package.json", "composer.json"), F.nullif(F.trim(F.get_json_object(text, "$.name")), F.lit("")))
        .when(file == "pyproject.toml", _find(text, r"(?ms)^\s*\[project\]\s*$(?:(?!^\s*\[).)*?^\s*name\s*=\s*[\"']([^\"'\n]*)[\"']"))
        .when(file == "Cargo.toml", _find(text, r"(?ms)^\s*\[package\]\s*$(?:(?!^\s*\[).)*?^\s*name\s*=\s*[\"']([^\"'\n]*)[\"']"))
        .when(file == "pom.xml", _find(own, r"(?s)<artifactId>(.*?)</artifactId>"))
        .when(file.isin("settings.gradle", "settings.gradle.kts"), _find(text, r"(?m)^\s*rootProject\.name\s*=\s*[\"']?([^\"'\n]*)[\"']?\s*$"))
        .when(file == "go.mod", _find(text, r"(?m)^\s*module\s+(\S+)"))
        .when(file.endswith(".csproj"), F.coalesce(_find(text, r"(?s)<AssemblyName>(.*?)</AssemblyName>"), F.regexp_replace(file, r"\.csproj$", "")))
    )


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _psr4(manifests: DataFrame) -> DataFrame:
    """A root for each folder that autoload or autoload-dev of a composer.json names; one named in both is production."""
    c = manifests.filter(F.regexp_like("path", F.lit(r"(^|/)composer\.json$"))).withColumn("folder", _folder(F.col("path")))
    section = lambda name, role: c.select("folder", "text", F.explode(F.from_json(F.get_json_object("text", f"$.{name}['psr-4']"), "map<string,string>")).alias("space", "said"), F.lit(role).alias("role"))
    both = section("autoload", "production").unionByName(section("autoload-dev", "test"))
    said = F.when(F.col("said").startswith("["), F.from_json("said", "array<string>")).otherwise(F.array("said"))
    rows = both.select("folder", "text", "role", F.explode(said).alias("to")).filter(~F.regexp_like("to", F.lit(r"^/|(^|/)\.\.(/|$)")))
    steps = F.filter(F.split(F.concat_ws("/", "folder", "to"), "/"), lambda x: ~x.isin("", "."))
    name = F.coalesce(_named(F.lit("composer.json"), F.col("text")), F.nullif(F.col("folder"), F.lit("")), F.lit("repository"))
    rows = rows.select(F.lit("composer").alias("family"), F.array_join(steps, "/").alias("root"), name.alias("package_name"), "role")
    return rows.groupBy("family", "root", "package_name").agg(F.min_by("role", rank("role", ROLES)).alias("role"), F.lit(False).alias("is_test"))


def roots(manifests: DataFrame, sources: DataFrame | None = None, cargo: DataFrame | None = None) -> DataFrame:
    """family, root, package_name, role (of a PSR-4 root), is_test (of a .NET project).

    manifests: path, text. sources: path, for the folders with Terraform files. cargo: roots from cargo metadata, which
    take the place of those that Cargo.toml texts name.
    """
    file = F.element_at(F.split("path", "/"), -1)
    kind = F.when(file.endswith(".csproj"), "*.csproj").otherwise(file)
    family = F.create_map(*[F.lit(x) for f, (_, names) in FAMILIES.items() for n in names for x in (n, f)])
    order = F.create_map(*[F.lit(x) for _, names in FAMILIES.values() for i, n in enumerate(names) for x in (n, i)])
    m = manifests.select("path", "text", _folder(F.col("path")).alias("root"), family[kind].alias("family"), order[kind].alias("at"), file.alias("file")).filter("family IS NOT NULL AND family <> 'composer'")
    m = m.withColumn("named", _named(F.col("file"), F.col("text"))).filter("NOT (at > 0 AND family = 'npm' AND root = '')").filter("family <> 'cargo' OR named IS NOT NULL")
    m = m if cargo is None else m.filter("family <> 'cargo'")
    work = F.when(F.col("path").endswith("go.work"), F.when(F.col("root") == "", "go-workspace").otherwise(F.concat(F.lit("go-workspace:"), "root")))
    m = m.withColumn("package_name", F.coalesce("named", work, F.nullif(F.col("root"), F.lit("")), F.lit("repository")))
    test = (F.lower(F.coalesce(_find(F.col("text"), r"(?s)<IsTestProject>(.*?)</IsTestProject>"), F.lit(""))) == "true") | F.regexp_like(F.lower("path"), F.lit(r"\.tests?\.csproj$"))
    m = m.withColumn("is_test", (F.col("family") == "dotnet") & test)
    # A .NET folder with two projects keeps both: its files then belong to neither.
    each = m.filter("family = 'dotnet'").select("family", "root", "package_name", "is_test")
    one = m.filter("family <> 'dotnet'").groupBy("family", "root").agg(F.min_by("package_name", F.struct("at", "path")).alias("package_name"), F.lit(False).alias("is_test"))
    out = each.unionByName(one).withColumn("role", F.lit(None).cast("string")).select("family", "root", "package_name", "role", "is_test")
    out = out.unionByName(_psr4(manifests))
    if sources is not None:
        tf = sources.filter(F.col("path").endswith(".tf")).select(_folder(F.col("path")).alias("root")).distinct()
        tf = tf.select(F.lit("terraform").alias("family"), "root", F.coalesce(F.nullif(F.col("root"), F.lit("")), F.lit("repository")).alias("package_name"), F.lit(None).cast("string").alias("role"), F.lit(False).alias("is_test"))
        out = out.unionByName(tf)
    return out if cargo is None else out.unionByName(cargo.select("family", "root", "package_name", F.lit(None).cast("string").alias("role"), F.lit(False).alias("is_test")).distinct())


def classify(files: DataFrame, projects: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """path, language, role, classification, package_name, package_root of files (path, language).

    The longest root of a family of the file's language that holds it is its project. A PSR-4 root for tests and a .NET
    test project make production files tests; targets (path, role; from cargo metadata) say what a Rust file is. A C#
    file whose nearest root has several projects has none.
    """
    family = F.create_map(*[F.lit(x) for lang, fs in LANGUAGE_FAMILIES.items() for x in (lang, json.dumps(fs))])[F.col("language")]
    later = F.array_position(F.from_json(family, "array<string>"), F.col("family"))
    up = files.select("path", "language", F.explode(search.ancestors(F.col("path"))).alias("root"), F.from_json(family, "array<string>").alias("families"))
    up = up.select("path", "language", "root", F.explode("families").alias("family"))
    # Merged: Spark's guess at the size of tables from JSON and explode is far too low, and a broadcast would go by it.
    found = up.join(projects.hint("merge"), ["family", "root"]).withColumn("n", F.length("root"))
    best = found.groupBy("path", "language").agg(F.max(F.struct("n", later.alias("later"), "package_name", "family", "root", "role", "is_test")).alias("v"), F.max("n").alias("most"))
    tied = found.filter("language = 'csharp'").groupBy("path", "n").agg(F.count("*").alias("ties")).select("path", F.col("n").alias("most"), "ties")
    best = best.join(tied, ["path", "most"], "left").filter("coalesce(ties, 1) = 1").select("path", "v.*")
    kind = F.create_map(*[F.lit(x) for f, (c, _) in FAMILIES.items() for x in (f, c)])[F.col("family")]
    own = search.language_role(F.col("path"), F.col("language"))
    role = F.when((own == "production") & (F.col("language") == "php") & F.col("root").isNotNull(), F.coalesce("role", own)).when((own == "production") & F.coalesce("is_test", F.lit(False)), "test").otherwise(own)
    out = files.select("path", "language").join(best, "path", "left").withColumns({"role": role, "classification": F.coalesce(kind, F.lit(FALLBACK))})
    if targets is not None:
        said = targets.groupBy("path").agg(F.min_by("role", rank("role", ROLES)).alias("said"))
        out = out.join(said.hint("merge"), "path", "left").withColumn("role", F.when((F.col("language") == "rust") & (F.col("classification") != FALLBACK), F.coalesce("said", "role")).otherwise(F.col("role")))
    return out.select("path", "language", "role", "classification", "package_name", F.col("root").alias("package_root"))


def coverage(classified: DataFrame) -> DataFrame:
    """One row: the files in all, and those of each classification."""
    names = [*CLASSIFICATIONS, FALLBACK]
    return classified.agg(F.count("*").alias("total_files"), *[F.count_if(F.col("classification") == c).alias(f"{c}_files") for c in names])


def overview(classified: DataFrame, symbols: DataFrame) -> DataFrame:
    """kind, name, root, language, file_count, symbol_count of top-level folders and of projects."""
    n = symbols.groupBy("path").agg(F.count("*").alias("n"))
    f = classified.join(n, "path", "left")
    inner = F.col("path").contains("/")
    top = F.struct(F.lit("top_level_directory").alias("kind"), F.when(inner, F.split("path", "/")[0]).otherwise("(root)").alias("name"), F.when(inner, F.split("path", "/")[0]).alias("root"))
    kind = F.create_map(*[F.lit(x) for pair in CLASSIFICATIONS.items() for x in pair])[F.col("classification")]
    project = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.col("package_name").alias("name"), F.nullif(F.col("package_root"), F.lit("")).alias("root")))
    groups = f.select("language", "n", F.explode(F.array_compact(F.array(top, project))).alias("g"))
    return groups.groupBy("g.kind", "g.name", "g.root", "language").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbol_count"))


def overview_order() -> list[Column]:
    return [F.col("file_count").desc(), rank("kind", GROUP_KINDS), rank("language", LANGUAGES), F.col("root").asc_nulls_first(), F.col("name")]


def cargo_roots(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots and targets (path, role) from cargo metadata's JSON (base: the repository's absolute folder, json)."""
    kind = "packages array<struct<name:string,manifest_path:string,targets:array<struct<kind:array<string>,src_path:string>>>>"
    p = metadata.select("base", F.explode(F.from_json("json", kind)["packages"]).alias("p"))
    inner = lambda path: F.when(path.startswith(F.concat("base", F.lit("/"))), F.substring(path, F.length("base") + 2, F.length(path)))
    manifest = inner(F.col("p.manifest_path"))
    found = p.filter(manifest.isNotNull()).select(F.lit("cargo").alias("family"), _folder(manifest).alias("root"), F.col("p.name").alias("package_name"))
    t = p.select("base", F.explode("p.targets").alias("t"))
    role = F.when(F.array_contains("t.kind", "test"), "test").when(F.array_contains("t.kind", "example"), "example").when(F.array_contains("t.kind", "bench"), "bench").otherwise("production")
    targets = t.select(inner(F.col("t.src_path")).alias("path"), role.alias("role")).filter("path IS NOT NULL")
    return found.distinct(), targets


def cargo_metadata(spark: SparkSession, root: str, folders: list[str], command: tuple[str, ...] = ("cargo",)) -> DataFrame:
    """base, json: what cargo metadata says in the folders of a local repository. Runs on the driver, CARGO_CALLS times at
    most; a folder where cargo is missing, fails, takes too long or says too much gives no row."""
    rows = []
    for folder in sorted(folders)[:CARGO_CALLS]:
        manifest = f"{root}/{folder}/Cargo.toml" if folder else f"{root}/Cargo.toml"
        try:
            out = subprocess.run([*command, "metadata", "--format-version", "1", "--no-deps", "--offline", "--manifest-path", manifest], capture_output=True, timeout=CARGO_SECONDS, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            continue
        if len(out) <= CARGO_BYTES:
            rows.append((root.rstrip("/"), out.decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "base string, json string")
