"""A folder of sources as a table, and the package names its manifests state. All in DataFrame functions.

Cases: files beyond the size limit and files that aren't UTF-8 are counted by `left_out`, not read; manifests without a
name give null; an empty folder gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import delta, search

#: Folders that never hold sources. Fixed values.
SKIPPED = [".git", "target"]

#: Files that say something of a language's projects: names, or endings that begin with a star. Fixed values.
METADATA = [
    (["Cargo.toml", "Cargo.lock", ".cargo/config", ".cargo/config.toml", "rust-toolchain", "rust-toolchain.toml"], ["rust"]),
    (["composer.json"], ["php"]),
    (["package.json"], ["typescript", "javascript"]),
    (["tsconfig.json"], ["typescript"]),
    (["jsconfig.json"], ["javascript"]),
    (["pyproject.toml", "setup.py", "setup.cfg"], ["python"]),
    (["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"], ["java"]),
    (["*.csproj", "*.sln", "*.slnx", "Directory.Build.props", "Directory.Build.targets", "Directory.Packages.props", "global.json"], ["csharp"]),
    ([".shellcheckrc", "shellcheckrc"], ["shell"]),
    (["compile_commands.json", "compile_flags.txt", "CMakeLists.txt", "meson.build", "BUILD", "BUILD.bazel", ".clangd"], ["cpp"]),
    ([".terraform.lock.hcl", ".opentofu.lock.hcl", ".terraform-version", ".opentofu-version", ".terraformrc", "terraform.rc", "tofu.rc"], ["hcl"]),
    (["go.mod", "go.sum", "go.work", "go.work.sum"], ["go"]),
]


def metadata_languages(path: Column) -> Column:
    """The languages whose projects a file describes; null for files that describe none."""
    out = None
    for names, languages in METADATA:
        hit = F.lit(False)
        for n in names:
            hit = hit | (path.endswith(n[1:]) if n[0] == "*" else (path == n) | path.endswith("/" + n))
        out = F.when(hit, F.lit(languages)) if out is None else out.when(hit, F.lit(languages))
    return out


def _scan(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    inner = F.expr(f"substring(path, instr(path, {_quoted(base)}) + {len(base)})")
    parts = F.split(inner, "/")
    ok = ~F.arrays_overlap(parts, F.lit(SKIPPED))
    return raw.select(inner.alias("path"), "length", "content").filter(ok)


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def read(spark: SparkSession, root: str, max_bytes: int = 4 << 20, max_files: int | None = None, max_total: int | None = None) -> DataFrame:
    """path (relative to root), language, role, text and n_bytes of each source file of at most max_bytes.

    With max_files or max_total (bytes), files are admitted in the order of their paths: one that doesn't fit is passed
    over, and later, smaller ones may still enter. For that the driver holds the names and sizes of all sources.
    """
    d = _scan(spark, root).withColumn("language", search.path_language(F.col("path"))).filter("language IS NOT NULL").filter(F.col("length") <= max_bytes)
    if max_files is not None or max_total is not None:
        sizes = [tuple(r) for r in d.select("path", "length").collect()]
        most = sum(n for _, n in sizes)
        kept = delta.admit(sizes, len(sizes) if max_files is None else max_files, max_bytes, most if max_total is None else max_total)
        d = d.join(spark.createDataFrame([(p,) for p in kept], "path string"), "path", "left_semi")
    d = d.filter(F.is_valid_utf8(F.col("content").cast("string")))
    return d.select("path", "language", search.language_role(F.col("path"), F.col("language")).alias("role"), F.col("content").cast("string").alias("text"), F.col("length").alias("n_bytes"))


def left_out(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """One row: files over the limit, and files within it that aren't UTF-8."""
    d = _scan(spark, root).filter(search.path_language(F.col("path")).isNotNull())
    big = F.col("length") > max_bytes
    return d.agg(F.count_if(big).alias("oversized"), F.count_if(~big & ~F.is_valid_utf8(F.col("content").cast("string"))).alias("not_utf8"))
