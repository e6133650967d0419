"""Scalar functions of paths: languages, roles, validity, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import EXTENSIONS, LOCKS


def path_role(path: Column) -> Column:
    has = lambda *names: F.arrays_overlap(F.split(F.lower(path), "/"), F.lit(list(names)))
    return (
        F.when(has("vendor", "node_modules", "third_party"), "vendor").when(has("generated", "gen"), "generated").when(has("fixture", "fixtures", "testdata"), "fixture")
        .when(has("bench", "benches", "benchmark", "benchmarks"), "bench").when(has("example", "examples"), "example").when(has("test", "tests"), "test").otherwise("production")
    )


def _by_extension(extension: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[extension]


def path_language(path: Column) -> Column:
    """The language of a source: by its extension, but for lock files and what is below a folder named target."""
    parts = F.split(path, "/")
    build = F.arrays_overlap(parts, F.lit(["target"])) | F.element_at(parts, -1).isin(LOCKS)
    return F.when(~build, _by_extension(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def file_language(path: Column) -> Column:
    """The language a path's ending stands for, whatever the folder or the name before it: what queries go by."""
    return _by_extension(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_role(path: Column, language: Column) -> Column:
    """path_role, after the conventions of a language that go before it, and before those that refine production."""
    parts, low_parts = F.split(path, "/"), F.split(F.lower(path), "/")
    file, low = F.element_at(parts, -1), F.lower(F.element_at(parts, -1))
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    has = lambda *names: F.arrays_overlap(parts, F.lit(list(names)))
    go, script = language == "go", language.isin("typescript", "javascript")
    first = [
        ((language == "csharp") & F.arrays_overlap(low_parts, F.lit(["bin", "obj"])), "generated"),
        ((language == "hcl") & has(".terraform", ".terragrunt-cache"), "vendor"),
        (go & has("vendor"), "vendor"),
        (go & path.endswith("_test.go"), "test"),
        (go & (file.endswith(".pb.go") | file.endswith("_generated.go") | file.startswith("zz_generated.") | has("generated", "gen")), "generated"),
    ]
    then = [
        (script & (F.array_contains(low_parts, "__tests__") | file.contains(".test.") | file.contains(".spec.")), "test"),
        ((language == "python") & F.regexp_like(stem, F.lit(r"^test_|_test$")), "test"),
        ((language == "java") & (path.startswith("src/test/java/") | F.regexp_like(stem, F.lit("^Test|Tests?$"))), "test"),
        ((language == "csharp") & F.regexp_like(stem, F.lit("Tests?$")), "test"),
        ((language == "cpp") & F.regexp_like(low, F.lit(r"(_test|_tests|_unittest|_spec)\.[^.]+$")), "test"),
        ((language == "cpp") & F.regexp_like(low, F.lit(r"(\.pb|\.generated|\.gen|\.moc)\.[^.]+$")), "generated"),
        ((language == "hcl") & path.endswith(".tftest.hcl"), "test"),
    ]
    generic, out = path_role(path), F.lit("production")
    for condition, role in reversed(then):
        out = F.when(condition, role).otherwise(out)
    out = F.when(generic != "production", generic).otherwise(out)
    for condition, role in reversed(first):
        out = F.when(condition, role).otherwise(out)
    return out


def valid_path(path: Column) -> Column:
    """Whether a path is relative to its repository: not empty, absolute or of the home folder, without backslashes,
    dot components or a slash at the end."""
    return F.coalesce((path != "") & ~F.regexp_like(path, F.lit(r"^/|^~/|\\|/$|(^|/)\.{1,2}(/|$)")), F.lit(False))


def ancestors(path: Column) -> Column:
    """The folders a path lies in, from the repository itself ('') to its own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
