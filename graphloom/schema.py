"""Closed vocabularies and their orders. Fixed values; an order is a rank column wherever it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ["rust", "php", "typescript", "python", "javascript", "java", "csharp", "shell", "cpp", "hcl", "go"]
KIND_ORDER = ["module", "function", "method", "struct", "class", "enum", "trait", "interface", "constant", "field", "property", "impl_block", "import", "configuration", "test", "type_alias"]
ROLES = ["production", "test", "example", "bench", "fixture", "generated", "vendor"]
PRECISION = ["textual", "heuristic", "syntax", "precise"]
EDGE_KINDS = ["CONTAINS", "DEFINES", "REFERENCES", "CALLS", "IMPORTS", "IMPLEMENTS", "EXTENDS", "TESTS", "DEPENDS_ON", "BINDS", "RESOLVES", "ROUTES_TO", "DISPATCHES", "LISTENS_TO", "SCHEDULES", "REGISTERS", "AUTHORIZES_WITH", "MODIFIED_BY"]
PROVIDER_SEVERITY = ["not_configured", "ready", "dormant", "initializing", "catching_up", "degraded"]
EXTENSIONS = {
    "rs": "rust", "php": "php", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "pyi": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "cs": "csharp", "sh": "shell", "bash": "shell", "zsh": "shell", "ksh": "shell",
    "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "ipp": "cpp", "tpp": "cpp", "inc": "cpp",
    "tf": "hcl", "tfvars": "hcl", "hcl": "hcl", "go": "go",
}
#: Lock files that end like sources.
LOCKS = [".terraform.lock.hcl", ".opentofu.lock.hcl"]
#: Facts of language servers and of the strict resolver rank alike, before what is read from syntax, Git and text.
PROVIDERS = ["rust_analyzer", "vtsls", "pyright", "jdtls", "csharp_ls", "bash_language_server", "clangd", "terraform_ls", "gopls"]
PROVENANCE = ["tree_sitter", "git", "text_search", "heuristic"]
#: What a file's project is known from, and the kind of group it gives in an overview, in their order.
CLASSIFICATIONS = {
    "cargo_metadata": "cargo_package", "composer_metadata": "composer_psr4", "package_json_metadata": "npm_package", "pyproject_metadata": "pyproject_package",
    "maven_metadata": "maven_module", "gradle_metadata": "gradle_project", "dotnet_project_metadata": "dotnet_project", "shell_project_metadata": "shell_project",
    "cpp_project_metadata": "cpp_project", "terraform_module_metadata": "terraform_module", "go_module_metadata": "go_module",
}
FALLBACK = "path_fallback"
GROUP_KINDS = ["top_level_directory", *CLASSIFICATIONS.values()]
#: The lookup domain of each kind that calls and references can mean.
TARGET_KIND = {"function": "function", "method": "method", "test": "test", "module": "configuration", "property": "configuration", "configuration": "configuration"}


def rank(column: str | Column, order: list[str]) -> Column:
    """The position of a value in its vocabulary; unknown values last."""
    return F.coalesce(F.nullif(F.array_position(F.lit(order), F.col(column) if isinstance(column, str) else column), F.lit(0)) - 1, F.lit(len(order))).cast("int")


def provenance_rank(column: str = "provenance") -> Column:
    """0 for language servers and the strict resolver, then by PROVENANCE."""
    return (rank(column, PROVENANCE) + 1) % (len(PROVENANCE) + 1)
