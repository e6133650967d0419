"""Symbol ranking, text search, paging, byte limits, snippets and path rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors, file_language, language_role, path_language, path_role, valid_path  # noqa: F401 - part of this module's interface
from graphloom.functions.text import match_rank, signature  # noqa: F401
from graphloom.schema import FALLBACK, KIND_ORDER, LANGUAGES, ROLES, rank


def symbol_search(symbols: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None, not_kinds: list[str] | None = None, namespace: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """The best matches, in their order: filters come before the limit."""
    s = symbols.withColumn("match_rank", match_rank(query.strip())).filter("match_rank IS NOT NULL")
    if kinds:
        s = s.filter(F.col("kind").isin(kinds))
    if not_kinds:
        s = s.filter(~F.col("kind").isin(not_kinds))
    if namespace:
        s = s.filter((F.col("qualified_name") == namespace) | F.col("qualified_name").startswith(f"{namespace}::"))
    if path_prefix:
        p = path_prefix.rstrip("/")
        s = s.filter((F.col("path") == p) | F.col("path").startswith(f"{p}/"))
    return s.orderBy(*symbol_order(s.columns)).limit(limit)


def symbol_order(columns: list[str]) -> list[Column]:
    """The order of matches. Without role and language (of one file's symbols, say) these two say nothing."""
    kind = F.when(F.col("kind") == "impl_block", 1).when(F.col("kind") == "import", 2).otherwise(0)
    role = [rank("role", ROLES)] if "role" in columns else []
    language = [rank("language", LANGUAGES)] if "language" in columns else []
    place = [F.col(c) for c in ("qualified_name", "path", "start_line", "start_col", "end_line", "end_col") if c in columns]
    return [F.col("match_rank"), kind, *role, *language, *place, rank("kind", KIND_ORDER), F.col("id")]


def symbol_view(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with source_role, source_classification, package_name and package_root of their files (path, role,
    classification, package_name, package_root). A symbol of an unknown file goes by its path."""
    f = files.select("path", "role", "classification", "package_name", "package_root").withColumnsRenamed({"role": "_role", "classification": "_class"})
    j = symbols.drop("role", "classification", "package_name", "package_root").join(f, "path", "left")
    return j.withColumns({"source_role": F.coalesce("_role", path_role(F.col("path"))), "source_classification": F.coalesce("_class", F.lit(FALLBACK))}).drop("_role", "_class")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), body; a final line break ends the last line."""
    text = F.regexp_replace("text", "\r\n", "\n")
    text = F.when(text.endswith("\n"), F.expr("substr(text, 1, length(text) - 1)")).otherwise(text)
    return files.select("path", F.posexplode(F.split(text, "\n"))).select("path", (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("body"))


def text_search(files: DataFrame, needle: str, limit: int, case_sensitive: bool = False) -> DataFrame:
    """First match of each line, columns in code points (end exclusive), the line bounded to 512 around the match."""
    body = F.col("body") if case_sensitive else F.lower("body")
    at = F.instr(body, needle if case_sensitive else needle.lower())
    size = len(needle)
    start = F.greatest(F.lit(1), F.least(at - (512 - size) / 2, F.length("body") - 511)).cast("int")
    hit = lines(files).withColumn("start_column", at.cast("long")).filter("start_column > 0").orderBy("path", "line").limit(limit)
    return hit.select("path", "line", "start_column", (F.col("start_column") + size).alias("end_column"), F.substring(F.col("body"), start, F.lit(512)).alias("shown"), F.greatest(F.lit(0), F.length("body") - 512).cast("long").alias("omitted"))


def page(files: DataFrame, after: str | None, limit: int) -> DataFrame:
    """Keyset page: the next files by path after the cursor, with one more to tell whether the page is cut."""
    f = files if after is None else files.filter(F.col("path") > after)
    f = f.select("path", "language", "role", "package").orderBy("path").limit(limit + 1)
    return f.withColumn("beyond", F.row_number().over(Window.orderBy("path")) > limit)


def byte_limit(rows: DataFrame, order: list[str], budget: int, section: list[str] | None = None) -> DataFrame:
    """The longest prefix of each section whose JSON array fits the budget; without section columns all rows are one, which
    must be bounded already."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    w = (Window.partitionBy(*section) if section else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w) + F.count("*").over(w) + 1).filter(F.col("used") <= budget)


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Longest-prefix join: each path's ancestors meet the roots in an equi-join; the longest root wins, and at one root
    the last package by name. The repository's own root is ''; without any root both are null."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    best = up.join(roots.select("root", "package_name"), "root").groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "package_name", "root")).alias("v"))
    return paths.select("path").join(best, "path", "left").select("path", "v.package_name", F.col("v.root").alias("nearest"))


#: Two noncharacters that mark where a match begins and ends; texts hold them nowhere (Unicode keeps them for this).
_BEGIN, _END = "\ufdd0", "\ufdd1"
#: Characters shown of a line. Fixed value.
SHOWN = 512


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each match, with what is shown of its line; a few thousand matches at a time."""
    names = ["path", "line", "start_column", "end_column", "shown", "omitted"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for path, line, body, marked in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "body", "marked")), strict=True):
            head, *rest = marked.split(_BEGIN)
            at = len(head)
            for part in rest:
                n = part.index(_END)
                if n:
                    first = max(0, min(at - (SHOWN - n) // 2, len(body) - SHOWN))
                    rows.append((path, line, at + 1, at + 1 + n, body[first : first + SHOWN], max(0, len(body) - SHOWN)))
                    if len(rows) == 4096:
                        yield batch_of(rows)
                        rows = []
                at += len(part) - 1
    if rows:
        yield batch_of(rows)


def match_all(files: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Every match in every line: path, line, start_column, end_column (code points, end exclusive), shown, omitted.

    One replacement marks all matches of a line in their places, so look-around and word borders see the whole line; one
    pass over the marks gives the columns, in time that grows with the line. Patterns are Java's; empty matches don't
    count. The line is shown up to 512 characters around the match.
    """
    literal = r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    pattern = F.lit(f"(?{'u' if case_sensitive else 'iu'}:{query if regex else literal})")
    rows = lines(files).filter(F.regexp_like("body", pattern))
    marked = rows.withColumn("marked", F.regexp_replace("body", pattern, F.lit(f"{_BEGIN}$0{_END}")))
    return marked.mapInArrow(_places, "path string, line long, start_column long, end_column long, shown string, omitted long")


def snippets(symbols: DataFrame, files: DataFrame, most_lines: int = 20, most_chars: int = 4096) -> DataFrame:
    """id, path, snippet, truncated: a symbol's text, whole lines where columns aren't known, cut to the limits."""
    body = F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    count = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1).cast("int")
    said = F.array_join(F.slice(body, F.col("start_line").cast("int"), F.least(count, F.lit(most_lines))), "\n")
    if {"start_col", "end_col"} <= set(symbols.columns):
        last = F.length(F.get(body, F.col("end_line").cast("int") - 1))
        tail = F.when(count <= most_lines, F.greatest(F.lit(0), last - F.col("end_col") + 1)).otherwise(0)
        said = F.substring(said, F.col("start_col").cast("int"), (F.length(said) - F.col("start_col") + 1 - tail).cast("int"))
    j = symbols.join(files.select("path", "text"), "path")
    j = j.filter((F.col("start_line") >= 1) & (F.col("start_line") <= F.size(body))).withColumn("said", said)
    return j.select("id", "path", F.substring("said", 1, most_chars).alias("snippet"), ((count > most_lines) | (F.length("said") > most_chars)).alias("truncated"))
