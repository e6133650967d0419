"""Scalar functions of names and texts: match ranks, signatures, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_rank(query: str) -> Column:
    q = query.lower()
    name, full = F.lower("name"), F.lower("qualified_name")
    return (
        F.when((name == q) | (full == q), 0).when(name.startswith(q), 1).when(full.startswith(q), 2).when(name.contains(q), 3).when(full.contains(q), 4)
    )


def signature(text: Column, most: int = 512) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def offset(text: Column, line: Column, column: Column) -> Column:
    """How many characters stand before a place (line and column from 1)."""
    before = F.slice(F.split(text, "\n", -1), F.lit(1), (line - 1).cast("int"))
    return F.length(F.array_join(before, "\n")) + F.when(line > 1, 1).otherwise(0) + column - 1


def advance(line: Column, column: Column, passed: Column) -> tuple[Column, Column]:
    """The place behind a text that begins at a place."""
    breaks = F.length(passed) - F.length(F.replace(passed, F.lit("\n"), F.lit("")))
    return line + breaks, F.when(breaks == 0, column + F.length(passed)).otherwise(F.length(F.substring_index(passed, "\n", -1)) + 1)
