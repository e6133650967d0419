"""Dealing rows to ranges of a number, with a search tree instead of a scan over all bounds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Children of a node of the search tree.
FAN = 16


def quantile_cuts(rows: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 distinct whole numbers, ascending, that cut rows into ranges of like size."""
    share = [i / parts for i in range(1, parts)]
    at = F.col(key).cast("double") if _wide(rows, key) else F.col(key)
    return sorted({int(c) for c in rows.agg(F.percentile_approx(at, share, 20_000)).first()[0] or []}) if share else []


def _wide(rows: DataFrame, key: str) -> bool:
    """Whether the key is of decimals beyond a long, without places."""
    return rows.schema[key].dataType.simpleString().startswith("decimal")


def with_range(rows: DataFrame, key: str, cuts: list[int], name: str) -> DataFrame:
    """Adds name, the number of cuts (ascending, distinct) that are at most rows[key], a long or a decimal without places; 0 for a null key.

    The cuts are the separators of a tree of FAN children a node, one projection a level. So a row costs FAN comparisons
    for each of log_FAN(cuts) levels, whatever the number of ranges.
    """
    depth = 1
    while FAN**depth <= len(cuts):
        depth += 1
    kind = "decimal(38,0)" if _wide(rows, key) else "bigint"
    rows = rows.withColumn(name, F.lit(0))
    for level in range(depth):
        width = FAN ** (depth - level - 1)
        nodes = []
        for first in range(0, len(cuts) + 1, FAN * width):
            at = (first + width * i - 1 for i in range(1, FAN))
            nodes.append([cuts[i] for i in at if i < len(cuts)])
        table = F.from_json(F.lit(json.dumps(nodes)), f"array<array<{kind}>>")
        below = F.size(F.filter(F.get(table, F.col(name)), lambda cut: cut <= F.col(key)))
        rows = rows.withColumn(name, F.col(name) * FAN + F.greatest(below, F.lit(0)))
    return rows
