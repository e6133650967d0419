"""What others may add: readers of languages, sources of relations and of changes, barriers of freshness.

A Registry holds one reader a language; a second one for a language is refused. Readers give the columns of lexical.parse.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.schema import LANGUAGES
from graphloom.sources import lexical


class Extractor(Protocol):
    """files (path, text) of its language to path, symbols, calls, relations, diagnostics, errors."""

    def parse(self, files: DataFrame) -> DataFrame: ...


class RelationSource(Protocol):
    """Edges of a revision from elsewhere: kind, src, dst, seq, line, provenance, precision, owner."""

    def relations(self, revision: int) -> DataFrame: ...


class ChangeSource(Protocol):
    """path, previous_path, change, precision of what differs from a baseline."""

    def changes(self, scope: str, ref: str | None) -> DataFrame: ...


class FreshnessBarrier(Protocol):
    """Waits until what is published covers all that has happened, and says whether it does."""

    def wait(self, seconds: float) -> bool: ...


class Conflict(ValueError):
    pass


class _BuiltIn:
    parse = staticmethod(lexical.parse)


@dataclass
class Registry:
    """Readers by language, the built-in one for each that has no other."""

    own: dict[str, Extractor] = field(default_factory=dict)

    def add(self, language: str, reader: Extractor) -> None:
        if language not in LANGUAGES:
            raise Conflict(f"unknown language {language!r}")
        if language in self.own:
            raise Conflict(f"{language} already has a reader")
        self.own[language] = reader

    def parse(self, files: DataFrame) -> DataFrame:
        """Each file by the reader of its language, in one pass over the files for each reader."""
        f = files.withColumn("_language", search.path_language(F.col("path")))
        rest = f.filter(~F.coalesce(F.col("_language").isin(list(self.own)), F.lit(False))).drop("_language") if self.own else files
        out = _BuiltIn.parse(rest)
        for language, reader in sorted(self.own.items()):
            out = out.unionByName(reader.parse(f.filter(F.col("_language") == language).drop("_language")).select(*out.columns))
        return out
