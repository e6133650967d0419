"""The seven questions to one published snapshot: status, repo_map, search, symbol_search, context, callers, diff_context.

A snapshot is a stored revision (open_store), or tables at hand. Each answer is an Envelope of bounded sections. A section
is a lazy DataFrame until the answer is made; then its first limit + 1 rows come to the driver (501 at most), so what is
cut off is known exactly, and rows are dropped from the end until the section's JSON fits its bytes. Nothing is guessed: a
name that several symbols have is an error that says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from graphloom.operators import delta, quality, related, resolve, search
from graphloom.schema import PROVIDER_SEVERITY
from graphloom.sources import graph, manifests
from graphloom.sources.precise import NONE, Provider
from graphloom.sources.store import NotFresh, Store

#: Limits of requests and answers. Fixed values.
DEFAULT_LIMIT, MOST, QUERY_CHARS, FILTER_VALUES, PACKAGE_CHARS, FRESH_ATTEMPTS = 20, 500, 1024, 16, 256, 3
FRAMEWORK = ["DEPENDS_ON", "BINDS", "RESOLVES", "ROUTES_TO", "DISPATCHES", "LISTENS_TO", "SCHEDULES", "REGISTERS", "AUTHORIZES_WITH"]
#: KiB of JSON that a section may have. Fixed values.
SECTION_KIB = {
    "status": {"providers": 16, "diagnostics": 128}, "repo_map": {"files": 256, "overview": 64}, "search": {"matches": 256}, "symbol_search": {"symbols": 128},
    "context": {"source": 16, "callers": 96, "callees": 96, "implementations": 64, "tests": 64, "related_relations": 64, "syntax_call_candidates": 96, "related_files": 32},
    "callers": {"callers": 128, "syntax_candidates": 192},
    "diff_context": {"changed_files": 96, "changed_symbols": 128, "related_callers": 128, "related_tests": 96, "related_relations": 96, "related_call_candidates": 128},
}
#: Of fixed parts, such as the symbol asked for.
OTHER_KIB = 64


class InvalidRequest(ValueError):
    pass


class SymbolNotFound(LookupError):
    pass


class AmbiguousSymbol(LookupError):
    """Several symbols have the name; candidates are the first of them."""

    def __init__(self, name: str, candidates: list[Row]):
        super().__init__(f"{name!r} names {len(candidates)} symbols or more")
        self.candidates = candidates


class StaleReference(LookupError):
    """An id or a cursor of another revision."""


@dataclass
class Envelope:
    revision: int
    fresh: bool
    data: dict[str, list[dict]]
    truncation: list[tuple[str, str, int]] = field(default_factory=list)

    @property
    def truncated(self) -> bool:
        return bool(self.truncation)

    def to_json(self) -> str:
        return json.dumps({"revision": self.revision, "freshness": "fresh" if self.fresh else "stale", "truncated": self.truncated, "truncation": [dict(section=s, cause=c, limit=n) for s, c, n in self.truncation], "data": self.data}, ensure_ascii=False, default=str)


@dataclass
class Snapshot:
    """Tables of one revision. files: path, language, role, classification, package_name, package_root, text,
    diagnostic_count; symbols: id, language, name, qualified_name, container, kind, path, range; edges: kind, src, dst, seq,
    line, provenance, precision, owner; sites: resolved call sites; diagnostics: those that are kept."""

    revision: int
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    sites: DataFrame
    diagnostics: DataFrame
    fresh: bool = True
    workspace: str = ""

    def catalog(self) -> DataFrame:
        return resolve.callable_catalog(self.symbols)


def build(files: DataFrame, revision: int = 1, manifest_files: DataFrame | None = None, uses_framework: bool | None = None) -> Snapshot:
    """The snapshot of source files (path, language, role, text and, where there is one, package), not stored."""
    return Snapshot(revision, **graph.tables(files, manifest_files, uses_framework))


def open_store(store: Store, revision: int | None = None, workspace: str = "") -> Snapshot:
    """A published revision, the newest by default. Its tables are read, nothing is parsed."""
    revision = revision or store.current()
    if not revision:
        raise NotFresh("nothing is published")
    return Snapshot(revision, **{t: store.read(t, revision) for t in ("files", "symbols", "edges", "sites", "diagnostics")}, workspace=workspace or store.root, fresh=not store.revoked(revision))


#: What an answer says of a symbol.
VIEW = ["id", "language", "name", "qualified_name", "kind", "path", "start_line", "start_col", "end_line", "end_col", "signature", "provenance", "precision", "source_role", "source_classification", "package_name", "package_root"]


class Engine:
    """providers: language to a precise provider. renew: called where a fresh snapshot is asked for and this one isn't; it
    waits for the next and returns it, or None. bounded_work: relations are taken from the first edges by seq that a
    section's budget allows, and cut answers say so; without it all edges count."""

    def __init__(self, snapshot: Snapshot, providers: dict[str, Provider] | None = None, renew: Callable[[], Snapshot | None] | None = None, bounded_work: bool = False):
        self.s, self.providers, self.renew, self.bounded_work = snapshot, providers or {}, renew, bounded_work
        if {"start_col", "signature", "provenance"} - set(snapshot.symbols.columns):
            raise ValueError("symbols lack columns of a view")

    # Requests

    def _check(self, allow_stale: bool, package: str | None = None, **filters: list | None) -> str | None:
        """Checks a request, then the snapshot; returns the package as it is compared."""
        for name, values in filters.items():
            if values and len(values) > FILTER_VALUES:
                raise InvalidRequest(f"{name}: at most {FILTER_VALUES} values")
            if any(not v for v in values or ()):
                raise InvalidRequest(f"{name}: an empty value")
        if package is not None:
            package = package.strip()
            if not package or len(package) > PACKAGE_CHARS:
                raise InvalidRequest(f"package: 1 to {PACKAGE_CHARS} characters")
        for _ in range(FRESH_ATTEMPTS):
            if allow_stale or self.s.fresh or self.renew is None:
                break
            self.s = self.renew() or self.s
        if not allow_stale and not self.s.fresh:
            raise NotFresh(f"revision {self.s.revision} is not fresh")
        return package

    @staticmethod
    def _limit(limit: int | None) -> int:
        if limit is not None and limit < 0:
            raise InvalidRequest("limit is negative")
        return min(DEFAULT_LIMIT if limit is None else limit, MOST)

    @staticmethod
    def _query(text: str) -> str:
        if not text or len(text) > QUERY_CHARS:
            raise InvalidRequest(f"a query has 1 to {QUERY_CHARS} characters")
        return text

    def _answer(self, question: str, sections: dict[str, tuple[DataFrame, list[Column], int]], cut: list[tuple[str, str, int]] = ()) -> Envelope:
        """sections: name to (rows, order, limit)."""
        out = Envelope(self.s.revision, self.s.fresh, {}, [*cut])
        for name, (df, order, limit) in sections.items():
            budget = SECTION_KIB.get(question, {}).get(name, OTHER_KIB) << 10
            rows = (df.orderBy(*order) if order else df).limit(limit + 1).collect()
            if len(rows) > limit:
                rows = rows[:limit]
                out.truncation.append((name, "item_limit", limit))
            kept, used = [], 2
            for r in rows:
                row = r.asDict(recursive=True)
                used += len(json.dumps(row, ensure_ascii=False, default=str).encode()) + bool(kept)
                if used > budget:
                    out.truncation.append((name, "serialized_bytes", budget))
                    break
                kept.append(row)
            out.data[name] = kept
        out.truncation = sorted(set(out.truncation))
        return out

    def _filtered(self, df: DataFrame, path_prefix: str | None, package: str | None, roles: list | None, not_roles: list | None, languages: list | None) -> DataFrame:
        if path_prefix:
            p = path_prefix.rstrip("/")
            df = df.filter((F.col("path") == p) | F.col("path").startswith(f"{p}/"))
        if languages:
            df = df.filter(F.col("language").isin(languages))
        if package or roles or not_roles:
            f = self.s.files
            f = f.filter(F.col("package_name") == package) if package else f
            f = f.filter(F.col("role").isin(roles)) if roles else f
            f = f.filter(~F.col("role").isin(not_roles)) if not_roles else f
            df = df.join(f.select("path"), "path", "left_semi")
        return df

    def find(self, symbol: str | int, revision: int | None = None) -> Row:
        """By (id, revision), or by simple or qualified name, which only one symbol may have (case matters)."""
        s = self.s.symbols
        if revision is not None:
            if revision != self.s.revision:
                raise StaleReference(f"revision {revision} is not the published {self.s.revision}")
            rows = s.filter(F.col("id") == symbol).limit(2).collect()
        else:
            rows = s.filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol)).orderBy("id").limit(DEFAULT_LIMIT + 1).collect()
        if not rows:
            raise SymbolNotFound(str(symbol))
        if len(rows) > 1:
            raise AmbiguousSymbol(str(symbol), rows[:DEFAULT_LIMIT])
        return rows[0]

    def _anchor(self, row: Row) -> DataFrame:
        return self.s.symbols.sparkSession.createDataFrame([(row["id"],)], f"id {dict(self.s.symbols.dtypes)['id']}")

    def _view(self, symbols: DataFrame) -> DataFrame:
        return search.symbol_view(symbols, self.s.files).select(*VIEW)

    def _described(self, df: DataFrame) -> DataFrame:
        """Relations with what is known of the other end's file."""
        f = self.s.files.select("path", F.col("role").alias("source_role"), F.col("classification").alias("source_classification"), "package_name")
        return df.join(f, "path", "left")

    def _edges(self, section: str, anchors: DataFrame, kinds: list[str], incoming: bool, limit: int, cut: list) -> DataFrame:
        """The anchors' edges, all of them or as many as the section's work budget allows."""
        near = "dst" if incoming else "src"
        e = self.s.edges.filter(F.col("kind").isin(kinds)).join(anchors.select(F.col("id").alias(near)), near, "left_semi")
        if not self.bounded_work:
            return e
        e, more = quality.within_budget(e, limit)
        if more:
            cut.append((section, "work_limit", limit))
        return e

    def _related(self, section: str, anchors: DataFrame, kinds: list[str], incoming: bool, limit: int, cut: list) -> DataFrame:
        return related.related(self._edges(section, anchors, kinds, incoming, limit, cut), self.s.symbols, anchors, kinds, incoming)

    def _candidates(self, anchors: DataFrame, limit: int, own_only: bool = False, others_only: bool = False) -> DataFrame:
        """Call sites that may be calls of the anchors, and their own that aren't resolved, with names for the order."""
        g = related.site_groups(self.s.sites, self.s.catalog(), anchors, limit)
        g = g.filter("caller = anchor") if own_only else g.filter("caller <> anchor") if others_only else g
        name = self.s.symbols.select("id", "qualified_name", "path")
        g = g.join(name.select(F.col("id").alias("caller"), F.col("qualified_name").alias("caller_name"), "path"), "caller")
        return g.join(name.select(F.col("id").alias("candidate"), F.col("qualified_name").alias("candidate_name"), F.col("path").alias("candidate_path")), "candidate", "left")

    def _precise(self, row: Row, directions: list[str], limit: int) -> tuple[DataFrame | None, dict]:
        """What the provider of the symbol's language knows of it, joined to symbols, and the state of the provider. Facts
        of another revision don't count."""
        p = self.providers.get(row["language"])
        if p is None:
            return None, {"name": None, "state": "not_configured"}
        found = p.enrich(self.s.revision, row, tuple(directions), limit)
        state = found.state if found.state != "ready" or found.revision == self.s.revision else "catching_up"
        info = {"name": p.name, "state": state}
        if state != "ready":
            return None, info
        spark, sym = self.s.symbols.sparkSession, self.s.symbols
        rows = spark.createDataFrame([(i, r.direction, r.name, r.path, r.line, r.col, max(r.occurrences, len(r.lines), 1), list(r.lines[: related.PLACES]), r.provenance) for i, r in enumerate(found.relations)], "point long, direction string, name string, path string, line long, col long, n long, said array<bigint>, provenance string")
        at = delta.innermost(rows.select("point", "path", "name", "line", "col"), sym).select("point", "id")
        rows = rows.join(at, "point").groupBy("direction", "id").agg(F.sum("n").alias("occurrence_count"), F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("point", "said"))), lambda x: x["said"])), 1, related.PLACES).alias("lines"), F.min_by("provenance", "point").alias("provenance"))
        rows = rows.join(sym.select("id", "qualified_name", F.col("kind").alias("symbol_kind"), "path"), "id")
        rows = rows.withColumns({"anchor": F.lit(row["id"]), "edge_kind": F.lit("CALLS"), "locations_omitted": F.greatest(F.lit(0), F.col("occurrence_count") - F.size("lines")), "precision": F.lit("precise")})
        return rows, info

    @staticmethod
    def _merged(precise: DataFrame | None, direction: str, syntax: DataFrame) -> DataFrame:
        if precise is None:
            return syntax
        return delta.prefer_precise(precise.filter(F.col("direction") == direction).select(*syntax.columns), syntax)

    def _provider(self, info: dict) -> DataFrame:
        return self.s.symbols.sparkSession.createDataFrame([(info["name"], info["state"])], "name string, state string")

    # The seven questions

    def status(self, limit: int | None = 100) -> Envelope:
        s, n, spark = self.s, self._limit(limit), self.s.symbols.sparkSession
        row = delta.counts({"files": s.files, "symbols": s.symbols, "edges": s.edges}, s.sites)
        states = [(language, p.name, p.state(s.revision)) for language, p in sorted(self.providers.items())]
        worst = max((x[2] for x in states), key=PROVIDER_SEVERITY.index, default=NONE)
        total, first = quality.diagnostics_summary(s.files, s.diagnostics, n)
        return self._answer("status", {
            "workspace": (spark.createDataFrame([(s.workspace, s.revision, "ready", "fresh" if s.fresh else "stale", worst)], "workspace string, revision long, status string, freshness string, provider_state string"), [], 1),
            "counts": (row, [], 1), "providers": (spark.createDataFrame(states, "language string, name string, state string"), [F.col("language")], MOST),
            "coverage": (manifests.coverage(s.files), [], 1), "diagnostics_summary": (total, [], 1), "diagnostics": (first, quality.diagnostic_order(), n),
        })

    def overview(self) -> DataFrame:
        """Groups by top-level folder and by project, each with its languages' files and symbols."""
        return manifests.overview(self.s.files, self.s.symbols)

    def repo_map(self, languages=None, roles=None, not_roles=None, package=None, path_prefix=None, cursor: dict | None = None, limit: int | None = None, allow_stale: bool = False) -> Envelope:
        """Files by path; next_cursor goes on behind the last one. A cursor keeps its filters, its workspace and its revision."""
        package = self._check(allow_stale, package, languages=languages, roles=roles, not_roles=not_roles)
        if limit == 0:
            raise InvalidRequest("limit is 0")
        scope = dict(languages=languages, roles=roles, not_roles=not_roles, package=package, path_prefix=path_prefix)
        if cursor:
            if any(v for v in scope.values()):
                raise InvalidRequest("a cursor brings its own filters")
            if cursor["revision"] != self.s.revision or cursor["workspace"] != self.s.workspace:
                raise StaleReference(f"the cursor is of revision {cursor['revision']} of {cursor['workspace']!r}")
            scope = cursor["scope"]
        f = self._filtered(self.s.files, scope["path_prefix"], scope["package"], scope["roles"], scope["not_roles"], scope["languages"])
        f = f.filter(F.col("path") > cursor["after"]) if cursor else f
        sections = {} if cursor else {"overview": (self.overview(), manifests.overview_order(), self._limit(limit))}
        out = self._answer("repo_map", {**sections, "files": (f.select("path", "language", "role", "classification", "package_name", "package_root", "diagnostic_count"), [F.col("path")], self._limit(limit))})
        cut = any(section == "files" for section, _, _ in out.truncation) and out.data["files"]
        out.data["next_cursor"] = [{"workspace": self.s.workspace, "revision": self.s.revision, "after": out.data["files"][-1]["path"], "scope": scope}] if cut else []
        return out

    def search(self, query: str, regex: bool = False, case_sensitive: bool = False, limit: int | None = None, allow_stale: bool = False) -> Envelope:
        self._check(allow_stale)
        return self._answer("search", {"matches": (search.match_all(self.s.files, self._query(query), regex, case_sensitive), [F.col("path"), F.col("line"), F.col("start_column")], self._limit(limit))})

    def symbol_search(self, query: str, languages=None, kinds=None, not_kinds=None, namespace=None, roles=None, not_roles=None, package=None, path_prefix=None, limit: int | None = None, allow_stale: bool = False) -> Envelope:
        q, n = self._query(query.strip()), self._limit(limit)
        package = self._check(allow_stale, package, languages=languages, kinds=kinds, not_kinds=not_kinds, roles=roles, not_roles=not_roles)
        s = self._filtered(self.s.symbols, path_prefix, package, roles, not_roles, languages)
        found = search.symbol_search(search.symbol_view(s, self.s.files).withColumn("role", F.col("source_role")), q, n + 1, kinds, not_kinds, namespace)
        return self._answer("symbol_search", {"symbols": (found.select(*VIEW, "match_rank"), [], n)})

    def context(self, symbol: str | int, revision: int | None = None, limit: int | None = None, allow_stale: bool = False) -> Envelope:
        self._check(allow_stale)
        s, n, row, cut = self.s, self._limit(limit), self.find(symbol, revision), []
        a, order = self._anchor(row), related.related_order()
        mine = s.symbols.join(a, "id", "left_semi")
        precise, info = self._precise(row, related.DIRECTIONS, n)
        near = {
            "callers": self._merged(precise, "incoming", self._related("callers", a, ["CALLS"], True, n, cut)),
            "callees": self._merged(precise, "outgoing", self._related("callees", a, ["CALLS"], False, n, cut)),
            "implementations": self._related("implementations", a, ["IMPLEMENTS"], True, n, cut),
        }
        tests = related.tests(self._edges("tests", a, ["CALLS"], True, n, cut), s.symbols, a)
        both = self._related("related_relations", a, FRAMEWORK, True, n, cut).unionByName(self._related("related_relations", a, FRAMEWORK, False, n, cut))
        maybe = self._candidates(a, n)
        for ids, is_own, key in ((near["callees"], True, "candidate"), (near["callers"], False, "caller")):
            known = ids.select(F.col("id").alias(key)).distinct().withColumn("_known", F.lit(True))
            own = F.col("caller") == F.col("anchor")
            maybe = maybe.join(known, key, "left").filter(~(F.coalesce("_known", F.lit(False)) & (own if is_own else ~own))).drop("_known")
        out = {"symbol": (self._view(mine), [], 1), "source": (search.snippets(mine, s.files), [], 1), "provider": (self._provider(info), [], 1)}
        out |= {k: (self._described(df), order, n) for k, df in near.items()}
        out["tests"] = (self._described(tests), related.tests_order(), n)
        out["related_relations"] = (self._described(both), related.directed_order(), n)
        out["syntax_call_candidates"] = (maybe, related.site_order(), n)
        paths = maybe.filter("caller <> anchor").select("path").unionByName(maybe.filter("candidate IS NOT NULL").select(F.col("candidate_path").alias("path")))
        for df in [*near.values(), tests, both]:
            paths = paths.unionByName(df.select("path"))
        out["related_files"] = (paths.distinct(), [F.col("path")], n)
        return self._answer("context", out, cut)

    def callers(self, symbol: str | int, revision: int | None = None, limit: int | None = None, allow_stale: bool = False) -> Envelope:
        self._check(allow_stale)
        s, n, row, cut = self.s, self._limit(limit), self.find(symbol, revision), []
        a = self._anchor(row)
        precise, info = self._precise(row, ["incoming"], n)
        found = self._merged(precise, "incoming", self._related("callers", a, ["CALLS"], True, n, cut))
        maybe = self._candidates(a, n, others_only=True).join(found.select(F.col("id").alias("caller")).distinct(), "caller", "left_anti")
        return self._answer("callers", {
            "target": (self._view(s.symbols.join(a, "id", "left_semi")), [], 1), "provider": (self._provider(info), [], 1),
            "callers": (self._described(found), related.related_order(), n), "syntax_candidates": (maybe, related.site_order(), n),
        }, cut)

    def diff_context(self, changes: DataFrame, limit: int | None = None, allow_stale: bool = False) -> Envelope:
        """changes: path, change (added, deleted, modified, renamed) and maybe previous_path. The first limit paths give
        the changed symbols (those declared in them), the first limit of these give the relations."""
        self._check(allow_stale)
        s, n, cut = self.s, self._limit(limit), []
        paths = changes.filter("change <> 'deleted'").select("path").distinct().orderBy("path").limit(n)
        changed = s.symbols.join(paths, "path", "left_semi")
        place = [F.col("path"), F.col("start_line"), F.col("start_col"), F.col("id")]
        a = changed.orderBy(*place).select("id").limit(n)
        both = self._related("related_relations", a, FRAMEWORK, True, n, cut).unionByName(self._related("related_relations", a, FRAMEWORK, False, n, cut))
        tests = related.tests(self._edges("related_tests", a, ["CALLS"], True, n, cut), s.symbols, a)
        return self._answer("diff_context", {
            "changed_files": (changes, [F.col("path")], n),
            "changed_symbols": (self._view(changed), place, n),
            "related_callers": (self._described(self._related("related_callers", a, ["CALLS"], True, n, cut)), related.diff_order(), n),
            "related_tests": (self._described(tests), related.diff_order(), n),
            "related_relations": (self._described(both), related.diff_directed_order(), n),
            "related_call_candidates": (self._candidates(a, n), related.site_order(), n),
        }, cut)
