"""Relations that Laravel code states to its container, router, event bus and scheduler, from PHP sources.

Each statement is a call, so one table says which calls count and what their arguments mean. An end of a relation is a
list of qualified names in order of preference; related.endpoint turns it into a symbol, or into none where it isn't
clear. A statement outside of any function begins at a configuration symbol named after its place.

Cases: null text is an empty file; files of other languages give none; a file gives MOST relations at the most, and
`omitted` counts the others; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.lexical import _Reader
from graphloom.sources.python_code import _type

MOST = 2048
_RELATION = {"kind": "string", "from_names": "array<string>", "synthetic": "string", "to_names": "array<string>", "line": "long", "col": "long"}
_APP = ("$this->app", "$app", "$this->container", "App")
#: Names of calls and of what they are called on. Fixed values.
_ROUTES = "get post put patch delete options match any resource apiResource".split()
_RULES: list[tuple[tuple[str, ...], tuple[str, ...], str]] = [
    (("",), ("app", "resolve"), "resolve"),
    (("",), ("dispatch",), "dispatch"),
    (_APP, ("bind", "singleton", "scoped", "instance"), "bind"),
    (("$schedule", "$this->schedule", "Schedule"), ("job", "command"), "schedule"),
    (("Route",), tuple(_ROUTES), "route"),
    (("Event",), ("listen",), "listen"),
    (("Gate",), ("policy",), "policy"),
    (("$this",), ("commands",), "command"),
    (("Artisan",), ("resolveCommands",), "command"),
    (("*",), ("dispatch", "dispatchSync", "dispatchAfterResponse"), "dispatch_static"),
]
_CALL = re.compile(r"(?<![\w$\\>:])(?:(?P<on>\$?[\w\\]+(?:->\w+)*)(?P<sep>->|::))?(?P<name>\\?[A-Za-z_]\w*)\s*(?=\()")
_NAMED, _CREATED = re.compile(r"\s*(\\?[A-Za-z_][\w\\]*)::class\s*$"), re.compile(r"\s*new\s+(\\?[A-Za-z_][\w\\]*)")
_PARAMETER = re.compile(r"^\s*(?:#\[[^\]]*\]\s*)?(?:(?:public|protected|private|readonly)\s+)*\??(\\?[A-Za-z_][\w\\]*)\s+&?(?:\.\.\.)?\$\w+")


class _Statements:
    def __init__(self, path: str, text: str):
        self.path, self.r = path, _Reader("php", path, text)
        self.rows: list[dict] = []
        self._constructors()
        for m in _CALL.finditer(self.r.code):
            if m.start("name") not in self.r.taken:
                self._statement(m)
        self.rows.sort(key=lambda x: (x["line"], x["col"]))

    def _arguments(self, at: int) -> list[tuple[int, int]]:
        """Where each argument of the bracket at a place begins and ends."""
        end = self.r.close.get(at)
        if end is None:
            return []
        cuts, i = [at], at + 1
        for m in re.compile(r"[,(\[{]").finditer(self.r.code, at + 1, end):
            if m.start() < i:
                continue
            if m[0] == ",":
                cuts.append(m.start())
            else:
                i = self.r.close.get(m.start(), end)
        cuts.append(end)
        return [(a + 1, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if self.r.code[a + 1 : b].strip() or self.r.text[a + 1 : b].strip()]

    def _class(self, span: tuple[int, int], *patterns: re.Pattern) -> str | None:
        for p in patterns:
            if m := p.match(self.r.code[span[0] : span[1]]):
                return self.r.aliases.type(m[1])
        return None

    def _add(self, kind: str, start: list[str] | str, to: list[str], at: int) -> None:
        line, col = self.r._place(at)
        synthetic = None
        if isinstance(start, str):
            caller = max((b for b in self.r.bodies if b[0] <= at < b[1]), default=None)
            synthetic = None if caller else f"Laravel::{start}::{self.path}:{line}:{col}"
            start = [self.r.symbols[caller[2]]["qualified_name"]] if caller else []
        self.rows.append(dict(kind=kind, from_names=start, synthetic=synthetic, to_names=to, line=line, col=col))

    def _constructors(self) -> None:
        for m in re.finditer(r"\bfunction\s+__construct\s*(?=\()", self.r.code):
            owner = next((s for s in self.r.symbols if s["name"] == "__construct" and s["start_line"] <= self.r._place(m.start())[0] <= s["end_line"]), None)
            for a, b in self._arguments(m.end()) if owner else []:
                p = _PARAMETER.match(self.r.code[a:b])
                if p and (target := self.r.aliases.type(p[1])):
                    self._add("DEPENDS_ON", [owner["qualified_name"].rpartition("::")[0]], [target], a + len(self.r.code[a:b]) - len(self.r.code[a:b].lstrip()))

    def _statement(self, m: re.Match) -> None:
        on, name = m["on"] or "", m["name"].lstrip("\\")
        short = on if on.startswith("$") else on.split("\\")[-1]
        rule = next((r for places, names, r in _RULES if name in names and (short in places or (places == ("*",) and m["sep"] == "::"))), None)
        if rule is None or (short and not short.startswith("$") and m["sep"] != "::"):
            return
        args, at = self._arguments(m.end()), m.start()
        first = self._class(args[0], _NAMED) if args else None
        made = self._class(args[0], _CREATED) if args else None
        second = self._class(args[1], _NAMED, _CREATED) if len(args) > 1 else None
        if rule == "resolve" and first:
            self._add("RESOLVES", "resolve", [first], at)
        elif rule == "dispatch" and made:
            self._add("DISPATCHES", "dispatch", [f"{made}::handle"], at)
        elif rule == "dispatch_static" and (job := self.r.aliases.type(on)):
            self._add("DISPATCHES", "dispatch", [f"{job}::handle"], at)
        elif rule == "bind" and first and second:
            self._add("BINDS", [first], [second], at)
        elif rule == "schedule" and (made or first):
            self._add("SCHEDULES", "schedule", [f"{made or first}::handle"], at)
        elif rule == "listen" and first and len(args) > 1 and (listener := self._class(args[1], _NAMED)):
            self._add("LISTENS_TO", [f"{listener}::handle", f"{listener}::__invoke"], [first], at)
        elif rule == "policy" and first and len(args) > 1 and (policy := self._class(args[1], _NAMED)):
            self._add("AUTHORIZES_WITH", [first], [policy], at)
        elif rule == "command" and args:
            for span in self._items(args[0]):
                if job := self._class(span, _NAMED):
                    self._add("REGISTERS", "command", [f"{job}::handle"], at)
        elif rule == "route" and args:
            self._route(args[-1], at)

    def _items(self, span: tuple[int, int]) -> list[tuple[int, int]]:
        a = span[0] + len(self.r.code[span[0] : span[1]]) - len(self.r.code[span[0] : span[1]].lstrip())
        return self._arguments(a) if self.r.code[a : a + 1] == "[" else []

    def _route(self, span: tuple[int, int], at: int) -> None:
        items = self._items(span)
        if len(items) == 2 and (on := self._class(items[0], _NAMED)):
            if said := re.fullmatch(r"\s*(['\"])(\w+)\1\s*", self.r.text[items[1][0] : items[1][1]]):
                self._add("ROUTES_TO", "route", [f"{on}::{said[2]}"], at)
        elif not items and (on := self._class(span, _NAMED)):
            self._add("ROUTES_TO", "route", [f"{on}::__invoke"], at)


def statements(path: str, text: str | None) -> tuple[list[dict], int]:
    """The relations of one PHP file, and how many are left out."""
    if not path.endswith(".php"):
        return [], 0
    rows = _Statements(path, (text or "").replace("\r\n", "\n")).rows
    return rows[:MOST], max(0, len(rows) - MOST)


def uses_framework(composer: Column) -> Column:
    """Whether a composer.json asks for the framework: relations count only in such repositories."""
    asks = lambda part: F.get_json_object(composer, f"$.{part}['laravel/framework']").isNotNull()
    return F.coalesce(asks("require") | asks("require-dev"), F.lit(False))


def parse(files: DataFrame) -> DataFrame:
    """path, relations, omitted of each row of files (path, text)."""
    sql, arrow = _type(_RELATION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                rows = [statements(p or "", t) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("path").cast(pa.string()), pa.array([r for r, _ in rows], arrow), pa.array([n for _, n in rows], pa.int64())], ["path", "relations", "omitted"])

    return files.select("path", "text").mapInArrow(run, f"path string, relations {sql}, omitted long")


def relations(parsed: DataFrame) -> DataFrame:
    """request (path and place in it) and the columns of a relation."""
    r = parsed.select("path", F.posexplode("relations").alias("at", "r"))
    return r.select(F.concat_ws("#", "path", F.lpad(F.col("at").cast("string"), 8, "0")).alias("request"), "path", "r.*")
