"""Symbols, call sites and base classes of Python sources.

A file is one task's work and no row waits for another, so extraction is one pass of mapInArrow over the files; what
follows (catalog, resolution, relations) is joins on the exploded rows. Python's own `ast` reads the text.

Cases: null text is an empty file; text that doesn't parse has no facts and one diagnostic; empty tables give empty
tables; repeated rows each give their facts; other columns are ignored.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE, HINT = 512, 128
_SYMBOL = {"name": "string", "qualified_name": "string", "container": "string", "kind": "string", "signature": "string", "start_line": "long", "start_col": "long", "end_line": "long", "end_col": "long"}
_CALL = {"caller": "int", "form": "string", "target_kind": "string", "name": "string", "qualifier": "string", "receiver_hint": "string", "receiver_type": "string", "receiver_type_source": "string", "line": "long", "col": "long"}
_DIAGNOSTIC = {"kind": "string", "cause": "string", "node_kind": "string", "start_line": "long", "start_col": "long", "end_line": "long", "end_col": "long"}
_BASE = {"from": "int", "names": "array<string>"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_OWN = (*_FUNCTION, ast.ClassDef, ast.Lambda, ast.Import, ast.ImportFrom)


def module_path(path: str) -> list[str]:
    *folders, file = path.split("/")
    if folders[:1] == ["src"]:
        folders = folders[1:]
    stem = file.removesuffix(".pyi") if file.endswith(".pyi") else file.removesuffix(".py")
    return folders if stem == "__init__" else [*folders, stem]


def _is_type(name: str) -> bool:
    return name[:1].isupper()


def _nodes(root: ast.AST, stop: tuple = ()) -> Iterator[ast.AST]:
    """All nodes below root in the text's order; those of the types in stop are left out, with what is in them."""
    stack = list(ast.iter_child_nodes(root))[::-1]
    while stack:
        node = stack.pop()
        if not isinstance(node, stop):
            yield node
            stack.extend(list(ast.iter_child_nodes(node))[::-1])


class _File:
    def __init__(self, path: str, text: str):
        self.module = module_path(path)
        self.lines = [x.encode() for x in text.split("\n")]
        self.namespaces: dict[str, str] = {}
        self.named: dict[str, str] = {}
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.bases: list[dict] = []
        tree = ast.parse(text)
        for node in _nodes(tree):
            self._bind(node)
        self._body(tree.body, self.module, None, False, None)

    def _bind(self, node: ast.AST) -> None:
        """The names an import gives to modules (namespaces) and to things in modules (named)."""
        if isinstance(node, ast.Import):
            for x in node.names:
                if not x.asname:
                    top = x.name.split(".")[0]
                    self.namespaces[top] = top
                self.namespaces[x.asname or x.name] = x.name.replace(".", "::")
        elif isinstance(node, ast.ImportFrom):
            above = self.module[:-1]
            if node.level > len(above) + 1:
                return
            start = above[: len(above) + 1 - node.level] if node.level else []
            module = start + (node.module.split(".") if node.module else [])
            for x in node.names:
                if x.name != "*":
                    self.named[x.asname or x.name] = "::".join([*module, x.name])

    def _col(self, line: int, byte: int) -> int:
        return len(self.lines[line - 1][:byte].decode("utf-8", "ignore")) + 1

    def _text(self, start: tuple[int, int], end: tuple[int, int]) -> str:
        (a, i), (b, j) = start, end
        if a == b:
            return self.lines[a - 1][i:j].decode("utf-8", "ignore")
        return b"\n".join([self.lines[a - 1][i:], *self.lines[a : b - 1], self.lines[b - 1][:j]]).decode("utf-8", "ignore")

    def _start(self, node: ast.AST) -> tuple[int, int]:
        """Where a declaration begins: at the sign of its first decorator, if it has one."""
        first = (getattr(node, "decorator_list", None) or [node])[0]
        line, byte = first.lineno, first.col_offset
        return (line, byte) if first is node else (line, self.lines[line - 1].rfind(b"@", 0, byte))

    def _add(self, node: ast.AST, name: str | None, kind: str, prefix: list[str], body: list | None = None) -> int:
        start, end = self._start(node), (node.end_lineno, node.end_col_offset)
        said = " ".join(self._text(start, self._start(body[0]) if body else end).split())
        said = said if len(said) <= SIGNATURE else said[: SIGNATURE - 1] + "…"
        name = name or said
        place = dict(start_line=start[0], start_col=self._col(*start), end_line=end[0], end_col=self._col(*end))
        self.symbols.append(dict(name=name, qualified_name="::".join([*prefix, name]), container=prefix[-1] if prefix else None, kind=kind, signature=said, **place))
        return len(self.symbols) - 1

    def _body(self, body: list, prefix: list[str], container: str | None, in_class: bool, base: str | None) -> None:
        """Declarations in the text's order, those below if, for, with, try and match too. Blocks wait on a stack."""
        stack = list(body)[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                self._add(node, None, "import", prefix)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if isinstance(target, ast.Name):
                    self._add(node, target.id, "property" if in_class else "constant", prefix)
            elif isinstance(node, _FUNCTION):
                kind = "test" if node.name.startswith("test_") else "method" if in_class else "function"
                at = self._add(node, node.name, kind, prefix, node.body)
                for part in node.body:
                    if not isinstance(part, _OWN):
                        self._calls(part, at, container, base)
                self._body(node.body, [*prefix, node.name], node.name, False, base)
            elif isinstance(node, ast.ClassDef):
                at = self._add(node, node.name, "class", prefix, node.body)
                names = [x for x in map(self._base_name, node.bases) if x]
                found = [(x, self._candidates(x, prefix)) for x in names]
                found = [(x, c) for x, c in found if c]
                self.bases += [{"from": at, "names": c} for _, c in found]
                only = found[0][0].split("::")[-1] if len(found) == 1 else None
                self._body(node.body, [*prefix, node.name], node.name, True, only)
            elif isinstance(node, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                stack.extend([x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.ExceptHandler, ast.match_case))][::-1])

    def _base_name(self, node: ast.AST) -> str | None:
        while isinstance(node, ast.Subscript):
            node = node.value
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return "::".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None

    def _candidates(self, name: str, prefix: list[str]) -> list[str]:
        space, _, member = name.rpartition("::")
        if not space:
            return ["::".join([*prefix, name]), *([self.named[name]] if name in self.named else [])]
        module = self.namespaces.get(space) or self.named.get(space)
        return [f"{module}::{member}"] if module else []

    def _calls(self, root: ast.AST, caller: int, container: str | None, base: str | None) -> None:
        for node in [root, *_nodes(root, _OWN)]:
            if isinstance(node, ast.Call):
                f = node.func
                if isinstance(f, ast.Name):
                    row, line, byte = self._plain(f.id), f.lineno, f.col_offset
                elif isinstance(f, ast.Attribute):
                    row, line, byte = self._attribute(f, container, base), f.end_lineno, f.end_col_offset - len(f.attr.encode())
                else:
                    continue
                form, kind, name, qualifier, hint = row
                self.calls.append(dict(caller=caller, form=form, target_kind=kind, name=name, qualifier=qualifier, receiver_hint=hint, receiver_type=None, receiver_type_source=None, line=line, col=self._col(line, byte)))

    def _plain(self, name: str) -> tuple:
        target = self.named.get(name)
        if _is_type(name):
            return "scoped", "method", "__init__", (target or name).split("::")[-1], name
        if target and "::" in target:
            module, _, simple = target.rpartition("::")
            return "scoped", "function", simple, module, name
        return "function", "function", name, None, None

    def _attribute(self, f: ast.Attribute, container: str | None, base: str | None) -> tuple:
        on = f.value.id if isinstance(f.value, ast.Name) else None
        if on in ("self", "cls"):
            return "member", "method", f.attr, container, on
        if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
            return "member", "method", f.attr, base, "super()"
        said = self._text((f.value.lineno, f.value.col_offset), (f.value.end_lineno, f.value.end_col_offset))
        if _is_type(f.attr):
            return "scoped", "method", "__init__", f.attr, self._hint(said)
        module = self.namespaces.get(said) or (self.named.get(on) if on else None)
        if module:
            return "scoped", "function", f.attr, module, said
        if on and _is_type(on):
            return "scoped", "method", f.attr, on, on
        return "member", "method", f.attr, None, self._hint(said)

    @staticmethod
    def _hint(said: str) -> str | None:
        words = "".join(c if c.isalnum() or c == "_" else " " for c in said).split()
        words = [w for w in words if w[0].isalpha() or w[0] == "_"]
        return words[-1] if words and len(words[-1]) <= HINT else None


def read(path: str, text: str | None) -> tuple[list[dict], list[dict], list[dict], list[dict]]:
    """Symbols, calls, bases and diagnostics (one at most) of one file."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            # One line ends as another does, for ast and for the columns here; form feeds are blanks.
            f = _File(path, (text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\f", " "))
    except SyntaxError as e:
        line, col = max(e.lineno or 1, 1), max(e.offset or 1, 1)
        end = (e.end_lineno, e.end_offset) if e.end_lineno and e.end_offset else (line, col)
        end = end if end >= (line, col) else (line, col)
        return [], [], [], [dict(kind="error", cause="syntax", node_kind="ERROR" if e.lineno else "<unlocated-error>", start_line=line, start_col=col, end_line=end[0], end_col=end[1])]
    except (ValueError, RecursionError, MemoryError):
        return [], [], [], [dict(kind="error", cause="unreadable", node_kind="<unlocated-error>", start_line=1, start_col=1, end_line=1, end_col=1)]
    return f.symbols, f.calls, f.bases, []


def facts(path: str, text: str | None) -> tuple[list[dict], list[dict], list[dict], int]:
    """Symbols, calls and bases of one file, and its number of diagnostics."""
    s, c, b, errors = read(path, text)
    return s, c, b, len(errors)


def _type(fields: dict[str, str]) -> tuple[str, pa.DataType]:
    return "array<struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">>", pa.list_(pa.struct([(k, _ARROW[v]) for k, v in fields.items()]))


def parse(files: DataFrame) -> DataFrame:
    """path, symbols, calls, bases, diagnostics of each row of files (path, text)."""
    kinds = [_type(_SYMBOL), _type(_CALL), _type(_BASE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                rows = [facts(p or "", t) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)]
                parts = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("path").cast(pa.string()), *(pa.array(list(x), k[1]) for x, k in zip(parts, kinds, strict=False)), pa.array(parts[3], pa.int32())], ["path", "symbols", "calls", "bases", "diagnostics"])

    return files.select("path", "text").mapInArrow(run, f"path string, symbols {kinds[0][0]}, calls {kinds[1][0]}, bases {kinds[2][0]}, diagnostics int")


def _id(at) -> F.Column:
    return F.concat_ws("#", "path", F.lpad(at.cast("string"), 8, "0"))


def symbols(parsed: DataFrame) -> DataFrame:
    """One row a symbol; its id is its path and place in the file, so ids sort as (path, place)."""
    s = parsed.select("path", F.posexplode("symbols").alias("at", "s"))
    return s.select(_id(F.col("at")).alias("id"), "path", "s.*")


def call_sites(parsed: DataFrame) -> DataFrame:
    c = parsed.select("path", F.posexplode("calls").alias("at", "c"))
    return c.select(_id(F.col("at")).alias("seq"), _id(F.col("c.caller")).alias("caller"), *[f"c.{k}" for k in _CALL if k != "caller"], "path")


def base_classes(parsed: DataFrame) -> DataFrame:
    """request (the class's id) and the names it may extend, in order: what first_unique takes."""
    b = parsed.select("path", F.posexplode("bases").alias("at", "b"))
    return b.select(_id(F.col("b.from")).alias("request"), "at", F.col("b.names").alias("names"))
