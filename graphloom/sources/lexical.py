"""Symbols, call sites and type relations of ten brace languages and shell, read lexically.

Comments and strings are blanked (lengths and line breaks stay), brackets are paired in one pass, and the declarations
that a language's patterns find are nested by the brackets around them. This is no grammar: macros, generated names and
overloaded syntax can escape it, so its facts are of precision `heuristic`. Python has its own reader (python_code);
`parse` sends every file to the reader of its language.

Cases: null text is an empty file; each bracket without a partner is a diagnostic, and what does pair gives its facts; files
of no known language have no facts; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schema import EXTENSIONS
from graphloom.sources import python_code
from graphloom.sources.python_code import _CALL, _DIAGNOSTIC, _SYMBOL, HINT, SIGNATURE, _id, _type

_RELATION = {"from": "int", "relation": "string", "names": "array<string>"}
#: Diagnostics kept of a file; their number is exact. Fixed value.
KEPT = 64
TYPES = ("class", "struct", "enum", "trait", "interface", "impl_block")
CALLABLE = ("function", "method", "test")

_SLASHES, _HASHES, _BLOCK = r"//[^\n]*", r"(?<![\w$])#[^\n]*", r"/\*(?:.*?\*/|.*)"
_DOUBLE, _SINGLE, _TICKS = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`?"
#: Words before a parenthesis that are no calls. Fixed values.
_NOT_CALLED = frozenset(
    "if for foreach while switch catch return function fn func match sizeof typeof using lock fixed when and or not in is as new await yield else elif case do throw defer go select range echo print isset empty unset list array exit die declare super this self Self constructor static_assert decltype alignof noexcept import require nameof default checked unchecked var let const".split()
)


@dataclass(frozen=True)
class Rule:
    """A declaration: its kind, its pattern (group `name`), and where it may stand: any, top, type, enum or outer (top or type)."""

    kind: str
    pattern: str
    where: str = "any"


@dataclass(frozen=True)
class Language:
    blank: tuple[str, ...]
    rules: tuple[Rule, ...]
    module: Callable[[str, str], list[str]]
    own: tuple[str, ...] = ("this",)
    bare: str = "function"
    constructor: str | None = None
    test: str | None = None
    lines_end: bool = False
    heritage: tuple[tuple[str, str], ...] = ()
    compiled: list = field(default_factory=list, compare=False)

    def ready(self) -> tuple:
        if not self.compiled:
            self.compiled.append((re.compile("|".join(self.blank), re.S), [(r, re.compile(r.pattern, re.M)) for r in self.rules]))
        return self.compiled[0]


def _folders(path: str, drop: tuple[str, ...] = ("src",), stems: tuple[str, ...] = ()) -> list[str]:
    *folders, file = path.split("/")
    folders = folders[1:] if folders and folders[0] in drop else folders
    stem = file.rsplit(".", 1)[0]
    return folders if stem in stems else [*folders, stem]


def _stated(pattern: str, sep: str, other: Callable[[str], list[str]]) -> Callable[[str, str], list[str]]:
    """The module a file states itself, else the one its path gives."""
    rx = re.compile(pattern, re.M)
    return lambda path, code: m[1].strip(sep).split(sep) if (m := rx.search(code)) else other(path)


def _java_path(path: str) -> list[str]:
    *folders, file = path.split("/")
    at = next((i + 3 for i in range(len(folders) - 2) if folders[i] == "src" and folders[i + 1] in ("main", "test") and folders[i + 2] == "java"), 0)
    return folders[at:]


_W = r"[A-Za-z_$][\w$]*"
_SCRIPT = (
    Rule("import", r"^[ \t]*(?:import\b(?!\s*\()|export\s+(?:\*|\{[^}]*\})\s*from\b)[^;\n]*(?P<name>)"),
    Rule("class", rf"\bclass\s+(?P<name>{_W})"),
    Rule("function", rf"\bfunction\s*\*?\s*(?P<name>{_W})\s*(?=[(<])"),
    Rule("function", rf"\b(?:const|let|var)\s+(?P<name>{_W})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_W})\s*(?::[^=;\n]+)?=>", "outer"),
    Rule("function", rf"\bexports\.(?P<name>{_W})\s*=\s*(?:async\s+)?function\b"),
    Rule("constant", rf"\b(?:const|let|var)\s+(?P<name>{_W})\s*(?::[^=;\n]+)?=(?!\s*(?:async\s*)?(?:\([^()]*\)|{_W})\s*(?::[^=;\n]+)?=>)", "top"),
    Rule("method", rf"(?<![.\w$@])(?P<name>#?{_W})\s*(?=(?:<[^<>()]*>)?\()", "type"),
    Rule("test", r"(?<![.\w$])(?:it|test)(?:\.(?:only|skip|todo))?\((?P<name>)"),
)
_MEMBER = Rule("constant", r"[{,]\s*(?P<name>[A-Za-z_]\w*)\s*(?=[,}=(;])", "enum")
_TS = (*_SCRIPT, _MEMBER, Rule("interface", rf"\binterface\s+(?P<name>{_W})"), Rule("enum", rf"\benum\s+(?P<name>{_W})"), Rule("type_alias", rf"\btype\s+(?P<name>{_W})\s*(?:<[^=;]*>)?\s*(?==)"),
       Rule("module", rf"\b(?:namespace|module)\s+(?P<name>{_W}(?:\.{_W})*)\s*(?=\{{)"), Rule("property", rf"(?<![.\w$@])(?P<name>#?{_W})[?!]?\s*(?=[:=;])", "type"))
_EXTENDS = (("extends", r"\bextends\s+([^{]+?)(?=\bimplements\b|\{|$)"), ("implements", r"\bimplements\s+([^{]+)"))

LANGUAGES: dict[str, Language] = {
    "rust": Language(
        (_SLASHES, _BLOCK, r'\bb?r(#*)".*?"\1', _DOUBLE.replace(r"\n", ""), r"'(?:\\[^'\n]+|[^'\\\n])'"),
        (
            Rule("module", r"\bmod\s+(?P<name>\w+)"), Rule("struct", r"\b(?:struct|union)\s+(?P<name>\w+)"), Rule("enum", r"\benum\s+(?P<name>\w+)"), Rule("trait", r"\btrait\s+(?P<name>\w+)"),
            Rule("impl_block", r"^[ \t]*(?:unsafe\s+)?impl\b(?:[^{;]*\bfor\b)?\s*(?:<[^{;]*?>)?\s*(?P<name>[A-Za-z_][\w:]*)", "outer"), Rule("function", r"\bfn\s+(?P<name>\w+)"),
            Rule("constant", r"\b(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)\s*:"), Rule("type_alias", r"\btype\s+(?P<name>\w+)\s*(?=[=<])", "outer"),
            Rule("import", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+(?P<name>)"), Rule("field", r"(?:^|[{,])\s*(?:pub(?:\([^)]*\))?\s+)?(?P<name>[a-z_]\w*)\s*:(?!:)", "type"),
        ),
        lambda path, code: _folders(path, stems=("lib", "main", "mod")), own=("self", "Self"), test=r"#\[(?:\w+::)*(?:test|rstest)\b", heritage=(("implements", r"\bimpl\b(?:\s*<[^{;]*?>)?\s*([\w:]+)(?:<[^{;]*>)?\s+for\b"),),
    ),
    "php": Language(
        (r"<\?(?:php|=)?|\?>", _SLASHES, r"#(?!\[)[^\n]*", _BLOCK, _DOUBLE.replace(r"\n", ""), _SINGLE.replace(r"\n", "")),
        (
            Rule("module", r"\bnamespace\s+(?P<name>[\w\\]+)"), Rule("import", r"^[ \t]*use\s+[^;{(]+(?P<name>)", "top"), Rule("class", r"\bclass\s+(?P<name>\w+)"), Rule("interface", r"\binterface\s+(?P<name>\w+)"),
            Rule("trait", r"\btrait\s+(?P<name>\w+)"), Rule("enum", r"\benum\s+(?P<name>\w+)"), Rule("function", r"\bfunction\s+&?\s*(?P<name>\w+)"), Rule("constant", r"\bconst\s+(?:\w+\s+)?(?P<name>\w+)\s*=", "outer"),
            Rule("property", r"\b(?:public|protected|private|var|readonly|static)\s+(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)", "type"),
        ),
        _stated(r"\bnamespace\s+([\w\\]+)", "\\", lambda path: []), own=("$this", "self", "static"), constructor="__construct", test=r"#\[\s*(?:[\w\\]+\\)?Test\b", heritage=_EXTENDS,
    ),
    "typescript": Language((_SLASHES, _BLOCK, _DOUBLE, _SINGLE, _TICKS), _TS, lambda path, code: _folders(path, stems=("index",)), constructor="constructor", heritage=_EXTENDS),
    "javascript": Language((_SLASHES, _BLOCK, _DOUBLE, _SINGLE, _TICKS), _SCRIPT, lambda path, code: _folders(path, stems=("index",)), constructor="constructor", heritage=_EXTENDS[:1]),
    "java": Language(
        (_SLASHES, _BLOCK, r'""".*?"""', _DOUBLE, _SINGLE),
        (
            Rule("import", r"^[ \t]*import\s+[^;]+(?P<name>)", "top"), _MEMBER, Rule("class", r"\b(?:class|record)\s+(?P<name>\w+)"), Rule("interface", r"@?\binterface\s+(?P<name>\w+)"), Rule("enum", r"\benum\s+(?P<name>\w+)"),
            Rule("method", r"(?<![.\w@])(?P<name>\w+)\s*(?=\()", "type"), Rule("field", r"[\w>\]]\s+(?P<name>\w+)\s*(?=[=;])", "type"),
        ),
        _stated(r"^\s*package\s+([\w.]+)", ".", _java_path), bare="method", constructor="constructor", test=r"@(?:\w+\.)*(?:Test|ParameterizedTest|RepeatedTest)\b", heritage=_EXTENDS,
    ),
    "csharp": Language(
        (_SLASHES, _BLOCK, r'""".*?"""', r'@"(?:""|[^"])*"', _DOUBLE, _SINGLE),
        (
            Rule("import", r"^[ \t]*(?:global\s+)?using\s+[^;()]+(?P<name>)(?=;)", "top"), _MEMBER, Rule("struct", r"\b(?:record\s+)?struct\s+(?P<name>\w+)"), Rule("class", r"\b(?:class|record(?!\s+struct))\s+(?P<name>\w+)"), Rule("interface", r"\binterface\s+(?P<name>\w+)"),
            Rule("enum", r"\benum\s+(?P<name>\w+)"), Rule("type_alias", r"\bdelegate\s+[\w<>\[\],.?]+\s+(?P<name>\w+)", "outer"), Rule("method", r"(?<![.\w@])(?P<name>~?\w+)\s*(?=(?:<[^<>()]*>)?\()", "type"),
            Rule("property", r"[\w>\]?]\s+(?P<name>\w+)\s*(?=\{|=>)", "type"), Rule("field", r"[\w>\]?]\s+(?P<name>\w+)\s*(?==(?!>)|;)", "type"),
        ),
        _stated(r"^\s*namespace\s+([\w.]+)", ".", lambda path: _folders(path)), own=("this", "base"), bare="method", constructor="constructor", test=r"\[\s*(?:Fact|Theory|Test|TestMethod|TestCase)\b", heritage=(("extends", r":\s*([^{;]+)"),),
    ),
    "shell": Language(
        (r"(?<![^\s;&|(])#[^\n]*", _DOUBLE.replace(r"\n", ""), r"'[^']*'"),
        (Rule("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w.:-]+)\s*\(\s*\)"), Rule("function", r"^[ \t]*function\s+(?P<name>[\w.:-]+)(?=\s*(?:\{|$))"), Rule("import", r"^[ \t]*(?:source|\.|alias)[ \t]+[^\n;]+(?P<name>)")),
        lambda path, code: _folders(path, drop=()), own=(), lines_end=False,
    ),
    "cpp": Language(
        (_SLASHES, _BLOCK, r'R"([^(\s]{0,16})\(.*?\)\1"', _DOUBLE, r"(?<!\w)'(?:\\[^'\n]+|[^'\\\n])'"),
        (
            Rule("import", r"^[ \t]*#[ \t]*include[^\n]*(?P<name>)"), _MEMBER, Rule("module", r"\bnamespace\s+(?P<name>[\w:]+)\s*(?=\{)"), Rule("class", r"(?<!enum )\bclass\s+(?P<name>\w+)(?=\s*(?:final\b|:(?!:)|\{))"), Rule("struct", r"(?<!enum )\b(?:struct|union)\s+(?P<name>\w+)(?=\s*(?:final\b|:(?!:)|\{))"),
            Rule("enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)"), Rule("type_alias", r"\b(?:using\s+|concept\s+)(?P<name>\w+)\s*(?==)"), Rule("function", r"(?<![.\w@])(?P<name>(?:\w+::)*~?\w+)\s*(?=\()", "outer"), Rule("field", r"[\w>*&\]]\s+[*&]*(?P<name>\w+)\s*(?=[=;]|\{[^{}]*\}\s*;)", "type"),
        ),
        lambda path, code: _folders(path, drop=()), test=r"\bTEST(?:_F|_P|_CASE)?\b", heritage=(("extends", r":(?!:)\s*([^{;]+)"),),
    ),
    "hcl": Language(
        (_HASHES, _SLASHES, _BLOCK),
        (Rule("configuration", r"^[ \t]*(?P<name>[a-z_]\w*(?:[ \t]+\"[^\"\n]*\")*)[ \t]*(?=\{)"), Rule("property", r"^[ \t]*(?P<name>[A-Za-z_][\w-]*)[ \t]*=(?![=>])")),
        lambda path, code: [*path.split("/")[:-1], re.sub(r"(?:\.tftest\.hcl|\.tfvars|\.hcl|\.tf)$", "", path.split("/")[-1])], own=(), lines_end=True,
    ),
    "go": Language(
        (_SLASHES, _BLOCK, _DOUBLE, r"`[^`]*`?", r"'(?:\\[^'\n]+|[^'\\\n])'"),
        (
            Rule("import", r"^import\b[^\n]*(?P<name>)"), Rule("method", r"^func\s*\(\s*(?:\w+\s+)?\*?(?P<on>\w+)[^)]*\)\s*(?P<name>\w+)"), Rule("function", r"^func\s+(?P<name>\w+)"), Rule("struct", r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
            Rule("interface", r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), Rule("type_alias", r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?!struct\b|interface\b)(?==|[\w*\[(])"),
            Rule("constant", r"^const\s+(?P<name>\w+)"), Rule("property", r"^var\s+(?P<name>\w+)"), Rule("method", r"^[ \t]+(?P<name>[A-Z]\w*)(?=\()", "type"), Rule("field", r"^[ \t]+(?P<name>[A-Za-z_]\w*)[ \t]+(?=[\w*\[(<])", "type"),
        ),
        _stated(r"^package\s+(\w+)", ".", lambda path: []), own=(), lines_end=True,
    ),
}

# A match begins where a chain of receivers does, so a long chain is read once.
_CALLS = re.compile(r"(?<![\w$])(?<![\w$][.\\])(?<![\w$]->)(?<![\w$]::)(?<![\w$]\?\.)(?<![\w$]\?->)(?P<new>new\s+)?(?P<on>(?:[\w$]+(?:\?\.|\?->|->|::|\.|\\))*+)(?P<name>[A-Za-z_$][\w$]*)\s*(?:::\s*<[^<>()]*>|<[\w\s,.?\[\]]*>)?(?=\()")
_COMMANDS = re.compile(r"(?:^|[;&|({]|\b(?:then|do|else|if|while|until)\b|!)[ \t]*(?P<name>(?!(?:then|do|else|if|while|until)\b)[A-Za-z_][\w.:-]*)(?![\w.:-]*=)", re.M)
_SHELL_WORDS = frozenset("if then else elif fi for while until do done case esac in function select time return local export readonly declare typeset unset shift set exit break continue eval exec trap test echo printf cd read true false source alias".split())
_TRAVERSAL = re.compile(r"(?<![\w.\"-])(?P<a>[a-z_][\w-]*)\.(?P<b>[A-Za-z_][\w-]*)(?:\.(?P<c>[A-Za-z_][\w-]*))?")
_HCL_CALL = re.compile(r"(?<![\w.])(?P<name>[a-z_]\w*)(?=\()")
_GO_TEST = re.compile(r"(?:Test|Benchmark|Fuzz|Example)(?![a-z])")
_OPEN, _BRACKETS = {")": "(", "]": "[", "}": "{"}, re.compile(r"[()\[\]{}]")
_HEAD = re.compile(r"=>|[({\[;)\]}]|\n")


_MADE = re.compile(r"\b(?:app|resolve)\s*\(\s*(\\?[A-Za-z_][\w\\]*)::class\s*\)\s*\??->\s*\Z")
_TYPED = re.compile(r"(?:^|[,(])\s*(?:#\[[^\]]*\]\s*)*(?P<own>(?:(?:public|protected|private|readonly)\s+)*)\??(?P<type>\\?[A-Za-z_][\w\\]*)\s+&?(?:\.\.\.)?\$(?P<name>\w+)")
_PLAIN = frozenset("int float string bool array mixed iterable callable object null void never self static parent false true".split())
_USE = re.compile(r"^[ \t]*use\s+(?!function\b|const\b)([\w\\]+)(?:\s+as\s+(\w+))?\s*;", re.M)
# Strings are blanks in the code, so what an import is from is read in the text.
_FROM = re.compile(r"^[ \t]*import\s+(?:type\s+)?(?P<what>[\w$*{][^;()]*?)\s*\bfrom\b", re.M)
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?P<what>[A-Za-z_$][\w$]*|\{[^}]*\})\s*=\s*require\s*\(")
_STRING = re.compile(r"\s*(['\"])([^'\"\n]*)\1")
_STATIC = re.compile(r"^[ \t]*import\s+static\s+([\w.]+)\.(\w+)\s*;", re.M)
_USING = re.compile(r"^[ \t]*(?:global\s+)?using\s+(?:(?P<static>static)\s+|(?P<alias>\w+)\s*=\s*)(?P<of>[\w.]+)(?:<[^;]*>)?\s*;", re.M)


class _Aliases:
    """What a file's imports call things: PHP types, names and namespaces of scripts, Java's static members, C#'s types."""

    def __init__(self, language: str, path: str, code: str, text: str):
        self.language, self.path = language, path
        self.named: dict[str, tuple[str, str]] = {}
        self.spaces: dict[str, str] = {}
        self.static: list[str] = []
        self.declared = frozenset()
        if language == "php":
            space = re.search(r"\bnamespace\s+([\w\\]+)", code)
            self.module = space[1].strip("\\").split("\\") if space else []
            self.uses = {(b or a.split("\\")[-1]): a.strip("\\").replace("\\", "::") for a, b in _USE.findall(code)}
        elif language in ("typescript", "javascript"):
            for m in [*_FROM.finditer(code), *(_REQUIRE.finditer(code) if language == "javascript" else ())]:
                said = _STRING.match(text, m.end())
                module = self._module(said[2]) if said else None
                if module is not None:
                    self._script(m["what"].strip(), module, "require" in m[0])
        elif language == "java":
            self.named = {b: (b, a.replace(".", "::")) for a, b in _STATIC.findall(code)}
        elif language == "csharp":
            for m in _USING.finditer(code):
                if m["static"]:
                    self.static.append(m["of"].replace(".", "::"))
                else:
                    self.spaces[m["alias"]] = m["of"].replace(".", "::")
            self.declared = frozenset(re.findall(r"\b(\w+)\s*\([^()]*\)\s*(?:where[^{;]*)?(?:\{|=>)", code)) if self.static else frozenset()

    def type(self, name: str) -> str | None:
        """The full name of a PHP type as a file writes it."""
        if name.lower() in _PLAIN:
            return None
        if name.startswith("\\"):
            return name.strip("\\").replace("\\", "::")
        head, _, rest = name.partition("\\")
        return "::".join([self.uses.get(head) or "::".join([*self.module, head]), *(rest.split("\\") if rest else [])])

    def _module(self, said: str) -> str | None:
        """The module of a relative specifier; None for packages."""
        if not said.startswith("."):
            return None
        parts = self.path.split("/")[:-1]
        for step in said.split("/"):
            if step == "..":
                if not parts:
                    return None
                parts.pop()
            elif step not in ("", "."):
                parts.append(step)
        if not parts:
            return None
        parts[-1] = re.sub(r"\.(?:[cm]?[jt]sx?)$", "", parts[-1])
        parts = parts[1:] if parts[0] == "src" else parts
        return "::".join(parts[:-1] if len(parts) > 1 and parts[-1] == "index" else parts)

    def _script(self, what: str, module: str, required: bool) -> None:
        listed = re.search(r"\{([^}]*)\}", what)
        for x in (listed[1] if listed else "").split(","):
            if m := re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s*(?:as|:)\s*([\w$]+))?\s*", x):
                self.named[m[2] or m[1]] = (m[1], module)
        if m := re.search(r"\*\s*as\s+([\w$]+)", what):
            self.spaces[m[1]] = module
        elif m := re.match(r"[\w$]+", what):
            if required:
                self.spaces[m[0]] = module
            else:
                self.named.setdefault(m[0], (m[0], module))

    def call(self, name: str, on: list[str], sep: str) -> tuple | None:
        """form, target_kind, name and qualifier of a call that an import explains."""
        if self.language in ("typescript", "javascript"):
            if not on and name in self.named:
                real, module = self.named[name]
                return "scoped", "function", real, module
            if len(on) == 1 and on[0] in self.spaces:
                return "scoped", "function", name, self.spaces[on[0]]
        elif self.language == "java" and not on and name in self.named:
            return "scoped", "method", *self.named[name]
        elif self.language == "csharp":
            if not on and len(self.static) == 1 and name not in self.declared and not sep:
                return "scoped", "method", name, self.static[0]
            if len(on) == 1 and on[0] in self.spaces:
                return "scoped", "method", name, self.spaces[on[0]]
        return None


class _Reader:
    def __init__(self, language: str, path: str, text: str):
        self.language, self.spec, self.path, self.text = language, LANGUAGES[language], path, text
        blank, rules = self.spec.ready()
        self.code = blank.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.marks: dict[str, list[int]] = {}
        self.aliases = _Aliases(language, path, self.code, text)
        self.params: dict[int, dict[str, tuple[str, str]]] = {}
        self.props: dict[tuple[str | None, str], tuple[str, str]] = {}
        self.errors, self.diagnostics = self._pair()
        self.module = self.spec.module(path, self.code)
        if language == "go" and self.module:
            self.module = [*self.module, path.split("/")[-1].rsplit(".", 1)[0]]
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.relations: list[dict] = []
        self.bodies: list[tuple[int, int, int, str | None]] = []
        self._declare(rules)
        self._call()

    def _pair(self) -> tuple[list[dict], int]:
        """close: the partner of each opening bracket; around: the innermost open one after each bracket (-1: none).
        Returns the first KEPT brackets without a partner, by place, and how many there are."""
        self.close, self.brackets, self.around = {}, [], []
        stack, odd, open_ = [], [], dict.fromkeys("([{", 0)
        for m in _BRACKETS.finditer(self.code):
            c, at = m[0], m.start()
            if c in open_:
                stack.append(at)
                open_[c] += 1
            elif open_[_OPEN[c]]:
                # What is open above the partner has none of its own.
                while self.code[stack[-1]] != _OPEN[c]:
                    open_[self.code[stack[-1]]] -= 1
                    odd.append((stack.pop(), "missing"))
                open_[_OPEN[c]] -= 1
                self.close[stack.pop()] = at
            else:
                odd.append((at, "error"))
            self.brackets.append(at)
            self.around.append(stack[-1] if stack else -1)
        odd = sorted([*odd, *((at, "missing") for at in stack)])
        rows = []
        for at, kind in odd[:KEPT]:
            line, col = self._place(at)
            rows.append(dict(kind=kind, cause="bracket", node_kind=self.code[at], start_line=line, start_col=col, end_line=line, end_col=col + 1))
        return rows, len(odd)

    def _inside(self, at: int) -> int:
        i = bisect_right(self.brackets, at - 1)
        return self.around[i - 1] if i else -1

    def _place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def _body(self, at: int) -> tuple[int | None, int]:
        """Where the body of a declaration opens (None: it has none) and where the declaration ends."""
        while m := _HEAD.search(self.code, at):
            c, at = m[0], m.end()
            if c == "{":
                return m.start(), self.close.get(m.start(), len(self.code) - 1) + 1
            if c in "([":
                at = self.close.get(m.start(), len(self.code) - 1) + 1
            elif c in ";)]}" or (c == "\n" and self.spec.lines_end):
                return None, m.start()
        return None, len(self.code)

    def _begin(self, at: int, marks: str = ";{}") -> int:
        """Where the statement around a place begins: behind the last mark."""
        if marks not in self.marks:
            self.marks[marks] = [m.start() for m in re.finditer("[" + re.escape(marks) + "]", self.code)]
        i = bisect_right(self.marks[marks], at - 1)
        i = self.marks[marks][i - 1] + 1 if i else 0
        return i + len(self.code[i:at]) - len(self.code[i:at].lstrip())

    def _before(self, at: int) -> str:
        """The text of the statement before a place, without what stands in parentheses."""
        return re.sub(r"\([^()]*\)", "", self.code[self._begin(at) : at])

    def _allowed(self, rule: Rule, m: re.Match, scope: tuple | None) -> bool:
        kind, at, name = scope[3] if scope else None, m.start("name"), m["name"]
        level = self._inside(at) == (scope[0] if scope else -1)
        places = {"any": True, "top": level and kind in (None, "module"), "type": level and kind in TYPES, "enum": level and kind == "enum", "outer": level and (kind in (None, "module") or kind in TYPES)}
        if not places[rule.where] or name.isdigit():
            return False
        if rule.where not in ("type", "outer"):
            return True
        if name in _NOT_CALLED and name != "constructor":
            return False
        said = self._before(at)
        if rule.kind in ("method", "function") and self.code[m.end() : m.end() + 1] in ("(", "<"):
            if "=" in re.sub(r"[=!<>]=|=>|operator\s*\S+", "", said) or (self.language == "cpp" and not said.strip() and kind not in TYPES and "::" not in name):
                return False
            return not re.search(r"\b(?:return|new|throw|else)\s*$", said)
        if self.language == "typescript" and rule.kind == "property":
            return not re.search("[:=]", said)
        return not (rule.kind == "field" and re.search(r"\b(?:return|throw|package|import|using|goto|namespace)\s*$", said))

    def _declare(self, rules: list) -> None:
        found, self.taken = [], set()
        for order, (rule, rx) in enumerate(rules):
            found += [(m.start("name") if m["name"] else m.start() + len(m[0]) - len(m[0].lstrip()), order, rule, m) for m in rx.finditer(self.code)]
        if self.language in ("shell", "hcl"):
            self._add("module", self.module[-1] if self.module else self.path, self.module[:-1], 0, len(self.code), None)
        scopes: list[tuple] = []  # opening bracket, end, prefix, kind
        for at, _, rule, m in sorted(found, key=lambda x: x[:2]):
            while scopes and scopes[-1][1] <= at:
                scopes.pop()
            scope = scopes[-1] if scopes else None
            if at in self.taken or not self._allowed(rule, m, scope):
                continue
            self.taken.add(at)
            self._one(rule, m, scope, scopes)
        if self.language == "go":
            self._grouped()

    def _grouped(self) -> None:
        """Go: the names of const and var groups, and build constraints as imports."""
        for m in re.finditer(r"^(const|var)\s*(?=\()", self.code, re.M):
            opens = m.end()
            for x in re.finditer(r"(?:^|;)[ \t]*([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)(?=[ \t]*(?:=|$|[\w*\[(.;]))", self.code[opens + 1 : self.close.get(opens, len(self.code))], re.M):
                for y in re.finditer(r"\w+", x[1]):
                    at = opens + 1 + x.start(1) + y.start()
                    if y[0] != "_" and self._inside(at) == opens and at not in self.taken:
                        self.taken.add(at)
                        line = self.code.find("\n", at)
                        self._add("constant" if m[1] == "const" else "property", y[0], list(self.module), at, line if line >= 0 else len(self.code), None)
        for m in re.finditer(r"^//go:build[ \t]+([^\n]+)", self.text, re.M):
            self._add("import", f"build::{m[1].strip()}", list(self.module), m.start(), m.end(), None)

    def _one(self, rule: Rule, m: re.Match, scope: tuple | None, scopes: list) -> None:
        kind, name, inside = rule.kind, m["name"], scope[3] if scope else None
        prefix = list(scope[2]) if scope else list(self.module)
        start = self._start(rule, m)
        plain = kind in ("field", "property", "constant") and self.language != "hcl" and not (kind == "property" and self.language == "csharp")
        if kind == "import":
            opens, end = None, m.end()
        elif plain:
            stop = re.compile("[;,}\n]").search(self.code, m.end())
            opens, end = None, stop.start() if stop else len(self.code)
        else:
            opens, end = self._body(m.end())
        if kind == "import":
            name = " ".join(self.text[start:end].split())
        elif kind == "test":
            name = self._quoted(m.end())
        elif kind == "module":
            parts = re.split(r"::|[.\\]", name)
            if self.language == "php":
                prefix, parts = [], parts
            prefix, name = [*prefix, *parts[:-1]], parts[-1]
        elif kind == "impl_block":
            name = name.split("::")[-1]
        elif self.language == "hcl":
            kind, name, prefix = self._block(kind, name, prefix, inside)
        elif kind in ("function", "method"):
            if self.language == "go" and "on" in m.re.groupindex and m["on"]:
                prefix = [*prefix, m["on"]]
            if "::" in name:
                *over, name = name.split("::")
                kind, prefix = "method", [*prefix, *over]
            kind = "method" if inside in TYPES else kind
            if self.language == "php" and kind == "function" and inside in CALLABLE:
                prefix = list(self.module)
            if self.language == "php":
                self._parameters(m, name, prefix)
            if self.language in ("java", "csharp") and scope and name == scope[2][-1]:
                name = "constructor"
            kind = "test" if self._is_test(name, start) else kind
        if self.language == "php" and kind == "property" and (said := re.search(r"([\w\\]+)\s+\$\w+$", m[0])) and (of := self.aliases.type(said[1])):
            self.props[prefix[-1] if prefix else None, name] = (of, "property")
        at = self._add(kind, name, prefix, start, end, opens)
        if opens is not None:
            inner = [*prefix, name]
            scopes.append((opens, end, inner, kind))
            if kind in CALLABLE:
                owner = prefix[-1] if (inside in TYPES or kind == "method") and prefix else next((s[2][-1] for s in reversed(scopes[:-1]) if s[3] in TYPES), None)
                self.bodies.append((opens, end, at, owner))
            elif kind == "configuration":
                self.bodies.append((opens, end, at, None))
        if kind in TYPES:
            self._relate(at, self.code[start : opens if opens is not None else end], prefix)

    def _parameters(self, m: re.Match, name: str, prefix: list[str]) -> None:
        """Types of the parameters of the declaration to be added next, and of the properties a constructor promotes."""
        opens = self.code.find("(", m.end())
        said = self.code[opens + 1 : self.close.get(opens, opens)] if opens >= 0 else ""
        for p in _TYPED.finditer(said):
            if of := self.aliases.type(p["type"]):
                self.params.setdefault(len(self.symbols), {})[p["name"]] = (of, "parameter")
                if name == "__construct" and p["own"]:
                    self.props[prefix[-1] if prefix else None, p["name"]] = (of, "promoted_property")

    def _start(self, rule: Rule, m: re.Match) -> int:
        if rule.kind in ("import", "impl_block") or rule.where == "enum":
            return m.start() + len(m[0]) - len(m[0].lstrip(" \t\n{,"))
        at = self._begin(m.start("name"), ";{},(" if rule.kind in ("field", "property") else ";{}")
        if self.language in ("go", "shell", "hcl", "typescript", "javascript"):
            line = self.starts[bisect_right(self.starts, m.start("name")) - 1]
            at = max(at, line + len(self.code[line:]) - len(self.code[line : m.end()].lstrip()) - len(self.code[m.end() :]))
        return re.compile(r"(?:\s*(?:#\[[^\]]*\]|#[^\n]*\n|(?:public|private|protected)\s*:(?!:)))*\s*").match(self.code, at, m.start("name") + 1).end()

    def _quoted(self, at: int) -> str:
        m = re.compile(r"\s*(['\"`])(.*?)\1", re.S).match(self.text, at)
        return m[2] if m else "test"

    def _block(self, kind: str, said: str, prefix: list[str], inside: str | None) -> tuple[str, str, list[str]]:
        words = [w.strip('"') for w in said.split()]
        if kind == "property":
            return ("property", words[0], prefix)
        word = words[0]
        if inside is None and len(words) > 1:
            kind = {"module": "module", "variable": "property", "output": "property", "run": "test"}.get(word, "configuration")
            head = ["resource", *words[1:-1]] if word == "resource" else [word, *words[1:-1]]
            return kind, words[-1], [*prefix, *head]
        return "configuration", "::".join(words), prefix

    def _is_test(self, name: str, at: int) -> bool:
        low, file = name.lower(), self.path.split("/")[-1]
        if self.language == "go":
            return file.endswith("_test.go") and bool(_GO_TEST.match(name))
        if self.language == "shell":
            return low.startswith("test_") or low.endswith("_test")
        if self.language == "php" and name.startswith("test"):
            return True
        if self.language == "cpp" and (low.startswith("test_") or low.endswith("_test") or re.fullmatch(self.spec.test, name)):
            return True
        return bool(self.spec.test and re.search(self.spec.test, self._attributes(at)))

    def _attributes(self, at: int) -> str:
        """What stands before a declaration's body and after the statement before it: attributes, annotations, its head."""
        end = re.compile("[{;]").search(self.code, at)
        return self.code[self._begin(at) : end.start() if end else len(self.code)]

    def _add(self, kind: str, name: str, prefix: list[str], start: int, end: int, opens: int | None) -> int:
        said = " ".join(self.text[start : opens if opens is not None else end][: 8 * SIGNATURE].split())
        said = said if len(said) <= SIGNATURE else said[: SIGNATURE - 1] + "…"
        (a, b), (c, d) = self._place(start), self._place(end)
        self.symbols.append(dict(name=name, qualified_name="::".join([*prefix, name]), container=prefix[-1] if prefix else None, kind=kind, signature=said, start_line=a, start_col=b, end_line=c, end_col=d))
        return len(self.symbols) - 1

    def _relate(self, at: int, head: str, prefix: list[str]) -> None:
        for relation, pattern in self.spec.heritage:
            if not (m := re.search(pattern, head)):
                continue
            plain = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m[1]))
            names = [re.sub(r"\b(?:public|private|protected|virtual)\b", "", x).strip() for x in plain.split(",")]
            for i, x in enumerate(n for n in names if re.fullmatch(r"[\w.:\\$]+", n)):
                name = "::".join(p for p in re.split(r"::|[.\\]", x) if p)
                own = self.symbols[at]["kind"]
                kind = "implements" if self.language == "csharp" and own != "interface" and (i or own != "class") else relation
                spaces = ["::".join([*prefix[:k], name]) for k in range(len(prefix), -1, -1)]
                self.relations.append({"from": at, "relation": kind, "names": spaces})

    def _call(self) -> None:
        """Each call belongs to the innermost callable around it; one outside of all has none and is left out."""
        self.bodies.sort()
        found = self._found()
        stack: list[tuple] = []
        i = 0
        for at, row in found:
            while i < len(self.bodies) and self.bodies[i][0] <= at:
                stack.append(self.bodies[i])
                i += 1
            while stack and stack[-1][1] <= at:
                stack.pop()
            if stack:
                opens, _, caller, owner = stack[-1]
                form, kind, name, qualifier, hint, *known = row(self.symbols[caller]["kind"], owner, caller, opens)
                line, col = self._place(at)
                of, source = known or (None, None)
                self.calls.append(dict(caller=caller, form=form, target_kind=kind, name=name, qualifier=qualifier, receiver_hint=hint, receiver_type=of, receiver_type_source=source, line=line, col=col))

    def _found(self) -> list[tuple]:
        if self.language == "shell":
            return [(m.start("name"), lambda *_, n=m["name"]: ("function", "function", n, None, None)) for m in _COMMANDS.finditer(self.code) if m["name"] not in _SHELL_WORDS]
        if self.language == "hcl":
            out = [(m.start(), lambda *_, n=m["name"]: ("function", "function", n, None, None)) for m in _HCL_CALL.finditer(self.code)]
            for m in _TRAVERSAL.finditer(self.code):
                out.append((m.start(), lambda *_, x=self._traversal(m["a"], m["b"], m["c"]): x))
            return sorted(((a, r) for a, r in out if r(None, None)), key=lambda x: x[0])
        out = []
        for m in _CALLS.finditer(self.code):
            if m.start("name") not in self.taken and (m["on"] or m["new"] or m["name"] not in _NOT_CALLED):
                out.append((m.start("name"), lambda *a, m=m: self._lookup(m, *a)))
        return out

    def _receiver(self, m: re.Match, on: list[str], sep: str, owner: str | None, caller: int, opens: int) -> tuple | None:
        """A PHP call whose receiver's type is known: by $this, a typed parameter or property, a local `new`, the service
        container, or the type's own name."""
        name, php = m["name"], self.aliases
        member = "nullsafe_member" if sep.startswith("?") else "member"
        if m["new"]:
            of = php.type("\\".join([*on, name]))
            return "scoped", "method", "__construct", of, name, of, "scoped_type"
        if not on:
            # A receiver that is a call ends right before the name, so the search ends there.
            made = _MADE.search(self.code, self._begin(m.start()), m.start())
            if made:
                of = php.type(made[1])
                return member, "method", name, of, None, of, "service_locator"
            return None
        if sep == "::":
            said = ("\\" if self.code[max(0, m.start() - 1) : m.start()] == "\\" else "") + "\\".join(on)
            if said in ("self", "static"):
                return "scoped", "method", name, owner, said, owner, "self_type"
            if said == "parent":
                up = re.search(rf"\bclass\s+{re.escape(owner or '')}\b[^{{]*?\bextends\s+(\\?[\w\\]+)", self.code) if owner else None
                of = php.type(up[1]) if up else None
                return "scoped", "method", name, of, "parent", of, "parent_type" if of else None
            of = php.type(said) if not said.startswith("$") else None
            return ("scoped", "method", name, of, on[-1][:HINT], of, "scoped_type") if of else None
        if on == ["$this"]:
            return member, "method", name, owner, "$this", owner, "this"
        found = self.props.get((owner, on[1])) if len(on) == 2 and on[0] == "$this" else None
        if len(on) == 1 and on[0].startswith("$"):
            last = None
            for last in re.finditer(rf"{re.escape(on[0])}\s*=(?![=>])\s*(?:new\s+(\\?[A-Za-z_][\w\\]*))?", self.code[opens : m.start()]):
                pass
            if last is None:
                found = self.params.get(caller, {}).get(on[0][1:])
            elif last[1] and last[1] not in ("self", "static", "parent", "class"):
                found = (php.type(last[1]), "local_new")
        return (member, "method", name, found[0], on[-1][:HINT], found[0], found[1]) if found else None

    @staticmethod
    def _traversal(a: str, b: str, c: str | None) -> tuple | None:
        if a in ("each", "count", "self", "path", "terraform"):
            return None
        if a == "data":
            return ("scoped", "configuration", c, f"data::{b}", None) if c else None
        space = {"var": "variable", "local": "locals", "module": "module"}.get(a)
        return ("scoped", "configuration", b, space or f"resource::{a}", None)

    def _lookup(self, m: re.Match, kind: str, owner: str | None, caller: int, opens: int) -> tuple:
        name, on = m["name"], [p for p in re.split(r"\?\.|\?->|->|::|\.|\\", m["on"]) if p]
        sep = m["on"][len(m["on"].rstrip("?.->:\\")) :] if m["on"] else ""
        hint = on[-1] if on and len(on[-1]) <= HINT else on[-1][:HINT] if on and self.language == "go" else None
        if self.language == "php" and (known := self._receiver(m, on, sep, owner, caller, opens)):
            return known
        if not m["new"] and (known := self.aliases.call(name, on, sep)):
            return (*known, hint)
        if m["new"] and self.spec.constructor:
            return "scoped", "method", self.spec.constructor, name, name
        if not on or (sep == "\\"):
            if self.code[max(0, m.start() - 2) : m.start()].endswith((".", "->", "::")):
                return "member", "method", name, None, None
            domain = "method" if self.language == "cpp" and kind == "method" else self.spec.bare
            if self.language == "go" and _GO_TEST.match(name):
                domain = "test"
            return "function", domain, name, None, None
        if on[-1] in self.spec.own:
            return ("scoped" if sep == "::" else "member"), "method", name, owner, hint
        if sep == "::":
            if self.language == "cpp":
                return "function", "method" if on[-1][:1].isupper() else "function", name, on[-1], hint
            return "scoped", "method" if self.language == "php" or on[-1][:1].isupper() else "function", name, None if on[-1] == "parent" else on[-1], hint
        if self.language == "go":
            return "member", "method", name, on[-1] if on[-1][:1].isupper() else None, hint
        if on[-1][:1].isupper() and sep == ".":
            return "scoped", "method", name, on[-1], hint
        return "nullsafe_member" if sep.startswith("?") else "member", "method", name, None, hint


def read(path: str, text: str | None) -> tuple[list[dict], list[dict], list[dict], int, list[dict]]:
    """Symbols, calls and relations of one file of any of the eleven languages, its number of diagnostics and the first of them."""
    language = EXTENSIONS.get(path.rsplit(".", 1)[-1]) if "." in path.split("/")[-1][1:] else None
    if language is None:
        return [], [], [], 0, []
    if language == "python":
        s, c, b, errors = python_code.read(path, text)
        return s, c, [{"from": x["from"], "relation": "extends", "names": x["names"]} for x in b], len(errors), errors
    r = _Reader(language, path, (text or "").replace("\r\n", "\n"))
    return r.symbols, r.calls, r.relations, r.diagnostics, r.errors


def facts(path: str, text: str | None) -> tuple[list[dict], list[dict], list[dict], int]:
    return read(path, text)[:4]


def parse(files: DataFrame) -> DataFrame:
    """path, symbols, calls, relations, diagnostics (their number) and errors (the first of them) of each row of files
    (path, text). python_code.symbols and python_code.call_sites explode them to tables."""
    kinds = [_type(_SYMBOL), _type(_CALL), _type(_RELATION)]
    errors = _type(_DIAGNOSTIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                rows = [read(p or "", t) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)]
                parts = list(zip(*rows, strict=True))
                lists = (pa.array(list(x), k[1]) for x, k in zip(parts, kinds, strict=False))
                yield pa.RecordBatch.from_arrays([b.column("path").cast(pa.string()), *lists, pa.array(parts[3], pa.int32()), pa.array(list(parts[4]), errors[1])], ["path", "symbols", "calls", "relations", "diagnostics", "errors"])

    return files.select("path", "text").mapInArrow(run, f"path string, symbols {kinds[0][0]}, calls {kinds[1][0]}, relations {kinds[2][0]}, diagnostics int, errors {errors[0]}")


def diagnostics(parsed: DataFrame) -> DataFrame:
    """path, file (the file that keeps it), kind, cause, node_kind and range of each kept diagnostic."""
    return parsed.select("path", F.col("path").alias("file"), F.explode("errors").alias("e")).select("path", "file", "e.*")


def relations(parsed: DataFrame) -> DataFrame:
    """request (a type's id), relation, at, and the names it may mean, nearest scope first."""
    b = parsed.select("path", F.posexplode("relations").alias("at", "b"))
    return b.select(_id(F.col("b.from")).alias("request"), "b.relation", "at", F.col("b.names").alias("names"))
