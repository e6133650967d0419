"""The seven questions over stdio: JSON-RPC, one request a line, read-only tools.

Two questions run at once; others wait for a place for QUEUE_SECONDS, and a question that takes longer than SECONDS is
cancelled with its Spark jobs. An answer has at most MOST_BYTES. Errors are typed; nothing ends the server but its input.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as OutOfTime

from graphloom import engine
from graphloom.sources.store import NotFresh

#: Fixed values.
SLOTS, QUEUE_SECONDS, SECONDS, MOST_BYTES = 2, 5.0, 30.0, 1 << 20
_TEXT, _TEXTS, _COUNT, _FLAG = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer", "minimum": 0}, {"type": "boolean"}
_SCOPE = {"languages": _TEXTS, "roles": _TEXTS, "not_roles": _TEXTS, "package": _TEXT, "path_prefix": _TEXT}
_COMMON = {"limit": _COUNT, "allow_stale": _FLAG}
_SYMBOL = {"symbol": {"type": ["string", "integer"]}, "revision": _COUNT}
#: Tools: what each is for, its arguments, and those it needs.
TOOLS = {
    "status": ("Revision, counts, providers, coverage and diagnostics", {"limit": _COUNT}, []),
    "repo_map": ("Groups of files, and files by path, page by page", {**_SCOPE, "cursor": {"type": "object"}, **_COMMON}, []),
    "search": ("Matches in the text of files", {"query": _TEXT, "regex": _FLAG, "case_sensitive": _FLAG, **_COMMON}, ["query"]),
    "symbol_search": ("Symbols by name, best first", {"query": _TEXT, "kinds": _TEXTS, "not_kinds": _TEXTS, "namespace": _TEXT, **_SCOPE, **_COMMON}, ["query"]),
    "context": ("A symbol with its relations, tests, candidates and source", {**_SYMBOL, **_COMMON}, ["symbol"]),
    "callers": ("Who calls a symbol, and who may", {**_SYMBOL, **_COMMON}, ["symbol"]),
    "diff_context": ("Symbols of changed files with callers, tests and relations", {"scope": {"enum": ["worktree", "base_ref", "merge_base"]}, "ref": _TEXT, **_COMMON}, []),
}
_ERRORS = {engine.InvalidRequest: "invalid_request", engine.SymbolNotFound: "symbol_not_found", engine.AmbiguousSymbol: "ambiguous_symbol", engine.StaleReference: "stale_reference", NotFresh: "freshness_not_met"}


class Refused(Exception):
    """An error that the client is told by its kind."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Server:
    """changes: gives the table of changed paths for a scope and a reference, for diff_context."""

    def __init__(self, questions: engine.Engine, changes: Callable | None = None, slots: int = SLOTS, queue_seconds: float = QUEUE_SECONDS, seconds: float = SECONDS, most_bytes: int = MOST_BYTES):
        self.questions, self.changes, self.queue_seconds, self.seconds, self.most_bytes = questions, changes, queue_seconds, seconds, most_bytes
        self.places, self.pool = threading.BoundedSemaphore(slots), ThreadPoolExecutor(slots)
        self.counters = {"answered": 0, "failed": 0, "queue_timeout": 0, "execution_timeout": 0}

    def call(self, tool: str, arguments: dict) -> str:
        """The JSON of an answer; Refused where there is none."""
        if tool not in TOOLS:
            raise Refused("unknown_tool", tool)
        _, known, needed = TOOLS[tool]
        if (odd := set(arguments) - set(known)) or (odd := set(needed) - set(arguments)):
            raise Refused("invalid_request", f"arguments: {', '.join(sorted(odd))}")
        if not self.places.acquire(timeout=self.queue_seconds):
            self.counters["queue_timeout"] += 1
            raise Refused("queue_timeout", f"no place within {self.queue_seconds} seconds")
        group, sc = uuid.uuid4().hex, self.questions.s.symbols.sparkSession.sparkContext
        job = self.pool.submit(self._run, tool, arguments, group)
        job.add_done_callback(lambda _: self.places.release())
        try:
            out = job.result(self.seconds)
        except OutOfTime:
            sc.cancelJobGroup(group)
            self.counters["execution_timeout"] += 1
            raise Refused("execution_timeout", f"no answer within {self.seconds} seconds") from None
        except tuple(_ERRORS) as e:
            self.counters["failed"] += 1
            raise Refused(next(kind for of, kind in _ERRORS.items() if isinstance(e, of)), str(e)) from e
        if len(out.encode()) > self.most_bytes:
            self.counters["failed"] += 1
            raise Refused("response_too_large", f"more than {self.most_bytes} bytes")
        self.counters["answered"] += 1
        return out

    def _run(self, tool: str, arguments: dict, group: str) -> str:
        self.questions.s.symbols.sparkSession.sparkContext.setJobGroup(group, tool, interruptOnCancel=True)
        if tool == "diff_context":
            if self.changes is None:
                raise engine.InvalidRequest("there is no source of changes")
            changes = self.changes(arguments.pop("scope", "worktree"), arguments.pop("ref", None))
            return self.questions.diff_context(changes, **arguments).to_json()
        return getattr(self.questions, tool)(**arguments).to_json()

    def handle(self, request: dict) -> dict | None:
        """The response to one request; None to a notification."""
        if "id" not in request:
            return None
        head, method, params = {"jsonrpc": "2.0", "id": request["id"]}, request.get("method"), request.get("params") or {}
        if method == "initialize":
            return {**head, "result": {"protocolVersion": params.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "2"}}}
        if method == "ping":
            return {**head, "result": {}}
        if method == "tools/list":
            hints = {"readOnlyHint": True, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False}
            return {**head, "result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r, "additionalProperties": False}, "annotations": hints} for n, (d, p, r) in TOOLS.items()]}}
        if method != "tools/call":
            return {**head, "error": {"code": -32601, "message": f"no method {method!r}"}}
        try:
            said = self.call(params.get("name"), dict(params.get("arguments") or {}))
            return {**head, "result": {"content": [{"type": "text", "text": said}], "isError": False}}
        except Refused as e:
            return {**head, "error": {"code": -32602 if e.kind in ("invalid_request", "unknown_tool") else -32000, "message": str(e), "data": {"kind": e.kind}}}
        except Exception as e:  # noqa: BLE001 - one failed question doesn't end the server
            self.counters["failed"] += 1
            return {**head, "error": {"code": -32603, "message": type(e).__name__, "data": {"kind": "internal_error"}}}

    def serve(self, lines: Iterable[str], write: Callable[[str], object]) -> None:
        """Answers requests as they come, each in a thread of its own, until the input ends."""
        lock, threads = threading.Lock(), []

        def one(line: str) -> None:
            try:
                out = self.handle(json.loads(line))
            except (ValueError, TypeError, AttributeError):
                out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a JSON request"}}
            if out is not None:
                with lock:
                    write(json.dumps(out, ensure_ascii=False) + "\n")

        for line in lines:
            if line.strip():
                threads = [t for t in threads if t.is_alive()]
                threads.append(threading.Thread(target=one, args=(line,), daemon=True))
                threads[-1].start()
        for t in threads:
            t.join()
