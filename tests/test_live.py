"""Live stores, servers, providers and extensions on small tables."""

import json
import sys
import textwrap
import threading
import time

import pytest

from graphloom import engine, extension, server
from graphloom.operators import search
from graphloom.sources import graph, lexical, precise
from graphloom.sources.store import RevisionConflict, Store
from graphloom.streaming import live

CODE = {"a.py": "def one():\n    return two()\n\n\ndef two():\n    return 2\n", "b.py": "def three():\n    return 3\n"}


def sources(spark, code):
    d = spark.createDataFrame(list(code.items()), "path string, text string")
    return d.select("path", search.path_language(d.path).alias("language"), search.path_role(d.path).alias("role"), "text")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("live")))
    graph.publish(s, sources(spark, CODE))
    return s


def test_relevant_events_and_bursts(spark):
    rows = [("a.py", "modify"), ("a.py", "access_read"), ("b.py", "access_close_write"), (".git/index", "modify"), ("x/.git/HEAD", "create"), ("x.git/a", "create")]
    assert {tuple(r) for r in live.relevant(spark.createDataFrame(rows, "path string, kind string")).collect()} == {rows[0], rows[2], rows[5]}
    at = [0, 40, 90, 140, 190, 240, 251, 300, 400, 449]
    got = live.bursts(spark.createDataFrame([("s", t) for t in at], "source string, at long"), ["source"]).orderBy("at").collect()
    assert [r.burst for r in got] == [0, 0, 0, 0, 0, 0, 1, 1, 2, 2]


def test_stable_scan(spark):
    states = iter([["a"], ["a", "b"], ["a", "b"]])
    seen = []
    out = live.stable_scan(lambda: spark.createDataFrame([(x,) for x in next(states)], "path string"), lambda inv: seen.append(inv.count()) or inv)
    assert seen == [1, 2] and out.count() == 2
    n = iter(range(100))
    with pytest.raises(live.Unstable):
        live.stable_scan(lambda: spark.createDataFrame([(next(n),)], "path long"), lambda inv: inv)


def test_events_revoke_and_scans_cover(spark, tmp_path):
    s, kinds = Store(spark, str(tmp_path / "s")), []

    def scan(kind, paths):
        kinds.append((kind, sorted(paths)))
        return {"files": spark.createDataFrame([(kind,)], "path string")}

    x = live.Live(s, scan)
    assert x.reconcile() == "full" and s.current() == 1 and x.reconcile() == "noop"
    g = x.notice({"a"}, "w", 5)
    assert s.revoked(1) and not x.wait(0.05) and s.wait(1, 0.05) is None
    done = []
    t = threading.Thread(target=lambda: done.append(x.wait(20, g)))
    t.start()
    assert x.reconcile() == "targeted" and kinds[-1] == ("targeted", ["a"])
    t.join()
    assert done == [True] and s.wait(1, 5) == 2 and not s.revoked(2)
    x.notice({"b"}, "w", 7)
    assert x.reconcile() == "full" and s.current() == 3
    x.notice({"c"}, "w", 8)
    x.scan = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        x.reconcile()
    x.scan = scan
    assert x.reconcile() == "full" and kinds[-1] == ("full", ["c"])
    x.scan = lambda *a: (_ for _ in ()).throw(RevisionConflict("moved"))
    x.notice({"d"})
    with pytest.raises(RevisionConflict):
        x.reconcile()


def test_stream_of_events(spark, tmp_path):
    d = tmp_path / "events"
    d.mkdir()
    (d / "0.json").write_text('{"path": "a.py", "kind": "modify"}\n{"path": ".git/x", "kind": "modify"}\n')
    x = live.Live(Store(spark, str(tmp_path / "s")), lambda kind, paths: {"files": spark.createDataFrame([(p,) for p in sorted(paths)], "path string")})
    q = x.follow(spark.readStream.schema("path string, kind string").json(str(d))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert x.covered == x.generation == 1 and [r.path for r in x.store.read("files").collect()] == ["a.py"]


def test_server(spark, store):
    e = engine.Engine(engine.open_store(store))
    s = server.Server(e, lambda scope, ref: spark.createDataFrame([("a.py", "modified")], "path string, change string"), seconds=300)
    ask = lambda tool, **a: {"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}}
    assert s.handle({"method": "notifications/initialized"}) is None
    assert s.handle({"id": 0, "method": "initialize"})["result"]["serverInfo"]["name"] == "graphloom"
    tools = s.handle({"id": 1, "method": "tools/list"})["result"]["tools"]
    assert [t["name"] for t in tools] == list(server.TOOLS) and all(t["annotations"]["readOnlyHint"] for t in tools)
    data = json.loads(s.handle(ask("callers", symbol="a::two"))["result"]["content"][0]["text"])["data"]
    assert [r["qualified_name"] for r in data["callers"]] == ["a::one"]
    assert json.loads(s.handle(ask("diff_context"))["result"]["content"][0]["text"])["data"]["changed_files"][0]["path"] == "a.py"
    kinds = {t: s.handle(r)["error"]["data"]["kind"] for t, r in {"a": ask("callers", symbol="no"), "b": ask("nothing"), "c": ask("search"), "d": ask("search", query="x", odd=1), "e": ask("search", query="")}.items()}
    assert kinds == {"a": "symbol_not_found", "b": "unknown_tool", "c": "invalid_request", "d": "invalid_request", "e": "invalid_request"}
    assert s.handle({"id": 2, "method": "no"})["error"]["code"] == -32601
    out = []
    s.serve(["not json\n", "\n", json.dumps({"id": 3, "method": "ping"}) + "\n"], out.append)
    assert sorted(json.loads(x)["id"] or 0 for x in out) == [0, 3]
    small = server.Server(e, most_bytes=10, seconds=300)
    assert small.handle(ask("search", query="two"))["error"]["data"]["kind"] == "response_too_large"


def test_server_queue_and_deadline(store):
    e = engine.Engine(engine.open_store(store))
    e.search = lambda **a: time.sleep(1.5)
    s = server.Server(e, slots=1, queue_seconds=0.1, seconds=0.5)
    ask = {"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "x"}}}
    got = []
    t = threading.Thread(target=lambda: got.append(s.handle(ask)))
    t.start()
    time.sleep(0.2)
    assert s.handle(ask)["error"]["data"]["kind"] == "queue_timeout"
    t.join()
    assert got[0]["error"]["data"]["kind"] == "execution_timeout" and s.counters["execution_timeout"] == 1


def test_table_provider_merges_and_caches(spark, store):
    s = engine.open_store(store)
    rows = [(1, "a::two", "incoming", "three", "b.py", 1, 5, 7, [2, 3, 4, 5]), (1, "a::two", "incoming", "one", "a.py", 1, 5, 1, [2]), (2, "a::two", "incoming", "three", "b.py", 1, 5, 1, [2])]
    table = spark.createDataFrame(rows, "revision long, symbol string, direction string, name string, path string, line long, col long, occurrence_count long, lines array<bigint>")
    p = precise.Cached(precise.TableProvider("pyright", table))
    e = engine.Engine(s, {"python": p})
    for _ in range(2):
        got = e.callers("a::two").data
        assert [(r["qualified_name"], r["precision"], r["occurrence_count"], r["lines"], r["locations_omitted"]) for r in got["callers"]] == [("a::one", "precise", 1, [2], 0), ("b::three", "precise", 7, [2, 3, 4], 4)]
        assert got["provider"] == [{"name": "pyright", "state": "ready"}]
    assert (p.hits, p.misses) == (1, 1) and e.status().data["workspace"][0]["provider_state"] == "ready"
    s.revision = 9
    assert [r["precision"] for r in e.callers("a::two").data["callers"]] == ["heuristic"]
    tiny = precise.Cached(precise.TableProvider("pyright", table), answers=1)
    row = e.find("a::two")
    for limit in (1, 2, 1):
        assert tiny.enrich(1, row, ("incoming",), limit).truncated == (limit == 1)
    assert tiny.misses == 3


SERVER = """
    import json, sys
    def read():
        n = 0
        while (line := sys.stdin.buffer.readline().strip()):
            if line.lower().startswith(b"content-length"): n = int(line.split(b":")[1])
        return json.loads(sys.stdin.buffer.read(n))
    def say(x):
        raw = json.dumps({"jsonrpc": "2.0", **x}).encode()
        sys.stdout.buffer.write(b"Content-Length: %d\\r\\n\\r\\n" % len(raw) + raw); sys.stdout.buffer.flush()
    root = None
    while True:
        m = read()
        if "id" not in m or "method" not in m: continue
        at = {"start": {"line": 0, "character": 4}, "end": {"line": 0, "character": 7}}
        if m["method"] == "initialize":
            root = m["params"]["rootUri"]; say({"id": 99, "method": "client/ask", "params": {}}); out = {"capabilities": {}}
        elif m["method"] == "textDocument/prepareCallHierarchy": out = [{"name": "two", "position": m["params"]["position"]}]
        elif m["method"] == "callHierarchy/incomingCalls": out = [{"from": {"name": "one()", "uri": root + "a.py", "selectionRange": at}, "fromRanges": [{"start": {"line": 1, "character": 11}}]}, {"from": {"name": "far", "uri": "file:///elsewhere/x.py", "selectionRange": at}, "fromRanges": []}]
        elif m["method"] == "textDocument/references": out = [{"uri": root + "b.py", "range": at}]
        else: out = []
        say({"id": m["id"], "result": out})
"""


def test_language_server(spark, store, tmp_path):
    for name, text in CODE.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "server.py").write_text(textwrap.dedent(SERVER))
    e = engine.Engine(engine.open_store(store))
    row = e.find("a::two")
    p = precise.LspProvider("pyright", str(tmp_path), [sys.executable, str(tmp_path / "server.py")], seconds=20)
    got = p.enrich(1, row, ("incoming", "outgoing"), 20)
    assert got.state == "ready" and got.relations == (precise.Relation("incoming", "one", "a.py", 1, 5, 1, (2,), "pyright"),)
    p.close()
    refs = precise.LspProvider("bash_language_server", str(tmp_path), [sys.executable, str(tmp_path / "server.py")], False, 20)
    assert [r.path for r in refs.enrich(1, row, ("incoming",), 20).relations] == ["b.py"]
    refs.close()
    gone = precise.LspProvider("gopls", str(tmp_path), ["/nowhere/gopls"])
    assert gone.enrich(1, row, ("incoming",), 20).state == "degraded" and gone.state(1) == "degraded"
    slow = precise.LspProvider("clangd", str(tmp_path), [sys.executable, "-c", "import time; time.sleep(60)"], seconds=0.3)
    assert slow.enrich(1, row, ("incoming",), 20).cause and set(precise.SERVERS) >= {"rust", "hcl"}


def test_registry(spark):
    class Fixed:
        def parse(self, files):
            return lexical.parse(files.selectExpr("path", "'fn made() {}' AS text"))

    r = extension.Registry()
    r.add("rust", Fixed())
    with pytest.raises(extension.Conflict):
        r.add("rust", Fixed())
    with pytest.raises(extension.Conflict):
        r.add("cobol", Fixed())
    d = spark.createDataFrame([("a.rs", "fn old() {}"), ("b.go", "package b\nfunc F() {}\n"), ("c.txt", "x")], "path string, text string")
    got = {(x.path, s.name) for x in r.parse(d).collect() for s in x.symbols}
    assert got == {("a.rs", "made"), ("b.go", "F")}
