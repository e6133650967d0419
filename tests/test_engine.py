"""Folder to snapshot to answers, Git's inventory and differences, and operators against brute force."""

import re
import subprocess

import pytest

from graphloom import engine
from graphloom.operators import related, search
from graphloom.sources import git, graph, precise
from graphloom.sources.store import NotFresh, Store

CODE = {
    "src/a.py": "def target(x):\n    return x\n\n\ndef caller():\n    target(1)\n    target(2)\n    target(3)\n    target(4)\n\n\nclass Base:\n    def go(self):\n        return target(5)\n\n\nclass Sub(Base):\n    def own(self):\n        self.go()\n        lost()\n",
    "tests/test_a.py": "from src.a import nothing\n\n\ndef test_it():\n    target(1)\n    target(2)\n",
    "w/x.go": "package w\n\nfunc target() {}\nfunc Twice() { target(); target() }\n",
    "root.rs": "fn lonely() {}\n",
}


@pytest.fixture(scope="module")
def snap(spark, tmp_path_factory):
    """A stored revision; answers read it and parse nothing."""
    d = spark.createDataFrame(list(CODE.items()), "path string, text string")
    d = d.select("path", search.path_language(d.path).alias("language"), search.path_role(d.path).alias("role"), "text")
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    graph.publish(store, d)
    s = engine.open_store(store)
    s.revision = 7
    assert "MapInArrow" not in s.edges._jdf.queryExecution().toString()
    return s


def test_names_are_not_guessed(snap):
    e = engine.Engine(snap)
    with pytest.raises(engine.AmbiguousSymbol):
        e.callers("target")
    with pytest.raises(engine.SymbolNotFound):
        e.callers("Target")
    with pytest.raises(engine.StaleReference):
        e.context("src/a.py#00000000", revision=6)
    with pytest.raises(engine.InvalidRequest):
        e.symbol_search("  ")
    with pytest.raises(engine.InvalidRequest):
        e.repo_map(limit=0)
    snap.fresh = False
    with pytest.raises(NotFresh):
        e.callers("a::target")
    assert e.callers("a::target", allow_stale=True).fresh is False
    again = engine.Snapshot(**{**snap.__dict__, "fresh": True})
    e = engine.Engine(snap, renew=lambda: again)
    assert e.callers("a::target").fresh is True and e.s is again
    snap.fresh = True
    for bad in ({"languages": [""]}, {"package": " "}, {"package": "x" * 257}, {"roles": ["test"] * 17}):
        with pytest.raises(engine.InvalidRequest):
            engine.Engine(snap).repo_map(**bad)


def test_callers_never_cross_languages(snap):
    a = engine.Engine(snap).callers("a::target")
    got = {(r["qualified_name"], r["occurrence_count"], tuple(r["lines"]), r["locations_omitted"]) for r in a.data["callers"]}
    assert got == {("a::caller", 4, (6, 7, 8), 1), ("a::Base::go", 1, (14,), 0), ("tests::test_a::test_it", 2, (5, 6), 0)} and not a.truncated
    assert [r["qualified_name"] for r in engine.Engine(snap).callers("w::x::target").data["callers"]] == ["w::x::Twice"]


def test_context_and_limits(snap):
    e = engine.Engine(snap)
    a = e.context("a::target")
    assert a.data["source"][0]["snippet"] == "def target(x):\n    return x" and a.data["source"][0]["truncated"] is False
    assert [(r["qualified_name"], r["occurrence_count"], r["precision"]) for r in a.data["tests"]] == [("tests::test_a::test_it", 2, "heuristic")]
    assert [r["path"] for r in a.data["related_files"]] == ["src/a.py", "tests/test_a.py"]
    b = e.context("a::target", limit=1)
    assert b.truncated and ("callers", "item_limit", 1) in b.truncation and len(b.data["callers"]) == 1
    assert [r["name"] for r in e.context("a::Sub::own").data["syntax_call_candidates"]] == ["go", "lost"]
    assert e.context("a::target", limit=0).data["callers"] == []


def test_map_pages_and_status(snap):
    e = engine.Engine(snap)
    first = e.repo_map(limit=3)
    assert [r["path"] for r in first.data["files"]] == ["root.rs", "src/a.py", "tests/test_a.py"] and {r["name"] for r in first.data["overview"]} < {"(root)", "src", "tests", "w"}
    cursor = first.data["next_cursor"][0]
    second = e.repo_map(cursor=cursor)
    assert [r["path"] for r in second.data["files"]] == ["w/x.go"] and second.data["next_cursor"] == [] and "overview" not in second.data
    with pytest.raises(engine.StaleReference):
        e.repo_map(cursor={**cursor, "revision": 6})
    assert [r["path"] for r in e.repo_map(roles=["test"]).data["files"]] == ["tests/test_a.py"]
    counts = e.status().data["counts"][0]
    assert counts["files"] == 4 and counts["call_sites"] == counts["resolved"] + counts["ambiguous"] + counts["unresolved"]
    assert '"revision": 7' in e.status().to_json()


def test_search_and_diff(snap, spark):
    e = engine.Engine(snap)
    assert [(r["path"], r["line"], r["start_column"]) for r in e.search("TARGET(").data["matches"]][:3] == [("src/a.py", 1, 5), ("src/a.py", 6, 5), ("src/a.py", 7, 5)]
    assert [r["name"] for r in e.symbol_search("own", kinds=["method"]).data["symbols"]] == ["own"]
    d = spark.createDataFrame([("src/a.py", "modified", None), ("gone.py", "deleted", None)], "path string, change string, previous_path string")
    a = e.diff_context(d)
    assert {r["name"] for r in a.data["changed_symbols"]} == {"target", "caller", "Base", "go", "Sub", "own"}
    assert [r["qualified_name"] for r in a.data["related_tests"]] == ["tests::test_a::test_it"]
    assert {(r["kind"], r["src"], r["dst"]) for r in snap.edges.filter("kind = 'EXTENDS'").collect()} == {("EXTENDS", "src/a.py#00000004", "src/a.py#00000002")}


@pytest.mark.parametrize("query,regex,case", [("ab", False, False), ("a.", True, True), (r"\bé+", True, False), ("x*", True, True), (r"(?<=b)a", True, True), ("a$", True, True), (r"\E.", False, True)])
def test_matches_against_brute_force(spark, query, regex, case):
    rows = [("p", "abab ABx\nxxaé É\r\nba a$\\E.\n"), ("q", ""), ("r", None), ("s", "𝔸ab" * 300)]
    got = {(r.path, r.line, r.start_column, r.end_column) for r in search.match_all(spark.createDataFrame(rows, "path string, text string"), query, regex, case).collect()}
    rx, want = re.compile(query if regex else re.escape(query), 0 if case else re.I), set()
    for path, text in rows:
        for i, line in enumerate((text or "").splitlines()):
            want |= {(path, i + 1, m.start() + 1, m.end() + 1) for m in rx.finditer(line) if m[0]}
    assert got == want


@pytest.mark.parametrize("limits", [(100, 100), (100, 7), (100, 8), (5, 9), (0, 3), (100, 0), (9, 100)])
def test_admission_against_the_fold(spark, limits):
    rows = [(i * 3, i % 4, "resolved" if i % 3 else "unresolved") for i in range(40)]
    sites = spark.createDataFrame(rows, "seq long, caller long, resolution string")
    got = {r.seq for r in related.admit_sites(sites, spark.createDataFrame([(1,), (2,)], "id long"), *limits).filter("admitted").collect()}
    want, used = set(), 0
    for seq, caller, resolution in rows:
        cost = (2 if caller in (1, 2) else 1) if resolution == "resolved" else 0
        if len(want) < limits[0] and used + cost <= limits[1]:
            want.add(seq)
            used += cost
    assert got == want


def test_endpoints_and_extensions(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "qualified_name string, id long")
    r = spark.createDataFrame([(1, ["x", "a"]), (2, ["b", "a"]), (3, ["x"])], "request long, names array<string>")
    assert {(x.request, x.target) for x in related.endpoint(r, t).collect()} == {(1, 1), (2, None)}
    s = spark.createDataFrame([(1, "f", ["n", "m"]), (2, "g", ["n", "m"]), (3, "f", ["z"])], "seq long, name string, namespaces array<string>")
    d = spark.createDataFrame([("n", "f", "A"), ("m", "f", "A"), ("n", "g", "A"), ("m", "g", "B")], "namespace string, name string, container string")
    assert {tuple(x) for x in related.extension_containers(s, d).collect()} == {(1, "A")}


def test_git(spark, tmp_path):
    root = str(tmp_path)

    def run(*a):
        subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x.org", *a], check=True, capture_output=True)

    def put(name, text):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)

    run("init", "-q", "-b", "main")
    put(".gitignore", "no.py\n")
    for n in ("k/a.py", "b.py", "no.py", "c é.py"):
        put(n, f"# {n}\n" * 20)
    assert {(r.path, r.change) for r in git.changes(spark, root).collect()} == {(".gitignore", "added"), ("k/a.py", "added"), ("b.py", "added"), ("c é.py", "added")}
    first = git.identity(root)
    run("add", "-A")
    run("commit", "-qm", "one")
    assert [r.path for r in git.inventory(spark, root).orderBy("path").collect()] == ["b.py", "c é.py", "k/a.py"]
    assert {r.path for r in git.files(spark, root).collect()} == {"b.py", "c é.py", "k/a.py"}
    run("mv", "k/a.py", "k/z.py")
    (tmp_path / "b.py").unlink()
    put("c é.py", "new")
    put("n.py", "new")
    got = {(r.path, r.previous_path, r.change, r.precision) for r in git.changes(spark, root).collect()}
    assert got == {("k/z.py", "k/a.py", "renamed", "heuristic"), ("b.py", None, "deleted", "precise"), ("c é.py", None, "modified", "precise"), ("n.py", None, "added", "precise")}
    run("add", "-A")
    run("commit", "-qm", "two")
    assert git.changes(spark, root).count() == 0 and git.changes(spark, root, "base_ref", "HEAD~1").count() == 4 and git.baseline(root, "merge_base", "HEAD~1") == git.baseline(root, "base_ref", "HEAD~1")
    assert first != git.identity(root) and git.identity(root)[0] == git.identity(root)[0]
    with pytest.raises(git.GitError):
        git.baseline(root, "base_ref", "--all")
