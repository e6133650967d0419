from graphloom.operators import resolve
from graphloom.sources import manifests, python_code, worktree

CODE = '''import a.b
import os.path as p
from .near import Thing, low as deep


class C(Thing, metaclass=M):
    x: int = 1
    y, z = 1, 2

    @staticmethod
    def m(self):
        self.n(); super().n(); a.b.f(); p.join(1); deep(); Thing(); o.q.r(); C.m(1)
        run(lambda: hidden())

        def inner():
            own()
'''


def test_python_facts():
    s, c, b, bad = python_code.facts("src/k/f.py", CODE)
    assert bad == 0
    assert [(x["qualified_name"], x["kind"]) for x in s[3:]] == [("k::f::C", "class"), ("k::f::C::x", "property"), ("k::f::C::m", "method"), ("k::f::C::m::inner", "function")]
    got = [(x["form"], x["name"], x["qualifier"], x["caller"]) for x in c]
    assert got == [("member", "n", "C", 5), ("member", "n", "Thing", 5), ("function", "super", None, 5), ("scoped", "f", "a::b", 5), ("scoped", "join", "os::path", 5), ("scoped", "low", "k::near", 5),
                   ("scoped", "__init__", "Thing", 5), ("member", "r", None, 5), ("scoped", "m", "C", 5), ("function", "run", None, 5), ("function", "own", None, 6)]
    assert b == [{"from": 3, "names": ["k::f::Thing", "k::near::Thing"]}]
    assert s[5]["signature"] == "@staticmethod def m(self):" and s[5]["start_line"] == 10


def test_python_odd_files():
    assert python_code.facts("a.py", None) == python_code.facts("a.py", "") == ([], [], [], 0)
    for text in ("def f(:\n", "x = '\0'", "(" * 5000):
        assert python_code.facts("a.py", text)[3] == 1
    s = python_code.facts("a.py", "é = 1; ü = 2\r\nb = 3\r\n")[0]
    assert [(x["name"], x["start_line"], x["start_col"]) for x in s] == [("é", 1, 1), ("ü", 1, 8), ("b", 2, 1)]
    assert python_code.module_path("src/a/__init__.py") == ["a"] and python_code.module_path("src.py") == ["src"]


def test_folder_to_resolved_calls(spark, tmp_path):
    for name, text in {"src/a.py": "def one():\n    return two()\n", "src/b.py": "def two():\n    return one() + none()\n", "target/c.py": "def one(): pass\n", "x.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "src/big.py").write_text("#" * 500)
    files = worktree.read(spark, str(tmp_path), 400)
    assert sorted(r.path for r in files.select("path").collect()) == ["src/a.py", "src/b.py"]
    assert tuple(worktree.left_out(spark, str(tmp_path), 400).first()) == (1, 1)
    sizes = {r.path: r.n_bytes for r in files.collect()}
    assert [r.path for r in worktree.read(spark, str(tmp_path), 400, max_files=1).collect()] == ["src/a.py"]
    assert [r.path for r in worktree.read(spark, str(tmp_path), 400, max_total=sizes["src/b.py"]).collect()] in (["src/a.py"], ["src/b.py"])
    assert worktree.read(spark, str(tmp_path), 400, max_total=5).count() == 0
    parsed = python_code.parse(files)
    r = resolve.resolve(python_code.call_sites(parsed), resolve.callable_catalog(python_code.symbols(parsed)))
    assert {(x["name"], x.resolution, x.target) for x in r.collect()} == {("two", "resolved", "src/b.py#00000000"), ("one", "resolved", "src/a.py#00000000"), ("none", "unresolved", None)}
    assert python_code.parse(files.limit(0)).count() == 0


def test_manifests(spark):
    rows = [
        ("a/package.json", '{"name": "js"}', "js"), ("a/composer.json", "not json", None), ("pyproject.toml", '[tool]\nname = "no"\n[project]\nversion = "1"\nname = "py"\n', "py"), ("b/pyproject.toml", '[project]\nversion = "1"\n[tool]\nname = "no"\n', "b"),
        ("c/pom.xml", "<project><parent><artifactId>up</artifactId></parent><artifactId>own</artifactId></project>", "own"), ("d/go.mod", "module ex.org/m\n", "ex.org/m"),
        ("e/settings.gradle", "rootProject.name = 'g'\n", "g"), ("f/Lib.csproj", "<Project/>", "Lib"), ("f/readme.md", "name", None), ("g/package.json", None, "g"),
    ]
    d = spark.createDataFrame(rows, "path string, text string, want string")
    got = {r.root: r.package_name for r in manifests.roots(d).collect()}
    assert got == {r[0].rpartition("/")[0]: r[2] for r in rows if r[2]}
    assert manifests.roots(d.filter("false")).count() == 0


def test_reconcile_policy():
    from graphloom.streaming.policy import FULL_AFTER, Policy

    kind, p = Policy().decide(0)
    assert kind == "full" and p.decide(0) == ("noop", p)
    for _ in range(FULL_AFTER):
        kind, p = p.decide(1)
        assert kind == "targeted"
    assert p.decide(1)[0] == "full" and p.decide(0)[0] == "full" and Policy(False).decide(3, uncertain=True)[0] == "full"
