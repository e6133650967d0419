"""Every registered query against DuckDB, and the parts that SQL can't show."""

import duckdb
import pytest

from graphloom.operators import delta
from graphloom.plans import answers, catalog, code, projects  # noqa: F401 - each registers its queries in catalog
from graphloom.sources.store import NotFresh, RevisionConflict, Store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = duck.execute(catalog.ORACLE[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
    assert sorted(repr(tuple(x)) for x in df.select(*cols).collect()) == want


def test_publish_is_atomic(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    b = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, text string")
    assert s.current() == 0 and s.publish({"files": a}, 0) == 1
    with pytest.raises(RevisionConflict):
        s.publish({"files": b}, 0)
    assert s.publish({"files": b}, 1) == 2 and s.require(2) == 2
    with pytest.raises(NotFresh):
        s.require(3)
    assert {(r.path, r.change) for r in s.changes("files", 1, 2).collect()} == {("b", "modified"), ("c", "added")}


def test_two_publishers_one_wins(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    one, two = (spark.createDataFrame([(x, x)], "path string, text string") for x in "ab")
    monkeypatch.setattr(b, "current", lambda: 0)  # it looked before the other one published
    assert a.publish({"files": one}, 0) == 1
    with pytest.raises(RevisionConflict):
        b.publish({"files": two}, 0)
    assert [tuple(r) for r in a.read("files").collect()] == [("a", "a")]
    assert list((tmp_path / "store/staging").iterdir()) == [] and a.publish({"files": two}, 1) == 2


def test_inheritance_prefers_traits_and_keeps_ambiguity(spark):
    types = spark.createDataFrame([("C", "T", "trait"), ("C", "P", "extends"), ("D", "C", "extends"), ("E", "P", "implements"), ("E", "Q", "implements"), ("X", "Y", "extends"), ("Y", "X", "extends"), ("F", "E", "extends")], "type string, parent string, relation string")
    methods = spark.createDataFrame([("T", "m"), ("P", "m"), ("Q", "m")], "type string, method string")
    got = {r.type: (r.owner, r.state) for r in delta.inherited(types, methods).collect()}
    assert got["C"] == ("T", "unique") and got["D"] == ("T", "unique") and got["E"][1] == got["F"][1] == "ambiguous" and "X" not in got


def plain_inherited(types, methods):
    """The reference's recursive lookup: traits, then classes, then interfaces; a type on the path has nothing."""

    def look(t, m, path):
        if t in path:
            return None
        if (t, m) in methods:
            return t, "unique"
        for kind in ("trait", "extends", "implements"):
            found = {x for a, p, k in types if (a, k) == (t, kind) and (x := look(p, m, {*path, t}))}
            if found:
                return min(found)[0], "ambiguous" if len(found) > 1 or any(s == "ambiguous" for _, s in found) else "unique"
        return None

    names = {x for t in types for x in t[:2]} | {t for t, _ in methods}
    return {(t, m): x for t in names for m in {m for _, m in methods} if (x := look(t, m, set()))}


def test_inheritance_of_any_depth_and_on_cycles(spark):
    types = [("D", "C", "extends"), ("C", "P", "extends"), ("C", "T", "trait"), ("T", "T2", "trait"), ("T2", "T3", "trait")]
    types += [(f"L{i}", f"L{i + 1}", "extends") for i in range(12)]
    types += [("X", "Y", "trait"), ("Y", "X", "trait"), ("X", "Q", "extends"), ("Y", "R", "extends"), ("Z", "X", "extends")]
    methods = [("P", "m"), ("T3", "m"), ("L12", "m"), ("Q", "m"), ("R", "m")]
    got = delta.inherited(spark.createDataFrame(types, "type string, parent string, relation string"), spark.createDataFrame(methods, "type string, method string"))
    got = {(r.type, r.method): (r.owner, r.state) for r in got.collect()}
    assert got["D", "m"] == ("T3", "unique") and got["L0", "m"] == ("L12", "unique") and got["X", "m"] == ("R", "unique") and got["Y", "m"] == ("Q", "unique")
    assert got == plain_inherited(types, methods)


def test_budgets():
    assert delta.admit([("a", 5), ("b", 50), ("c", 6), ("d", 4)], 3, 20, 10) == ["a", "d"]
    assert delta.split_budget(10, {"x": 1, "y": 2, "z": 0}) == {"x": 3, "y": 7, "z": 0}
