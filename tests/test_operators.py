"""Graph operators on null, empty, repeated and clashing rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import delta, quality, ranges, related, resolve, search

SYMBOLS = "id long, name string, qualified_name string, container string, kind string, path string, start_line long, end_line long"
SITES = "seq long, caller long, form string, target_kind string, name string, qualifier string, line long"


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 300])
def test_ranges_count_the_cuts_below(spark, n):
    cuts = [3 * i for i in range(n)]
    keys = [None, -5, 0, 1, 3 * n - 3, 3 * n - 2, 10**15, *range(0, 3 * n, 7)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = ranges.with_range(rows, "k", cuts, "r").collect()
    assert all(r.r == (0 if r.k is None else sum(c <= r.k for c in cuts)) for r in got) and len(got) == len(keys)


def test_running_total_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(5, 2), (5, 3), (1, 1), (9, None)], "seq long, n long")
    got = {(r.seq, r.n): r.total for r in related.running_total(rows, "seq", F.coalesce("n", F.lit(0))).collect()}
    assert got == {(1, 1): 1, (5, 2): 6, (5, 3): 6, (9, None): 6}
    assert related.running_total(rows.filter("false"), "seq", F.col("n")).count() == 0


def test_calls_without_qualifier_meet_their_candidates(spark):
    s = spark.createDataFrame([(1, "f", "a::f", "a", "function", "a", 1, 2), (2, "f", "b::f", "b", "function", "b", 1, 2), (3, "g", "a::g", "a", "function", "a", 3, 4)], SYMBOLS)
    sites = spark.createDataFrame([(1, 3, "function", "function", "f", None, 3), (2, 3, "function", "function", "f", "a", 3), (3, 3, "member", "method", "f", None, 4), (4, 3, "function", "function", "none", None, 4)], SITES)
    cat = resolve.callable_catalog(s)
    r = resolve.resolve(sites, cat)
    assert {x.seq: (x.resolution, x.target, x.candidates) for x in r.collect()} == {1: ("ambiguous", None, 2), 2: ("resolved", 1, 1), 3: ("unresolved", None, 0), 4: ("unresolved", None, 0)}
    assert {(x.seq, x.id) for x in resolve.fan_out(r, cat, 5).collect()} == {(1, 1), (1, 2)}
    # The second site is resolved to 1, so of the first one's candidates only 2 is left.
    assert {(x.anchor, x.caller) for x in related.syntax_callers(r, cat, s).collect()} == {(2, 3)}
    own = {(x.candidate, x.name) for x in related.site_groups(r, cat, s.filter("id = 3"), 5).collect()}
    assert own == {(2, None), (None, "f"), (None, "none")}
    assert related.site_groups(r.filter("false"), cat, s, 5).count() == 0


def test_nearest_root_of_odd_paths(spark):
    paths_ = spark.createDataFrame([("README",), ("a/b.py",), ("a/b/c.py",), ("ab/x",)], "path string")
    roots = spark.createDataFrame([("", "top"), ("a", "one"), ("a", "two")], "root string, package_name string")
    got = {r.path: (r.package_name, r.nearest) for r in search.nearest_root(paths_, roots).collect()}
    assert got == {"README": ("top", ""), "a/b.py": ("two", "a"), "a/b/c.py": ("two", "a"), "ab/x": ("top", "")}
    assert {r.nearest for r in search.nearest_root(paths_, roots.filter("false")).collect()} == {None}


def test_scalar_functions_of_nulls(spark):
    d = spark.createDataFrame([(None, None), ("", ""), ("a/.rs", "x\ny"), ("target/a.rs", "é"), ("x/a.tfvars", "z")], "p string, t string")
    got = d.select(paths.path_language(F.col("p")).alias("a"), paths.file_language(F.col("p")).alias("b"), paths.valid_path(F.col("p")).alias("v"), text.signature(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(None, None, False, None), (None, None, False, ""), (None, "rust", True, "x y"), (None, "rust", True, "é"), ("hcl", "hcl", True, "z")]


def test_fingerprint_and_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    assert delta.fingerprint(a).first() == delta.fingerprint(a.orderBy(F.col("k").desc())).first() != delta.fingerprint(a.distinct()).first()
    assert tuple(delta.fingerprint(a.filter("false")).first()) == (0, 0)
    assert [tuple(r) for r in delta.multiset_difference(a, a.distinct()).collect()] == [(1, "x", 1)]
    with pytest.raises(ValueError):
        quality.disjoint_union({"p": spark.createDataFrame([("go",)], "language string"), "q": spark.createDataFrame([("go",), ("rust",)], "language string")})


def test_work_budget_cuts_by_seq(spark):
    e = spark.range(5000).select(F.col("id").alias("seq"))
    kept, more = quality.within_budget(e, 20)
    assert more and kept.count() == 2048 and kept.agg(F.max("seq")).first()[0] == 2047
    kept, more = quality.within_budget(e.limit(10), 20)
    assert not more and kept.count() == 10


def test_one_line_of_very_many_matches(spark):
    d = spark.createDataFrame([("p", "ab" * 40_000)], "path string, text string")
    assert search.match_all(d, "a").count() == 40_000
