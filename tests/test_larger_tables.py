"""What the graph operators shuffle, join and read, by counts that grow faster than tables do."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import delta, quality, related, resolve
from graphloom.plans import answers, catalog, projects  # noqa: F401 - these register their queries in catalog
from graphloom.sources.facts import Facts


def counted(df, metric: str, node: str) -> int:
    """Runs df; the most rows that a node of its plan counts."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        if node in name and p.metrics().contains(metric):
            most = max(most, p.metrics().apply(metric).value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_many_points_of_one_place_in_many_spans(spark):
    n = 2000
    points = spark.range(n).select(F.col("id").alias("point"), F.lit("p").alias("path"), F.lit("f").alias("name"), F.lit(5).cast("long").alias("line"), (F.col("id") % 2).alias("col"))
    spans = spark.range(n).select(F.lit("p").alias("path"), F.lit("f").alias("name"), (F.col("id") + 10).alias("id"), F.lit(5).cast("long").alias("start_line"), F.lit(0).cast("long").alias("start_col"), F.lit(5).cast("long").alias("end_line"), (F.col("id") % 3 + 1).alias("end_col"))
    got = delta.innermost(points.unionByName(points.limit(7)), spans)
    assert counted(got, "numOutputRows", "Join") <= 2 * n
    # [5:0, 5:1) holds column 0 only and is the narrowest; [5:0, 5:2) is the narrowest around column 1.
    assert {(r.col, r.id) for r in got.collect()} == {(0, 10), (1, 11)} and got.count() == n


def test_callers_of_many_anchors_of_one_key(spark):
    n = 300
    s = spark.range(n).select("id", F.lit("m").alias("name"), F.lit("a::m").alias("qualified_name"), F.lit("a").alias("container"), F.lit("method").alias("kind"))
    # One more with a key of its own beside theirs: the caller 1000 is resolved to it there, so its pair is left out.
    s = s.unionByName(spark.createDataFrame([(n, "m", "b::a::m", "a", "method")], s.schema))
    sites = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 150 + 1000).alias("caller"), F.lit("scoped").alias("form"), F.lit("method").alias("target_kind"), F.lit("m").alias("name"), F.lit("a").alias("qualifier"), F.col("id").alias("line"))
    sites = sites.unionByName(spark.createDataFrame([(n, 1000, "scoped", "method", "m", "b::a", 7)], sites.schema))
    cat = resolve.callable_catalog(s)
    got = related.syntax_callers(resolve.resolve(sites, cat), cat, s)
    assert counted(got, "shuffleRecordsWritten", "Exchange") <= 10 * n
    rows = {(r.anchor, r.caller): (r.sites, r.lines, r.omitted) for r in got.collect()}
    assert rows == {(a, c): (2, [c - 1000, c - 850], 0) for a in range(n + 1) for c in range(1000, 1150) if (a, c) != (n, 1000)}


def test_roots_and_targets_from_json_are_not_broadcast(spark, sf):
    plan = catalog.QUERIES["cargo_targets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 2


def test_audit_covers_symbols_of_every_kind(spark, sf, monkeypatch):
    from graphloom.plans import answers  # noqa: F401 - registers its queries in catalog

    symbols = Facts.symbols
    monkeypatch.setattr(Facts, "symbols", lambda g: symbols(g).unionByName(symbols(g).filter("kind = 'module' AND id = 0")))
    got = catalog.QUERIES["audit_of_sound_tables"](spark, sf).filter("check_name = 'duplicate_id'")
    assert [r.violations for r in got.collect()] == [1]


def shuffles(df) -> list[int]:
    """Runs df; the rows that each of its exchanges has written."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if p.nodeName().endswith("Exchange") and p.metrics().contains("shuffleRecordsWritten"):
            rows.append(p.metrics().apply("shuffleRecordsWritten").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def test_sites_are_shuffled_once_to_be_resolved(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = Facts(spark, sf)
        n = g.table("lineitem").count()
        assert [x for x in shuffles(catalog._resolved(g)) if x >= n] == [n]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sites_resolved_by_parts_are_those_resolved_one_by_one(spark, sf, monkeypatch):
    table = Facts.table
    odd = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag"))
    monkeypatch.setattr(Facts, "table", lambda g, name: table(g, name).withColumn("l_returnflag", odd) if name == "lineitem" else table(g, name))
    g = Facts(spark, sf)
    cat = resolve.callable_catalog(g.symbols().filter("kind = 'method'"))
    got = catalog._resolved(g)
    want = resolve.resolve(g.call_sites(), cat).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    kinds = {tuple(r) for r in got.select("form", F.col("qualifier").isNull()).distinct().collect()}
    assert kinds == {("member", True), ("scoped", True), ("scoped", False)}


def test_admission_sorts_no_more_than_a_range(spark):
    sites = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("caller"), F.lit("resolved").alias("resolution"))
    tests = spark.range(3).select("id")
    got = related.admit_sites(sites, tests, 500, 900)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    total = taken = 0
    want = set()
    for i in range(3000):
        cost = 2 if i % 7 < 3 else 1
        if taken < 500 and total + cost <= 900:
            want.add(i)
            total, taken = total + cost, taken + 1
    assert {r.seq for r in got.filter("admitted").collect()} == want


def widths(df) -> list[tuple[int, int]]:
    """Runs df; rows and bytes a row that each of its exchanges has written."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        if p.nodeName().endswith("Exchange") and p.metrics().contains("shuffleRecordsWritten"):
            n = p.metrics().apply("shuffleRecordsWritten").value()
            out.append((n, p.metrics().apply("dataSize").value() / max(n, 1)))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


@pytest.mark.parametrize("name", ["call_candidates", "own_candidates", "candidate_groups"])
def test_candidates_shuffle_numbers(spark, sf, name):
    n = Facts(spark, sf).table("lineitem").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [x for x in widths(catalog.QUERIES[name](spark, sf)) if x[0] > 0.4 * n and x[1] > 64] == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_call_candidates_of_parts_that_are_there_twice(spark, sf, monkeypatch):
    table = Facts.table
    odd = lambda t: t.withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")))
    more = lambda t: odd(t).unionByName(t.filter("p_partkey % 2 = 0").withColumns({"p_name": F.lit("red nut"), "p_size": F.lit(1)}))
    monkeypatch.setattr(Facts, "table", lambda g, name: more(table(g, name)) if name == "part" else table(g, name))
    got = catalog.QUERIES["call_candidates"](spark, sf)
    r = catalog._resolved(Facts(spark, sf)).filter("resolution <> 'resolved'").withColumn("qualifier", F.coalesce("qualifier", F.lit("")))
    want = r.groupBy("caller", "form", "name", "qualifier", "resolution").agg(F.count("*"), F.max("candidates"), F.min("seq"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("limits", [(99, 99, 9999), (99, 30, 20), (99, 60, 25), (99, 9, 40), (12, 5, 99)])
def test_report_of_a_bounded_build_from_counts(spark, limits):
    symbols = spark.range(30).select("id", F.when(F.col("id") % 3 == 0, "test").otherwise("function").alias("kind"))
    edges = spark.range(25).select((F.col("id") % 7).alias("src"), (F.col("id") + 8).alias("dst"), (F.col("id") * 2).alias("seq"))
    n = F.col("id")
    sites = spark.range(200).select((n * 7 % 200).alias("seq"), (n % 31).alias("caller"), F.when(n % 4 == 1, "ambiguous").otherwise("resolved").alias("resolution"))
    want = quality.build_report(*quality.bounded_build(symbols, edges, sites, *limits)).first().asDict()
    assert quality.bounded_report(symbols, edges, sites, *limits).first().asDict() == want


@pytest.mark.parametrize("name", ["build_report", "build_report_by_symbols", "degradations", "indexing_status"])
def test_reports_of_builds_make_no_rows(spark, sf, name):
    # What is kept is counted, so nothing is shuffled or joined any more when the rows of the report are made.
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("far", [1, 10**9])
def test_running_total_shuffles_rows_once(spark, sf, monkeypatch, far):
    # far: part keys so large that the sites of one caller reach into the next one's by seq.
    table = Facts.table
    key = {"part": "p_partkey", "lineitem": "l_partkey"}
    monkeypatch.setattr(Facts, "table", lambda g, name: table(g, name).withColumn(key[name], F.col(key[name]) * far) if name in key else table(g, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = Facts(spark, sf)
        n = g.table("lineitem").count()
        got = catalog.running_candidates(g)
        # Once by part and once by range.
        assert [x for x in shuffles(got) if x >= n] == [n, n] and g.ordered_by_caller() == (far == 1)
        total, want = 0, {}
        for seq, candidates in sorted(tuple(r) for r in catalog._resolved(g).select("seq", "candidates").collect()):
            total += candidates
            want[seq] = total  # sites of one seq share it
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == n and dict(rows) == want and len(set(rows)) == len(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
