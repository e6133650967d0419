"""Consistency of a snapshot's tables, diagnostics, and what a bounded build keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import related, resolve
from graphloom.operators.delta import multiset_difference
from graphloom.schema import LANGUAGES, PRECISION, provenance_rank, rank

#: Diagnostics kept of a file. Fixed value.
KEPT = 64
DIAGNOSTIC_KINDS = ["error", "missing"]


def relation_tier(sites: DataFrame, tests: bool = False) -> list[Column]:
    """provenance and precision of the edge of a resolved site: the site's own where it is precise, else heuristic; a TESTS
    edge that isn't precise is of heuristic provenance too."""
    sure = F.col("precision") == "precise"
    return [F.when(sure | F.lit(not tests), F.col("provenance")).otherwise("heuristic").alias("provenance"), F.when(sure, "precise").otherwise("heuristic").alias("precision")]


def expected_edges(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """The CALLS and TESTS edges that resolved sites (with provenance and precision) give: kind, src, dst, seq, line, ..."""
    r = sites.filter("resolution = 'resolved'").withColumnsRenamed({"caller": "src", "target": "dst"})
    calls = r.select(F.lit("CALLS").alias("kind"), "src", "dst", "seq", "line", *relation_tier(r))
    t = r.join(symbols.filter("kind = 'test'").select(F.col("id").alias("src")), "src", "left_semi")
    t = t.groupBy("src", "dst").agg(F.min_by(F.struct("seq", "line", "provenance", "precision"), "seq").alias("v")).select("src", "dst", "v.*")
    return calls.unionByName(t.select(F.lit("TESTS").alias("kind"), "src", "dst", "seq", "line", *relation_tier(t, tests=True)))


def audit(files: DataFrame, symbols: DataFrame, edges: DataFrame, sites: DataFrame, catalog: DataFrame, diagnostics: DataFrame, totals: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """check_name, violations: each derived table recomputed from what it comes from, and compared.

    files: path, symbol_count, diagnostic_count. symbols: id, name, qualified_name, path, kind, ... edges: kind, src, dst,
    seq, line, provenance, precision, owner (the path that states a relation; null for those of calls). sites: seq,
    caller, path, ..., resolution, target, candidates. catalog: the callable catalog as stored. diagnostics: path and
    file (the file that keeps it), provenance, precision. totals: one row of recorded ambiguous and unresolved sites and
    edges. counts: more (name to a table of violations). Adjacency by source and by target is one table here, so that the
    two sides can't drift apart; what can is that an edge's ends exist.

    Sites are grouped by what they say and how they are resolved, and each group is resolved again once. The checks run one job
    after the other, and shuffle files of those that have run are let go, so that no two hold the sites at once.
    """
    ids = symbols.select("id")
    missing = lambda df, c: df.filter(F.col(c).isNotNull()).join(ids.withColumnRenamed("id", c), c, "left_anti")
    out: dict[str, int] = {}

    def run(df: DataFrame) -> None:
        """Takes the checks of one row, a column each."""
        out.update({name: n or 0 for name, n in df.first().asDict().items()})
        related.sweep(df)

    def every(checks: dict[str, DataFrame]) -> None:
        """Takes checks of as many rows as violations, in one job."""
        rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in checks.items()]
        out.update(dict(reduce(DataFrame.unionByName, rows).collect()))
        related.sweep(rows[0])

    sure = sites.filter("resolution = 'resolved'").select("seq", "caller", "target", "line", "resolution", "provenance", "precision").checkpoint()
    related.sweep(sure)
    plain = ["kind", "src", "dst", "seq", "line", "provenance", "precision"]
    differ = multiset_difference(expected_edges(sure, symbols), edges.filter("owner IS NULL").select(*plain))
    lost = lambda kind: F.count_if((F.col("surplus") > 0) & (F.col("kind") == kind))
    run(differ.agg(lost("CALLS").alias("resolved_call_edge"), lost("TESTS").alias("resolved_test_edge"), F.count_if(F.col("surplus") < 0).alias("relationship_ownership")))
    n_edges = edges.count()
    every({"unknown_source": missing(edges.select("src"), "src"), "unknown_target": missing(edges.select("dst"), "dst")})

    own = symbols.select(F.col("id").alias("caller"), F.col("path").alias("home"), F.lit(True).alias("known"))
    homes = sites.select("caller", "path").join(own, "caller", "left")
    unknown = F.col("known").isNull() & F.col("caller").isNotNull()
    run(homes.agg(F.count_if(unknown).alias("unknown_caller"), F.count_if(F.col("path") != F.col("home")).alias("call_site_location")))

    key, stored = resolve.keys_of(sites, catalog), ["resolution", "target", "candidates"]
    now: dict[str, int] = {}
    kinds = set()
    for kind, resolution, n in sites.groupBy("target_kind", "resolution").count().collect():
        kinds.add(kind)
        now[resolution] = now.get(resolution, 0) + n
    related.sweep(sites)
    typed = F.col("receiver_type").isNull() != F.col("receiver_type_source").isNull() if "receiver_type" in sites.columns else F.lit(False)
    said = sites.groupBy("form", *key, *stored).agg(F.count("*").alias("n"), F.count_if(typed).alias("typed")).withColumnsRenamed({c: f"was_{c}" for c in stored})
    again = resolve.resolve(said, catalog.filter(F.col("target_kind").isin([k for k in kinds if k is not None])))
    # Groups without a target meet the ids by numbers of their own, so that they don't come together.
    again = again.withColumn("at", F.coalesce("was_target", -1 - F.abs(F.hash("name", "qualifier")).cast("long")))
    again = again.join(ids.distinct().select(F.col("id").alias("at"), F.lit(True).alias("known")), "at", "left")
    same = F.lit(True)
    for c in stored:
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    count = lambda c: F.sum(F.when(c, F.col("n")))
    run(again.agg(count(F.col("was_target").isNotNull() & F.col("known").isNull()).alias("unknown_call_target"), count(F.trim(F.coalesce("name", F.lit(""))) == "").alias("call_site_name"), F.sum("typed").alias("receiver_type"), count(~same).alias("call_site_resolution")))

    then = totals.first()
    related.sweep(totals)
    out["call_site_count"] = int(any(now.get(c, 0) != then[c] for c in ("ambiguous", "unresolved")))
    out["edge_count"] = int(n_edges != then["edges"])
    per_file = symbols.groupBy("path").agg(F.count("*").alias("n"))
    fresh = resolve.callable_catalog(symbols)
    rest = {
        "duplicate_id": ids.groupBy("id").count().filter("count > 1"),
        "file_index": files.join(per_file, "path", "full_outer").filter("coalesce(symbol_count, -1) <> coalesce(n, 0)"),
        "name_index": symbols.filter(F.col("name") != F.element_at(F.split("qualified_name", "::"), -1)),
        "diagnostic_count": files.join(diagnostics.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("kept")), "path", "left").filter("diagnostic_count < coalesce(kept, 0)"),
        "diagnostic_path": diagnostics.filter("path <> file"),
        "diagnostic_quality": diagnostics.filter("provenance <> 'tree_sitter' OR precision <> 'syntax'"),
        **counts,
    }
    every({"callable_index": multiset_difference(fresh, catalog.select(*fresh.columns))})
    every(rest)
    return symbols.sparkSession.createDataFrame(list(out.items()), "check_name string, violations long")


def diagnostic_order() -> list[Column]:
    place = [F.col(c) for c in ("path", "start_line", "start_col", "end_line", "end_col")]
    return [*place, rank("language", LANGUAGES), rank("kind", DIAGNOSTIC_KINDS), rank("precision", PRECISION), provenance_rank(), F.col("cause").asc_nulls_first(), F.col("node_kind").asc_nulls_first()]


def diagnostics_summary(files: DataFrame, diagnostics: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """One row of files_with_diagnostics, total_diagnostics (exact), capture_omitted (not kept of a file) and
    response_omitted (kept, but beyond limit); and the first limit diagnostics in their order.

    files: path, diagnostic_count; diagnostics: what is kept of each file.
    """
    kept = diagnostics.groupBy("path").agg(F.count("*").alias("kept"))
    f = files.join(kept, "path", "left").select("diagnostic_count", F.coalesce("kept", F.lit(0)).alias("kept"))
    row = f.agg(
        F.count_if(F.col("diagnostic_count") > 0).alias("files_with_diagnostics"),
        F.coalesce(F.sum("diagnostic_count"), F.lit(0)).alias("total_diagnostics"),
        F.coalesce(F.sum(F.greatest(F.col("diagnostic_count") - F.col("kept"), F.lit(0))), F.lit(0)).alias("capture_omitted"),
        F.greatest(F.coalesce(F.sum("kept"), F.lit(0)) - limit, F.lit(0)).alias("response_omitted"),
    )
    return row, diagnostics.orderBy(*diagnostic_order()).limit(limit)


def build_report(symbols: DataFrame, edges: DataFrame, sites: DataFrame) -> DataFrame:
    """One row: what a bounded build has kept and left out, and by which budget.

    symbols: admitted. edges: admitted, and symbols_known, whether both its ends are kept. sites: admitted, cost (the
    edges it brings), caller_known, and over_sites, whether it is refused as one site too many.
    """
    left = lambda c: F.count_if(~F.col("admitted") & c)
    s = symbols.agg(F.count_if("admitted").alias("retained_symbols"), F.count_if(~F.col("admitted")).alias("omitted_symbols"))
    e = edges.agg(F.count_if("admitted").alias("relations"), left(~F.col("symbols_known")).alias("edges_by_symbols"), left(F.col("symbols_known")).alias("edges_by_edges"))
    cost = lambda c: F.coalesce(F.sum(F.when(~F.col("admitted") & c, F.col("cost"))), F.lit(0))
    known, over = F.col("caller_known"), F.col("over_sites")
    c = sites.agg(
        F.count_if("admitted").alias("retained_call_sites"), F.coalesce(F.sum(F.when(F.col("admitted"), F.col("cost"))), F.lit(0)).alias("call_edges"),
        left(~known).alias("call_sites_omitted_by_symbol_budget"), left(known & ~over).alias("call_sites_omitted_by_edge_budget"), left(known & over).alias("call_sites_omitted_by_call_site_budget"),
        cost(~known).alias("by_symbols"), cost(known & ~over).alias("by_edges"), cost(known & over).alias("by_sites"),
    )
    row = s.join(e).join(c)
    out = row.select(
        "retained_symbols", "omitted_symbols", (F.col("relations") + F.col("call_edges")).alias("retained_edges"),
        (F.col("edges_by_symbols") + F.col("by_symbols")).alias("edges_omitted_by_symbol_budget"), (F.col("edges_by_edges") + F.col("by_edges")).alias("edges_omitted_by_edge_budget"), F.col("by_sites").alias("edges_omitted_by_call_site_budget"),
        "retained_call_sites", "call_sites_omitted_by_symbol_budget", "call_sites_omitted_by_edge_budget", "call_sites_omitted_by_call_site_budget",
    )
    by = lambda kind: sum((F.col(f"{kind}_omitted_by_{b}_budget") for b in ("symbol", "edge")), F.col(f"{kind}_omitted_by_call_site_budget"))
    return out.withColumns({"omitted_edges": by("edges"), "omitted_call_sites": by("call_sites")})


#: What a retained symbol, edge or call site gives, by budget: cause, capabilities it affects, the counter of what is left out, and of what was seen beside the retained.
DEGRADATIONS = [
    ("symbols", ["declarations"], "omitted_symbols", "symbols", "omitted_symbols"),
    ("symbols", ["relationships"], "edges_omitted_by_symbol_budget", "symbols", "omitted_symbols"),
    ("symbols", ["relationships", "call_sites"], "call_sites_omitted_by_symbol_budget", "symbols", "omitted_symbols"),
    ("edges", ["relationships"], "edges_omitted_by_edge_budget", "edges", "edges_omitted_by_edge_budget"),
    ("edges", ["call_sites"], "call_sites_omitted_by_edge_budget", "edges", "edges_omitted_by_edge_budget"),
    ("call_sites", ["relationships"], "edges_omitted_by_call_site_budget", "call_sites", "call_sites_omitted_by_call_site_budget"),
    ("call_sites", ["call_sites"], "call_sites_omitted_by_call_site_budget", "call_sites", "call_sites_omitted_by_call_site_budget"),
]


def degradations(report: DataFrame, limits: dict[str, int]) -> DataFrame:
    """cause, affected, budget, observed, omitted: one row for each way in which the build has left something out."""
    each = F.array(*[
        F.struct(F.lit(cause).alias("cause"), F.lit(",".join(affected)).alias("affected"), F.lit(limits[cause]).cast("long").alias("budget"), (F.col(f"retained_{of}") + F.col(seen)).cast("long").alias("observed"), F.col(left).cast("long").alias("omitted"))
        for cause, affected, left, of, seen in DEGRADATIONS
    ])
    return report.select(F.explode(each).alias("d")).select("d.*").filter("omitted > 0")


def indexing_status(report: DataFrame, indexed: int, skipped: int) -> DataFrame:
    """capability, retained, omitted, complete. Facts are complete only if no file was skipped either."""
    whole = F.lit(skipped == 0)
    rows = [
        ("file_inventory", F.lit(indexed), F.lit(skipped), F.lit(True)),
        ("text_search", F.lit(indexed), F.lit(skipped), F.lit(True)),
        ("declarations", F.col("retained_symbols"), F.col("omitted_symbols"), whole),
        ("relationships", F.col("retained_edges"), F.col("omitted_edges"), whole & (F.col("call_sites_omitted_by_symbol_budget") == 0)),
        ("call_sites", F.col("retained_call_sites"), F.col("omitted_call_sites"), whole),
    ]
    each = F.array(*[F.struct(F.lit(name).alias("capability"), kept.cast("long").alias("retained"), left.cast("long").alias("omitted"), (corpus & (left == 0)).alias("complete")) for name, kept, left, corpus in rows])
    return report.select(F.explode(each).alias("c")).select("c.*")


def bounded_build(symbols: DataFrame, edges: DataFrame, sites: DataFrame, max_symbols: int, max_edges: int, max_sites: int, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """symbols (id, a long), edges (src, dst, seq) and resolved sites (seq, caller, resolution) with what build_report takes.

    Symbols are kept by id, then edges with both ends by seq, then call sites in a fold over what room edges have left. If
    any symbol is left out, no call site is kept. places: see related.admit_sites.
    """
    s = related.running_total(symbols.select("id", "kind"), "id", F.lit(1)).withColumn("admitted", F.col("total") <= max_symbols).drop("total")
    kept = s.filter("admitted").select("id")
    e = edges.join(kept.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(kept.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    e = e.withColumn("symbols_known", F.coalesce(F.col("a") & F.col("b"), F.lit(False))).drop("a", "b")
    known = related.running_total(e.filter("symbols_known"), "seq", F.lit(1)).withColumn("admitted", F.col("total") <= max_edges).drop("total")
    e = known.unionByName(e.filter("NOT symbols_known").withColumn("admitted", F.lit(False)))
    all_kept = s.filter("NOT admitted").isEmpty()
    used = known.filter("admitted").count()
    c = related.admit_sites(sites, symbols.filter("kind = 'test'"), max_sites, max_edges, used, places)
    return s, e, c.withColumn("caller_known", F.lit(all_kept)).withColumn("admitted", F.col("admitted") & F.col("caller_known"))


def bounded_report(symbols: DataFrame, edges: DataFrame, sites: DataFrame, max_symbols: int, max_edges: int, max_sites: int, places: DataFrame | None = None) -> DataFrame:
    """The report of a bounded build, as build_report gives it of bounded_build's tables, without making these.

    What is kept ends at one place of each order, so rows are only counted: symbols, edges with both ends, and sites by ranges.
    """
    stop, n_kept = related.last_within(symbols.select("id"), "id", max_symbols)
    ids = symbols.select("id") if stop is None else symbols.select("id").filter(F.col("id") < stop)
    known = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("seq")
    n_known, n_edges = known.count(), edges.count()
    relations = n_known if n_known <= max_edges else related.last_within(known, "seq", max_edges)[1]
    related.sweep(edges)
    none = (0, 0)
    if stop is None:
        by_symbols = none
        found = related.admission_counts(sites, symbols.filter("kind = 'test'"), max_sites, max_edges, relations, places)
    else:
        row = related.costs(sites, symbols.filter("kind = 'test'")).agg(F.count("*"), F.coalesce(F.sum("cost"), F.lit(0))).first()
        by_symbols, found = tuple(row), dict.fromkeys(("admitted", "over", "edges"), none)
    related.sweep(edges)
    (retained, call_edges), (over, by_sites), (refused, by_edges) = (found[k] for k in ("admitted", "over", "edges"))
    out = {
        "retained_symbols": n_kept, "omitted_symbols": 0 if stop is None else symbols.count() - n_kept, "retained_edges": relations + call_edges,
        "edges_omitted_by_symbol_budget": n_edges - n_known + by_symbols[1], "edges_omitted_by_edge_budget": n_known - relations + by_edges, "edges_omitted_by_call_site_budget": by_sites,
        "retained_call_sites": retained, "call_sites_omitted_by_symbol_budget": by_symbols[0], "call_sites_omitted_by_edge_budget": refused, "call_sites_omitted_by_call_site_budget": over,
        "omitted_edges": n_edges - relations + by_symbols[1] + by_edges + by_sites, "omitted_call_sites": by_symbols[0] + refused + over,
    }
    return symbols.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{c} long" for c in out))


#: Work of a section for each of its results, and its bounds. Fixed values.
WORK = {"examined": (16, 1024, 8192), "traversal": (32, 2048, 16384), "intermediate": (8, 2048, 4096)}


def work_budget(limit: Column) -> dict[str, Column]:
    """How many rows a section of so many results may examine, traverse and keep on the way."""
    return {name: F.greatest(F.lit(low), F.least(F.lit(high), limit * each)) for name, (each, low, high) in WORK.items()}


def within_budget(edges: DataFrame, limit: int, order: str = "seq") -> tuple[DataFrame, bool]:
    """The first edges by seq that a section may traverse, and whether there are more."""
    each, low, high = WORK["traversal"]
    n = max(low, min(high, limit * each))
    return edges.orderBy(order).limit(n), len(edges.select(order).limit(n + 1).collect()) > n


def disjoint_union(parts: dict[str, DataFrame]) -> DataFrame:
    """The graphs of languages (name to a table with a language column) as one; ValueError if two hold one language."""
    held: dict[str, str] = {}
    for name, df in parts.items():
        for (language,) in df.select("language").distinct().collect():  # as many as languages
            if language in held:
                raise ValueError(f"{name} and {held[language]} both have {language}")
            held[language] = name
    out = None
    for df in parts.values():
        out = df if out is None else out.unionByName(df)
    return out
