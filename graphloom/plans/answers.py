"""Registered queries of orders, evidence, candidates, consistency, diagnostics and bounded builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import delta, quality, related, resolve, search
from graphloom.plans.catalog import _EDGES, _edges, _joined, _numbered_sites, _resolved, query
from graphloom.plans.projects import _sql
from graphloom.schema import EDGE_KINDS, LANGUAGES, ROLES
from graphloom.sources import graph
from graphloom.sources.facts import SLOT, Facts
from graphloom.streaming import live


def _ordered(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in an order, and the place of each."""
    return df.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


# Orders

_RANKED = f"""SELECT id, qualified_name, role, language, m AS match_rank, row_number() OVER (ORDER BY m, list_position({_sql(ROLES)}, role), list_position({_sql(LANGUAGES)}, language), qualified_name, path, start_line, end_line, id) AS position FROM (
  SELECT *, {_sql(ROLES)}[(id % {SLOT} % 7)::INT + 1] AS role, {_sql(LANGUAGES)}[(id % {SLOT} % 11)::INT + 1] AS language,
    CASE WHEN lower(name) = '1' OR lower(qualified_name) = '1' THEN 0 WHEN starts_with(lower(name), '1') THEN 1 WHEN starts_with(lower(qualified_name), '1') THEN 2 WHEN contains(lower(name), '1') THEN 3 WHEN contains(lower(qualified_name), '1') THEN 4 END AS m FROM symbols) WHERE m IS NOT NULL ORDER BY position LIMIT 400"""


def _with_role(s: DataFrame) -> DataFrame:
    at = lambda xs: F.element_at(F.lit(xs), (F.col("id") % SLOT % len(xs) + 1).cast("int"))
    return s.withColumns({"role": at(ROLES), "language": at(LANGUAGES)})


@query(_RANKED)
def ranked_symbols(g: Facts) -> DataFrame:
    """Symbol search with the role of a symbol's file and its language in the order."""
    found = search.symbol_search(_with_role(g.symbols()), "1", 400)
    return _ordered(found, search.symbol_order(found.columns), 400).select("id", "qualified_name", "role", "language", "match_rank", "position")


_REL = (
    _EDGES
    + f""", rel AS (SELECT 'incoming' AS direction, dst AS anchor, src AS id, kind AS edge_kind FROM edges UNION SELECT 'outgoing', src, dst, kind FROM edges
), named AS (SELECT r.*, s.qualified_name, list_position({_sql(EDGE_KINDS)}, edge_kind) AS k FROM rel r JOIN symbols s ON s.id = r.id WHERE r.anchor IN (SELECT id FROM symbols WHERE kind IN ('struct', 'method')))
"""
)


def _relations(g: Facts, incoming: bool | None = None) -> DataFrame:
    s = g.symbols()
    anchors, kinds = s.filter("kind IN ('struct', 'method')"), ["CALLS", "CONTAINS"]
    e = _edges(g)
    both = [related.related(e, s, anchors, kinds, way) for way in ((True, False) if incoming is None else (incoming,))]
    return both[0] if len(both) == 1 else both[0].unionByName(both[1])


@query(_REL + "SELECT anchor, id, edge_kind, row_number() OVER (ORDER BY qualified_name, id, k, anchor) AS position FROM named WHERE direction = 'incoming' ORDER BY position LIMIT 500")
def related_in_order(g: Facts) -> DataFrame:
    return _ordered(_relations(g, True), [*related.related_order(), F.col("anchor")], 500).select("anchor", "id", "edge_kind", "position")


@query(_REL + "SELECT anchor, id, direction, edge_kind, row_number() OVER (ORDER BY qualified_name, direction, k, id, anchor) AS position FROM named ORDER BY position LIMIT 500")
def directed_in_order(g: Facts) -> DataFrame:
    return _ordered(_relations(g), [*related.directed_order(), F.col("anchor")], 500).select("anchor", "id", "direction", "edge_kind", "position")


@query(_REL + "SELECT anchor, id, edge_kind, row_number() OVER (ORDER BY qualified_name, anchor, id, k) AS position FROM named WHERE direction = 'incoming' ORDER BY position LIMIT 500")
def diff_related_in_order(g: Facts) -> DataFrame:
    return _ordered(_relations(g, True), [*related.diff_order(), F.col("edge_kind")], 500).select("anchor", "id", "edge_kind", "position")


@query(_REL + "SELECT anchor, id, direction, edge_kind, row_number() OVER (ORDER BY anchor, qualified_name, direction, id, k) AS position FROM named ORDER BY position LIMIT 500")
def diff_directed_in_order(g: Facts) -> DataFrame:
    return _ordered(_relations(g), [*related.diff_directed_order(), F.col("edge_kind")], 500).select("anchor", "id", "direction", "edge_kind", "position")


@query(_EDGES + """SELECT anchor, id, precision, row_number() OVER (ORDER BY CASE precision WHEN 'precise' THEN 0 ELSE 1 END, qualified_name, id, anchor) AS position FROM (
  SELECT dst AS anchor, src AS id, CASE WHEN bool_or(precision = 'precise') THEN 'precise' ELSE 'heuristic' END AS precision FROM edges WHERE kind = 'CALLS' AND src IN (SELECT id FROM symbols WHERE kind = 'test') GROUP BY ALL) JOIN symbols s USING (id) ORDER BY position LIMIT 500""")  # fmt: skip
def tests_in_order(g: Facts) -> DataFrame:
    s = g.symbols()
    t = related.tests(_edges(g), s, s.filter("kind = 'method'"))
    return _ordered(t, [*related.tests_order(), F.col("anchor")], 500).select("anchor", "id", "precision", "position")


# Views, evidence and candidates


@query(f"""SELECT s.id, s.name, s.qualified_name, s.kind, s.path, coalesce(role, 'production') AS source_role, coalesce(classification, 'path_fallback') AS source_classification, coalesce(package, '') AS package
  FROM symbols s LEFT JOIN (SELECT path, {_sql(ROLES)}[(n % 7)::INT + 1] AS role, 'cargo_metadata' AS classification, tab || '-pkg' AS package FROM (SELECT DISTINCT path, split_part(path, '/', 1) AS tab, split_part(split_part(path, '/', 2), '.', 1)::INT AS n FROM symbols) WHERE n % 3 <> 2) f USING (path)""")
def symbol_views(g: Facts) -> DataFrame:
    """Symbols with what is known of their files; a file without metadata goes by its path."""
    s = g.symbols()
    n = F.regexp_extract("path", r"/(\d+)\.rs$", 1).cast("int")
    f = s.select("path").distinct().filter(n % 3 != 2)
    f = f.select("path", F.element_at(F.lit(ROLES), n % 7 + 1).alias("role"), F.lit("cargo_metadata").alias("classification"), F.concat(F.split("path", "/")[0], F.lit("-pkg")).alias("package_name"), F.lit("").alias("package_root"))
    v = search.symbol_view(s, f)
    return v.select("id", "name", "qualified_name", "kind", "path", "source_role", "source_classification", F.coalesce("package_name", F.lit("")).alias("package"))


@query(_EDGES + """SELECT kind, src, dst, e.line, coalesce(form, '') AS form, coalesce(name, '') AS name, coalesce(qualifier, '') AS qualifier, count(*) AS edges FROM edges e LEFT JOIN (
  SELECT caller, target, line, arg_min(form, seq) AS form, arg_min(name, seq) AS name, arg_min(qualifier, seq) AS qualifier FROM resolved WHERE resolution = 'resolved' GROUP BY ALL) r ON kind = 'CALLS' AND src = caller AND dst = target AND e.line = r.line GROUP BY ALL""")
def edge_evidence(g: Facts) -> DataFrame:
    e = related.evidence(_edges(g), _resolved(g))
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return e.groupBy("kind", "src", "dst", "line", none("form"), none("name"), none("qualifier")).agg(F.count("*").alias("edges"))


_TESTS = "SELECT id FROM symbols WHERE kind = 'test'"


@query(f"""SELECT caller, coalesce(candidate, -1) AS candidate, coalesce(name, '') AS name, count(*) AS sites, array_to_string(list(line ORDER BY seq)[1:3], ',') AS lines, greatest(0, count(*) - 3) AS omitted FROM (
    SELECT r.caller, r.seq, r.line, c.id AS candidate, CASE WHEN c.id IS NULL THEN r.form END AS form, CASE WHEN c.id IS NULL THEN r.name END AS name, CASE WHEN c.id IS NULL THEN r.qualifier END AS qualifier FROM resolved r
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY target_kind, name, qualifier ORDER BY id) AS k FROM catalog WHERE id IN (SELECT id FROM symbols WHERE kind = 'method')) c
      ON resolution = 'ambiguous' AND k <= 3 AND r.target_kind = c.target_kind AND r.name = c.name AND r.qualifier IS NOT DISTINCT FROM c.qualifier
    WHERE resolution <> 'resolved' AND r.caller IN ({_TESTS})) x
  WHERE candidate IS NULL OR NOT EXISTS (SELECT 1 FROM resolved y WHERE y.resolution = 'resolved' AND y.caller = x.caller AND y.target = x.candidate) GROUP BY caller, candidate, form, name, qualifier""")  # fmt: skip
def candidate_groups(g: Facts) -> DataFrame:
    """Call sites of tests by caller and candidate, or by what they say where they have none."""
    s = g.symbols()
    cat = resolve.callable_catalog(s.filter("kind = 'method'"))
    sites, words = _numbered_sites(g, resolved=True)
    r = related.own_site_groups(sites, s.filter("kind = 'test'"), related.candidates_of(words, cat, 2), ["member"], "place")
    return r.select("caller", F.coalesce("candidate", F.lit(-1)).alias("candidate"), F.coalesce("name", F.lit("")).alias("name"), "sites", _joined("lines").alias("lines"), "omitted")


@query("""SELECT p.l_orderkey AS point, s.id FROM (SELECT l_orderkey, min(l_linenumber) AS ln FROM lineitem GROUP BY 1) p JOIN (
    SELECT o_orderkey % 50 AS f, o_orderkey AS id, o_orderkey % 7 AS a, o_orderkey % 5 AS ac, o_orderkey % 7 + o_orderkey % 4 AS b, o_orderkey % 11 + 1 AS bc FROM orders) s
  ON p.l_orderkey % 50 = s.f AND (s.a, s.ac) <= (p.ln, p.l_orderkey % 6) AND (p.ln, p.l_orderkey % 6) < (s.b, s.bc) QUALIFY row_number() OVER (PARTITION BY p.l_orderkey ORDER BY s.b - s.a, abs(s.bc - s.ac), s.id) = 1""")  # fmt: skip
def innermost_by_columns(g: Facts) -> DataFrame:
    """Containment with columns: places of lineitem in spans of orders."""
    k = F.col("o_orderkey")
    s = g.table("orders").select((k % 50).cast("string").alias("path"), F.lit("f").alias("name"), k.alias("id"), (k % 7).alias("start_line"), (k % 5).alias("start_col"), (k % 7 + k % 4).alias("end_line"), (k % 11 + 1).alias("end_col"))
    p = g.table("lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("line"))
    p = p.select(F.col("l_orderkey").alias("point"), (F.col("l_orderkey") % 50).cast("string").alias("path"), F.lit("f").alias("name"), "line", (F.col("l_orderkey") % 6).alias("col"))
    return delta.innermost(p, s).select("point", "id")


@query("""SELECT request, arg_min(id, i * 10 + j) AS target FROM (SELECT c_custkey AS request, unnest([0, 1]) AS i, unnest([n_name, c_name]) AS name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
  JOIN (VALUES (0, 'method'), (1, 'struct'), (2, 'class')) k(j, kind) ON true JOIN (SELECT name, kind, min(id) AS id FROM symbols GROUP BY name, kind HAVING count(*) = 1) USING (name, kind) GROUP BY request""")
def named_relations_by_kind(g: Facts) -> DataFrame:
    """First unique name by position, then by the kind of its target."""
    c = g.table("customer").join(g.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.select(F.col("c_custkey").alias("request"), F.array("n_name", "c_name").alias("names"), F.lit(["method", "struct", "class"]).alias("kinds"))
    return delta.first_unique(r, g.symbols().select("id", "kind", F.col("name").alias("qualified_name")))


# Consistency

_PLANT = """, broken AS (SELECT seq, caller, CASE WHEN seq % 101 = 0 THEN 'unresolved' ELSE resolution END AS resolution, CASE WHEN seq % 101 = 0 THEN NULL ELSE target END AS target, line, seq % 103 = 0 AS moved FROM resolved
), want AS (SELECT 'CALLS' AS kind, caller AS src, target AS dst, seq FROM broken WHERE resolution = 'resolved' UNION ALL SELECT 'TESTS', caller, target, min(seq) FROM broken WHERE resolution = 'resolved' AND caller IN (SELECT id FROM symbols WHERE kind = 'test') GROUP BY caller, target
), have AS (SELECT kind, src, dst, seq FROM (SELECT 'CALLS' AS kind, caller AS src, target AS dst, seq FROM resolved WHERE resolution = 'resolved' UNION ALL SELECT 'TESTS', caller, target, min(seq) FROM resolved WHERE resolution = 'resolved' AND caller IN (SELECT id FROM symbols WHERE kind = 'test') GROUP BY caller, target) WHERE seq % 107 <> 0
), diags AS (SELECT doc_id, unnest(range(doc_id % 3)) AS i FROM documents)
"""


def _audit(g: Facts, plant: bool) -> DataFrame:
    from graphloom.sources.store import ensure_checkpoint_dir

    ensure_checkpoint_dir(g.spark)
    s, r = g.symbols(), _resolved(g)
    catalog = resolve.callable_catalog(s)
    path = F.concat(F.lit("orders/"), (F.col("caller") - F.lit(SLOT * 5)) % 16, F.lit(".rs"))
    sites = r.withColumns({"path": path, "provenance": F.lit("tree_sitter"), "precision": F.lit("syntax"), "receiver_type": F.lit(None).cast("string"), "receiver_type_source": F.lit(None).cast("string")})
    # Resolved sites are kept apart, so that what the edges come from isn't resolved for each use of them.
    sure = sites.filter("resolution = 'resolved'").select("seq", "caller", "target", "line", "resolution", "provenance", "precision").checkpoint()
    related.sweep(sure)
    edges = quality.expected_edges(sure, s).withColumn("owner", F.lit(None).cast("string"))
    c = g.contains().select(F.lit("CONTAINS").alias("kind"), "src", "dst", F.col("dst").alias("seq"), F.lit(0).cast("long").alias("line"), F.lit("tree_sitter").alias("provenance"), F.lit("syntax").alias("precision"), F.lit("p").alias("owner"))
    totals = r.agg(F.count_if(F.col("resolution") == "ambiguous").alias("ambiguous"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"))
    totals = totals.join(edges.agg((F.count("*") + g.contains().count()).alias("edges")))
    files = s.groupBy("path").agg(F.count("*").alias("symbol_count")).withColumn("diagnostic_count", F.lit(0).cast("long"))
    d = g.table("documents").select(F.col("doc_id").cast("string").alias("file"), F.explode(F.expr("slice(array(1, 2), 1, greatest(int(doc_id % 3), 0))")).alias("i"), "doc_id")
    d = d.select("file", F.col("file").alias("path"), "doc_id", "i", F.lit("tree_sitter").alias("provenance"), F.lit("syntax").alias("precision"))
    files = files.unionByName(g.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).cast("long").alias("symbol_count"), (F.col("doc_id") % 3).alias("diagnostic_count")))
    kept = s.select("id")
    if plant:
        lost = F.col("seq") % 101 == 0
        sites = sites.withColumns({"resolution": F.when(lost, "unresolved").otherwise(F.col("resolution")), "target": F.when(~lost, F.col("target")), "candidates": F.when(lost, F.lit(0).cast("long")).otherwise(F.col("candidates"))})
        sites = sites.withColumns({"path": F.when(F.col("seq") % 103 == 0, "elsewhere").otherwise(F.col("path")), "receiver_type": F.when(F.col("seq") % 109 == 0, "T")})
        edges = edges.filter("seq % 107 <> 0")
        c = c.unionByName(c.filter("dst % 97 = 0").withColumns({"src": F.lit(-1).cast("long")})).unionByName(c.filter("dst % 89 = 0").withColumns({"dst": F.lit(-2).cast("long")}))
        files = files.withColumn("symbol_count", F.when(F.col("path") == "part/3.rs", F.col("symbol_count") + 1).otherwise(F.col("symbol_count"))).withColumn("diagnostic_count", F.when(F.expr("try_cast(path AS bigint) % 15 = 1"), 0).otherwise(F.col("diagnostic_count")))
        d = d.withColumns({"path": F.when(F.col("doc_id") % 21 == 1, "x").otherwise(F.col("path")), "precision": F.when(F.col("doc_id") % 33 == 2, "heuristic").otherwise(F.col("precision"))})
        catalog = catalog.filter("target_kind <> 'method' OR id % 79 <> 0")
        kept = kept.unionByName(s.filter("kind = 'method' AND id % 61 = 0").select("id"))
    # Doubled ids would double what joins by id, so they are planted beside the symbols that the other checks read.
    return quality.audit(files, s, edges.unionByName(c), sites, catalog, d, totals, {"duplicate_id": kept.groupBy("id").count().filter("count > 1")})


_CHECKS = ["duplicate_id", "unknown_source", "unknown_target", "unknown_caller", "unknown_call_target", "file_index", "name_index", "callable_index", "call_site_location", "call_site_name", "receiver_type", "call_site_resolution",
           "resolved_call_edge", "resolved_test_edge", "relationship_ownership", "call_site_count", "edge_count", "diagnostic_count", "diagnostic_path", "diagnostic_quality"]
#: Each check in SQL of its own, over tables with faults.
_FAULTS = {
    "duplicate_id": "SELECT count(*) FROM symbols WHERE kind = 'method' AND id % 61 = 0",
    "unknown_source": "SELECT count(*) FROM contains WHERE dst % 97 = 0",
    "unknown_target": "SELECT count(*) FROM contains WHERE dst % 89 = 0",
    "file_index": "SELECT count(DISTINCT path) FROM symbols WHERE path = 'part/3.rs'",
    "callable_index": "SELECT count(*) FROM catalog WHERE id % 79 = 0 AND id IN (SELECT id FROM symbols WHERE kind = 'method')",
    "call_site_location": "SELECT count(*) FROM broken WHERE moved",
    "receiver_type": "SELECT count(*) FROM resolved WHERE seq % 109 = 0",
    "call_site_resolution": """SELECT count(*) FROM broken b JOIN sites s USING (seq) JOIN resolved o USING (seq) LEFT JOIN (SELECT target_kind, name, qualifier, count(*) AS n, min(id) AS sole FROM catalog WHERE id % 79 <> 0 AND id IN (SELECT id FROM symbols WHERE kind = 'method') GROUP BY ALL) k
        ON s.target_kind = k.target_kind AND s.name = k.name AND s.qualifier = k.qualifier WHERE b.resolution IS DISTINCT FROM (CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END) OR b.target IS DISTINCT FROM (CASE WHEN n = 1 THEN sole END) OR (CASE WHEN b.seq % 101 = 0 THEN 0 ELSE o.candidates END) <> coalesce(n, 0)""",
    "resolved_call_edge": "SELECT count(*) FROM (SELECT * FROM want WHERE kind = 'CALLS' EXCEPT ALL SELECT * FROM have)",
    "resolved_test_edge": "SELECT count(*) FROM (SELECT * FROM want WHERE kind = 'TESTS' EXCEPT ALL SELECT * FROM have)",
    "relationship_ownership": "SELECT count(*) FROM (SELECT * FROM have EXCEPT ALL SELECT * FROM want)",
    "call_site_count": "SELECT CASE WHEN (SELECT count(*) FROM resolved WHERE resolution <> 'unresolved' AND seq % 101 = 0) > 0 THEN 1 ELSE 0 END",
    "edge_count": "SELECT CASE WHEN (SELECT count(*) FROM have) + (SELECT count(*) + count(*) FILTER (dst % 97 = 0) + count(*) FILTER (dst % 89 = 0) FROM contains) <> (SELECT count(*) FROM resolved WHERE resolution = 'resolved') + (SELECT count(*) FROM (SELECT DISTINCT caller, target FROM resolved WHERE resolution = 'resolved' AND caller IN (SELECT id FROM symbols WHERE kind = 'test'))) + (SELECT count(*) FROM contains) THEN 1 ELSE 0 END",
    "diagnostic_count": "SELECT count(*) FROM documents WHERE doc_id % 15 = 1",
    "diagnostic_path": "SELECT count(*) FROM diags WHERE doc_id % 21 = 1",
    "diagnostic_quality": "SELECT count(*) FROM diags WHERE doc_id % 33 = 2",
}


@query(_PLANT + " UNION ALL ".join(f"SELECT '{c}' AS check_name, ({_FAULTS.get(c, 'SELECT 0')})::BIGINT AS violations" for c in _CHECKS))
def audit(g: Facts) -> DataFrame:
    """Every check over tables with faults of each kind, planted by their keys."""
    return _audit(g, True)


@query(" UNION ALL ".join(f"SELECT '{c}' AS check_name, 0::BIGINT AS violations" for c in _CHECKS))
def audit_of_sound_tables(g: Facts) -> DataFrame:
    return _audit(g, False)


# Diagnostics

_DIAG = f"""diag AS (SELECT * FROM (SELECT 'u' || user_id AS path, event_id % 90 + 1 AS start_line, event_id % 7 + 1 AS start_col, event_id % 90 + 1 + event_id % 2 AS end_line, event_id % 9 + 1 AS end_col, {_sql(LANGUAGES)}[(event_id % 11)::INT + 1] AS language,
    ['error', 'missing'][(event_id % 2)::INT + 1] AS kind, 'syntax' AS precision, ['tree_sitter', 'gopls', 'git'][(event_id % 3)::INT + 1] AS provenance, CASE WHEN event_id % 4 = 0 THEN 'gap' END AS cause, event_type AS node_kind, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 64)"""


def _diagnostics(g: Facts) -> tuple[DataFrame, DataFrame]:
    e, k = g.table("events"), F.col("event_id")
    files = e.groupBy(F.concat(F.lit("u"), "user_id").alias("path")).agg(F.count("*").alias("diagnostic_count"))
    at = lambda xs: F.element_at(F.lit(xs), (k % len(xs) + 1).cast("int"))
    d = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter(F.col("k") <= quality.KEPT)
    d = d.select(F.concat(F.lit("u"), "user_id").alias("path"), (k % 90 + 1).alias("start_line"), (k % 7 + 1).alias("start_col"), (k % 90 + 1 + k % 2).alias("end_line"), (k % 9 + 1).alias("end_col"), at(LANGUAGES).alias("language"), at(["error", "missing"]).alias("kind"), F.lit("syntax").alias("precision"), at(["tree_sitter", "gopls", "git"]).alias("provenance"), F.when(k % 4 == 0, "gap").alias("cause"), F.col("event_type").alias("node_kind"), "event_id")
    return files, d


@query(f""", {_DIAG} SELECT event_id, row_number() OVER (ORDER BY path, start_line, start_col, end_line, end_col, list_position({_sql(LANGUAGES)}, language), kind, CASE provenance WHEN 'gopls' THEN 0 WHEN 'tree_sitter' THEN 1 ELSE 2 END, cause NULLS FIRST, node_kind, event_id) AS position FROM diag ORDER BY position LIMIT 100""")
def diagnostics_in_order(g: Facts) -> DataFrame:
    _, first = quality.diagnostics_summary(*_diagnostics(g), 100)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*quality.diagnostic_order(), "event_id")).cast("long")).select("event_id", "position")


@query("""SELECT count(*) AS files_with_diagnostics, sum(n)::BIGINT AS total_diagnostics, sum(greatest(n - 64, 0))::BIGINT AS capture_omitted, greatest(sum(least(n, 64)) - 100, 0)::BIGINT AS response_omitted FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def diagnostics_totals(g: Facts) -> DataFrame:
    return quality.diagnostics_summary(*_diagnostics(g), 100)[0]


# Bounded builds

_BUILD = """, costs AS (SELECT seq, cost, sum(cost) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM (
  SELECT seq, CASE WHEN resolution <> 'resolved' THEN 0 WHEN caller IN (SELECT id FROM symbols WHERE kind = 'test') THEN 2 ELSE 1 END AS cost FROM resolved)
), refused AS (SELECT seq AS at, 999 - (total - cost) AS room FROM costs WHERE total > 999 ORDER BY seq LIMIT 1
), late AS (SELECT min(c.seq) AS seq FROM costs c, refused r WHERE r.room = 1 AND c.seq > r.at AND c.cost = 1
), f AS (SELECT seq, cost, total <= 999 OR cost = 0 OR coalesce(seq = (SELECT seq FROM late), false) AS fits FROM costs
), h AS (SELECT seq, cost, fits, coalesce(sum(fits::INT) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 700 AS over FROM f
), report AS (SELECT (SELECT count(*) FROM symbols) AS retained_symbols, 0 AS omitted_symbols, (SELECT count(*) FROM contains) + sum(cost) FILTER (fits AND NOT over) AS retained_edges, sum(cost) FILTER (NOT (fits AND NOT over)) AS omitted_edges, 0 AS edges_omitted_by_symbol_budget,
    coalesce(sum(cost) FILTER (NOT fits AND NOT over), 0) AS edges_omitted_by_edge_budget, coalesce(sum(cost) FILTER (over), 0) AS edges_omitted_by_call_site_budget, count(*) FILTER (fits AND NOT over) AS retained_call_sites, count(*) FILTER (NOT (fits AND NOT over)) AS omitted_call_sites,
    0 AS call_sites_omitted_by_symbol_budget, count(*) FILTER (NOT fits AND NOT over) AS call_sites_omitted_by_edge_budget, count(*) FILTER (over) AS call_sites_omitted_by_call_site_budget FROM h)
"""
_COUNTERS = "retained_symbols omitted_symbols retained_edges omitted_edges edges_omitted_by_symbol_budget edges_omitted_by_edge_budget edges_omitted_by_call_site_budget retained_call_sites omitted_call_sites call_sites_omitted_by_symbol_budget call_sites_omitted_by_edge_budget call_sites_omitted_by_call_site_budget".split()


def _bounded(g: Facts, max_symbols: int, room: int, max_sites: int) -> tuple[DataFrame, dict[str, int]]:
    e = g.contains().withColumn("seq", F.col("dst"))
    limits = {"symbols": max_symbols, "edges": e.count() + room, "call_sites": max_sites}
    return quality.bounded_report(g.symbols(), e, _resolved(g), *limits.values(), g.places()), limits


@query(_BUILD + f"SELECT {', '.join(f'{c}::BIGINT AS {c}' for c in _COUNTERS)} FROM report")
def build_report(g: Facts) -> DataFrame:
    """What a build keeps that has room for 999 edges of call sites, and for 700 call sites."""
    return _bounded(g, 1 << 40, 999, 700)[0].select(*[F.col(c).cast("long").alias(c) for c in _COUNTERS])


@query(f""", kept AS (SELECT id FROM symbols ORDER BY id LIMIT 500), e AS (SELECT src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) AS ok FROM contains)
  , c AS (SELECT CASE WHEN resolution <> 'resolved' THEN 0 WHEN caller IN ({_TESTS}) THEN 2 ELSE 1 END AS cost FROM resolved)
  SELECT least(500, (SELECT count(*) FROM symbols)) AS retained_symbols, greatest(0, (SELECT count(*) FROM symbols) - 500) AS omitted_symbols, (SELECT count(*) FROM e WHERE ok) AS retained_edges, ((SELECT count(*) FROM e WHERE NOT ok) + (SELECT sum(cost) FROM c))::BIGINT AS edges_omitted_by_symbol_budget, 0::BIGINT AS retained_call_sites, (SELECT count(*) FROM c) AS call_sites_omitted_by_symbol_budget""")
def build_report_by_symbols(g: Facts) -> DataFrame:
    """500 symbols: edges to others and all call sites are left out."""
    r = _bounded(g, 500, 1 << 40, 1 << 40)[0]
    return r.select(*[F.col(c).cast("long").alias(c) for c in ("retained_symbols", "omitted_symbols", "retained_edges", "edges_omitted_by_symbol_budget", "retained_call_sites", "call_sites_omitted_by_symbol_budget")])


@query(_BUILD + """SELECT capability, retained::BIGINT AS retained, omitted::BIGINT AS omitted, complete FROM report, LATERAL (VALUES ('file_inventory', 90, 10, false), ('text_search', 90, 10, false), ('declarations', retained_symbols, omitted_symbols, false), ('relationships', retained_edges, omitted_edges, false), ('call_sites', retained_call_sites, omitted_call_sites, false)) v(capability, retained, omitted, complete)""")
def indexing_status(g: Facts) -> DataFrame:
    """Capabilities of the bounded build, 10 of 100 files being skipped."""
    return quality.indexing_status(_bounded(g, 1 << 40, 999, 700)[0], 90, 10)


@query(_BUILD + """SELECT cause, affected, budget::BIGINT AS budget, observed::BIGINT AS observed, omitted::BIGINT AS omitted FROM report, LATERAL (VALUES
    ('edges', 'relationships', (SELECT count(*) FROM contains) + 999, retained_edges + edges_omitted_by_edge_budget, edges_omitted_by_edge_budget), ('edges', 'call_sites', (SELECT count(*) FROM contains) + 999, retained_edges + edges_omitted_by_edge_budget, call_sites_omitted_by_edge_budget),
    ('call_sites', 'relationships', 700, retained_call_sites + call_sites_omitted_by_call_site_budget, edges_omitted_by_call_site_budget), ('call_sites', 'call_sites', 700, retained_call_sites + call_sites_omitted_by_call_site_budget, call_sites_omitted_by_call_site_budget)) v(cause, affected, budget, observed, omitted) WHERE omitted > 0""")
def degradations(g: Facts) -> DataFrame:
    return quality.degradations(*_bounded(g, 1 << 40, 999, 700))


@query("""SELECT l_orderkey % 700 AS k, least(8192, greatest(1024, 16 * (l_orderkey % 700)))::BIGINT AS examined, least(16384, greatest(2048, 32 * (l_orderkey % 700)))::BIGINT AS traversal, least(4096, greatest(2048, 8 * (l_orderkey % 700)))::BIGINT AS intermediate FROM lineitem GROUP BY ALL""")
def work_budgets(g: Facts) -> DataFrame:
    k = g.table("lineitem").select((F.col("l_orderkey") % 700).alias("k")).distinct()
    return k.select("k", *[c.cast("long").alias(name) for name, c in quality.work_budget(F.col("k")).items()])


@query("""SELECT lang AS language, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def disjoint_languages(g: Facts) -> DataFrame:
    """Graphs of one language each, as one."""
    f = g.files()
    names = sorted(r[0] for r in f.select("language").distinct().collect() if r[0])
    return quality.disjoint_union({n: f.filter(F.col("language") == n) for n in names}).groupBy("language").agg(F.count("*").alias("files"))


# Places, ids and events


@query("""SELECT path, length(array_to_string(ls[1 : l - 1], chr(10))) + CASE WHEN l > 1 THEN 1 ELSE 0 END + 2 AS at, l + len(string_split(said, chr(10))) - 1 AS line, CASE WHEN contains(said, chr(10)) THEN length(string_split(said, chr(10))[-1]) + 1 ELSE 3 + length(said) END AS col
  FROM (SELECT path, ls, l, array_to_string(ls[1 : l], chr(10)) AS said FROM (SELECT path, string_split(text, chr(10)) AS ls, doc_id % 4 + 1 AS l FROM files))""")
def text_places(g: Facts) -> DataFrame:
    """Offsets of places, and places behind texts, in every document."""
    f = g.files().withColumn("l", F.col("doc_id") % 4 + 1)
    said = F.array_join(F.slice(F.split("text", "\n", -1), F.lit(1), F.col("l").cast("int")), "\n")
    line, col = text.advance(F.col("l"), F.lit(3), said)
    return f.select("path", text.offset(F.col("text"), F.col("l"), F.lit(3)).alias("at"), line.alias("line"), col.alias("col"))


@query(f"""SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY path, id) - 1 AS local_id FROM (SELECT *, {_sql(LANGUAGES)}[(id % {SLOT} % 11)::INT + 1] AS language FROM symbols)""")
def numbered_symbols(g: Facts) -> DataFrame:
    """Dense ids by language, in the order of paths and declarations."""
    return graph.number(_with_role(g.symbols())).select("id", "language", F.col("local_id").cast("long").alias("local_id"))


_AT = "epoch_ms(ts)"


@query(f"""SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY run, piece) - 1 AS burst FROM (SELECT *, floor((ms - min(ms) OVER (PARTITION BY user_id, run)) / 3600000) AS piece FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms) AS run FROM (
    SELECT event_id, user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM (SELECT *, {_AT} AS ms FROM events))))""")
def bounded_bursts(g: Facts) -> DataFrame:
    """Bursts of a user's events, half an hour apart at most, cut where they last an hour."""
    e = g.table("events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return live.bursts(e, ["user_id"], 1_800_000, 3_600_000).select("event_id", F.col("burst").cast("long").alias("burst"))


@query("""SELECT event_id, path FROM (SELECT event_id, user_id, event_type, CASE WHEN user_id % 5 = 0 THEN 'a/.git/x' WHEN user_id % 5 = 1 THEN '.gitignore' ELSE 'src/' || user_id || '.py' END AS path FROM events) WHERE event_type <> 'view' AND user_id % 5 <> 0""")
def relevant_events(g: Facts) -> DataFrame:
    """Events that may change sources: views stand for accesses, purchases for a close after writing."""
    u = F.col("user_id")
    path = F.when(u % 5 == 0, "a/.git/x").when(u % 5 == 1, ".gitignore").otherwise(F.concat(F.lit("src/"), u, F.lit(".py")))
    kind = F.when(F.col("event_type") == "view", "access_read").when(F.col("event_type") == "purchase", "access_close_write").otherwise("modify")
    return live.relevant(g.table("events").select("event_id", path.alias("path"), kind.alias("kind"))).select("event_id", "path")
