"""The registered queries over the star-schema tables, each beside the same question in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import delta, related, resolve, search
from graphloom.schema import PROVIDER_SEVERITY, rank
from graphloom.sources.facts import Facts

QUERIES, ORACLE = {}, {}

#: The graph tables in DuckDB.
FACTS = """
WITH files AS (
  SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language,
         ['production','test','example','bench','fixture','generated','vendor'][doc_id % 7 + 1] AS role, source AS package, text, strlen(text) AS n_bytes
  FROM documents
), nat AS (SELECT n.*, r.*, r_name || '::' || n_name AS ns FROM nation n JOIN region r ON n_regionkey = r_regionkey
), raw AS (
  SELECT 0 AS slot, 'region' AS tab, r_regionkey::BIGINT AS k, r_name AS name, r_name AS qualified_name, NULL AS container, 'module' AS kind FROM region
  UNION ALL SELECT 1, 'nation', n_nationkey, n_name, ns, r_name, 'class' FROM nat
  UNION ALL SELECT 2, 'supplier', s_suppkey, s_name, ns || '::' || s_name, n_name, 'interface' FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT 3, 'customer', c_custkey, c_name, ns || '::' || c_name, n_name, 'struct' FROM customer JOIN nat ON c_nationkey = n_nationkey
  UNION ALL SELECT 4, 'part', p_partkey, p_name, p_brand || '::' || p_name, p_brand, CASE WHEN p_size > 40 THEN 'field' ELSE 'method' END FROM part
  UNION ALL SELECT 5, 'orders', o_orderkey, 'order_' || o_orderkey, c_name || '::order_' || o_orderkey, c_name, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'function' END FROM orders JOIN customer ON o_custkey = c_custkey
), symbols AS (
  SELECT slot * 1099511627776 + k AS id, name, qualified_name, container, kind, tab || '/' || (k % 16) || '.rs' AS path, k % 997 + 1 AS start_line, k % 997 + 1 + k % 5 AS end_line FROM raw
), contains AS (
  SELECT n_regionkey::BIGINT AS src, 1099511627776 + n_nationkey AS dst FROM nation
  UNION ALL SELECT 1099511627776 + s_nationkey, 2 * 1099511627776 + s_suppkey FROM supplier
  UNION ALL SELECT 1099511627776 + c_nationkey, 3 * 1099511627776 + c_custkey FROM customer
  UNION ALL SELECT 3 * 1099511627776 + o_custkey, 5 * 1099511627776 + o_orderkey FROM orders
), sites AS (
  SELECT l_orderkey * 10000000000000 + l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS seq, 5 * 1099511627776 + l_orderkey AS caller,
         CASE WHEN l_returnflag = 'R' THEN 'member' ELSE 'scoped' END AS form, 'method' AS target_kind, p_name AS name,
         CASE WHEN l_returnflag <> 'R' THEN p_brand END AS qualifier, l_linenumber::BIGINT AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey
), catalog AS (
  SELECT DISTINCT CASE WHEN kind IN ('module', 'property') THEN 'configuration' ELSE kind END AS target_kind, name, q AS qualifier, id FROM (
    SELECT *, unnest(CASE WHEN contains(qualified_name, '::') THEN [NULL, container, regexp_replace(qualified_name, '::[^:]*$', ''), regexp_extract(regexp_replace(qualified_name, '::[^:]*$', ''), '[^:]*$')] ELSE [NULL, container] END) AS q
    FROM symbols WHERE kind IN ('function', 'method', 'test', 'configuration', 'module', 'property'))
), keys AS (SELECT target_kind, name, qualifier, count(*) AS n, min(id) AS sole FROM catalog GROUP BY ALL
), resolved AS (
  SELECT s.*, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, CASE WHEN n = 1 THEN sole END AS target, coalesce(n, 0) AS candidates
  FROM sites s LEFT JOIN keys k ON s.target_kind = k.target_kind AND s.name = k.name AND s.qualifier = k.qualifier
), ln AS (
  SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM (SELECT path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM files)
)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = FACTS + sql
        return f

    return add


def _resolved(g: Facts) -> DataFrame:
    # Each part's calls are resolved once, so a site is shuffled by its part alone and not by what it says, too.
    return g.call_sites(resolve.resolve(g.said(), resolve.callable_catalog(g.symbols().filter("kind = 'method'"))))


def _numbered_sites(g: Facts, resolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sites that aren't resolved, or all, narrow enough to be shuffled by caller: caller, member, said, nth, place, line; and
    what said and nth stand for: said, nth, target_kind, name, qualifier ('' for null, too), resolution, candidates, target."""
    r = resolve.resolve(g.said(), resolve.callable_catalog(g.symbols().filter("kind = 'method'"))).filter("part IS NOT NULL")
    r = r if resolved else r.filter("resolution <> 'resolved'")
    r = r.withColumn("qualifier", F.coalesce("qualifier", F.lit("")))
    # The least part that says it stands for what is said; nth tells what else a part's key says, should it be there twice.
    r = r.withColumn("nth", F.rank().over(Window.partitionBy("part", "qualified").orderBy("name", "qualifier", "resolution")))
    what = ["target_kind", "name", "qualifier", "resolution"]
    number = F.struct((F.col("part") * 2 + F.col("qualified").cast("int")).alias("said"), "nth")
    words = r.groupBy(*what).agg(F.min(number).alias("number"), F.max("candidates").alias("candidates"), F.max("target").alias("target")).select("number.*", *what, "candidates", "target")
    own = words.select("said", "nth", *[F.col(c).alias(f"w_{c}") for c in what])
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in what]
    sites = g.call_sites(r.drop("nth").join(own, same))
    return sites.select("caller", (F.col("form") == "member").alias("member"), "said", "nth", "place", "line"), words


_HEAD = "array_to_string(list(line ORDER BY seq)[1:3], ',') AS first_lines, greatest(0, count(*) - 3) AS omitted"


@query(f"SELECT target, caller, count(*) AS occurrence_count, {_HEAD} FROM resolved WHERE resolution = 'resolved' GROUP BY ALL")
def callers(g: Facts) -> DataFrame:
    return resolve.relations(_resolved(g).filter("resolution = 'resolved'"), ["target", "caller"])


@query(f"SELECT target, o_orderpriority AS caller_group, count(*) AS occurrence_count, {_HEAD} FROM resolved JOIN orders ON caller = 5 * 1099511627776 + o_orderkey WHERE resolution = 'resolved' GROUP BY ALL")
def callers_by_priority(g: Facts) -> DataFrame:
    o = g.table("orders").select((F.lit(5 * (1 << 40)) + F.col("o_orderkey")).alias("caller"), F.col("o_orderpriority").alias("caller_group"))
    return resolve.relations(_resolved(g).filter("resolution = 'resolved'").join(o, "caller"), ["target", "caller_group"])


@query("SELECT target_kind, name, coalesce(qualifier, '') AS qualifier, id FROM catalog")
def callable_catalog(g: Facts) -> DataFrame:
    return resolve.callable_catalog(g.symbols()).select("target_kind", "name", F.coalesce("qualifier", F.lit("")).alias("qualifier"), "id")


@query("SELECT seq, caller, resolution, coalesce(target, -1) AS target, candidates FROM resolved")
def resolve_calls(g: Facts) -> DataFrame:
    return _resolved(g).select("seq", "caller", "resolution", F.coalesce("target", F.lit(-1)).alias("target"), "candidates")


@query("""SELECT seq, id, position FROM (SELECT r.seq, c.id, row_number() OVER (PARTITION BY r.seq ORDER BY c.id) AS position FROM resolved r JOIN catalog c
  ON r.target_kind = c.target_kind AND r.name = c.name AND r.qualifier = c.qualifier WHERE resolution = 'ambiguous') WHERE position <= 3""")
def candidate_fan_out(g: Facts) -> DataFrame:
    cat = resolve.callable_catalog(g.symbols().filter("kind = 'method'"))
    return resolve.fan_out(_resolved(g), cat, 2)


@query("""SELECT c.id AS target, count(DISTINCT r.seq) AS sites, min(r.seq) AS first_seq FROM catalog c JOIN resolved r
  ON r.target_kind = c.target_kind AND r.name = c.name AND r.qualifier = c.qualifier WHERE resolution = 'ambiguous' GROUP BY c.id""")
def ambiguous_callers(g: Facts) -> DataFrame:
    cat = resolve.callable_catalog(g.symbols().filter("kind = 'method'"))
    amb = _resolved(g).filter("resolution = 'ambiguous'").groupBy(*resolve.KEY).agg(F.count("*").alias("sites"), F.min("seq").alias("first_seq"))
    return cat.join(amb, resolve.KEY).groupBy(F.col("id").alias("target")).agg(F.sum("sites").alias("sites"), F.min("first_seq").alias("first_seq"))


@query("""SELECT caller, form, name, coalesce(qualifier, '') AS qualifier, resolution, count(*) AS sites, max(candidates) AS candidates, min(seq) AS first_seq
  FROM resolved WHERE resolution <> 'resolved' GROUP BY ALL""")
def call_candidates(g: Facts) -> DataFrame:
    sites, words = _numbered_sites(g)
    groups = resolve.call_groups(sites, words, ["caller", "member"], "place")
    form = F.when(F.col("member"), "member").otherwise("scoped")
    return groups.select("caller", form.alias("form"), "name", "qualifier", "resolution", "sites", "candidates", g.seq("caller", "first").alias("first_seq"))


@query("""SELECT caller, target, min(seq) AS seq, arg_min(line, seq) AS line, count(*) AS evidence FROM resolved
  WHERE resolution = 'resolved' AND caller IN (SELECT id FROM symbols WHERE kind = 'test') GROUP BY ALL""")
def test_edges(g: Facts) -> DataFrame:
    return resolve.test_edges(_resolved(g), g.symbols())


_RANK = """CASE WHEN lower(qualified_name) = '{q}' OR lower(name) = '{q}' THEN 0 WHEN starts_with(lower(name), '{q}') THEN 1 WHEN starts_with(lower(qualified_name), '{q}') THEN 2
  WHEN contains(lower(name), '{q}') THEN 3 WHEN contains(lower(qualified_name), '{q}') THEN 4 END"""


@query(f"SELECT id, name, qualified_name, kind, path, m AS match_rank FROM (SELECT *, {_RANK.format(q='nation_1')} AS m FROM symbols) WHERE m IS NOT NULL AND kind <> 'test' ORDER BY m, qualified_name, path, start_line, end_line, id LIMIT 50")
def symbol_search(g: Facts) -> DataFrame:
    return search.symbol_search(g.symbols(), " Nation_1 ", 50, not_kinds=["test"]).select("id", "name", "qualified_name", "kind", "path", "match_rank")


@query(f"SELECT id, name, kind, m AS match_rank FROM (SELECT *, {_RANK.format(q='1')} AS m FROM symbols) WHERE m IS NOT NULL AND kind IN ('struct', 'interface') AND (qualified_name = 'ASIA' OR starts_with(qualified_name, 'ASIA::')) AND starts_with(path, 'customer/') ORDER BY m, qualified_name, path, start_line, end_line, id LIMIT 20")
def symbol_search_filtered(g: Facts) -> DataFrame:
    return search.symbol_search(g.symbols(), "1", 20, kinds=["struct", "interface"], namespace="ASIA", path_prefix="customer/").select("id", "name", "kind", "match_rank")


@query("""SELECT path, line, instr(lower(body), 'worthless') AS start_column, instr(lower(body), 'worthless') + 9 AS end_column, greatest(0, length(body) - 512) AS omitted
  FROM ln WHERE instr(lower(body), 'worthless') > 0 ORDER BY path, line LIMIT 500""")
def text_search(g: Facts) -> DataFrame:
    return search.text_search(g.files(), "worthless", 500).drop("shown")


@query("SELECT path, max(line) AS lines, sum(length(body))::BIGINT AS characters FROM ln GROUP BY path")
def line_table(g: Facts) -> DataFrame:
    return search.lines(g.files()).groupBy("path").agg(F.max("line").alias("lines"), F.sum(F.length("body")).alias("characters"))


@query("""SELECT path, language, role, package, row_number() OVER (ORDER BY path) > 50 AS beyond FROM (
  SELECT path, language, role, package FROM files WHERE path > 'src3/en/doc_2' AND role NOT IN ('vendor', 'generated') ORDER BY path LIMIT 51)""")
def repo_map_page(g: Facts) -> DataFrame:
    return search.page(g.files().filter(~F.col("role").isin("vendor", "generated")), "src3/en/doc_2", 50)


@query("""SELECT 'top_level_directory' AS kind, split_part(path, '/', 1) AS name, language, count(*) AS file_count, sum(n_bytes)::BIGINT AS bytes FROM files GROUP BY ALL
  UNION ALL SELECT 'package', package, language, count(*), sum(n_bytes)::BIGINT FROM files GROUP BY ALL""")
def repo_overview(g: Facts) -> DataFrame:
    f = g.files()
    top = f.select(F.lit("top_level_directory").alias("kind"), F.split("path", "/")[0].alias("name"), "language", "n_bytes")
    both = top.unionByName(f.select(F.lit("package").alias("kind"), F.col("package").alias("name"), "language", "n_bytes"))
    return both.groupBy("kind", "name", "language").agg(F.count("*").alias("file_count"), F.sum("n_bytes").alias("bytes"))


@query("""SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM contains) AS edges, count(*) AS call_sites,
  count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution = 'ambiguous') AS ambiguous, count(*) FILTER (resolution = 'unresolved') AS unresolved FROM resolved""")
def status_counts(g: Facts) -> DataFrame:
    return delta.counts({"files": g.files(), "symbols": g.symbols(), "edges": g.contains()}, _resolved(g))


@query("SELECT role, language, count(*) AS files, count(*) FILTER (package = 'src0') AS of_first_package FROM files GROUP BY ALL")
def metadata_coverage(g: Facts) -> DataFrame:
    return g.files().groupBy("role", "language").agg(F.count("*").alias("files"), F.count_if(F.col("package") == "src0").alias("of_first_package"))


_STATE = "['not_configured','ready','dormant','initializing','catching_up','degraded']"


@query(f"SELECT event_type, {_STATE}[max(user_id % 6) + 1] AS state, count(*) AS reports FROM events GROUP BY event_type")
def provider_rollup(g: Facts) -> DataFrame:
    e = g.table("events").withColumn("state", F.element_at(F.lit(PROVIDER_SEVERITY), (F.col("user_id") % 6 + 1).cast("int")))
    return e.groupBy("event_type").agg(F.max_by("state", rank("state", PROVIDER_SEVERITY)).alias("state"), F.count("*").alias("reports"))


@query("""SELECT event_type, sum(n)::BIGINT AS total, sum(least(n, 64))::BIGINT AS retained, sum(greatest(n - 64, 0))::BIGINT AS omitted FROM (
  SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def diagnostics_summary(g: Facts) -> DataFrame:
    n = g.table("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.sum("n").alias("total"), F.sum(F.least(F.lit(64), "n")).alias("retained"), F.sum(F.greatest(F.lit(0), F.col("n") - 64)).alias("omitted"))


@query("""SELECT p.l_orderkey AS point, s.path, s.name, p.line, s.id FROM (SELECT DISTINCT l_orderkey, l_orderkey % 997 + 1 AS line, 'orders/' || (l_orderkey % 16) || '.rs' AS path, 'order_' || l_orderkey AS name FROM lineitem) p
  JOIN symbols s ON s.path = p.path AND s.name = p.name AND s.start_line <= p.line AND p.line < s.end_line QUALIFY row_number() OVER (PARTITION BY p.l_orderkey ORDER BY s.end_line - s.start_line, s.id) = 1""")
def innermost_symbol(g: Facts) -> DataFrame:
    k = F.col("l_orderkey")
    p = g.table("lineitem").select("l_orderkey").distinct().select(k.alias("point"), F.concat(F.lit("orders/"), k % 16, F.lit(".rs")).alias("path"), F.concat(F.lit("order_"), k).alias("name"), (k % 997 + 1).alias("line"))
    return delta.innermost(p, g.symbols())


@query("""SELECT id, tier FROM (SELECT DISTINCT target AS id, 'precise' AS tier FROM resolved WHERE resolution = 'resolved' AND line = 1
  UNION ALL SELECT DISTINCT target, 'syntax' FROM resolved WHERE resolution = 'resolved' AND target NOT IN (SELECT target FROM resolved WHERE resolution = 'resolved' AND line = 1))""")
def precise_merge(g: Facts) -> DataFrame:
    r = _resolved(g).filter("resolution = 'resolved'")
    tier = lambda df, t: df.select(F.col("target").alias("id")).distinct().withColumn("tier", F.lit(t))
    return delta.prefer_precise(tier(r.filter("line = 1"), "precise"), tier(r, "syntax"))


@query("""SELECT path, CASE WHEN language IN ('de', 'fr') THEN package || '-' || language ELSE package END AS package_name, CASE WHEN language IN ('de', 'fr') THEN package || '/' || language ELSE package END AS nearest FROM files""")
def nearest_package(g: Facts) -> DataFrame:
    f = g.files()
    roots = f.select(F.col("package").alias("root"), F.col("package").alias("package_name")).unionByName(f.filter("language IN ('de', 'fr')").select(F.concat_ws("/", "package", "language").alias("root"), F.concat_ws("-", "package", "language").alias("package_name"))).distinct()
    return search.nearest_root(f, roots)


_NEXT = "SELECT path, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM files WHERE doc_id % 7 <> 3 UNION ALL SELECT 'new/' || path, text FROM files WHERE doc_id % 11 = 0"


def _revisions(g: Facts) -> tuple[DataFrame, DataFrame]:
    f = g.files()
    new = f.filter("doc_id % 7 <> 3").select("path", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return f.select("path", "text"), new.unionByName(f.filter("doc_id % 11 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "text"))


@query(f"SELECT path, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT path, text FROM files) o FULL JOIN ({_NEXT}) n USING (path) WHERE o.text IS DISTINCT FROM n.text")
def revision_delta(g: Facts) -> DataFrame:
    return delta.revision_delta(*_revisions(g))


@query("""SELECT s.path, s.id AS changed, count(DISTINCT r.caller) AS callers, count(*) AS occurrences FROM symbols s JOIN resolved r ON r.target = s.id
  WHERE resolution = 'resolved' AND s.path IN ('part/1.rs', 'part/5.rs') GROUP BY ALL""")
def diff_context(g: Facts) -> DataFrame:
    s = g.symbols().filter(F.col("path").isin("part/1.rs", "part/5.rs")).select("path", F.col("id").alias("changed"))
    r = _resolved(g).filter("resolution = 'resolved'").groupBy("target", "caller").agg(F.count("*").alias("n"))
    return s.join(r, F.col("changed") == F.col("target")).groupBy("path", "changed").agg(F.count("*").alias("callers"), F.sum("n").alias("occurrences"))


@query("""SELECT path FROM (SELECT path FROM symbols WHERE id IN (SELECT target FROM resolved WHERE resolution = 'resolved')
  UNION SELECT path FROM symbols WHERE id IN (SELECT caller FROM resolved WHERE resolution = 'resolved'))""")
def related_files(g: Facts) -> DataFrame:
    r, s = _resolved(g).filter("resolution = 'resolved'"), g.symbols().select("id", "path")
    return s.join(r.select(F.col("target").alias("id")), "id", "left_semi").unionByName(s.join(r.select(F.col("caller").alias("id")), "id", "left_semi")).select("path").distinct()


@query("SELECT name, kind, sum(d)::BIGINT AS surplus FROM (SELECT name, kind, 1 AS d FROM symbols WHERE kind IN ('method', 'field') UNION ALL SELECT name, kind, -1 FROM symbols WHERE kind = 'method' AND id % 2 = 0) GROUP BY ALL HAVING sum(d) <> 0")
def multiset_audit(g: Facts) -> DataFrame:
    s = g.symbols()
    return delta.multiset_difference(s.filter("kind IN ('method', 'field')").select("name", "kind"), s.filter("kind = 'method' AND id % 2 = 0").select("name", "kind"))


@query("""SELECT package, path, role FROM (SELECT package, path, role, sum(strlen('{"package":"' || package || '","path":"' || path || '","role":"' || role || '"}')) OVER w + count(*) OVER w + 1 AS used
  FROM files WINDOW w AS (PARTITION BY package ORDER BY path ROWS UNBOUNDED PRECEDING)) WHERE used <= 512""")
def byte_limited(g: Facts) -> DataFrame:
    """Each package's files as a section, as many of them as fit into 512 bytes of JSON."""
    return search.byte_limit(g.files().select("package", "path", "role"), ["path"], 512, ["package"]).drop("used")


@query("""SELECT request, arg_min(id, i) AS target FROM (SELECT o_orderkey AS request, unnest(range(3)) AS i, unnest([o_orderpriority || '::none', p.qualified_name, q.qualified_name]) AS qualified_name
    FROM orders JOIN symbols p ON p.id = 4 * 1099511627776 + o_orderkey % 200 + 1 JOIN symbols q ON q.id = 3 * 1099511627776 + o_custkey) JOIN (SELECT qualified_name, min(id) AS id FROM symbols GROUP BY 1 HAVING count(*) = 1) USING (qualified_name) GROUP BY request""")
def named_relations(g: Facts) -> DataFrame:
    o, s = g.table("orders"), g.symbols().select("id", "qualified_name")
    p = s.select(F.col("id").alias("pid"), F.col("qualified_name").alias("pq"))
    c = s.select(F.col("id").alias("cid"), F.col("qualified_name").alias("cq"))
    r = o.join(p, F.col("pid") == F.lit(4 * (1 << 40)) + F.col("o_orderkey") % 200 + 1).join(c, F.col("cid") == F.lit(3 * (1 << 40)) + F.col("o_custkey"))
    return delta.first_unique(r.select(F.col("o_orderkey").alias("request"), F.array(F.concat("o_orderpriority", F.lit("::none")), "pq", "cq").alias("names")), s)


@query("""SELECT n_name AS type, m AS method, owner, state FROM (SELECT n_name, 'm' || (n_nationkey % 5) AS m, n_name AS owner, 'unique' AS state FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT a.n_name, 'm' || (b.n_nationkey % 5), min(b.n_name), CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'unique' END FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey % 2 = 1 AND b.n_nationkey % 2 = 0 GROUP BY 1, 2)""")
def inherited_methods(g: Facts) -> DataFrame:
    from graphloom.sources.store import ensure_checkpoint_dir

    ensure_checkpoint_dir(g.spark)
    n = g.table("nation")
    even = n.filter("n_nationkey % 2 = 0")
    methods = even.select(F.col("n_name").alias("type"), F.concat(F.lit("m"), F.col("n_nationkey") % 5).alias("method"))
    a, b = n.filter("n_nationkey % 2 = 1").select(F.col("n_name").alias("type"), "n_regionkey"), even.select(F.col("n_name").alias("parent"), "n_regionkey")
    return delta.inherited(a.join(b, "n_regionkey").select("type", "parent", F.lit("extends").alias("relation")), methods)


@query("""SELECT type, 'm' AS method, CASE WHEN r = 0 THEN type WHEN r <= 5 THEN 'T' || (k - r + 5) ELSE 'c' || (k - r + 13) END AS owner, 'unique' AS state FROM (SELECT c_custkey AS k, c_custkey % 13 AS r, 'c' || c_custkey AS type, max(c_custkey) OVER () AS top FROM customer)
  WHERE r = 0 OR (r <= 5 AND k - r + 5 <= top) OR (r > 5 AND k - r + 13 <= top) UNION ALL SELECT 'T' || c_custkey, 'm', 'T' || c_custkey, 'unique' FROM customer WHERE c_custkey % 13 = 5""")
def inherited_deeply(g: Facts) -> DataFrame:
    """Chains of thirteen types: the top has the method, and so has a trait of the sixth, which those below it get."""
    from graphloom.sources.store import ensure_checkpoint_dir

    ensure_checkpoint_dir(g.spark)
    c = g.table("customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 13).alias("r"))
    name = lambda p, x: F.concat(F.lit(p), x)
    up = c.filter("r <> 0").select(name("c", F.col("k")).alias("type"), name("c", F.col("k") + 1).alias("parent"), F.lit("extends").alias("relation"))
    uses = c.filter("r = 5").select(name("c", F.col("k")).alias("type"), name("T", F.col("k")).alias("parent"), F.lit("trait").alias("relation"))
    own = c.filter("r = 0").select(name("c", F.col("k")).alias("type")).unionByName(uses.select(F.col("parent").alias("type"))).withColumn("method", F.lit("m"))
    return delta.inherited(up.unionByName(uses), own)


_ROLE_PATH = "package || '/' || ['src', 'tests', 'examples', 'benches', 'fixtures', 'generated', 'vendor'][doc_id % 7 + 1] || '/' || doc_id || ['.rs', '.py', '.go', '.tf', '.txt'][doc_id % 5 + 1]"


@query(f"""SELECT path, ['production', 'test', 'example', 'bench', 'fixture', 'generated', 'vendor'][doc_id % 7 + 1] AS role, ['rust', 'python', 'go', 'hcl', NULL][doc_id % 5 + 1] AS language FROM (SELECT doc_id, {_ROLE_PATH} AS path FROM files)""")
def path_rules(g: Facts) -> DataFrame:
    at = lambda xs, n: F.element_at(F.lit(xs), (F.col("doc_id") % n + 1).cast("int"))
    p = F.concat(F.concat_ws("/", "package", at(["src", "tests", "examples", "benches", "fixtures", "generated", "vendor"], 7), F.col("doc_id").cast("string")), at([".rs", ".py", ".go", ".tf", ".txt"], 5))
    return g.files().select(p.alias("path")).select("path", search.path_role(F.col("path")).alias("role"), search.path_language(F.col("path")).alias("language"))


@query("SELECT path, CASE WHEN length(s) > 512 THEN s[:511] || '…' ELSE s END AS signature FROM (SELECT path, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS s FROM ln WHERE line = 1)")
def signatures(g: Facts) -> DataFrame:
    return search.lines(g.files()).filter("line = 1").select("path", search.signature(F.col("body")).alias("signature"))


@query("""SELECT source, epoch, previous FROM (SELECT event_type AS source, event_id AS epoch, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS previous FROM events) WHERE previous IS NOT NULL AND epoch <> previous + 1""")
def epoch_gaps(g: Facts) -> DataFrame:
    return delta.gaps(g.table("events").select(F.col("event_type").alias("source"), F.col("event_id").alias("epoch")))


@query("SELECT event_type AS change, user_id % 50 AS file, count(*) AS events, max(event_id) AS last_epoch FROM events GROUP BY ALL")
def change_stream(g: Facts) -> DataFrame:
    from graphloom.streaming.changes import reconcile

    return reconcile(g.spark, g.root)


@query("SELECT sum(('0x' || md5(seq || '|' || caller || '|' || resolution || '|' || coalesce(target, -1))[1:8])::BIGINT)::BIGINT AS fingerprint, count(*) AS rows FROM resolved")
def graph_fingerprint(g: Facts) -> DataFrame:
    """One number that changes with any row, whatever their order."""
    return delta.fingerprint(_resolved(g).select("seq", "caller", "resolution", F.coalesce("target", F.lit(-1)).alias("target")))


#: One Python module a supplier; K stands for its key.
_MODULE = "import math\n\nclass TK(Base):\n    size = 1\n\n    def area(self, x):\n        return self.edge(x) + math.sqrt(x)\n\n    @property\n    def edge(self):\n        return helper(1)\n\n\ndef helper(x):\n    return TK(x)\n"


def _parsed(g: Facts) -> DataFrame:
    from graphloom.sources import python_code

    key = F.col("s_suppkey").cast("string")
    return python_code.parse(g.table("supplier").select(F.concat(F.lit("src/pkg/m"), key, F.lit(".py")).alias("path"), F.replace(F.lit(_MODULE), F.lit("K"), key).alias("text")))


_AT = "'src/pkg/m' || s_suppkey || '.py#0000000'"


@query(f"""SELECT {_AT} || i AS id, replace(name, 'K', s_suppkey::VARCHAR) AS name, 'pkg::m' || s_suppkey || '::' || CASE WHEN i IN (2, 3, 4) THEN 'T' || s_suppkey || '::' ELSE '' END || replace(name, 'K', s_suppkey::VARCHAR) AS qualified_name, kind, replace(signature, 'K', s_suppkey::VARCHAR) AS signature, a AS start_line, b AS end_line
  FROM supplier, (VALUES (0, 'import math', 'import', 'import math', 1, 1), (1, 'TK', 'class', 'class TK(Base):', 3, 11), (2, 'size', 'property', 'size = 1', 4, 4), (3, 'area', 'method', 'def area(self, x):', 6, 7),
    (4, 'edge', 'method', '@property def edge(self):', 9, 11), (5, 'helper', 'function', 'def helper(x):', 14, 15)) v(i, name, kind, signature, a, b)""")
def python_symbols(g: Facts) -> DataFrame:
    from graphloom.sources import python_code

    return python_code.symbols(_parsed(g)).select("id", "name", "qualified_name", "kind", "signature", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query(f"""SELECT {_AT} || i AS seq, {_AT} || c AS caller, form, target_kind, name, coalesce(replace(q, 'K', s_suppkey::VARCHAR), '') AS qualifier, line, col
  FROM supplier, (VALUES (0, 3, 'member', 'method', 'edge', 'TK', 7, 21), (1, 3, 'scoped', 'function', 'sqrt', 'math', 7, 36), (2, 4, 'function', 'function', 'helper', NULL, 11, 16), (3, 5, 'scoped', 'method', '__init__', 'TK', 15, 12)) v(i, c, form, target_kind, name, q, line, col)""")
def python_calls(g: Facts) -> DataFrame:
    from graphloom.sources import python_code

    return python_code.call_sites(_parsed(g)).select("seq", "caller", "form", "target_kind", "name", F.coalesce("qualifier", F.lit("")).alias("qualifier"), F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))


# Relations, candidates, changes and admission.

#: Edges of the tables, with a precision and provenance of their own: calls of line 1 are precise.
_EDGES = """, edges AS (
  SELECT 'CONTAINS' AS kind, src, dst, 0 AS seq, 0 AS line, 'syntax' AS precision, 'tree' AS provenance FROM contains
  UNION ALL SELECT 'CALLS', caller, target, seq, line, CASE WHEN line = 1 THEN 'precise' ELSE 'heuristic' END, CASE WHEN line % 2 = 1 THEN 'resolver' ELSE 'tree' END FROM resolved WHERE resolution = 'resolved')
"""


def _edges(g: Facts) -> DataFrame:
    c = g.contains().select(F.lit("CONTAINS").alias("kind"), "src", "dst", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("line"), F.lit("syntax").alias("precision"), F.lit("tree").alias("provenance"))
    precision, provenance = F.when(F.col("line") == 1, "precise").otherwise("heuristic"), F.when(F.col("line") % 2 == 1, "resolver").otherwise("tree")
    r = _resolved(g).filter("resolution = 'resolved'")
    return c.unionByName(r.select(F.lit("CALLS").alias("kind"), F.col("caller").alias("src"), F.col("target").alias("dst"), "seq", "line", precision.alias("precision"), provenance.alias("provenance")))


_PLACES = "array_to_string(list(line ORDER BY seq)[1:3], ',') AS lines, greatest(0, count(*) - 3) AS omitted"
def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(_EDGES + f"""SELECT dst AS anchor, src AS id, kind AS edge_kind, count(*) AS occurrence_count, {_PLACES},
  arg_max(precision, CASE precision WHEN 'precise' THEN 3 WHEN 'syntax' THEN 2 ELSE 1 END) AS precision, arg_min(provenance, (CASE precision WHEN 'precise' THEN 0 WHEN 'syntax' THEN 1 ELSE 2 END, seq)) AS provenance
  FROM edges WHERE dst IN (SELECT id FROM symbols WHERE kind IN ('method', 'struct')) GROUP BY dst, src, kind""")  # fmt: skip
def related_symbols(g: Facts) -> DataFrame:
    s = g.symbols()
    r = related.related(_edges(g), s, s.filter("kind IN ('method', 'struct')"), ["CALLS", "CONTAINS"], True)
    return r.select("anchor", "id", "edge_kind", "occurrence_count", _joined("lines").alias("lines"), F.col("locations_omitted").alias("omitted"), "precision", "provenance")


@query(_EDGES + f"""SELECT dst AS anchor, src AS id, count(*) AS occurrence_count, {_PLACES}, CASE WHEN bool_or(precision = 'precise') THEN 'precise' ELSE 'heuristic' END AS precision
  FROM edges WHERE kind = 'CALLS' AND src IN (SELECT id FROM symbols WHERE kind = 'test') GROUP BY dst, src""")
def related_tests(g: Facts) -> DataFrame:
    s = g.symbols()
    r = related.tests(_edges(g), s, s.filter("kind = 'method'"))
    return r.select("anchor", "id", "occurrence_count", _joined("lines").alias("lines"), F.col("locations_omitted").alias("omitted"), "precision")


@query(f"""SELECT anchor, caller, count(*) AS sites, {_PLACES} FROM (SELECT DISTINCT c.id AS anchor, r.caller, r.seq, r.line FROM catalog c JOIN resolved r
    ON r.target_kind = c.target_kind AND r.name = c.name AND r.qualifier = c.qualifier WHERE resolution = 'ambiguous') x
  WHERE NOT EXISTS (SELECT 1 FROM resolved y WHERE y.resolution = 'resolved' AND y.caller = x.caller AND y.target = x.anchor) GROUP BY anchor, caller""")
def syntax_callers(g: Facts) -> DataFrame:
    """Ambiguous callers of every method."""
    s = g.symbols().filter("kind = 'method'")
    r = related.syntax_callers(_resolved(g), resolve.callable_catalog(s), s)
    return r.select("anchor", "caller", "sites", _joined("lines").alias("lines"), "omitted")


@query(f"""SELECT caller, form, name, coalesce(qualifier, '') AS qualifier, resolution, count(*) AS sites, {_PLACES} FROM resolved
  WHERE resolution <> 'resolved' AND caller IN (SELECT id FROM symbols WHERE kind = 'test') GROUP BY ALL""")
def own_candidates(g: Facts) -> DataFrame:
    sites, words = _numbered_sites(g)
    r = related.own_candidates(sites, g.symbols().filter("kind = 'test'"), ["member", "said", "nth"], "place").join(words, ["said", "nth"])
    form = F.when(F.col("member"), "member").otherwise("scoped")
    return r.select("caller", form.alias("form"), "name", "qualifier", "resolution", "sites", _joined("lines").alias("lines"), "omitted")


@query("""SELECT path FROM symbols WHERE path IN ('part/1.rs', 'part/5.rs') UNION SELECT 'orders/' || (l_orderkey % 16) || '.rs' FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_name IN (SELECT name FROM symbols WHERE kind = 'method' AND path IN ('part/1.rs', 'part/5.rs') GROUP BY name HAVING count(*) <> count(*) FILTER (id % 32 <> 1))""")
def affected_paths(g: Facts) -> DataFrame:
    s = g.symbols()
    at = F.concat(F.lit("orders/"), F.pmod(F.col("caller") - F.lit(5 * (1 << 40)), F.lit(16)), F.lit(".rs"))
    paths = g.spark.createDataFrame([("part/1.rs",), ("part/5.rs",)], "path string")
    return related.affected(s, s.filter("NOT (kind = 'method' AND id % 32 = 1)"), g.call_sites().withColumn("path", at), paths)


@query("""SELECT seq, sum(candidates) OVER (ORDER BY seq)::BIGINT AS total FROM resolved""")
def running_candidates(g: Facts) -> DataFrame:
    # No column beside those that the total needs, so that its two sides read one shuffle.
    sites = _resolved(g).select("caller", "place", F.col("candidates").alias("_value"))
    return related.running_total(sites, "seq", F.col("_value"), g.places(), g.seq("caller", "place"), "caller" if g.ordered_by_caller() else None).select("seq", "total")


_COSTS = """, costs AS (SELECT seq, cost, sum(cost) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM (
  SELECT seq, CASE WHEN resolution <> 'resolved' THEN 0 WHEN caller IN (SELECT id FROM symbols WHERE kind = 'test') THEN 2 ELSE 1 END AS cost FROM resolved)
), refused AS (SELECT seq AS at, 999 - (total - cost) AS room FROM costs WHERE total > 999 ORDER BY seq LIMIT 1
), late AS (SELECT min(c.seq) AS seq FROM costs c, refused r WHERE r.room = 1 AND c.seq > r.at AND c.cost = 1)
"""


@query(_COSTS + "SELECT seq, cost FROM costs WHERE total <= 999 OR cost = 0 OR seq = (SELECT seq FROM late)")
def admitted_sites(g: Facts) -> DataFrame:
    s = g.symbols()
    r = related.admit_sites(_resolved(g), s.filter("kind = 'test'"), 1 << 40, 999, places=g.places())
    return r.filter("admitted").select("seq", "cost")


@query("""SELECT path, line, instr(body, 'the ') AS first_column, (length(body) - length(replace(body, 'the ', ''))) // 4 AS matches FROM ln WHERE contains(body, 'the ')""")
def regex_matches(g: Facts) -> DataFrame:
    m = search.match_all(g.files(), "t[h]e ", regex=True, case_sensitive=True)
    return m.groupBy("path", "line").agg(F.min("start_column").alias("first_column"), F.count("*").alias("matches"))


@query("""SELECT id, path, array_to_string(ls[a : least(b, a + 19)], chr(10))[1:4096] AS snippet, b - a + 1 > 20 OR length(array_to_string(ls[a : least(b, a + 19)], chr(10))) > 4096 AS truncated
  FROM (SELECT doc_id AS id, path, string_split(text, chr(10)) AS ls, doc_id % 3 + 1 AS a, doc_id % 3 + 1 + doc_id % 40 AS b FROM files) WHERE a <= len(ls)""")
def snippets(g: Facts) -> DataFrame:
    f, k = g.files(), F.col("doc_id")
    return search.snippets(f.select(k.alias("id"), "path", (k % 3 + 1).alias("start_line"), (k % 3 + 1 + k % 40).alias("end_line")), f)


@query("""SELECT request, CASE WHEN n = 1 THEN id END AS target FROM (SELECT request, n, id, row_number() OVER (PARTITION BY request ORDER BY i) AS k FROM (SELECT l_orderkey * 8 + l_linenumber AS request, unnest(range(2)) AS i,
    unnest(['none', p_name]) AS name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY ALL) JOIN part ON pk = p_partkey) JOIN (SELECT name, count(*) AS n, min(id) AS id FROM symbols WHERE kind = 'field' GROUP BY name) USING (name)) WHERE k = 1""")
def framework_endpoints(g: Facts) -> DataFrame:
    li = g.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"))
    li = li.join(g.table("part").select("p_partkey", "p_name"), F.col("pk") == F.col("p_partkey"))
    r = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request"), F.array(F.lit("none"), "p_name").alias("names"))
    return related.endpoint(r, g.symbols().filter("kind = 'field'").select(F.col("name").alias("qualified_name"), "id"))


@query("""SELECT seq, min(b) AS container FROM (SELECT s.seq, p.p_brand AS b FROM sites s JOIN part q ON s.qualifier = q.p_brand AND s.name = q.p_name JOIN part p ON p.p_name = s.name AND p.p_size % 5 = s.line % 5) GROUP BY seq HAVING count(DISTINCT b) = 1""")
def extension_containers(g: Facts) -> DataFrame:
    p = g.table("part")
    sites = g.call_sites().filter("qualifier IS NOT NULL").select("seq", "name", F.array((F.col("line") % 5).cast("string")).alias("namespaces"))
    return related.extension_containers(sites, p.select((F.col("p_size") % 5).cast("string").alias("namespace"), F.col("p_name").alias("name"), F.col("p_brand").alias("container")))


_NAMES = ["a_test.go", "zz_generated.x.go", "Foo.pb.go", "t.spec.ts", "test_a.py", "b_test.py", "ATest.java", "Tester.java", "obj/a.cs", "ATests.cs", "q_unittest.cc", "m.pb.h", "x.tftest.hcl", ".terraform/m.tf", "main.rs", "__tests__/a.js"]
_ROLES = ["test", "generated", "generated", "test", "test", "test", "test", "test", "generated", "test", "test", "generated", "test", "vendor", "production", "test"]


@query(f"""SELECT doc_id, path, CASE WHEN doc_id % 3 = 1 AND doc_id % 16 NOT IN (0, 1, 2, 8, 13) THEN 'example' ELSE {_ROLES}[doc_id % 16 + 1] END AS role FROM (SELECT doc_id, package || ['/src/', '/Examples/', '/lib/'][doc_id % 3 + 1] || {_NAMES}[doc_id % 16 + 1] AS path FROM files)""")
def language_roles(g: Facts) -> DataFrame:
    at = lambda xs, n: F.element_at(F.lit(xs), (F.col("doc_id") % n + 1).cast("int"))
    f = g.files().select("doc_id", F.concat("package", at(["/src/", "/Examples/", "/lib/"], 3), at(_NAMES, 16)).alias("path"))
    return f.select("doc_id", "path", search.language_role(F.col("path"), search.path_language(F.col("path"))).alias("role"))


_ODD = ["a/b", "", "/a", "~/a", "a/", "a/./b", "../a", "a..b/c", "a/.git", "."]


@query("""SELECT doc_id, doc_id % 10 IN (0, 7, 8) AS valid FROM files""")
def valid_paths(g: Facts) -> DataFrame:
    return g.files().select("doc_id", search.valid_path(F.element_at(F.lit(_ODD), (F.col("doc_id") % 10 + 1).cast("int"))).alias("valid"))


_MANIFESTS = ["a/Cargo.toml", "composer.json", "x/package.json", "y.csproj", "go.mod", "mygo.mod", "a/.cargo/config", "config", "k/BUILD"]


@query("""SELECT doc_id, ['rust', 'php', 'typescript,javascript', 'csharp', 'go', '', 'rust', '', 'cpp'][doc_id % 9 + 1] AS languages FROM files""")
def metadata_inputs(g: Facts) -> DataFrame:
    from graphloom.sources import worktree

    p = F.element_at(F.lit(_MANIFESTS), (F.col("doc_id") % 9 + 1).cast("int"))
    return g.files().select("doc_id", F.coalesce(F.array_join(worktree.metadata_languages(p), ","), F.lit("")).alias("languages"))


@query("""SELECT user_id, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst""")
def change_bursts(g: Facts) -> DataFrame:
    e = g.table("events").groupBy("user_id", F.session_window("ts", "30 minutes"))
    return e.agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).drop("session_window")
