"""Source files to graph tables: parsed once, stored, and derived from there.

tables() gives what a revision consists of; publish() writes it through a Store, so that questions read Parquet and parse
nothing. Relations carry the path that states them (owner; null for edges of call sites).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import delta, quality, related, resolve, search
from graphloom.schema import FALLBACK
from graphloom.sources import framework, lexical, manifests, python_code
from graphloom.sources.store import Store, ensure_checkpoint_dir

TYPES = ["class", "struct", "interface", "trait", "enum"]
_EDGE = ["kind", "src", "dst", "seq", "line", "provenance", "precision", "owner"]


def _language(df: DataFrame) -> DataFrame:
    return df.withColumn("language", search.path_language(F.col("path")))


def _relation(df: DataFrame, kind: str | F.Column, seq: F.Column, line: F.Column | None = None, owner: str = "path") -> DataFrame:
    heuristic = F.lit("heuristic")
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "src", "dst", seq.cast("string").alias("seq"), (F.lit(None) if line is None else line).cast("long").alias("line"), heuristic.alias("provenance"), heuristic.alias("precision"), F.col(owner).alias("owner"))


def containment(symbols: DataFrame) -> DataFrame:
    """CONTAINS edges: from the only symbol of the same file with the name before the last `::`, else from the only module
    of that name in the language."""
    outer = F.regexp_replace("qualified_name", "::(?:(?!::).)*$", "")
    inner = symbols.withColumn("outer", outer).filter("outer <> qualified_name")
    one = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias(name)).filter("n = 1").drop("n")
    here = one(symbols.withColumn("outer", F.col("qualified_name")), ["path", "outer"], "near")
    module = one(symbols.filter("kind = 'module'").withColumn("outer", F.col("qualified_name")), ["language", "outer"], "far")
    e = inner.join(here, ["path", "outer"], "left").join(module, ["language", "outer"], "left").withColumn("src", F.coalesce("near", "far")).filter("src IS NOT NULL AND src <> id")
    return _relation(e.withColumn("dst", F.col("id")), "CONTAINS", F.concat(F.lit("/"), "id"), F.col("start_line"))


def heritage(named: DataFrame, symbols: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges of types that name what they build on (request, relation, at, names): the first name
    that one type alone has. A C# class that extends an interface implements it; a Rust impl block stands for its type,
    and its methods implement those of the trait with their names."""
    types = symbols.filter(F.col("kind").isin(TYPES))
    keyed = named.withColumn("key", F.concat_ws("|", "request", "relation", F.col("at").cast("string")))
    found = delta.first_unique(keyed.select(F.col("key").alias("request"), "names"), types).withColumnRenamed("request", "key")
    kinds = types.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("qualified_name").alias("target_name"))
    owner = symbols.select(F.col("id").alias("request"), "path", "language", F.col("kind").alias("own_kind"), F.col("qualified_name").alias("own_name"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    r = keyed.join(found, "key").join(kinds, "target").join(owner, "request")
    flips = (F.col("language") == "csharp") & (F.col("relation") == "extends") & F.col("own_kind").isin("class", "struct") & (F.col("target_kind") == "interface")
    kind = F.when(flips, "IMPLEMENTS").otherwise(F.upper("relation"))
    seq = F.concat(F.lit("/"), "key")
    plain = _relation(r.filter("own_kind <> 'impl_block'").withColumns({"src": F.col("request"), "dst": F.col("target")}), kind, seq)
    one = types.groupBy("qualified_name").agg(F.count("*").alias("n"), F.min("id").alias("src")).filter("n = 1").select(F.col("qualified_name").alias("own_name"), "src")
    impl = r.filter("own_kind = 'impl_block'")
    by_type = _relation(impl.join(one, "own_name").withColumn("dst", F.col("target")), "IMPLEMENTS", seq)
    m = symbols.filter("kind = 'method'").select(F.col("id").alias("src"), "path", "name", F.regexp_replace("qualified_name", "::(?:(?!::).)*$", "").alias("own_name"), F.col("start_line").alias("line"))
    m = impl.select("path", "own_name", "target_name", "key", "a", "b").join(m, ["path", "own_name"]).filter("a <= line AND line <= b")
    traits = symbols.filter("kind IN ('method', 'function')").groupBy("qualified_name").agg(F.count("*").alias("n"), F.min("id").alias("dst")).filter("n = 1")
    m = m.withColumn("qualified_name", F.concat_ws("::", "target_name", "name")).join(traits.drop("n"), "qualified_name").filter("src <> dst")
    return plain.unionByName(by_type).unionByName(_relation(m, "IMPLEMENTS", F.concat(F.lit("/"), "key", F.lit("/"), "src"), F.col("line")))


def framework_edges(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that the framework's statements give, and the configuration symbols that statements outside of functions begin at."""
    r = framework.relations(framework.parse(files.filter("language = 'php'")))
    php = symbols.filter("language = 'php'")
    ends = lambda names: related.endpoint(r.select("request", F.col(names).alias("names")), php)
    to = ends("to_names").filter("target IS NOT NULL").withColumnRenamed("target", "dst")
    named = ends("from_names").filter("target IS NOT NULL").withColumnRenamed("target", "named")
    r = r.join(to, "request").join(named, "request", "left").withColumn("own", F.when(F.col("synthetic").isNotNull(), F.regexp_replace("request", "#(.)", "#9")))
    r = r.withColumn("src", F.coalesce("named", "own")).filter("src IS NOT NULL")
    edges = _relation(r, F.col("kind"), F.concat(F.lit("/"), "request"), F.col("line"))
    place = [F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), F.col("col").alias("end_col")]
    made = r.filter("own IS NOT NULL").select(F.col("own").alias("id"), "path", F.element_at(F.split("synthetic", "::"), -1).alias("name"), F.col("synthetic").alias("qualified_name"), F.lit("Laravel").alias("container"), F.lit("configuration").alias("kind"), F.lit(None).cast("string").alias("signature"), *place)
    return edges, made


def tables(files: DataFrame, manifest_files: DataFrame | None = None, uses_framework: bool | None = None) -> dict[str, DataFrame]:
    """files, symbols, edges, sites and diagnostics of source files (path, language, role, text).

    manifest_files: path, text; they give projects and say whether the framework's statements count, unless
    uses_framework does. Parsed files are stored in the shared folder, as everything else comes from them.
    """
    spark = files.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/parsed-{uuid.uuid4().hex}"
    parsed = lexical.parse(files)
    parsed.write.parquet(at)
    parsed = spark.read.schema(parsed.schema).parquet(at)
    if uses_framework is None:
        asks = manifest_files.filter(F.regexp_like("path", F.lit(r"(^|/)composer\.json$"))).filter(framework.uses_framework(F.col("text"))) if manifest_files is not None else None
        uses_framework = asks is not None and not asks.isEmpty()
    tree = {"provenance": F.lit("tree_sitter"), "precision": F.lit("syntax")}
    symbols = _language(python_code.symbols(parsed)).withColumns(tree)
    extra = None
    if uses_framework:
        extra, made = framework_edges(files, symbols)
        symbols = symbols.unionByName(_language(made).withColumns({**tree, "precision": F.lit("heuristic")}))
    sites = resolve.resolve(_language(python_code.call_sites(parsed)), resolve.callable_catalog(symbols)).withColumn("provenance", F.lit("tree_sitter"))
    strict = F.col("receiver_type_source").isin(resolve.STRICT) & (F.col("resolution") == "resolved")
    sites = sites.withColumns({"precision": F.when(strict, "precise").otherwise("syntax"), "provenance": F.when(strict, "resolver").otherwise(F.col("provenance"))})
    calls = quality.expected_edges(sites, symbols).withColumn("owner", F.lit(None).cast("string"))
    edges = containment(symbols).unionByName(heritage(lexical.relations(parsed), symbols)).unionByName(calls.select(*_EDGE))
    edges = edges if extra is None else edges.unionByName(extra)
    if manifest_files is not None:
        known = manifests.classify(files.select("path", "language"), manifests.roots(manifest_files, files.select("path"))).drop("language")
    else:
        known = files.select("path", "role", F.lit(FALLBACK).alias("classification"), (F.col("package") if "package" in files.columns else F.lit(None).cast("string")).alias("package_name"), F.lit(None).cast("string").alias("package_root"))
    found = parsed.select("path", F.col("diagnostics").cast("long").alias("diagnostic_count"))
    diagnostics = _language(lexical.diagnostics(parsed)).withColumns(tree)
    files = files.select("path", "language", "text").join(known, "path").join(found, "path")
    return {"files": files, "symbols": symbols, "edges": edges, "sites": sites, "diagnostics": diagnostics}


def number(symbols: DataFrame) -> DataFrame:
    """Adds local_id: a symbol's place in its language, by path and then by declaration."""
    return symbols.withColumn("local_id", F.row_number().over(Window.partitionBy("language").orderBy("path", "id")) - 1)


def publish(store: Store, files: DataFrame, manifest_files: DataFrame | None = None, uses_framework: bool | None = None) -> int:
    """Writes the tables of source files as the next revision of the store, and returns its number."""
    return store.publish(tables(files, manifest_files, uses_framework), store.current())
