"""Name resolution and what follows from it: catalog, call and test edges, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import TARGET_KIND

KEY = ["target_kind", "name", "qualifier"]
#: What a receiver's type is known from, where a unique candidate makes a call precise. Fixed values.
STRICT = ["parameter", "property", "promoted_property", "local_new", "service_locator", "scoped_type"]


def keys_of(sites: DataFrame, catalog: DataFrame) -> list[str]:
    """The lookup key; calls never cross languages where both sides state them."""
    return (["language"] if "language" in sites.columns and "language" in catalog.columns else []) + KEY


def same_key(df: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    """df with columns to join by: those of the key, and `_q` for a qualifier, which null has one value of, too."""
    return df.withColumn("_q", F.coalesce("qualifier", F.lit("\u0000"))), [*(k for k in key if k != "qualifier"), "_q"]


def callable_catalog(symbols: DataFrame) -> DataFrame:
    """Each callable symbol under up to four qualifiers: none, container, its full prefix, the prefix's last segment."""
    parts = F.split("qualified_name", "::")
    prefix = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::")
    prefix = F.when(F.size(parts) > 1, prefix)
    last = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    quals = F.array_distinct(F.array(F.lit(None).cast("string"), "container", prefix, last))
    kinds = symbols.filter(F.col("kind").isin(list(TARGET_KIND)))
    domain = F.create_map(*[F.lit(x) for pair in TARGET_KIND.items() for x in pair])[F.col("kind")]
    language = ["language"] if "language" in symbols.columns else []
    return kinds.select(*language, domain.alias("target_kind"), "name", F.explode(quals).alias("qualifier"), "id")


def resolve(sites: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds resolution, target, candidates: one match resolves, several are ambiguous, none or no qualifier is unresolved.

    The catalog is aggregated before the join, so an ambiguous key adds one row and not one for each candidate.
    """
    key = keys_of(sites, catalog)
    keys = catalog.groupBy(*key).agg(F.count("*").alias("candidates"), F.min("id").alias("target"))
    keys = keys.select(*[F.col(k).alias(f"k_{k}") for k in key], "candidates", F.col("target").alias("only"))
    lookup = (F.col("form") == "function") | F.col("qualifier").isNotNull()
    on = (F.col("target_kind") == F.col("k_target_kind")) & (F.col("name") == F.col("k_name")) & F.col("qualifier").eqNullSafe(F.col("k_qualifier")) & lookup
    if "language" in key:
        on = on & (F.col("language") == F.col("k_language"))
    out = sites.join(keys, on, "left").drop(*[f"k_{k}" for k in key])
    kind = F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved")
    return out.withColumns({"resolution": kind, "target": F.when(kind == "resolved", F.col("only")), "candidates": F.coalesce("candidates", F.lit(0)).cast("long")}).drop("only")


def relations(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of edges: occurrence_count, the first three lines by seq, and how many are left out.

    Only the first three rows of a group are gathered, so a hot group costs three rows a task.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    head = edges.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]).alias("lines"))
    count = edges.groupBy(*keys).agg(F.count("*").alias("occurrence_count"))
    out = count.join(head, keys)
    return out.select(*keys, "occurrence_count", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("first_lines"), F.greatest(F.lit(0), F.col("occurrence_count") - 3).alias("omitted"))


def fan_out(sites: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """Ambiguous sites with up to limit + 1 candidates each, by id."""
    cat = catalog.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))).filter(F.col("rn") <= limit + 1)
    amb, on = same_key(sites.filter("resolution = 'ambiguous'").drop("candidates", "target"), KEY)
    cat = same_key(cat, KEY)[0].select(*on, "id", "rn")
    return amb.join(cat, on).select("seq", "id", F.col("rn").cast("long").alias("position"))


def test_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """TESTS edges: the first resolved site of each (test, target), with the number of sites behind it."""
    tests = symbols.filter("kind = 'test'").select(F.col("id").alias("caller"))
    return resolved.filter("resolution = 'resolved'").join(tests, "caller", "left_semi").groupBy("caller", "target").agg(F.min("seq").alias("seq"), F.min_by("line", "seq").alias("line"), F.count("*").alias("evidence"))


def call_groups(sites: DataFrame, words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sites by keys and what they say, with how many they are and the first by order.

    sites: keys, order, said and nth. words: said, nth, and what these stand for. So sites are shuffled by numbers alone.
    """
    groups = sites.groupBy(*keys, "said", "nth").agg(F.count("*").alias("sites"), F.min(order).alias("first"))
    return groups.join(words, ["said", "nth"])
