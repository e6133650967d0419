"""Differences of snapshots, set relations, containment, inheritance, admission folds and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revision_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, deleted, modified) between two tables of path and text."""
    side = lambda df, n: df.select("path", F.sha2("text", 256).alias(n))
    j = side(old, "old").join(side(new, "new"), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return j.select("path", kind.alias("change")).filter("change IS NOT NULL")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with how many more."""
    cols = a.columns
    both = a.withColumn("d", F.lit(1)).unionByName(b.withColumn("d", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("d").alias("surplus")).filter("surplus <> 0")


def innermost(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Containment join: the smallest symbol of the same path and name around a place (start <= place < end), by lines,
    then by the distance of its columns, then by id. Columns count where both tables have them (col; start_col, end_col)."""
    cols = {"start_col", "end_col"} <= set(symbols.columns) and "col" in points.columns
    ends = ["start_col", "end_col"] if cols else []
    width = [F.abs(F.col("end_col") - F.col("start_col"))] if cols else []
    within = "(start_line, start_col) <= (line, col) AND (line, col) < (end_line, end_col)" if cols else "start_line <= line AND line < end_line"
    place = ["path", "name", "line", *(["col"] if cols else [])]
    best = F.min(F.struct(F.col("end_line") - F.col("start_line"), *width, F.col("id"))).alias("m")
    if not cols:
        j = points.join(symbols.select("path", "name", "id", "start_line", "end_line"), ["path", "name"]).filter(within)
        return j.groupBy("point", *place).agg(best).select("point", *place, F.col("m.id").alias("id"))
    # Points of one place and symbols of one span meet once, not each with each; of one span the least id is taken anyway.
    spans = symbols.groupBy("path", "name", "start_line", "end_line", *ends).agg(F.min("id").alias("id"))
    at = points.select(*place).distinct().join(spans, ["path", "name"]).filter(within).groupBy(*place).agg(best).select(*place, F.col("m.id").alias("id"))
    return points.select("point", *place).distinct().join(at, place).select("point", *place, "id")


def prefer_precise(precise: DataFrame, syntax: DataFrame) -> DataFrame:
    """Precise rows win by id; the other syntax rows follow."""
    rest = syntax.join(precise.select("id").distinct(), "id", "left_anti")
    return precise.unionByName(rest)


def first_unique(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Named relations: the first candidate name (by position) that exactly one symbol has; others are passed over.

    Where requests say which kinds a target may have (kinds, in order of preference), a name is looked up in each kind by
    itself, so that a class and a function of one name don't stand in each other's way.
    """
    cand = requests.select("request", F.posexplode("names").alias("position", "qualified_name"), *(["kinds"] if "kinds" in requests.columns else []))
    if "kinds" not in requests.columns:
        unique = targets.groupBy("qualified_name").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
        return cand.join(unique, "qualified_name").groupBy("request").agg(F.min_by("id", "position").alias("target"))
    cand = cand.select("request", "position", "qualified_name", F.posexplode("kinds").alias("preference", "kind"))
    unique = targets.groupBy("qualified_name", "kind").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return cand.join(unique, ["qualified_name", "kind"]).groupBy("request").agg(F.min_by("id", F.struct("position", "preference")).alias("target"))


def _contexts(edges: DataFrame) -> DataFrame:
    """type, parent, tier, at, to: edges between types as looked up along a path; at and to are a type and, in order of
    name, the types of its cycle that the path has passed. A type outside cycles has itself alone. No edge leads back."""
    reach = edges.select("type", F.col("parent").alias("over")).distinct()
    size = -1
    while (now := reach.count()) != size:
        size = now
        further = reach.join(reach.select(F.col("type").alias("over"), F.col("over").alias("next")), "over").select("type", F.col("next").alias("over"))
        reach = reach.unionByName(further).distinct().checkpoint()
    round_ = reach.select(F.col("type").alias("parent"), F.col("over").alias("type")).withColumn("cyclic", F.lit(True))
    edges = edges.join(round_, ["type", "parent"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).checkpoint()
    fresh = seen = edges.select("type").unionByName(edges.select(F.col("parent").alias("type"))).distinct().withColumn("path", F.array("type"))
    back = edges.filter("cyclic").select("type", "parent").distinct()
    while not fresh.isEmpty():
        fresh = fresh.join(back, "type").filter(~F.array_contains("path", F.col("parent"))).select(F.col("parent").alias("type"), F.array_sort(F.concat("path", F.array("parent"))).alias("path"))
        fresh = fresh.distinct().join(seen, ["type", "path"], "left_anti").checkpoint()
        seen = seen.unionByName(fresh)
    out = seen.join(edges, "type").filter(~(F.col("cyclic") & F.array_contains("path", F.col("parent"))))
    path = F.when(F.col("cyclic"), F.array_sort(F.concat("path", F.array("parent")))).otherwise(F.array("parent"))
    return out.select("type", "parent", "tier", F.struct("type", "path").alias("at"), F.struct(F.col("parent").alias("type"), path.alias("path")).alias("to"))


def inherited(types: DataFrame, methods: DataFrame) -> DataFrame:
    """type, method, owner, state: own methods, else the parents' through traits, then classes, then interfaces.

    One owner is `unique`, several are `ambiguous`, and ambiguity sticks. Each round settles types one level further,
    and rounds end when no row changes. A type on the path of the lookup has nothing, as in the reference.
    """
    tier = F.when(F.col("relation") == "trait", 0).when(F.col("relation") == "extends", 1).otherwise(2)
    edges = _contexts(types.select("type", F.col("parent"), tier.alias("tier")).distinct()).checkpoint()
    have = methods.select("type", "method").distinct()
    places = edges.select("at").unionByName(edges.select(F.col("to").alias("at"))).unionByName(methods.select(F.struct("type", F.array("type").alias("path")).alias("at"))).distinct()
    own = places.join(have, F.col("at.type") == F.col("type")).select("at", "method", F.col("type").alias("owner"), F.lit("unique").alias("state")).checkpoint()
    known = own
    while True:
        up = known.withColumnRenamed("at", "to").join(edges, "to")
        up = up.groupBy("at", "method", "tier").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("owner"), F.max(F.when(F.col("state") == "ambiguous", 1).otherwise(0)).alias("stuck"))
        up = up.groupBy("at", "method").agg(F.min_by(F.struct("owners", "owner", "stuck"), "tier").alias("v"))
        up = up.select("at", "method", "v.owner", F.when((F.col("v.owners") > 1) | (F.col("v.stuck") == 1), "ambiguous").otherwise("unique").alias("state"))
        after = own.unionByName(up.join(own, ["at", "method"], "left_anti")).checkpoint()
        if after.exceptAll(known).isEmpty() and known.exceptAll(after).isEmpty():
            break
        known = after
    return known.filter(F.col("at.path") == F.array("at.type")).select("at.type", "method", "owner", "state")


def admit(sizes: list[tuple[str, int]], max_files: int, max_file: int, max_total: int) -> list[str]:
    """Greedy admission in path order: too large or too many is passed over, and later, smaller files may still enter."""
    out, total = [], 0
    for path, size in sorted(sizes):
        if len(out) < max_files and size <= max_file and total + size <= max_total:
            out.append(path)
            total += size
    return out


def split_budget(limit: int, counts: dict[str, int]) -> dict[str, int]:
    """A limit shared in proportion to counts, in their order, without loss."""
    left, total, out = limit, sum(counts.values()), {}
    for k, n in counts.items():
        out[k] = left * n // total if total else 0
        left, total = left - out[k], total - n
    return out


def fingerprint(rows: DataFrame) -> DataFrame:
    """fingerprint, rows: the sum of 32 bits of each row's md5, in any order of rows. Columns hold no nulls and no '|'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *rows.columns)), 1, 8), 16, 10).cast("long")
    return rows.agg(F.coalesce(F.sum(bits), F.lit(0)).alias("fingerprint"), F.count("*").alias("rows"))


def gaps(events: DataFrame) -> DataFrame:
    """Per source: where the event number is not the last one plus one (each source has its own order)."""
    w = Window.partitionBy("source").orderBy("epoch")
    return events.withColumn("previous", F.lag("epoch").over(w)).filter("previous IS NOT NULL AND epoch <> previous + 1")


def counts(tables: dict[str, DataFrame], sites: DataFrame) -> DataFrame:
    """One row: the number of rows of each table, and of call sites, all and by resolution."""
    names = ["call_sites", "resolved", "ambiguous", "unresolved"]
    rows = sites.groupBy(F.col("resolution").alias("name")).agg(F.count("*").alias("n"))
    rows = rows.unionByName(rows.select(F.lit("call_sites").alias("name"), "n"))
    for name, df in tables.items():
        rows = rows.unionByName(df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)))
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("name") == x, F.col("n"))), F.lit(0)).alias(x) for x in [*tables, *names]])
