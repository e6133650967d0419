"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document's size is its number of words. Among all document rates r, those nearest to 1 (least relative entropy) that
give each source its target of words have the form r = exp(lambda * size / mean size), with one lambda a source; rates
stop at MOST. Lambda solves the convex dual of that problem. Newton steps, kept inside a bracket, find all sources'
lambdas together: each step is one aggregation over the table of (source, size, number of documents), and the lambdas
stay a table. Rates become copies: the whole part, and one more where a hash of the document lies below a threshold, which
three rounds of histograms move so that the source's words come next to its target. Reruns agree.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at MOST times its
source's words, and the excess goes to the others by weight.

Cases: null text has size 0; null sources are one source; rows of size 0 are taken as often as their rate says, which adds
no words; repeated rows are decided alike; an empty table gives an empty table. The weights need the sources in one order:
a window over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common

MOST, STEPS, CLOSE, BINS = 3, 60, 1e-9, 1024
_SOURCE = ["null_source", "source"]


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """null_source, source (not null), and the words and hash of each document beside its columns `keep` in `doc`."""
    return docs.select(
        F.struct(*keep).alias("doc"),
        F.col("source").isNull().alias("null_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        size(F.col("text")).alias("size"),
        (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)).alias("u"),
    )


def targets(hist: DataFrame, most: int = MOST) -> DataFrame:
    """null_source, source, source_size, mean_size, least_size, target, from null_source, source, size, n."""
    s = hist.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    s = s.withColumn("w", (F.row_number().over(Window.orderBy(*_SOURCE)) - 1) % 3 + 1).withColumn("top", most * F.col("source_size"))
    before = Window.orderBy(F.col("top") / F.col("w"), *_SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sources by room for each weight: those before the first that takes its share in full are at their top.
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("top").over(before), F.lit(0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct(F.col("top") / F.col("w"), F.col("level").alias("v")))).over(all_)["v"])
    return s.select(*_SOURCE, "source_size", (F.col("source_size") / F.col("filled")).alias("mean_size"), "least_size", F.least(F.col("top").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _rate(most: int) -> Column:
    return F.when(F.col("lambda") == float("inf"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lambda") * F.col("size") / F.col("mean_size"))))


def balance(hist: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """Adds each source's lambda to goals; hist has null_source, source, size, n."""
    least = F.col("least_size") / F.col("mean_size")
    rho = F.col("target") / F.col("source_size")
    down = rho < 1
    state = goals.withColumns({
        "lo": F.when(down, F.log(rho) / least).otherwise(0.0),
        "hi": F.when(down, 0.0).otherwise(F.log(F.lit(float(most))) / least),
        "lambda": F.when(F.coalesce(F.col("source_size"), F.lit(0)) == 0, 0.0).when(rho >= most * (1 - 1e-12), float("inf")).when(down, 0.0).otherwise(F.log(rho) / 2),
    }).withColumn("open", (F.col("lambda") != float("inf")) & (F.col("source_size") > 0) & (F.abs(rho - 1) > CLOSE))
    state = common.materialise(state.withColumn("lambda", F.when(F.col("open") | (F.col("lambda") == float("inf")), F.col("lambda")).otherwise(0.0)), "lambda")
    filled = hist.filter("size > 0")
    for _ in range(STEPS):
        if state.filter("open").isEmpty():
            break
        r, words = _rate(most), F.col("n") * F.col("size")
        sums = filled.join(state.filter("open").select(*_SOURCE, "lambda", "mean_size"), _SOURCE)
        sums = sums.groupBy(*_SOURCE).agg(F.sum(words * r).alias("f"), F.sum(F.when(r < most, words * r * F.col("size") / F.col("mean_size")).otherwise(0.0)).alias("df"))
        s = state.join(sums, _SOURCE, "left")
        off = F.col("f") - F.col("target")
        s = s.withColumns({"lo": F.when(off < 0, F.col("lambda")).otherwise(F.col("lo")), "hi": F.when(off > 0, F.col("lambda")).otherwise(F.col("hi"))})
        step = F.col("lambda") - off / F.col("df")
        s = s.withColumn("next", F.when((F.col("df") > 0) & (step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2))
        go = F.col("open") & (F.abs(off) > CLOSE * F.col("target")) & (F.col("hi") - F.col("lo") > 1e-13)
        s = s.withColumn("go", F.coalesce(go, F.lit(False))).withColumn("lambda", F.when(F.col("go"), F.col("next")).otherwise(F.col("lambda")))
        state = common.materialise(s.withColumn("open", F.col("go")).select(*state.columns), "lambda", state)
    return state.drop("lo", "hi", "open")


def thresholds(rows: DataFrame, state: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `below` to state: a document gets one copy more than the whole part of its rate if its v is below it.

    rows: null_source, source, size, u. v = u + 1 - the fraction of the rate, so that `below` is near 1.
    """
    v = _decided(rows, state, most).filter("size > 0").select(*_SOURCE, "size", "whole", "v")
    fixed = v.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("whole")).alias("got"))
    cut = state.join(fixed, _SOURCE, "left").withColumns({"got": F.coalesce("got", F.lit(0)).cast("double"), "at": F.lit(0.0), "width": F.lit(2.0)})
    last = None
    for _ in range(3):
        cut = last = common.materialise(cut, "thresholds", last)
        bins = v.filter(F.col("whole") < most).join(cut.select(*_SOURCE, "at", "width"), _SOURCE).filter((F.col("v") >= F.col("at")) & (F.col("v") < F.col("at") + F.col("width")))
        bins = bins.groupBy(*_SOURCE, F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("at")) / F.col("width") * BINS)).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy(*_SOURCE).orderBy("bin")
        bins = bins.join(cut.select(*_SOURCE, "got", "target"), _SOURCE).withColumn("sum", F.col("got") + F.sum("words").over(run))
        # The first bin that reaches the target; none if all bins together stay below it.
        hit = bins.filter("sum >= target").groupBy(*_SOURCE).agg(F.min("bin").alias("bin"), F.min_by(F.col("sum") - F.col("words"), "bin").alias("base"), F.min_by("sum", "bin").alias("after"))
        cut = cut.join(hit, _SOURCE, "left").withColumns({
            "at": F.when(F.col("bin").isNull(), F.col("at") + F.col("width")).otherwise(F.col("at") + F.col("bin") * F.col("width") / BINS),
            "width": F.when(F.col("bin").isNull(), 0.0).otherwise(F.col("width") / BINS),
            "got": F.coalesce("base", "got"),
            "closer": F.coalesce(F.col("after") - F.col("target") < F.col("target") - F.col("base"), F.lit(False)),
        }).select(*state.columns, "got", "at", "width", "closer")
    return common.materialise(cut.select(*state.columns, F.when(F.col("closer"), F.col("at") + F.col("width")).otherwise(F.col("at")).alias("below")), "thresholds", last)


def _decided(rows: DataFrame, state: DataFrame, most: int) -> DataFrame:
    r = rows.join(state, _SOURCE).withColumn("rate", _rate(most)).withColumn("whole", F.floor("rate"))
    return r.withColumn("v", F.col("u") + 1 - (F.col("rate") - F.col("whole")))


def mix(docs: DataFrame, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """Each document (its columns `keep` in the struct `doc`; all by default) with size, source_size, target, rate, copies.

    Columns without the text are stored beside the sizes, so that texts are read once; with it, once more at the end.
    """
    keep = docs.columns if keep is None else keep
    keyed, slim = _keyed(docs, keep), "text" not in keep
    rows = common.materialise(keyed if slim else keyed.drop("doc"), "sizes")
    hist = common.materialise(rows.groupBy(*_SOURCE, "size").agg(F.count("*").alias("n")), "size-histogram")
    state = thresholds(rows, balance(hist, targets(hist, most), most), most)
    out = _decided(rows if slim else keyed, state, most)
    extra = ((F.col("whole") < most) & (F.col("v") < F.col("below"))).cast("long")
    return out.select("doc", "size", "source_size", "target", "rate", (F.col("whole") + extra).alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(common.documents(spark, sf_dir), keep=["doc_id"])
    return m.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
