"""The corpus pipeline: five stages, each written as Parquet in the shared folder and read by the next.

run(spark, sf_dir) applies STAGES to documents. A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, language, lines, mixing, ngrams, packing

#: A document's least mean probability of its language.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language the model is sure of go: null and empty texts, texts without a letter, and those whose
    best language has a mean word probability below LEAST_SCORE. Without any labelled row all documents go. Repeated rows
    are decided alike; an empty table stays empty."""
    model = language.fit(docs.select("doc_id", "text", "lang"), ~language.held_out(5, 0))
    sure = language.predict(docs, model, F.struct(*docs.columns)).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return sure.select("extra.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of windows that occur earlier in the corpus go; each document stays, with its new text and length (both null
    where the text is). Repeated rows stay and have one result; an empty table stays empty."""
    d = lines.dedup_lines(docs).select("doc.*", "clean")
    return d.withColumns({"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join stays, that of least doc_id (null last). Texts without words
    (null too) are copies of nothing and all stay; of rows equal in doc_id and text one stays; rows of one doc_id with
    different texts are told apart; an empty table stays empty."""
    return ngrams.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null sources are one source; texts without words are taken as often as
    their rate says; repeated rows are taken alike; an empty table stays empty."""
    m = mixing.mix(docs).filter("copies > 0")
    return m.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; see graphloom.llm.packing for nulls, empty texts and repeated rows."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("packing", pack)]

#: SQL can't express the trained model, Newton steps and packing: tests/llm/test_pipeline.py holds each stage against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
