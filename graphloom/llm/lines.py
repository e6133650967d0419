"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Lines are split at \\n and compared without white space at their ends. Every window of three consecutive lines is
hashed (128 bits); where a window occurs more than once in the corpus, the first occurrence (least doc_id, then text
hash, then line) stays and the lines that any later occurrence covers are removed. Windows of blank lines only don't count.

Cases: null text stays null; texts of fewer than three lines are unchanged; repeated rows (same doc_id and text) are
one document, and each gets that document's result; a null doc_id comes first; an empty table gives an empty table;
columns other than doc_id and text are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

WINDOW = 3


def _lines(text):
    return F.split(text, "\n", -1)


def later_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, starts: first lines (from 0) of the windows that occur earlier in the corpus."""
    lines = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(_lines(F.col("text")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))).alias("lines"))
    lines = lines.filter(F.size("lines") >= window)
    pieces = F.transform(F.sequence(F.lit(0), F.size("lines") - window), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("lines", i + 1, window), "\n").alias("body")))
    rows = lines.select("doc_id", "text_hash", F.explode(pieces).alias("w")).filter(F.length(F.trim(F.translate("w.body", "\n", ""))) > 0)
    rows = rows.select("doc_id", "text_hash", F.col("w.at").alias("at"), F.xxhash64("w.body").alias("h1"), F.xxhash64(F.lit("second half"), "w.body").alias("h2"))
    rows = common.materialise(rows, "line-windows")
    place = F.struct("doc_id", "text_hash", "at")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h1", "h2", "first")
    later = rows.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the struct `doc` of all its columns, `clean` (the text that stays), n_lines and n_removed."""
    later = later_windows(docs.select("doc_id", "text"), window).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "starts")
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = rows.join(later, F.col("doc.doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("doc.text") == F.col("_h")), "left")
    lines = _lines(F.col("doc.text"))
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    rows = rows.select("doc", lines.alias("lines"), F.when(F.col("starts").isNotNull(), stay).alias("stay"))
    clean = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    return rows.select("doc", F.coalesce(clean, F.col("doc.text")).alias("clean"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("stay"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc.doc_id", F.col("clean").alias("text"), "n_lines", "n_removed")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
         list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS norm
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, text, i, norm[i] || chr(10) || norm[i + 1] || chr(10) || norm[i + 2] AS body
  FROM (SELECT doc_id, text, norm, unnest(range(1, len(norm) - 1)) AS i FROM l WHERE len(norm) >= 3)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM w WHERE length(replace(body, chr(10), '')) > 0
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM f WHERE k > 1
), each AS (
  SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) AS n_lines, count(g.i) AS n_removed
  FROM each e LEFT JOIN gone g USING (doc_id, i) GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
