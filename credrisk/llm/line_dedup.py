"""Line dedup (native): drop lines that many documents repeat, keep one copy.

Plan: explode the normalised lines to (document, position, 128-bit hash of the
key); the hashes are written once (28 bytes a line instead of the line); count
distinct documents per hash with Spark's two-level distinct aggregation, so a
line held by a third of all documents is combined map-side; write the hashes over
the threshold, so that both sides of the next join are plain exchanges and AQE
splits a hot hash; join them back; gather the dropped positions per
document and reassemble the text by position.  The texts are shuffled once, and cut into
lines again behind that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, hash_pair, materialise


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop every line whose key has ``min_chars`` code points or more and occurs
    in ``min_docs`` distinct documents or more, except in the largest id holding it.

    Returns ``doc`` (a struct of all input columns, so that no name can clash),
    ``n_lines``, ``n_dropped`` and ``kept_text``, one row per input row.

    Edge cases: a null or empty text is one empty line; the largest holder keeps
    all its copies of a line; rows sharing an id count as one document; a row
    without id takes no part and keeps its text; a very long text is cut and joined whole, in
    one row; an empty table gives no rows.
    """
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    lines = F.split(text, "\n", -1)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).select(
        "doc", F.col("doc")[id_col].alias("id"), F.xxhash64(text).alias("text_hash"))
    keyed = rows.where(F.col("id").isNotNull()).select(
        "id", "text_hash", F.posexplode(lines).alias("pos", "line")).select(
        "id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(
        F.length("key") >= min_chars)
    hashed = materialise(keyed.select("id", "text_hash", "pos", *hash_pair("h", F.col("key"))), "lines")

    repeated = materialise(hashed.groupBy("h1", "h2")
                           .agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("keeper"))
                           .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "repeated-lines")
    dropped = (hashed.join(repeated, ["h1", "h2"]).where(F.col("id") != F.col("keeper"))
               .groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop")))
    joined = rows.join(dropped, ["id", "text_hash"], "left")
    joined = joined.select("doc", "drop", lines.alias("lines"))  # cut again here: no exchange carries text and lines
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select(
        "doc", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), text).otherwise(kept).alias("kept_text"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), bad AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, bad.key IS NOT NULL AND k.doc_id <> bad.keeper AS gone FROM k LEFT JOIN bad ON k.key = bad.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
