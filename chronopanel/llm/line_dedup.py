"""Removing lines that many documents share.

Lines are exploded, normalised and hashed; one aggregation counts the documents of each
hash; what is over the threshold is joined back and the other lines are put together again
by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.registry import query, table
from chronopanel.llm.text import SPACES, ascii_lower, id_and_text, same, text_key
from chronopanel.session import materialize


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _long_lines(base: DataFrame, min_chars: int) -> DataFrame:
    """A row (__id, __text_key, pos, h) for each line that can be dropped at all."""
    return (
        base.select("__id", text_key(F.col("__text")).alias("__t"), F.posexplode(_lines(F.col("__text"))).alias("pos", "line"))
        .filter(F.octet_length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        .select("__id", "__t", "pos", text_key(F.col("key")).alias("h"))
    )


def frequent_lines(base: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h, n_docs, keeper): line hashes found in at least min_docs documents.

    Spark first makes (h, document) distinct, dealt out by both, and adds up before it
    deals out by h, so a line that all documents hold gives one row per task.
    """
    return (
        _long_lines(base, min_chars)
        .groupBy("h")
        .agg(
            (F.count_distinct("__id") + F.max(F.col("__id").isNull().cast("int"))).alias("n_docs"),
            F.max("__id").alias("keeper"),
        )
        .filter(F.col("n_docs") >= min_docs)
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per input row: id, text (what is kept), n_lines, n_dropped.

    A line is frequent when its key has at least ``min_chars`` code points and at least
    ``min_docs`` documents hold it. Frequent lines go, except in the document with the largest id that
    holds them, which keeps all its copies. Lines are cut at ``\\n`` only; a ``\\r`` at an end is
    white space.

    Null or empty text: one empty line, kept. A null id is one document, below all others. Rows that
    share an id are one document to the count and keep their own text. An empty table
    gives an empty result. Other columns are not read.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("__text", F.coalesce(F.col("__text"), F.lit("")))
    # Stored, so that the join below is one of two plain tables: Spark then splits the rows of a very common line.
    frequent = materialize(frequent_lines(base, min_chars, min_docs).select("h", "keeper"))
    dropped = (
        _long_lines(base, min_chars)
        .join(frequent, "h")
        .filter(~same(F.col("__id"), F.col("keeper")))
        .groupBy(F.col("__id").alias("__i"), "__t")
        .agg(F.collect_set("pos").alias("drop"))
    )
    # The document's own key; a null id joins too.
    on = same(F.col("__id"), F.col("__i")) & (F.col("__k") == F.col("__t"))
    lines = _lines(F.col("__text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    return (
        base.withColumn("__k", text_key(F.col("__text")))
        .join(dropped, on, "left")
        .select(
            F.col("__id").alias(id_col),
            F.when(F.col("drop").isNull(), F.col("__text"))
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).alias(text_col),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        )
    )


@query(
    "op6_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    keyed AS (
      SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM lines),
    often AS (
      SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
      GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    marked AS (
      SELECT y.doc_id, pos, line, o.k IS NOT NULL AND o.keeper <> y.doc_id AS gone
      FROM keyed y LEFT JOIN often o USING (k))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op6_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
