"""Queries of the quality operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.llm.text_quality import document_statistics, text_quality
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


@registry.add("p9_statistics")
def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The quality statistics of every document and its kind."""
    return text_quality(table(spark, folder, "documents", "doc_id", "text"))


@registry.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text is mainly a list, a table or junk."""
    found = text_quality(table(spark, folder, "documents", "doc_id", "text"))
    return found.filter(F.col("kind").isin("list", "table", "junk")).select("doc_id")


_BLANK = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"
_DENSE = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"
_COUNTS = rf"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
w AS (SELECT *, flatten(list_transform(lines, lambda x: regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+'))) AS words, length(regexp_replace(text, '[{_BLANK}]+', '', 'g')) AS visible,
  length(regexp_replace(text, CASE WHEN regexp_matches(text, '[\x{{0590}}-\x{{0E7F}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]') THEN '[\p{{L}}\p{{N}}_{_BLANK}\x{{0300}}-\x{{0E7F}}]' ELSE '[\p{{L}}\p{{N}}_{_BLANK}]' END, '', 'g')) AS signs FROM l)
SELECT doc_id, coalesce(len(lines), 0) = 0 AS empty, CASE WHEN len(lines) > 0 AND NOT regexp_matches(text, '{_DENSE}') THEN CAST(len(words) AS BIGINT) END AS words,
  CASE WHEN len(lines) > 0 AND NOT regexp_matches(text, '{_DENSE}') THEN round(least(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / greatest(len(words), 1), 30), 6) END AS mean_word_length,
  CASE WHEN len(lines) > 0 THEN round(signs / visible, 6) END AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？।؟][“”»"'')\]」 ]*$'))) / len(lines), 6) END AS ended_share FROM w"""


@registry.add("p9_counts", _COUNTS)
def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that SQL can say, as the operator has them: words are null for texts with scripts that set no blanks between words."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    dense = F.coalesce(F.col("text").rlike("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]"), F.lit(False))
    own = document_statistics(docs.select(F.struct("doc_id", dense.alias("dense")).alias("doc_id"), "text"))
    some = lambda column, where: F.when(where, column)
    full, spaced = ~F.col("empty"), ~F.col("empty") & ~F.col("doc_id.dense")
    return own.select(
        "doc_id.doc_id", "empty", some(F.col("words").cast("long"), spaced).alias("words"), some(F.round("mean_word_length", 6), spaced).alias("mean_word_length"),
        some(F.round("symbol_ratio", 6), full).alias("symbol_ratio"), some(F.round("ended_share", 6), full).alias("ended_share"),
    )
