"""Views that several queries share, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.functions import text as X
from lingualoom.operators import catalog
from lingualoom.sources.tables import table

FILES = "files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fname ORDER BY ingested_at, header_id) AS rn FROM archive_header WHERE fname IS NOT NULL) WHERE rn = 1)"
PAIRS = (
    FILES + ", pairs AS (SELECT DISTINCT f.site, f.fname AS simple, u.m AS standard, f.type, sha1(f.fname || '.txt___' || u.m || '.txt') AS pair_hash"
    " FROM files f, unnest(f.matching_files) AS u(m) WHERE f.easy AND u.m IS NOT NULL)"
)
SENTS = r"""sents AS (SELECT fname, CAST(row_number() OVER (PARTITION BY fname ORDER BY line_no, sent_id) - 1 AS INTEGER) AS i, sent FROM (
  SELECT *, row_number() OVER (PARTITION BY fname, sent_id ORDER BY parsed_at, line_no, sent NULLS FIRST) AS rn FROM parsed_lines WHERE fname IS NOT NULL)
  WHERE rn = 1 AND trim(regexp_replace(sent, '[\s\p{Z}]+', ' ', 'g')) <> '')"""
USED = "used AS (SELECT * FROM pairs WHERE simple IN (SELECT fname FROM sents) AND standard IN (SELECT fname FROM sents))"
BASE = f"WITH {PAIRS}, {SENTS}, {USED}"
VERDICTS = """verdicts AS (SELECT pair_hash, simple_sent, normal_sent, verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_hash, simple_sent, normal_sent ORDER BY judged_at DESC, judgment_id DESC, verdict DESC NULLS LAST) AS rn FROM judgments) WHERE rn = 1)"""


def clean_sql(x: str, lower: bool) -> str:
    """The cleaning of ``GRAM`` and ``EMBEDDING`` in SQL."""
    s = rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
    for k in range(26):
        s = f"replace({s}, '-{chr(65 + k)}', '{chr(97 + k)}')"
    for mark in (r"\*", ":", "_"):
        s = f"regexp_replace({s}, '{mark}in(nen)?', '', 'g')"
    s = rf"regexp_replace({s}, '([a-z])In(nen)?', '\1', 'g')"
    return f"lower({s})" if lower else s


def words_sql(x: str, lower: bool) -> str:
    tokens = rf"regexp_extract_all({clean_sql(x, lower)}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"
    return rf"list_filter({tokens}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))"


def tokens_sql(lower: bool = True) -> str:
    return f"tokens AS (SELECT fname, i, {words_sql('sent', lower)} AS words FROM sents)"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.first_rows(table(spark, folder, "archive_header"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.article_pairs(files(spark, folder))


def sents(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.sentences(table(spark, folder, "parsed_lines", "sent_id", "fname", "line_no", "sent", "parsed_at"))


def used_pairs(all_pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pairs of which both files have sentences."""
    has = sentences.select("fname").distinct()
    one = all_pairs.join(has.withColumnRenamed("fname", "simple"), "simple", "left_semi")
    return one.join(has.withColumnRenamed("fname", "standard"), "standard", "left_semi")


def tokens(sentences: DataFrame, options: X.Preprocessing = X.GRAM) -> DataFrame:
    from lingualoom.operators.weights import token_table

    return token_table(sentences, options)
