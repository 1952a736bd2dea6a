"""Queries of the reading level operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.llm import reading_level
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return reading_level.reading_levels(docs, table(spark, folder, "reading_labels", "doc_id", "reading_level"))


@registry.add("p6_levels")
def p6_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of every document, with what it rests on."""
    return _levels(spark, folder)


@registry.add("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose flag of simple language disagrees with their text."""
    header = table(spark, folder, "archive_header", "fname", "easy", "ingested_at", "header_id")
    # Files stored more than once count by their first row.
    first = header.filter(F.col("fname").isNotNull()).groupBy("fname").agg(F.min_by("easy", F.struct("ingested_at", "header_id")).alias("easy"))
    easy = table(spark, folder, "documents", "doc_id", "fname").join(first.filter(F.col("easy").isNotNull()), "fname").select("doc_id", "easy")
    return reading_level.disagreements(_levels(spark, folder), easy).select("doc_id")
