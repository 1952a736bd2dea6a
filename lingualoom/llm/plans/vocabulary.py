"""Queries of the tokenizer operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.llm import vocabulary
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


@registry.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text."""
    return vocabulary.encode(table(spark, folder, "documents", "doc_id", "text"))


@registry.add("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return vocabulary.decode(vocabulary.encode(table(spark, folder, "documents", "doc_id", "text")))
