"""Queries of the sentence operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.llm.sentence_units import sentence_units
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


@registry.add("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every document with their positions."""
    return sentence_units(table(spark, folder, "documents", "doc_id", "text"))
