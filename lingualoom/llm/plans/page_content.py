"""Queries of the page operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.llm.page_content import page_content
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


@registry.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of every page that carry its own article."""
    return page_content(table(spark, folder, "crawled_pages", "page_id", "html"))
