"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.operators.instants import header_instants
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


@registry.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every date of the archive header that is one, as UTC microseconds."""
    header = table(spark, folder, "archive_header", "header_id", "site", "crawl_date", "publication_date")
    return header_instants(header, table(spark, folder, "sites", "site", "time_zone", "date_order"))
