"""Queries of the sentence alignment operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.llm.sentence_pairs import sentence_pairs
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()


@registry.add("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sentences of linked files that say the same."""
    header = table(spark, folder, "archive_header", "fname", "easy", "matching_files", "ingested_at", "header_id")
    lines = table(spark, folder, "parsed_lines", "sent_id", "fname", "line_no", "sent")
    judgments = table(spark, folder, "judgments", "pair_hash", "simple_sent", "normal_sent", "verdict")
    return sentence_pairs(header, lines, judgments, table(spark, folder, "glossary"))
