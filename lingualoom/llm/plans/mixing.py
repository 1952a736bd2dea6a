"""Queries of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingualoom.llm import mixing, vocabulary
from lingualoom.plans.registry import Registry
from lingualoom.session import materialise
from lingualoom.sources.tables import table

registry = Registry()


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    # The source travels with the key, so that sizes need no join with the documents.
    keyed = docs.selectExpr("struct(doc_id, source) AS key", "text")
    sizes = vocabulary.token_counts(keyed, "key", "text").select("key.doc_id", "key.source", "tokens")
    sizes = materialise(mixing.with_hash(sizes), "mix_sizes")
    plan = materialise(mixing.budgets(sizes, table(spark, folder, "mix_targets")), "mix_plan")
    return sizes, materialise(mixing.thresholds(sizes, plan), "mix_ends")


@registry.add("p8_mix")
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix and how often each is taken."""
    return mixing.mixed(*_prepared(spark, folder))


@registry.add("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each mix."""
    return mixing.shares(*_prepared(spark, folder))
