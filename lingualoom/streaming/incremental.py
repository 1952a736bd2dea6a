"""Incremental work on a growing corpus: new catalog rows and verdicts as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lingualoom.functions import urls


def record_verdicts(spark: SparkSession, incoming: str, table_path: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Appends verdicts that arrive as JSON files to a Parquet table; each file is taken once, whatever fails in between."""
    stream = spark.readStream.schema(schema).json(incoming)
    return stream.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_pairs(spark: SparkSession, incoming: str, done_path: str, checkpoint: str, schema: str, max_files: int = 1000) -> StreamingQuery:
    """Pairs of files from new catalog rows, each once; pairs that an earlier batch wrote are skipped.

    A batch is bounded by ``max_files``. Pairs of a batch are anti-joined with those already written, so running a batch again adds nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(incoming)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.filter("easy").select("site", F.col("fname").alias("simple"), F.explode("matching_files").alias("standard")).filter(F.col("standard").isNotNull()).distinct()
        pairs = rows.withColumn("pair_hash", urls.pair_hash(F.col("simple"), F.col("standard")))
        try:
            seen = spark.read.parquet(done_path).select("pair_hash")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = None
        fresh = pairs if seen is None else pairs.join(seen, "pair_hash", "left_anti")
        fresh.write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdict_counts(verdicts: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Verdicts per day of judging from a stream with ``judged_at``; rows later than ``late`` are dropped, so state stays bounded."""
    return verdicts.withWatermark("judged_at", late).groupBy(F.window("judged_at", every)).agg(
        F.count("*").alias("n"), F.count_if("verdict").alias("right")
    ).select(F.col("window.start").alias("day"), "n", "right")
