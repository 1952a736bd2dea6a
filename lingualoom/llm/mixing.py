"""Mixing the documents of several sources to target shares of the total size.

Every document has a fixed hash. Sizes are summed by source and hash bucket; the bucket in which a source's budget
ends is the only one that is looked at again, by the next bits of the hash, and what is left of it by whole hashes.
That gives one threshold per mix and source: documents with a smaller hash are taken once more than the others.
Nothing is sorted, and a larger budget takes a superset of a smaller one.

A mix's total is the largest at which every source that has documents can give its share within its repeats; with
``total`` given, sources that are too small for their share give all that their repeats allow, and the report says so.

Defined results: shares of a mix are taken in proportion to their sum (so percents do as well as fractions); null or
non-positive shares, and null sources, take no part; null ``max_repeats`` counts as 1; a source listed twice in a mix
counts once, with the sum of its shares and the smallest of its repeats; a source without documents gives nothing and
is reported with 0; documents without tokens (null and empty texts) are of no size and in no mix; repeated rows of a
document count each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingualoom.session import bounded_broadcast, materialise

BITS = 12
#: Most rows of mixes by sources that are broadcast.
MAX_TARGETS = 50_000


def with_hash(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, tokens) with ``h``, a hash of the document from 0 to 2^63 - 1."""
    return sizes.select("doc_id", "source", "tokens").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 1))


def clean_targets(targets: DataFrame) -> DataFrame:
    """(mix_name, source, share, cap), shares of a mix adding up to 1."""
    own = (
        targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share"))
        .groupBy("mix_name", "source")
        .agg(F.sum("target_share").alias("s"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    )
    whole = own.groupBy(F.col("mix_name").alias("_m")).agg(F.sum("s").alias("_w"))
    return own.join(whole, F.col("mix_name").eqNullSafe(F.col("_m"))).select("mix_name", "source", (F.col("s") / F.col("_w")).alias("share"), "cap")


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(mix_name, source, share, cap, available, total, full, rest): whole repeats and the tokens still to take."""
    have = sizes.filter("tokens > 0").groupBy(F.col("source").alias("_s")).agg(F.sum("tokens").alias("available"))
    plan = bounded_broadcast(clean_targets(targets), MAX_TARGETS).join(have, F.col("source") == F.col("_s"), "left").drop("_s")
    plan = plan.withColumn("available", F.coalesce("available", F.lit(0)))
    reach = F.when(F.col("available") > 0, F.floor(F.col("available") * F.col("cap") / F.col("share")))
    most = plan.groupBy(F.col("mix_name").alias("_m")).agg(F.coalesce(F.lit(total).cast("long"), F.min(reach), F.lit(0)).alias("total"))
    plan = plan.join(most, F.col("mix_name").eqNullSafe(F.col("_m"))).drop("_m")
    take = F.least(F.floor(F.col("share") * F.col("total") + 1e-6), F.col("available") * F.col("cap"))
    plan = plan.withColumn("take", take.cast("long"))
    full = F.when(F.col("available") > 0, F.floor(F.col("take") / F.col("available"))).otherwise(0)
    return plan.withColumn("full", full.cast("long")).withColumn("rest", F.col("take") - F.col("full") * F.col("available"))


def _boundary(sums: DataFrame, wanted: DataFrame, bucket: str) -> DataFrame:
    """Of each mix and source the bucket in which ``rest`` ends, and what is left of ``rest`` before it.

    ``sums`` has one row per (mix, source, bucket), at most 2^BITS of a source.
    """
    by = Window.partitionBy("mix_name", "source").orderBy(bucket)
    run = wanted.join(sums, ["mix_name", "source"]).withColumn("upto", F.sum("n").over(by))
    run = run.withColumn("left", F.col("rest") - (F.col("upto") - F.col("n")))
    return run.filter((F.col("left") >= 0) & (F.col("left") < F.col("n")))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``below``: documents with a hash below it are taken ``full`` + 1 times, the others ``full`` times.

    The threshold is the one whose documents come nearest to ``rest``.
    """
    docs = sizes.filter("tokens > 0").select("source", "tokens", F.shiftright("h", 63 - BITS).alias("b1"), F.shiftright("h", 63 - 2 * BITS).alias("b2"), "h")
    key = plan.select("mix_name", F.col("source"), "rest").withColumn("mix_name", F.coalesce("mix_name", F.lit("\x00")))
    # Level 1: bounded by sources x 2^BITS rows, whatever the number of documents.
    first = docs.groupBy("source", "b1").agg(F.sum("tokens").alias("n"))
    # Both boundary tables have a row per mix and source; written, they keep the plans of later levels short.
    one = materialise(_boundary(key.select("mix_name", "source").join(first, "source"), key, "b1").select("mix_name", "source", "b1", F.col("left").alias("rest")), "mix_one")
    # Level 2: only documents of the boundary buckets, about one in 2^BITS.
    inner = docs.join(bounded_broadcast(one.select("mix_name", "source", "b1"), MAX_TARGETS), ["source", "b1"])
    second = inner.groupBy("mix_name", "source", "b2").agg(F.sum("tokens").alias("n"))
    two = materialise(_boundary(second, one.select("mix_name", "source", "rest"), "b2").select("mix_name", "source", "b2", F.col("left").alias("rest")), "mix_two")
    # Level 3: whole hashes of what is left, about one document in 2^(2 BITS).
    last = docs.join(bounded_broadcast(two.select("mix_name", "source", "b2"), MAX_TARGETS), ["source", "b2"])
    third = last.groupBy("mix_name", "source", "h").agg(F.sum("tokens").alias("n"))
    nearest = F.col("h") + F.when(F.col("left") * 2 > F.col("n"), 1).otherwise(0)
    three = _boundary(third, two.select("mix_name", "source", "rest"), "h").select(F.col("mix_name").alias("_m"), F.col("source").alias("_s"), nearest.alias("below"))
    joined = plan.join(three, (F.coalesce("mix_name", F.lit("\x00")) == F.col("_m")) & (F.col("source") == F.col("_s")), "left")
    return joined.drop("_m", "_s").withColumn("below", F.coalesce("below", F.lit(0)))


def mixed(sizes: DataFrame, ends: DataFrame) -> DataFrame:
    """(mix_name, doc_id, source, tokens, repeats) of every document in a mix."""
    chosen = bounded_broadcast(ends.select("mix_name", F.col("source").alias("_s"), "full", "below"), MAX_TARGETS)
    taken = sizes.filter("tokens > 0").join(chosen, F.col("source") == F.col("_s"))
    repeats = (F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")
    return taken.select("mix_name", "doc_id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def shares(sizes: DataFrame, ends: DataFrame) -> DataFrame:
    """The report: per mix and source the target and what came of it."""
    got = mixed(sizes, ends).groupBy("mix_name", "source").agg(
        F.count("*").alias("documents"), F.sum("repeats").alias("records"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    got = got.select(F.col("mix_name").alias("_m"), F.col("source").alias("_s"), "documents", "records", "tokens", "most_repeats")
    out = ends.join(got, F.col("mix_name").eqNullSafe(F.col("_m")) & (F.col("source") == F.col("_s")), "left")
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("mix_name", "source", F.col("share").alias("target_share"), "cap", "available", n("documents"), n("records"), n("tokens"), n("most_repeats"))
    return out.select("*", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("actual_share"))
