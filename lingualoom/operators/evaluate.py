"""Evaluation of matches and statistics of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.session import lookup_join


Config = tuple[str, str, float]
#: What a verdict is on: two sentences, or with verdicts by cell their numbers.
SENTENCES, CELL = ("pair_hash", "simple_sent", "normal_sent"), ("pair_hash", "i", "j")


def verdict_cells(verdicts: DataFrame, pairs: DataFrame, sents: DataFrame) -> DataFrame:
    """(pair_hash, i, j, verdict): every cell whose sentences have a verdict. So few verdicts get numbers instead of many matches their sentences."""
    own = verdicts.join(pairs.select("pair_hash", "simple", "standard"), "pair_hash")
    own = own.join(sents.select(F.col("fname").alias("simple"), "i", F.col("sent").alias("simple_sent")), ["simple", "simple_sent"])
    own = own.join(sents.select(F.col("fname").alias("standard"), F.col("i").alias("j"), F.col("sent").alias("normal_sent")), ["standard", "normal_sent"])
    return own.select(*CELL, "verdict")


def _judged(found: DataFrame, verdicts: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    if on == SENTENCES:
        return found.join(verdicts, list(on), how)
    return lookup_join(found, verdicts, list(on), 1_000_000, F.length("pair_hash") + 32, how)


def _each_config(rows: DataFrame, configs: list[Config]) -> DataFrame:
    """Every row once per (measure, strategy, sd), made in place."""
    listed = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(s).alias("strategy"), F.lit(float(sd)).alias("sd")) for m, s, sd in configs])
    return rows.select("*", F.explode(listed).alias("_c")).select(*rows.columns, "_c.*")


def match_statistics(found: DataFrame, pairs: DataFrame, configs: list[Config]) -> DataFrame:
    """(pair_hash, measure, strategy, sd, n, mean_sim): matches of each pair and configuration, 0 where there are none."""
    return tally_statistics(found.groupBy("pair_hash", "measure", "strategy", "sd").agg(F.count("*").alias("n"), F.sum("sim").alias("total")), pairs, configs)


def tally_statistics(tallies: DataFrame, pairs: DataFrame, configs: list[Config]) -> DataFrame:
    """``match_statistics`` from (pair_hash, measure, strategy, sd, n, total) of those that have matches."""
    whole = _each_config(pairs.select("pair_hash"), configs)
    out = whole.join(tallies, ["pair_hash", "measure", "strategy", "sd"], "left")
    return out.select("pair_hash", "measure", "strategy", "sd", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("mean_sim"))


def grouped_statistics(stats: DataFrame) -> DataFrame:
    """Means and sums by measure, by strategy, by threshold, and by all three, in one pass of grouping sets."""
    m, s, t = F.col("measure"), F.col("strategy"), F.col("sd")
    out = stats.groupingSets([[m], [s], [t], [m, s, t]], m, s, t).agg(
        F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.avg("mean_sim"), 6).alias("mean_sim"), F.sum("n").alias("total_n"), F.grouping_id().cast("long").alias("level")
    )
    return out.select("measure", "strategy", "sd", "level", "mean_n", "mean_sim", "total_n")


def precision_recall(found: DataFrame, truth: DataFrame, configs: list[Config]) -> DataFrame:
    """Per pair and configuration against (pair_hash, simple_sent, normal_sent): precision, recall and F1, all 0 without a hit.

    Of a simple sentence that stands in the truth twice the last counts, so ``truth`` has it once.
    """
    keys = ["pair_hash", "measure", "strategy", "sd"]
    size = truth.groupBy("pair_hash").agg(F.count("*").alias("expected"))
    hit = found.join(truth.select("pair_hash", "simple_sent", F.col("normal_sent").alias("right")), ["pair_hash", "simple_sent"], "left")
    own = hit.groupBy(*keys).agg(F.count("*").alias("aligned"), F.count_if(F.col("normal_sent") == F.col("right")).alias("correct"))
    out = _each_config(size, configs).join(own, keys, "left")
    c, a, e = (F.coalesce(x, F.lit(0)).cast("double") for x in (F.col("correct"), F.col("aligned"), F.col("expected")))
    return out.select(
        *keys, *[F.when(c > 0, x).otherwise(0.0).alias(n) for n, x in (("precision", c / a), ("recall", c / e), ("f1", 2 * c / (a + e)))]
    )


def macro_means(scores: DataFrame) -> DataFrame:
    """Means over pairs; F1 is the mean of F1s."""
    return scores.groupBy("measure", "strategy", "sd").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("precision", "recall", "f1")])


def judged_scores(found: DataFrame, verdicts: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Per pair and configuration from verdicts (pair_hash, simple_sent, normal_sent, verdict), or those by cell in ``judged``: matches without a verdict do not count."""
    keys = ["pair_hash", "measure", "strategy", "sd"]
    positive = verdicts.groupBy("pair_hash").agg(F.count_if("verdict").alias("p"))
    hit = _judged(found, verdicts, SENTENCES, "left") if judged is None else _judged(found, judged, CELL, "left")
    true = F.sum(F.when(F.col("verdict"), 1).otherwise(0))
    out = hit.groupBy(*keys).agg(true.alias("t"), F.count("verdict").alias("n")).join(positive, "pair_hash")
    return out.select(*keys, F.coalesce(F.try_divide("t", "n"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("t", "p"), F.lit(0.0)).alias("recall"))


def judged_means(scores: DataFrame) -> DataFrame:
    """Means over pairs; F1 is that of the mean precision and the mean recall."""
    out = scores.groupBy("measure", "strategy", "sd").agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return out.select("measure", "strategy", "sd", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def judged_similarities(found: DataFrame, verdicts: DataFrame, on: tuple[str, ...] = SENTENCES) -> DataFrame:
    """Mean similarity of matches that people hold right and wrong, by measure."""
    hit = _judged(found, verdicts.filter(F.col("verdict").isNotNull()), on, "inner")
    mean = lambda ok: F.round(F.avg(F.when(F.col("verdict") == ok, F.col("sim"))), 6)
    return hit.groupBy("measure").agg(mean(True).alias("sim_right"), mean(False).alias("sim_wrong"), F.count_if("verdict").alias("n_right"), F.count_if(~F.col("verdict")).alias("n_wrong"))


def precision_by_site(found: DataFrame, verdicts: DataFrame, pairs: DataFrame, on: tuple[str, ...] = SENTENCES) -> DataFrame:
    """Precision by site, measure and strategy; here a missing verdict counts as wrong."""
    hit = _judged(found, verdicts, on, "left")
    own = hit.groupBy("pair_hash", "measure", "strategy").agg(F.count_if(F.coalesce("verdict", F.lit(False))).alias("t"), F.count("*").alias("n"))
    return own.join(pairs.select("pair_hash", "site"), "pair_hash").groupBy("site", "measure", "strategy").agg((F.sum("t") / F.sum("n")).alias("precision"))


def strategy_pivot(by_site: DataFrame, strategies: list[str]) -> DataFrame:
    """Mean precision over sites, a row per measure and a column per strategy."""
    return by_site.groupBy("measure").pivot("strategy", strategies).agg(F.round(F.avg("precision"), 6))


def article_counts(pairs: DataFrame) -> DataFrame:
    """Different simple and standard articles per site and, with null site, of all."""
    return pairs.rollup("site").agg(F.countDistinct("simple").alias("simple_files"), F.countDistinct("standard").alias("standard_files"))


def length_statistics(values: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, population deviation and median of each column, long form, per group."""
    long = values.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.what", "x.v")
    return long.filter(F.col("v").isNotNull()).groupBy(*by, "what").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("deviation"), F.round(F.expr("percentile(v, 0.5)"), 6).alias("median"), F.count("*").alias("n")
    )


def aligned_counts(found: DataFrame) -> DataFrame:
    """Aligned sentences per site and of all (null site): different ones within a file, added up; either side."""
    files = found.groupBy("site", "pair_hash").agg(F.countDistinct("simple_sent").alias("s"), F.countDistinct("normal_sent").alias("n"))
    return files.rollup("site").agg(F.sum("s").alias("simple_sentences"), F.sum("n").alias("standard_sentences"))


def histogram(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the bin from 0; the upper end belongs to the last bin, what is outside has null."""
    k = F.floor((value - low) / ((high - low) / bins))
    return F.when((value < low) | (value > high), None).otherwise(F.least(k, F.lit(bins - 1))).cast("int")


def last_verdicts(judgments: DataFrame) -> DataFrame:
    """(pair_hash, simple_sent, normal_sent, verdict): the last verdict on a pair of sentences counts."""
    last = F.max(F.struct("judged_at", "judgment_id", "verdict")).alias("v")
    return judgments.groupBy("pair_hash", "simple_sent", "normal_sent").agg(last).select("pair_hash", "simple_sent", "normal_sent", "v.verdict")


def next_unjudged(candidates: DataFrame, verdicts: DataFrame, finished: DataFrame) -> DataFrame:
    """Candidate pairs of sentences nobody has judged yet, of file pairs that are not finished."""
    left = candidates.select("pair_hash", "simple_sent", "normal_sent").distinct().join(finished.select("pair_hash"), "pair_hash", "left_anti")
    return left.join(verdicts, ["pair_hash", "simple_sent", "normal_sent"], "left_anti")
