"""Alignment strategies on similarities in long form (pair_hash, i, j, sim)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that reports print for the strategies.
STRATEGY_LABELS = {"max": "MST", "max_increasing_subsequence": "MST-LIS"}
MATCHES = "pair_hash string, i int, j int, sim double"


def thresholds(sim: DataFrame, sd: float, least: float = 0.0) -> DataFrame:
    """(pair_hash, thr): mean plus ``sd`` population deviations of all cells, but ``least`` at least; ``least`` where that is no number."""
    if sd <= 0:
        return sim.select("pair_hash").distinct().withColumn("thr", F.lit(least))
    stat = sim.groupBy("pair_hash").agg((F.avg("sim") + sd * F.stddev_pop("sim")).alias("x"))
    return stat.select("pair_hash", F.when(F.isnan("x") | F.col("x").isNull(), F.lit(least)).otherwise(F.greatest(F.round("x", 10), F.lit(least))).alias("thr"))


def best_matches(sim: DataFrame, sd: float, least: float = 0.0) -> DataFrame:
    """Each simple sentence with its most similar standard one (the first of equals), if that is above the threshold.

    One aggregation instead of a window: the largest (similarity, -column) of each row.
    """
    top = sim.groupBy("pair_hash", "i").agg(F.max(F.struct("sim", (-F.col("j")).alias("back"))).alias("t"))
    top = top.select("pair_hash", "i", (-F.col("t.back")).alias("j"), "t.sim")
    kept = top.join(thresholds(sim, sd, least), "pair_hash")
    return kept.filter((F.col("sim") > F.col("thr")) & ~F.isnan("sim")).select("pair_hash", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "sim")


def increasing(js: list[int]) -> list[int]:
    """Positions of a longest non-decreasing subsequence, in n log n.

    Of several longest ones it is that which ends first and whose elements, from the end on, lie nearest before one another.
    The position with the smallest value among those that end a run of each length is kept while reading, and with it a
    link to the one before: values of runs of one length fall as they come, so this is the nearest that fits.
    """
    ends: list[int] = []
    values: list[int] = []
    link: dict[int, int] = {}
    last = -1
    for here, value in enumerate(js):
        size = bisect_right(values, value)
        link[here] = ends[size - 1] if size else -1
        if size == len(ends):
            ends.append(here)
            values.append(value)
            last = here
        else:
            ends[size], values[size] = here, value
    path = []
    while last >= 0:
        path.append(last)
        last = link[last]
    return sorted(path)


def ordered_alignment(matrix: np.ndarray, threshold: float, fix_row_index: bool = False) -> list[tuple[int, int]]:
    """Best matches in an order-preserving alignment.

    The rows' best columns above the threshold are the matches; a longest non-decreasing run of them is fixed. The other
    matches lie in the gaps before, between and after these; each gap is looked through by itself, within the columns of
    the fixed matches around it. By default the row that is searched is that of the match's position among all matches, as the
    published results have it; ``fix_row_index`` searches the sentence's own row.
    """
    if not matrix.size:
        return []
    peak = matrix.argmax(axis=1)
    return in_order(matrix, peak.tolist(), matrix[np.arange(len(matrix)), peak].tolist(), threshold, fix_row_index)


#: Columns up to which a row is looked through faster as a list than as an array.
NARROW = 64


def in_order(values: np.ndarray | list[list[float]], peak: list[int], top: list[float], threshold: float, fix_row_index: bool = False) -> list[tuple[int, int]]:
    """``ordered_alignment`` from rows, as lists if they are narrow, whose first largest values and the columns of these are known."""
    at = [i for i, x in enumerate(top) if x > threshold]
    columns = [peak[i] for i in at]
    fixed = increasing(columns)
    if len(fixed) == len(columns):
        return list(zip(at, columns))
    listed = isinstance(values, list)
    last = (len(values[0]) if listed else values.shape[1]) - 1
    low, before, out = 0, -1, []
    for here in (*fixed, len(columns)):
        high = columns[here] if here < len(columns) else last
        edge = low
        for k in range(before + 1, here):
            # The largest value at or after the column taken before, if it is above the threshold.
            row = values[at[k] if fix_row_index else k][edge : high + 1]
            largest = max(row) if listed else row.max()
            if largest > threshold:
                edge += row.index(largest) if listed else int(row.argmax())
                if values[at[k]][edge] > threshold:
                    out.append((at[k], edge))
        if here < len(columns):
            out.append((at[here], high))
        low, before = high, here
    return out


def ordered_matches(sim: DataFrame, sd: float, least: float = 0.0, fix_row_index: bool = False) -> DataFrame:
    """Order-preserving matches of every pair; a pair's cells come as one row."""
    cells = sim.groupBy("pair_hash").agg(F.array_sort(F.collect_list(F.struct("i", "j", "sim"))).alias("c"))
    rows = cells.join(thresholds(sim, sd, least), "pair_hash").select("pair_hash", "thr", F.transform("c", lambda x: x.i).alias("i"), F.transform("c", lambda x: x.j).alias("j"), F.transform("c", lambda x: x.sim).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ii, jj, ss = [], [], [], []
            for key, thr, i, j, s in zip(*(b.column(k).to_pylist() for k in range(5))):
                matrix = np.full((max(i) + 1, max(j) + 1), -np.inf)
                matrix[i, j] = s
                for x, y in ordered_alignment(np.where(np.isnan(matrix), -np.inf, matrix), thr, fix_row_index):
                    keys.append(key)
                    ii.append(x)
                    jj.append(y)
                    ss.append(float(matrix[x, y]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ii, pa.int32()), pa.array(jj, pa.int32()), pa.array(ss, pa.float64())], names=["pair_hash", "i", "j", "sim"])

    return rows.mapInArrow(run, MATCHES)


STRATEGIES = {"max": best_matches, "max_increasing_subsequence": ordered_matches}


def matches(sim: DataFrame, strategy: str, sd: float) -> DataFrame | None:
    """Matches by a strategy's name; None for an unknown one."""
    run = STRATEGIES.get(strategy)
    return None if run is None else run(sim, sd)


def all_matches(sims: dict[str, DataFrame], sds: tuple[float, ...] = (0.0, 1.5), strategies: tuple[str, ...] = ("max",)) -> DataFrame:
    """(pair_hash, measure, strategy, sd, i, j, sim) of every measure, strategy and threshold."""
    out = None
    for measure, sim in sims.items():
        for strategy in strategies:
            for sd in sds:
                own = STRATEGIES[strategy](sim, sd).select("pair_hash", F.lit(measure).alias("measure"), F.lit(strategy).alias("strategy"), F.lit(sd).alias("sd"), "i", "j", "sim")
                out = own if out is None else out.unionByName(own)
    return out


def with_sentences(found: DataFrame, pairs: DataFrame, sents: DataFrame) -> DataFrame:
    """``found`` with files and both sentences."""
    out = found.join(pairs.select("pair_hash", "site", "simple", "standard"), "pair_hash")
    out = out.join(sents.select(F.col("fname").alias("simple"), "i", F.col("sent").alias("simple_sent")), ["simple", "i"])
    return out.join(sents.select(F.col("fname").alias("standard"), F.col("i").alias("j"), F.col("sent").alias("normal_sent")), ["standard", "j"])


def export(found: DataFrame) -> DataFrame:
    """(standard, j, aligned): per standard sentence its simple ones with distances, as the exported corpus nests them."""
    pair = F.struct("simple", "i", "simple_sent", "normal_sent", F.col("sim").alias("dist"))
    return found.groupBy("standard", "j").agg(F.array_sort(F.collect_list(pair)).alias("aligned"))


def unusable_pairs(pairs: DataFrame, sents: DataFrame) -> DataFrame:
    """Pairs of which a file has no sentences, with the reason: they are set aside, not failed on."""
    has = sents.select("fname").distinct()
    a = has.select(F.col("fname").alias("simple"), F.lit(1).alias("ha"))
    b = has.select(F.col("fname").alias("standard"), F.lit(1).alias("hb"))
    both = pairs.join(a, "simple", "left").join(b, "standard", "left")
    reason = F.when(F.col("hb").isNull(), "standard side empty").when(F.col("ha").isNull(), "simple side empty")
    return both.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("pair_hash", "simple", "standard", "reason")
