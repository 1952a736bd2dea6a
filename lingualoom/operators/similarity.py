"""Similarities of all sentences of two linked files, long form: (pair_hash, i, j, sim).

Averages of word cosines need no join of words: they are the product of summed unit vectors. Sparse measures and those that
need the best word per word run in Arrow kernels that get a pair of files as one row, multiply matrices and give all of its
cells at once, so that neither shared terms nor cells are shuffled. A row holds what two articles have; within it work goes by
blocks of sentences, so that memory does not go with words by words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.operators import weights as W

MEASURES = ("n_gram", "bag_of_words", "cosine", "average", "maximum", "bipartite", "cwasa", "sbert")
#: Those that need the best word per word.
BY_WORDS = ("maximum", "bipartite", "cwasa")
#: Names under which measures are known elsewhere.
ALIASES = {"max_matching": "bipartite", "CWASA": "cwasa"}
LABELS = {"n_gram": "4-gram", "bag_of_words": "bag of words", "cosine": "cosine", "average": "average", "maximum": "maximum", "bipartite": "bipartite", "cwasa": "CWASA", "sbert": "sbert"}
_ROUND = 10


def grid(pairs: DataFrame, sents: DataFrame) -> DataFrame:
    """(pair_hash, i, j): every cell of every pair."""
    a = sents.select(F.col("fname").alias("simple"), "i")
    b = sents.select(F.col("fname").alias("standard"), F.col("i").alias("j"))
    return pairs.select("pair_hash", "simple", "standard").join(a, "simple").join(b, "standard").select("pair_hash", "i", "j")


#: Values that a kernel holds at a time.
_BLOCK = 4_000_000


def _sparse_dots(ia: np.ndarray, ta: np.ndarray, va: np.ndarray, ib: np.ndarray, tb: np.ndarray, vb: np.ndarray, m: int, n: int) -> np.ndarray:
    """Products of two sparse matrices (row, term, value), rows by rows, over the terms they share."""
    order = np.argsort(tb, kind="stable")
    tb, ib, vb = tb[order], ib[order], vb[order]
    first, end = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
    hit = end > first
    ia, va, first, size = ia[hit], va[hit], first[hit], (end - first)[hit]
    out = np.zeros(m * n)
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + _BLOCK, "right")))
        k = size[start:stop]
        at = np.repeat(first[start:stop] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        out += np.bincount(np.repeat(ia[start:stop] * n, k) + ib[at], np.repeat(va[start:stop], k) * vb[at], m * n)
        start = stop
    return out.reshape(m, n)


def _cells(keys: list[str], shapes: list[tuple[int, int]], values: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    """(pair_hash, i, j, values) of the grids of several pairs."""
    sizes = [m * n for m, n in shapes]
    own = pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
    i = np.concatenate([np.repeat(np.arange(m, dtype=np.int32), n) for m, n in shapes]) if keys else np.zeros(0, np.int32)
    j = np.concatenate([np.tile(np.arange(n, dtype=np.int32), m) for m, n in shapes]) if keys else np.zeros(0, np.int32)
    flat = [pa.array(np.concatenate([x.ravel() for x in v]) if v else np.zeros(0)) for v in values.values()]
    return pa.RecordBatch.from_arrays([own, pa.array(i), pa.array(j), *flat], names=["pair_hash", "i", "j", *values])


def _lists(column: pa.Array, *fields: str) -> list[tuple[np.ndarray, ...]]:
    """Per row of a column of lists of structs its fields as arrays."""
    ends = column.offsets.to_numpy()
    inner = column.values
    flat = [inner.field(f).to_numpy(zero_copy_only=False) for f in fields]
    return [tuple(x[a:b] for x in flat) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _sparse_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, shapes, sims = [], [], []
        for key, m, n, (ia, ta, va), (ib, tb, vb) in zip(*(batch.column(k).to_pylist() for k in range(3)), _lists(batch.column(3), "i", "t", "v"), _lists(batch.column(4), "i", "t", "v")):
            dots = _sparse_dots(ia, ta, va, ib, tb, vb, m, n)
            norm = np.outer(np.bincount(ia, va * va, m), np.bincount(ib, vb * vb, n))
            keys.append(key)
            shapes.append((m, n))
            sims.append(np.divide(dots, np.sqrt(norm), out=np.zeros_like(dots), where=norm > 0))
        yield _cells(keys, shapes, {"sim": sims})


def sparse_similarity(pairs: DataFrame, sents: DataFrame, tokens: DataFrame, tf: DataFrame, idf: DataFrame, measure: str) -> DataFrame:
    """Cosine of tf-idf vectors of all cells; cells without a common term are 0. Terms travel as their 8-byte hashes."""
    weighted = W.sentence_terms(tokens, measure).join(W.weights(tf, idf), ["fname", "term"])
    entry = F.struct(F.col("i").cast("long").alias("i"), F.xxhash64("term").alias("t"), (F.col("c") * F.col("w")).alias("v"))
    terms = weighted.groupBy("fname").agg(F.collect_list(entry).alias("terms"))
    # Numbers of sentences run from 0 without gaps.
    files = sents.groupBy("fname").agg(F.count("*").cast("int").alias("n")).join(terms, "fname", "left")
    none = F.array().cast("array<struct<i: bigint, t: bigint, v: double>>")
    files = files.select("fname", "n", F.coalesce("terms", none).alias("terms"))
    a = files.select(F.col("fname").alias("simple"), F.col("n").alias("m"), F.col("terms").alias("a"))
    b = files.select(F.col("fname").alias("standard"), "n", F.col("terms").alias("b"))
    rows = pairs.select("pair_hash", "simple", "standard").join(a, "simple").join(b, "standard").select("pair_hash", "m", "n", "a", "b")
    return rows.mapInArrow(_sparse_kernel, "pair_hash string, i int, j int, sim double").select("pair_hash", "i", "j", F.round("sim", _ROUND).alias("sim"))


def word_vectors(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word, vec): a vector of ``vectors`` (vec_id from 0 without gaps, embedding) for every word, by its digest."""
    n = vectors.agg(F.count("*").alias("n"))
    words = tokens.select(F.explode("words").alias("word")).distinct()
    # One row: the number of vectors.
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % F.col("n")
    return words.join(F.broadcast(n)).withColumn("vec_id", bucket).join(vectors.select("vec_id", "embedding"), "vec_id").select("word", F.col("embedding").alias("vec"))


def _sums(tokens: DataFrame, vecs: DataFrame, dims: int, unit: bool) -> DataFrame:
    """(fname, i, n, s): number of words and sum of their (unit) vectors, dimension by dimension, with partial aggregation."""
    ready = vecs.select("word", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    if unit:
        ready = ready.withColumn("q", F.sqrt(_dot("vec", "vec")))
        ready = ready.select("word", F.transform("vec", lambda x: F.when(F.col("q") > 0, x / F.col("q")).otherwise(F.lit(0.0))).alias("vec"))
    long = tokens.select("fname", "i", F.explode("words").alias("word")).join(ready, "word")
    # A vector shorter than the longest counts as 0 beyond its end.
    sums = [F.sum(F.coalesce(F.get("vec", F.lit(k)), F.lit(0.0))).alias(f"v{k}") for k in range(dims)]
    return long.groupBy("fname", "i").agg(F.count("*").alias("n"), *sums).select("fname", "i", "n", F.array(*[f"v{k}" for k in range(dims)]).cast("array<double>").alias("s"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_similarity(pairs: DataFrame, sents: DataFrame, tokens: DataFrame, vecs: DataFrame, dims: int, measure: str) -> DataFrame:
    """``cosine`` of mean word vectors, or ``average`` of all word-by-word cosines; 0 and NaN without words, as these are."""
    sums = _sums(tokens, vecs, dims, measure == "average")
    a = sums.select(F.col("fname").alias("simple"), "i", F.col("n").alias("n"), F.col("s").alias("x"))
    b = sums.select(F.col("fname").alias("standard"), F.col("i").alias("j"), F.col("n").alias("m"), F.col("s").alias("y"))
    both = pairs.select("pair_hash", "simple", "standard").join(a, "simple").join(b, "standard")
    if measure == "average":
        hit = both.select("pair_hash", "i", "j", (_dot("x", "y") / (F.col("n") * F.col("m"))).alias("s"))
        none = F.lit(float("nan"))
    else:
        norm = F.sqrt(_dot("x", "x")) * F.sqrt(_dot("y", "y"))
        hit = both.select("pair_hash", "i", "j", F.when(norm > 0, _dot("x", "y") / norm).otherwise(0.0).alias("s"))
        none = F.lit(0.0)
    full = grid(pairs, sents).join(hit, ["pair_hash", "i", "j"], "left")
    return full.select("pair_hash", "i", "j", F.round(F.coalesce("s", none), _ROUND).alias("sim"))


def encoded_similarity(pairs: DataFrame, sents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of sentence vectors. Each different sentence is encoded once; the encoder is a lookup by digest, to be replaced by any (sent, vec) table."""
    n = vectors.agg(F.count("*").alias("n"))
    bucket = F.conv(F.substring(F.md5("sent"), 1, 8), 16, 10).cast("bigint") % F.col("n")
    coded = sents.select("sent").distinct().join(F.broadcast(n)).withColumn("vec_id", bucket).join(vectors.select("vec_id", "embedding"), "vec_id")
    own = sents.join(coded.select("sent", F.transform("embedding", lambda x: x.cast("double")).alias("s")), "sent")
    a = own.select(F.col("fname").alias("simple"), "i", F.col("s").alias("x"))
    b = own.select(F.col("fname").alias("standard"), F.col("i").alias("j"), F.col("s").alias("y"))
    both = pairs.select("pair_hash", "simple", "standard").join(a, "simple").join(b, "standard")
    norm = F.sqrt(_dot("x", "x")) * F.sqrt(_dot("y", "y"))
    return both.select("pair_hash", "i", "j", F.round(F.when(norm > 0, _dot("x", "y") / norm).otherwise(0.0), _ROUND).alias("sim"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment; rows are no more than columns. Shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], j0 = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < least[free]
            least[free[better]] = slack[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def best_assignment(c: np.ndarray) -> float:
    """Sum of the dearest assignment of the shorter side's words. Where the best words of all are different ones, they are it."""
    d = c if c.shape[0] <= c.shape[1] else c.T
    top = d.argmax(axis=1)
    pick = top if len(set(top.tolist())) == len(top) else assignment(-d)
    return float(d[np.arange(len(d)), pick].sum())


def mutual_mean(c: np.ndarray) -> float:
    """Mean of the positive best similarities of the words of either side, mutual ones once; 0 if there are none."""
    to_right, to_left = c.argmax(axis=1), c.argmax(axis=0)
    right, left = c[np.arange(len(to_right)), to_right], c[to_left, np.arange(len(to_left))]
    kept = np.concatenate([right[(right > 0) & (to_left[to_right] != np.arange(len(to_right)))], left[left > 0]])
    return float(kept.mean()) if len(kept) else 0.0


def word_measures(cos: np.ndarray, left: list[list[int]], right: list[list[int]], measures: tuple[str, ...] = BY_WORDS) -> dict[str, np.ndarray]:
    """Measures of all cells from the cosines of a vocabulary and the word numbers of the sentences of both sides; 0 where a side has no words."""
    m, n = len(left), len(right)
    out = {k: np.zeros((m, n)) for k in measures}
    rows, columns = [i for i, x in enumerate(left) if x], [j for j, y in enumerate(right) if y]
    if not rows or not columns:
        return out
    y = np.concatenate([np.array(right[j]) for j in columns])
    ends = np.cumsum([len(right[j]) for j in columns])
    starts = np.append(0, ends[:-1])
    widths = np.diff(np.append(0, ends))
    # As many sentences at a time as fit a block.
    lengths = np.cumsum([len(left[i]) for i in rows])
    first = 0
    while first < len(rows):
        done = lengths[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(lengths, done + max(1, _BLOCK // len(y)), "right")))
        some = rows[first:stop]
        sizes = np.array([len(left[i]) for i in some])
        begins = np.cumsum(sizes) - sizes
        c = cos[np.concatenate([np.array(left[i]) for i in some])[:, None], y[None, :]]
        if "maximum" in out:
            by_row = np.add.reduceat(np.maximum.reduceat(c, starts, axis=1), begins, axis=0) / sizes[:, None]
            by_column = np.add.reduceat(np.maximum.reduceat(c, begins, axis=0), starts, axis=1) / widths
            out["maximum"][np.ix_(some, columns)] = (by_row + by_column) / 2
        if "bipartite" in out or "cwasa" in out:
            for i, a, size in zip(some, begins.tolist(), sizes.tolist()):
                for j, b, width in zip(columns, starts.tolist(), widths.tolist()):
                    part = c[a : a + size, b : b + width]
                    if "bipartite" in out:
                        out["bipartite"][i, j] = best_assignment(part) / min(size, width)
                    if "cwasa" in out:
                        out["cwasa"][i, j] = mutual_mean(part)
        first = stop
    return out


def _word_kernel(measures: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, shapes, values = [], [], {k: [] for k in measures}
        vectors = batch.column(4)
        flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy().tolist()
        for k, (key, a, b, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            index = {w: q for q, w in enumerate(words or [])}
            table = flat[ends[k] : ends[k + 1]].reshape(len(index), -1) if index else np.zeros((0, 1))
            norm = np.linalg.norm(table, axis=1, keepdims=True)
            table = np.divide(table, norm, out=np.zeros(table.shape), where=norm > 0)
            cos = np.round(table @ table.T, 12)
            found = word_measures(cos, [[index[w] for w in x] for x in a], [[index[w] for w in y] for y in b], measures)
            keys.append(key)
            shapes.append((len(a), len(b)))
            for name, x in found.items():
                values[name].append(x)
        yield _cells(keys, shapes, values)


def word_similarities(pairs: DataFrame, tokens: DataFrame, vecs: DataFrame, measures: tuple[str, ...] = BY_WORDS) -> DataFrame:
    """(pair_hash, i, j, a column per measure) of all cells; only what is asked for is computed.

    A pair is one row with the sentences of two articles and the vectors of their words, so a task holds what two articles have.
    """
    files = tokens.groupBy("fname").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x.words).alias("ws"))
    keyed = pairs.select("pair_hash", "simple", "standard")
    both = keyed.join(files.select(F.col("fname").alias("simple"), F.col("ws").alias("a")), "simple").join(files.select(F.col("fname").alias("standard"), F.col("ws").alias("b")), "standard")
    own = both.select("pair_hash", F.explode(F.array_distinct(F.flatten(F.concat("a", "b")))).alias("word"))
    vocabulary = own.join(vecs, "word").groupBy("pair_hash").agg(F.collect_list(F.struct("word", "vec")).alias("v"))
    vocabulary = vocabulary.select("pair_hash", F.transform("v", lambda x: x.word).alias("words"), F.flatten(F.transform("v", lambda x: x.vec)).cast("array<double>").alias("vectors"))
    rows = both.join(vocabulary, "pair_hash", "left").select("pair_hash", "a", "b", "words", F.coalesce("vectors", F.array().cast("array<double>")).alias("vectors"))
    out = rows.mapInArrow(partial(_word_kernel, measures), "pair_hash string, i int, j int, " + ", ".join(f"{k} double" for k in measures))
    return out.select("pair_hash", "i", "j", *[F.round(k, _ROUND).alias(k) for k in measures])
