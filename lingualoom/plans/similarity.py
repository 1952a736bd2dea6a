"""Queries of similarities, alignments and their evaluation."""

from __future__ import annotations

from functools import cached_property, partial

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import text as T
from lingualoom.functions import urls
from lingualoom.operators import align as A
from lingualoom.operators import catalog
from lingualoom.operators import evaluate as E
from lingualoom.operators import similarity as S
from lingualoom.operators import weights as W
from lingualoom.operators import whole_grid as G
from lingualoom.plans import fixture as X
from lingualoom.plans.registry import Registry, materialised
from lingualoom.plans.text import GRAM_TF, USED_FILES, WORD_TF, idf_sql
from lingualoom.session import MAX_BROADCAST, bounded_broadcast, materialise
from lingualoom.sources.tables import table

registry = Registry()
add = registry.add

DIMENSIONS = 64
CONFIG_SDS = (0.0, 1.5)

_GRID = "grid AS (SELECT p.pair_hash, a.i, b.i AS j FROM used p JOIN sents a ON a.fname = p.simple JOIN sents b ON b.fname = p.standard)"


def _sparse_sql(measure: str) -> str:
    bag = measure == "bag_of_words"
    tf, name = (WORD_TF, "word_tf") if bag else (GRAM_TF, "gram_tf")
    terms = (
        "st AS (SELECT fname, i, term, count(*) AS c FROM (SELECT fname, i, unnest(words) AS term FROM tokens) GROUP BY fname, i, term)"
        if bag
        else "st AS (SELECT fname, i, term, count(*) AS c FROM (SELECT fname, i, unnest(list_transform(range(1, length(s) - 2), lambda k: substr(s, CAST(k AS BIGINT), 4))) AS term FROM (SELECT fname, i, array_to_string(words, ' ') AS s FROM tokens) WHERE length(s) >= 4) GROUP BY fname, i, term)"
    )
    return f"""{X.BASE}, {X.tokens_sql()}, {USED_FILES}, {tf}, {idf_sql('idf', name)}, {_GRID}, {terms},
v AS (SELECT st.fname, st.i, st.term, st.c * t.tf * d.idf AS v FROM st JOIN {name} t USING (fname, term) JOIN idf d USING (term)),
q AS (SELECT fname, i, sum(v * v) AS q FROM v GROUP BY fname, i),
va AS (SELECT p.pair_hash, v.term, v.i, v.v AS x FROM used p JOIN v ON v.fname = p.simple),
vb AS (SELECT p.pair_hash, v.term, v.i AS j, v.v AS y FROM used p JOIN v ON v.fname = p.standard),
d AS (SELECT pair_hash, i, j, sum(x * y) AS d FROM va JOIN vb USING (pair_hash, term) GROUP BY pair_hash, i, j),
qa AS (SELECT p.pair_hash, q.i, q.q AS x FROM used p JOIN q ON q.fname = p.simple),
qb AS (SELECT p.pair_hash, q.i AS j, q.q AS y FROM used p JOIN q ON q.fname = p.standard),
da AS (SELECT d.*, qa.x FROM d JOIN qa USING (pair_hash, i)),
hit AS (SELECT pair_hash, i, j, CASE WHEN x * y > 0 THEN d / sqrt(x * y) ELSE 0 END AS s FROM da JOIN qb USING (pair_hash, j)),
sim AS (SELECT g.pair_hash, g.i, g.j, round(coalesce(hit.s, 0), 10) AS sim FROM grid g LEFT JOIN hit USING (pair_hash, i, j))"""


_VECTORS = """wv AS (SELECT word, embedding AS vec FROM (SELECT DISTINCT unnest(words) AS word FROM tokens) w
  JOIN embeddings e ON e.vec_id = CAST(('0x' || substr(md5(w.word), 1, 8)) AS BIGINT) % (SELECT count(*) FROM embeddings))"""
_CELL_WORDS = """lv AS (SELECT l.fname, l.i, l.k, CAST(w.vec AS DOUBLE[]) AS vec FROM long l JOIN wv w USING (word)),
la AS (SELECT p.pair_hash, l.i, l.k, l.vec AS x FROM used p JOIN lv l ON l.fname = p.simple),
lb AS (SELECT p.pair_hash, l.i AS j, l.k AS l, l.vec AS y FROM used p JOIN lv l ON l.fname = p.standard),
cos AS (SELECT pair_hash, i, j, k, l, round(list_cosine_similarity(x, y), 12) AS c FROM la JOIN lb USING (pair_hash))"""
_LONG = "long AS (SELECT fname, i, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM tokens)"


def _vector_sql(measure: str) -> str:
    head = f"{X.BASE}, {X.tokens_sql(False)}, {_GRID}, {_VECTORS}, {_LONG}"
    if measure == "cosine":
        return f"""{head}, nw AS (SELECT fname, i, len(words) AS n FROM tokens), e AS (SELECT l.fname, l.i, d.d, sum(CAST(w.vec[d.d] AS DOUBLE)) / any_value(n.n) AS x FROM long l JOIN wv w USING (word), range(1, {DIMENSIONS + 1}) AS d(d), nw n WHERE n.fname = l.fname AND n.i = l.i GROUP BY l.fname, l.i, d.d),
m AS (SELECT fname, i, list(x ORDER BY d) AS m FROM e GROUP BY fname, i),
ma AS (SELECT p.pair_hash, m.i, m.m AS x FROM used p JOIN m ON m.fname = p.simple),
mb AS (SELECT p.pair_hash, m.i AS j, m.m AS y FROM used p JOIN m ON m.fname = p.standard),
hit AS (SELECT pair_hash, i, j, list_cosine_similarity(x, y) AS s FROM ma JOIN mb USING (pair_hash)),
sim AS (SELECT g.pair_hash, g.i, g.j, round(coalesce(hit.s, 0), 10) AS sim FROM grid g LEFT JOIN hit USING (pair_hash, i, j))"""
    if measure == "average":
        return f"{head}, {_CELL_WORDS}, sim AS (SELECT g.pair_hash, g.i, g.j, round(coalesce(avg(c), 'nan'::DOUBLE), 10) AS sim FROM grid g LEFT JOIN cos USING (pair_hash, i, j) GROUP BY g.pair_hash, g.i, g.j)"
    if measure == "maximum":
        return f"""{head}, {_CELL_WORDS}, r AS (SELECT pair_hash, i, j, avg(m) AS m FROM (SELECT pair_hash, i, j, k, max(c) AS m FROM cos GROUP BY ALL) GROUP BY ALL),
l AS (SELECT pair_hash, i, j, avg(m) AS m FROM (SELECT pair_hash, i, j, l, max(c) AS m FROM cos GROUP BY ALL) GROUP BY ALL),
sim AS (SELECT g.pair_hash, g.i, g.j, round(coalesce((r.m + l.m) / 2, 0), 10) AS sim FROM grid g LEFT JOIN r USING (pair_hash, i, j) LEFT JOIN l USING (pair_hash, i, j))"""
    return f"""{head}, {_CELL_WORDS}, r AS (SELECT pair_hash, i, j, k, min(l) AS l, any_value(c) AS c FROM (SELECT *, max(c) OVER (PARTITION BY pair_hash, i, j, k) AS m FROM cos) WHERE c = m GROUP BY pair_hash, i, j, k),
l AS (SELECT pair_hash, i, j, l, min(k) AS k, any_value(c) AS c FROM (SELECT *, max(c) OVER (PARTITION BY pair_hash, i, j, l) AS m FROM cos) WHERE c = m GROUP BY pair_hash, i, j, l),
kept AS (SELECT r.pair_hash, r.i, r.j, r.c FROM r JOIN l ON l.pair_hash = r.pair_hash AND l.i = r.i AND l.j = r.j AND l.l = r.l WHERE r.c > 0 AND l.k <> r.k UNION ALL SELECT pair_hash, i, j, c FROM l WHERE c > 0),
sim AS (SELECT g.pair_hash, g.i, g.j, round(coalesce(avg(k.c), 0), 10) AS sim FROM grid g LEFT JOIN kept k USING (pair_hash, i, j) GROUP BY g.pair_hash, g.i, g.j)"""


_SBERT = f"""{X.BASE}, coded AS (SELECT s.sent, CAST(e.embedding AS DOUBLE[]) AS v FROM (SELECT DISTINCT sent FROM sents) s
  JOIN embeddings e ON e.vec_id = CAST(('0x' || substr(md5(s.sent), 1, 8)) AS BIGINT) % (SELECT count(*) FROM embeddings)),
sv AS (SELECT s.fname, s.i, c.v FROM sents s JOIN coded c USING (sent)),
sa AS (SELECT p.pair_hash, s.i, s.v AS x FROM used p JOIN sv s ON s.fname = p.simple),
sb AS (SELECT p.pair_hash, s.i AS j, s.v AS y FROM used p JOIN sv s ON s.fname = p.standard),
sim AS (SELECT pair_hash, i, j, round(list_cosine_similarity(x, y), 10) AS sim FROM sa JOIN sb USING (pair_hash))"""

SIM_SQL = {m: _sparse_sql(m) for m in ("n_gram", "bag_of_words")} | {m: _vector_sql(m) for m in ("cosine", "average", "maximum", "cwasa")} | {"sbert": _SBERT}


class Inputs:
    """Sentences, pairs and what measures need, each defined once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        # Both are read many times below, so they are written once.
        self.sents = materialise(X.sents(spark, folder), "sents")
        self.pairs = materialise(X.used_pairs(X.pairs(spark, folder), self.sents), "pairs")

    # Similarities work on numbers of files instead of their long names.

    @cached_property
    def _files(self) -> DataFrame:
        return materialise(catalog.unnested(self.pairs).withColumn("f", F.monotonically_increasing_id()), "file_numbers")

    @cached_property
    def _sents(self) -> DataFrame:
        return materialise(self.sents.join(self._files, "fname").select(F.col("f").alias("fname"), "i", "sent"), "numbered_sents")

    @cached_property
    def _pairs(self) -> DataFrame:
        a, b = (self._files.select(F.col("fname").alias(c), F.col("f").alias(f"{c}_f")) for c in ("simple", "standard"))
        numbered = self.pairs.join(a, "simple").join(b, "standard")
        return materialise(numbered.select("pair_hash", F.col("simple_f").alias("simple"), F.col("standard_f").alias("standard")), "numbered_pairs")

    def _vectors(self) -> np.ndarray | None:
        """The vectors by number, if they are numbered without gaps, of one length, and few enough to be sent to every worker."""
        own = table(self.spark, self.folder, "embeddings", "vec_id", "embedding")
        size, whole = F.size("embedding"), ~F.exists("embedding", lambda x: x.isNull())
        row = own.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"), F.min(size).alias("short"), F.max(size).alias("long"), F.count_if(whole).alias("whole")).first()
        if not row.n or (row.ids, row.low, row.high, row.whole) != (row.n, 0, row.n - 1, row.n) or not row.long or row.short != row.long or 8 * row.n * row.long > MAX_BROADCAST:
            return None
        rows = own.toArrow().sort_by("vec_id")["embedding"].combine_chunks()
        return rows.flatten().to_numpy().astype(np.float64).reshape(row.n, row.long)

    def grid(self, find, measures: tuple[str, ...], strategies: tuple[str, ...], pairs: DataFrame) -> DataFrame | None:
        """What ``find`` of ``whole_grid`` finds in ``pairs`` in all configurations, from one kernel; None if what every worker must have is too large for that."""
        if (vectors := self._vectors()) is None:
            return None
        files = materialise(G.file_words(self.sents, catalog.unnested(self.pairs)), "file_words")
        counts = materialise(G.document_counts(files), "document_counts")
        if 16 * counts.count() > MAX_BROADCAST:
            return None
        counts = counts.toArrow()
        shared: Broadcast = self.spark.sparkContext.broadcast((vectors, [G.idf_table(counts, m) for m in range(len(G.BY_TERMS))]))
        return find(pairs, files, shared, measures, strategies, CONFIG_SDS)

    def sim(self, measure: str) -> DataFrame:
        measure = S.ALIASES.get(measure, measure)
        if measure in ("n_gram", "bag_of_words"):
            tokens = materialise(X.tokens(self._sents), "tokens")
            tf = materialise(W.word_tf(tokens) if measure == "bag_of_words" else W.ngram_tf(tokens), f"tf_{measure}")
            idf = materialise(W.idf(tf, catalog.unnested(self._pairs)), f"idf_{measure}")
            idf = bounded_broadcast(idf, 1_000_000, 4 * F.length("term") + 24)
            return S.sparse_similarity(self._pairs, self._sents, tokens, tf, idf, measure)
        vectors = table(self.spark, self.folder, "embeddings", "vec_id", "embedding")
        if measure == "sbert":
            return S.encoded_similarity(self._pairs, self._sents, vectors)
        tokens = materialise(X.tokens(self._sents, T.EMBEDDING), "tokens")
        vecs = S.word_vectors(tokens, vectors)
        if measure in ("cosine", "average"):
            dims = vectors.agg(F.max(F.size("embedding")).alias("d")).first().d or 0
            return S.vector_similarity(self._pairs, self._sents, tokens, vecs, dims, measure)
        return S.word_similarities(self._pairs, tokens, vecs, (measure,)).select("pair_hash", "i", "j", F.col(measure).alias("sim"))

    def written(self, measures: tuple[str, ...]) -> dict[str, DataFrame]:
        """Similarities by measure, each computed once and written; those by best words come from one run of their kernel."""
        by_words = [m for m in measures if m in S.BY_WORDS]
        if len(by_words) > 1:
            tokens = materialise(X.tokens(self._sents, T.EMBEDDING), "tokens")
            vecs = S.word_vectors(tokens, table(self.spark, self.folder, "embeddings", "vec_id", "embedding"))
            all_ = materialise(S.word_similarities(self._pairs, tokens, vecs, tuple(by_words)), "sim_by_words")
            own = {m: all_.select("pair_hash", "i", "j", F.col(m).alias("sim")) for m in by_words}
        else:
            own = {}
        return {m: own[m] if m in own else materialise(self.sim(m), f"sim_{m}") for m in measures}


def _sim(measure: str, spark: SparkSession, folder: str) -> DataFrame:
    return Inputs(spark, folder).sim(measure).withColumn("sim", F.round("sim", 6))


for _m in S.MEASURES:
    add(f"sim_{_m}", f"{SIM_SQL[_m]} SELECT pair_hash, i, j, round(sim, 6) AS sim FROM sim" if _m in SIM_SQL else None)(partial(_sim, _m))


def match_sql(sim: str, sd: float, out: str, name: str = "sim") -> str:
    """CTEs that give the best matches of ``name`` as ``out``."""
    thr = f"CASE WHEN isnan(x) OR x IS NULL THEN 0.0 ELSE greatest(round(x, 10), 0.0) END" if sd else "0.0"
    return f"""{sim}, {out}_t AS (SELECT pair_hash, {thr} AS thr FROM (SELECT pair_hash, avg(sim) + {sd} * stddev_pop(sim) AS x FROM {name} GROUP BY pair_hash)),
{out} AS (SELECT pair_hash, i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair_hash, i ORDER BY sim DESC, j) AS rn FROM {name}) JOIN {out}_t USING (pair_hash) WHERE rn = 1 AND sim > thr)"""


def ordered_sql(sim: str, sd: float, out: str, name: str = "sim", fix: bool = False) -> str:
    """CTEs that give the order-preserving matches of ``name`` as ``out``.

    The longest run is found with a list of smallest tails per match and followed back; then every gap is walked by itself, from the column
    taken last to that of the next fixed match.
    """
    sql = materialised(match_sql(sim, sd, f"{out}_b", name)).replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{sql},
{out}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_hash ORDER BY i) - 1 AS k FROM {out}_b),
{out}_n AS (SELECT pair_hash, -1 AS k, CAST([] AS BIGINT[]) AS tails, CAST(0 AS BIGINT) AS size, CAST(-1 AS BIGINT) AS j FROM {out}_o WHERE k = 0
  UNION ALL SELECT o.pair_hash, o.k, list_concat(list_filter(n.tails, lambda x: x <= o.j), [CAST(o.j AS BIGINT)], list_filter(n.tails, lambda x: x > o.j)[2:]), 1 + len(list_filter(n.tails, lambda x: x <= o.j)), o.j
  FROM {out}_n n JOIN {out}_o o ON o.pair_hash = n.pair_hash AND o.k = n.k + 1),
{out}_p AS (SELECT a.pair_hash, a.k, max(b.k) AS before FROM {out}_n a JOIN {out}_n b ON b.pair_hash = a.pair_hash AND b.k < a.k AND b.size = a.size - 1 AND b.j <= a.j WHERE b.k >= 0 GROUP BY a.pair_hash, a.k),
{out}_k AS (SELECT pair_hash, min(k) AS k FROM (SELECT *, max(size) OVER (PARTITION BY pair_hash) AS top FROM {out}_n) WHERE size = top GROUP BY pair_hash
  UNION ALL SELECT p.pair_hash, p.before FROM {out}_k c JOIN {out}_p p ON p.pair_hash = c.pair_hash AND p.k = c.k),
{out}_f AS MATERIALIZED (SELECT o.* FROM {out}_o o JOIN {out}_k USING (pair_hash, k)),
{out}_w AS (SELECT pair_hash, max(j) AS last FROM {name} GROUP BY pair_hash),
{out}_g AS (SELECT o.pair_hash, o.i, o.k, coalesce(max(f.k) FILTER (f.k < o.k), -1) AS gap, coalesce(max(f.j) FILTER (f.k < o.k), 0) AS low, coalesce(min(f.j) FILTER (f.k > o.k), any_value(w.last)) AS high
  FROM {out}_o o JOIN {out}_f f USING (pair_hash) JOIN {out}_w w USING (pair_hash) GROUP BY o.pair_hash, o.i, o.k HAVING count(*) FILTER (f.k = o.k) = 0),
{out}_l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_hash, gap ORDER BY k) AS s FROM {out}_g JOIN {out}_b_t USING (pair_hash)),
{out}_s AS (SELECT pair_hash, gap, CAST(0 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS i, CAST(low AS BIGINT) AS edge, false AS taken FROM {out}_l WHERE s = 1
  UNION ALL SELECT pair_hash, gap, s, i, CASE WHEN top.v > thr THEN -top.b ELSE edge END, top.v > thr FROM (
    SELECT l.pair_hash, l.gap, l.s, l.i, any_value(x.edge) AS edge, any_value(l.thr) AS thr, max(struct_pack(v := CASE WHEN isnan(c.sim) THEN '-inf'::DOUBLE ELSE c.sim END, b := CAST(-c.j AS BIGINT))) AS top
    FROM {out}_s x JOIN {out}_l l ON l.pair_hash = x.pair_hash AND l.gap = x.gap AND l.s = x.s + 1 JOIN {name} c ON c.pair_hash = l.pair_hash AND c.i = l.{'i' if fix else 'k'} AND c.j BETWEEN x.edge AND l.high GROUP BY l.pair_hash, l.gap, l.s, l.i)),
{out} AS MATERIALIZED (SELECT pair_hash, i, j, sim FROM {out}_f UNION ALL SELECT c.pair_hash, c.i, c.j, c.sim FROM {out}_s x JOIN {name} c ON c.pair_hash = x.pair_hash AND c.i = x.i AND c.j = x.edge JOIN {out}_b_t t ON t.pair_hash = c.pair_hash WHERE x.taken AND c.sim > t.thr)"""


_SELECT = "SELECT pair_hash, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sim, 6) AS sim FROM m"


def _matches(measure: str, strategy: str, sd: float, fix: bool, spark: SparkSession, folder: str) -> DataFrame:
    # Read for thresholds and for matches, so computed once.
    sim = materialise(Inputs(spark, folder).sim(measure), f"sim_{measure}")
    found = A.ordered_matches(sim, sd, fix_row_index=fix) if strategy == "lis" else A.best_matches(sim, sd)
    return found.withColumn("sim", F.round("sim", 6))


for _sd, _tag in ((0.0, "00"), (1.5, "15")):
    add(f"match_max_{_tag}", match_sql(SIM_SQL["bag_of_words"], _sd, "m") + _SELECT)(partial(_matches, "bag_of_words", "max", _sd, False))
    add(f"match_lis_{_tag}", ordered_sql(SIM_SQL["bag_of_words"], _sd, "m") + _SELECT)(partial(_matches, "bag_of_words", "lis", _sd, False))
add("match_lis_fixed", ordered_sql(SIM_SQL["bag_of_words"], 1.5, "m", fix=True) + _SELECT)(partial(_matches, "bag_of_words", "lis", 1.5, True))
add("match_max_sbert", match_sql(_SBERT, 1.5, "m") + _SELECT)(partial(_matches, "sbert", "max", 1.5, False))


@add(
    "lis_length",
    match_sql(SIM_SQL["bag_of_words"], 0.0, "m")
    + """, s AS (SELECT pair_hash, list(list_value(j) ORDER BY i) AS js FROM m GROUP BY pair_hash)
SELECT pair_hash, CAST(len(list_reduce(js, lambda t, x: list_concat(list_filter(t, lambda y: y <= x[1]), x, list_filter(t, lambda y: y > x[1])[2:]))) AS INTEGER) AS longest FROM s""",
)
def lis_length(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the longest order-preserving part of each pair's matches, by a fold over the smallest tails."""
    found = A.best_matches(materialise(Inputs(spark, folder).sim("bag_of_words"), "sim_bag_of_words"), 0.0)
    js = found.groupBy("pair_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: x.j).alias("js"))
    tails = F.aggregate(
        "js", F.array().cast("array<int>"), lambda t, j: F.concat(F.filter(t, lambda x: x <= j), F.array(j), F.slice(F.filter(t, lambda x: x > j), 2, 1_000_000_000))
    )
    return js.select("pair_hash", F.size(tails).alias("longest"))


@add("quarantine_pairs", f"WITH {X.PAIRS}, {X.SENTS} SELECT pair_hash, simple, standard, CASE WHEN standard NOT IN (SELECT fname FROM sents) THEN 'standard side empty' ELSE 'simple side empty' END AS reason FROM pairs WHERE standard NOT IN (SELECT fname FROM sents) OR simple NOT IN (SELECT fname FROM sents)")
def quarantine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that cannot be aligned, and why."""
    return A.unusable_pairs(X.pairs(spark, folder), X.sents(spark, folder))


_GRID_MEASURES = ("bag_of_words", "sbert")


def _grid_sql() -> str:
    """All matches of two measures at both thresholds, with sentences and sites."""
    sbert = _SBERT.split(", coded AS", 1)[1].replace("sim AS (", "sim_b AS (", 1)
    sql = SIM_SQL["bag_of_words"] + ", coded AS" + sbert
    parts = []
    for measure, name in zip(_GRID_MEASURES, ("sim", "sim_b")):
        for sd in CONFIG_SDS:
            out = f"m_{measure}_{int(sd * 10)}"
            sql = match_sql(sql, sd, out, name)
            parts.append(f"SELECT pair_hash, '{measure}' AS measure, 'max' AS strategy, CAST({sd} AS DOUBLE) AS sd, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sim FROM {out}")
    return f"{sql}, found AS ({' UNION ALL '.join(parts)})"


GRID_SQL = _grid_sql()
FULL_SQL = GRID_SQL + ", full_ AS (SELECT f.*, p.site, p.simple, p.standard, a.sent AS simple_sent, b.sent AS normal_sent FROM found f JOIN used p USING (pair_hash) JOIN sents a ON a.fname = p.simple AND a.i = f.i JOIN sents b ON b.fname = p.standard AND b.i = f.j)"


def grid_matches(spark: SparkSession, folder: str, strategies: tuple[str, ...] = ("max",), measures: tuple[str, ...] = _GRID_MEASURES, only: str = "") -> tuple[Inputs, DataFrame]:
    """Matches of all configurations: of many measures from one kernel, else each similarity is computed once and written, for all of its configurations.

    Frequencies are always those of all files. Of pairs without verdicts (``only`` is "judged") or with all of them ("open") matches may be left out.
    """
    inputs, found = Inputs(spark, folder), None
    if len(measures) > len(_GRID_MEASURES):
        pairs = inputs.pairs
        if only == "judged":
            pairs = pairs.join(table(spark, folder, "judgments", "pair_hash").distinct(), "pair_hash", "left_semi")
        elif only == "open":
            pairs = pairs.join(_finished(spark, folder), "pair_hash", "left_anti")
        found = inputs.grid(G.matches, measures, strategies, pairs)
    return inputs, A.all_matches(inputs.written(measures), CONFIG_SDS, strategies) if found is None else found


#: A result set is one configuration of a file pair.
_RESULT_SET = ("pair_hash", "measure", "strategy", "sd")


def grid_tallies(spark: SparkSession, folder: str, strategies: tuple[str, ...], measures: tuple[str, ...]) -> tuple[Inputs, DataFrame]:
    """Number of matches and sum of their similarities of each result set that has any; of the whole grid counted where they are found."""
    inputs = Inputs(spark, folder)
    found = inputs.grid(G.tallies, measures, strategies, inputs.pairs) if len(measures) > len(_GRID_MEASURES) else None
    if found is None:
        found = A.all_matches(inputs.written(measures), CONFIG_SDS, strategies).groupBy(*_RESULT_SET).agg(F.count("*").alias("n"), F.sum("sim").alias("total"))
    return inputs, found


def grid_matched(spark: SparkSession, folder: str, strategies: tuple[str, ...], measures: tuple[str, ...]) -> tuple[Inputs, DataFrame]:
    """The result sets that have matches, each once; of the whole grid without looking for the matches in order."""
    inputs = Inputs(spark, folder)
    found = inputs.grid(G.matched, measures, strategies, inputs.pairs) if len(measures) > len(_GRID_MEASURES) else None
    if found is None:
        found = A.all_matches(inputs.written(measures), CONFIG_SDS, strategies).select(*_RESULT_SET).distinct()
    return inputs, found


def _finished(spark: SparkSession, folder: str) -> DataFrame:
    """File pairs with more than a dozen verdicts and none open."""
    done = table(spark, folder, "judgments", "pair_hash", "verdict").groupBy("pair_hash").agg(F.count("*").alias("n"), F.count("verdict").alias("v"))
    return done.filter("n = v AND n > 12").select("pair_hash")


#: Strategies and measures of the part of the grid that SQL can say in time, and of the whole one.
_PART, WHOLE = (("max",), _GRID_MEASURES), (tuple(A.STRATEGIES), S.MEASURES)


def _configs(grid: tuple = _PART) -> list[E.Config]:
    strategies, measures = grid
    return [(m, s, sd) for m in measures for s in strategies for sd in CONFIG_SDS]


@add("matching_grid", GRID_SQL + " SELECT pair_hash, measure, strategy, sd, i, j, round(sim, 6) AS sim FROM found")
def matching_grid(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Matches of several measures at both thresholds."""
    return grid_matches(spark, folder, *grid)[1].withColumn("sim", F.round("sim", 6))


@add("matching_grid_full")
def matching_grid_full(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of matches in the full grid: eight measures, two strategies, two thresholds."""
    _, found = grid_tallies(spark, folder, *WHOLE)
    n = F.sum("n")
    return found.groupBy("measure", "strategy", "sd").agg(n.alias("n"), F.round(F.sum("total") / n, 6).alias("mean_sim"))


def exported(spark: SparkSession, folder: str, production: bool) -> tuple[Inputs, DataFrame]:
    """The matches that are exported: of the configuration that SQL can say, or of the published corpus (maximum, in order, 1.5 deviations)."""
    inputs = Inputs(spark, folder)
    sim = materialise(inputs.sim("maximum" if production else "bag_of_words"), "sim_exported")
    return inputs, A.ordered_matches(sim, 1.5) if production else A.best_matches(sim, 1.5)


@add(
    "alignment_export",
    FULL_SQL + " SELECT standard, j, list(struct_pack(simple := simple, i := i, simple_sent := simple_sent, normal_sent := normal_sent, dist := round(sim, 6)) ORDER BY simple, i) AS aligned FROM full_ WHERE measure = 'bag_of_words' AND sd = 1.5 GROUP BY standard, j",
)
def alignment_export(spark: SparkSession, folder: str, production: bool = False) -> DataFrame:
    """The exported corpus, nested by standard sentence."""
    inputs, found = exported(spark, folder, production)
    return A.export(A.with_sentences(found.withColumn("sim", F.round("sim", 6)), inputs.pairs, inputs.sents))


@add("alignment_lines", FULL_SQL + " SELECT pair_hash, i, simple_sent, normal_sent FROM full_ WHERE measure = 'bag_of_words' AND sd = 1.5")
def alignment_lines(spark: SparkSession, folder: str, production: bool = False) -> DataFrame:
    """The exported corpus as parallel lines."""
    inputs, found = exported(spark, folder, production)
    return A.with_sentences(found, inputs.pairs, inputs.sents).select("pair_hash", "i", "simple_sent", "normal_sent")


_STATS = GRID_SQL + ", configs AS (SELECT DISTINCT measure, strategy, sd FROM (VALUES ('bag_of_words', 'max', 0.0::DOUBLE), ('bag_of_words', 'max', 1.5::DOUBLE), ('sbert', 'max', 0.0::DOUBLE), ('sbert', 'max', 1.5::DOUBLE)) t(measure, strategy, sd)), stats AS (SELECT u.pair_hash, c.measure, c.strategy, c.sd, count(f.i) AS n, coalesce(avg(f.sim), 0) AS mean_sim FROM used u CROSS JOIN configs c LEFT JOIN found f USING (pair_hash, measure, strategy, sd) GROUP BY ALL)"


@add("match_stats", _STATS + " SELECT pair_hash, measure, strategy, sd, n, round(mean_sim, 6) AS mean_sim FROM stats")
def match_stats(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Matches of each pair and configuration."""
    inputs, found = grid_matches(spark, folder, *grid)
    return E.match_statistics(found, inputs.pairs, _configs(grid)).withColumn("mean_sim", F.round("mean_sim", 6))


@add(
    "match_stats_grouping_sets",
    _STATS + " SELECT measure, strategy, sd, CAST(grouping(measure, strategy, sd) AS BIGINT) AS level, round(avg(n), 6) AS mean_n, round(avg(mean_sim), 6) AS mean_sim, CAST(sum(n) AS BIGINT) AS total_n FROM stats GROUP BY GROUPING SETS ((measure), (strategy), (sd), (measure, strategy, sd))",
)
def match_stats_grouping_sets(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """The same by measure, strategy, threshold and all three."""
    inputs, found = grid_tallies(spark, folder, *grid)
    return E.grouped_statistics(E.tally_statistics(found, inputs.pairs, _configs(grid)))


_TRUTH = f"{X.VERDICTS}, truth AS (SELECT pair_hash, simple_sent, max(normal_sent) AS normal_sent FROM verdicts WHERE verdict GROUP BY pair_hash, simple_sent)"


def _grid_with_verdicts(spark: SparkSession, folder: str, grid: tuple = _PART) -> tuple[DataFrame, DataFrame]:
    inputs, found = _grid_of(spark, folder, grid, "judged")
    verdicts = E.last_verdicts(table(spark, folder, "judgments"))
    return A.with_sentences(found, inputs.pairs, inputs.sents), verdicts


def _grid_of(spark: SparkSession, folder: str, grid: tuple, only: str) -> tuple[Inputs, DataFrame]:
    """The grid, of the whole one only what is needed."""
    return grid_matches(spark, folder, *grid, *([only] if grid == WHOLE else []))


def _grid_with_judged(spark: SparkSession, folder: str, grid: tuple) -> tuple[Inputs, DataFrame, DataFrame, DataFrame]:
    """Inputs, matches, verdicts, and verdicts by cell."""
    inputs, found = _grid_of(spark, folder, grid, "judged")
    verdicts = E.last_verdicts(table(spark, folder, "judgments"))
    return inputs, found, verdicts, materialise(E.verdict_cells(verdicts, inputs.pairs, inputs.sents), "verdict_cells")


@add(
    "gt_prf",
    f"{FULL_SQL}, {_TRUTH}, configs AS (SELECT DISTINCT measure, strategy, sd FROM found), size AS (SELECT pair_hash, count(*) AS e FROM truth GROUP BY pair_hash),"
    " own AS (SELECT f.pair_hash, f.measure, f.strategy, f.sd, count(*) AS a, count(*) FILTER (f.normal_sent = t.normal_sent) AS c FROM full_ f LEFT JOIN truth t USING (pair_hash, simple_sent) GROUP BY ALL),"
    " s AS (SELECT c.measure, c.strategy, c.sd, CASE WHEN o.c > 0 THEN o.c / o.a ELSE 0 END AS p, CASE WHEN o.c > 0 THEN o.c / z.e ELSE 0 END AS r, CASE WHEN o.c > 0 THEN 2 * o.c / (o.a + z.e) ELSE 0 END AS f FROM size z CROSS JOIN configs c LEFT JOIN own o USING (pair_hash, measure, strategy, sd))"
    " SELECT measure, strategy, sd, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM s GROUP BY measure, strategy, sd",
)
def gt_prf(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Precision, recall and F1 against pairs that people hold right, averaged over file pairs."""
    found, verdicts = _grid_with_verdicts(spark, folder, grid)
    truth = verdicts.filter("verdict").groupBy("pair_hash", "simple_sent").agg(F.max("normal_sent").alias("normal_sent"))
    return E.macro_means(E.precision_recall(found, truth, _configs(grid)))


@add(
    "judgment_prf",
    f"{FULL_SQL}, {X.VERDICTS}, pos AS (SELECT pair_hash, count(*) FILTER (verdict) AS p FROM verdicts GROUP BY pair_hash),"
    " s AS (SELECT f.pair_hash, f.measure, f.strategy, f.sd, coalesce(count(*) FILTER (v.verdict) / nullif(count(v.verdict), 0), 0) AS p, coalesce(count(*) FILTER (v.verdict) / nullif(any_value(pos.p), 0), 0) AS r FROM full_ f JOIN pos USING (pair_hash) LEFT JOIN verdicts v USING (pair_hash, simple_sent, normal_sent) GROUP BY ALL),"
    " m AS (SELECT measure, strategy, sd, avg(p) AS p, avg(r) AS r FROM s GROUP BY ALL)"
    " SELECT measure, strategy, sd, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m",
)
def judgment_prf(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Precision and recall by verdicts; F1 of the means."""
    _, found, verdicts, cells = _grid_with_judged(spark, folder, grid)
    return E.judged_means(E.judged_scores(found, verdicts, cells))


@add(
    "judgment_sims",
    f"{FULL_SQL}, {X.VERDICTS} SELECT measure, round(avg(sim) FILTER (verdict), 6) AS sim_right, round(avg(sim) FILTER (NOT verdict), 6) AS sim_wrong, CAST(count(*) FILTER (verdict) AS BIGINT) AS n_right, CAST(count(*) FILTER (NOT verdict) AS BIGINT) AS n_wrong FROM full_ JOIN verdicts USING (pair_hash, simple_sent, normal_sent) WHERE verdict IS NOT NULL GROUP BY measure",
)
def judgment_sims(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Mean similarity of right and of wrong matches."""
    _, found, _, cells = _grid_with_judged(spark, folder, grid)
    return E.judged_similarities(found, cells, E.CELL)


_BY_SITE = f"{FULL_SQL}, {X.VERDICTS}, s AS (SELECT f.site, f.measure, f.strategy, f.sd, avg(CAST(coalesce(v.verdict, false) AS INTEGER)) AS precision FROM full_ f LEFT JOIN verdicts v USING (pair_hash, simple_sent, normal_sent) WHERE f.sd = 1.5 AND f.pair_hash IN (SELECT pair_hash FROM verdicts) GROUP BY ALL)"


def _by_site(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    inputs, found, verdicts, cells = _grid_with_judged(spark, folder, grid)
    judged = inputs.pairs.join(verdicts.select("pair_hash").distinct(), "pair_hash", "left_semi")
    return E.precision_by_site(found.filter("sd = 1.5"), cells, judged, E.CELL)


@add("precision_by_site", _BY_SITE + " SELECT site, measure, strategy, round(precision, 6) AS precision FROM s")
def precision_by_site(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Precision per site, a missing verdict being wrong."""
    return _by_site(spark, folder, grid).withColumn("precision", F.round("precision", 6))


@add("precision_pivot", _BY_SITE + " SELECT measure, round(avg(precision) FILTER (strategy = 'max'), 6) AS \"max\" FROM s GROUP BY measure")
def precision_pivot(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Mean precision over sites, strategies as columns."""
    return E.strategy_pivot(_by_site(spark, folder, grid), list(grid[0]))


@add("positive_verdicts", f"WITH {X.VERDICTS} SELECT pair_hash, CAST(count(*) FILTER (verdict) AS BIGINT) AS positive FROM verdicts GROUP BY pair_hash")
def positive_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Right pairs of sentences per file pair."""
    return E.last_verdicts(table(spark, folder, "judgments")).groupBy("pair_hash").agg(F.count_if("verdict").alias("positive"))


@add("last_verdicts", f"WITH {X.VERDICTS} SELECT * FROM verdicts")
def last_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict that counts for each pair of sentences."""
    return E.last_verdicts(table(spark, folder, "judgments"))


@add(
    "next_unjudged",
    f"{FULL_SQL}, {X.VERDICTS}, fin AS (SELECT pair_hash FROM judgments GROUP BY pair_hash HAVING count(*) = count(verdict) AND count(*) > 12) SELECT DISTINCT pair_hash, simple_sent, normal_sent FROM full_ WHERE sd = 1.5 AND pair_hash NOT IN (SELECT pair_hash FROM fin) AND (pair_hash, simple_sent, normal_sent) NOT IN (SELECT (pair_hash, simple_sent, normal_sent) FROM verdicts)",
)
def next_unjudged(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Candidates of the stricter threshold that still need a verdict; a file pair counts as finished with more than a dozen verdicts and none open."""
    inputs, found = _grid_of(spark, folder, grid, "open")
    # A cell that several configurations find gets its sentences once.
    cells = found.filter("sd = 1.5").select("pair_hash", "i", "j").distinct()
    return E.next_unjudged(A.with_sentences(cells, inputs.pairs, inputs.sents), E.last_verdicts(table(spark, folder, "judgments")), _finished(spark, folder))


@add(
    "matched_skip",
    f"{_STATS}, done AS (SELECT pair_hash FROM stats WHERE n > 0 GROUP BY pair_hash HAVING count(*) = 4) SELECT pair_hash FROM used WHERE pair_hash NOT IN (SELECT pair_hash FROM done)",
)
def matched_skip(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Pairs that lack a result of at least one configuration and have to be matched again."""
    inputs, found = grid_matched(spark, folder, *grid)
    done = found.groupBy("pair_hash").agg(F.count("*").alias("n"))
    return inputs.pairs.join(done.filter(F.col("n") == len(grid[0]) * len(grid[1]) * len(CONFIG_SDS)), "pair_hash", "left_anti").select("pair_hash")


@add(
    "matching_header",
    FULL_SQL + " SELECT simple, list_sort(list(DISTINCT 'results/matched/' || pair_hash || '--' || measure || '--' || strategy || '--' || format('{:.1f}', sd) || '.matches')) AS results FROM full_ GROUP BY simple",
)
def matching_header(spark: SparkSession, folder: str, grid: tuple = _PART) -> DataFrame:
    """Per simple file the names of all of its result sets."""
    inputs, found = grid_matched(spark, folder, *grid)
    named = found.join(inputs.pairs.select("pair_hash", "simple"), "pair_hash")
    path = urls.matches_path("results/matched", F.col("pair_hash"), F.col("measure"), F.col("strategy"), F.col("sd"))
    return named.groupBy("simple").agg(F.array_sort(F.collect_set(path)).alias("results"))


# The queries above over the whole grid of 32 configurations.
for _query in (matching_grid, match_stats, match_stats_grouping_sets, gt_prf, judgment_prf, judgment_sims, precision_by_site, precision_pivot, next_unjudged, matched_skip, matching_header):
    add(f"{_query.__name__}_whole")(partial(_query, grid=WHOLE))


@add("site_judgments", f"WITH {X.PAIRS} SELECT DISTINCT judgment_id FROM judgments WHERE pair_hash IN (SELECT pair_hash FROM pairs WHERE site = 'www.stadt-lindental.example')")
def site_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on file pairs of one site."""
    own = X.pairs(spark, folder).filter(F.col("site") == "www.stadt-lindental.example").select("pair_hash")
    return table(spark, folder, "judgments", "judgment_id", "pair_hash").join(own, "pair_hash", "left_semi").select("judgment_id").distinct()


@add("aligned_counts", f"{FULL_SQL}, f AS (SELECT site, pair_hash, count(DISTINCT simple_sent) AS s, count(DISTINCT normal_sent) AS n FROM full_ WHERE measure = 'bag_of_words' AND sd = 1.5 GROUP BY ALL) SELECT site, CAST(sum(s) AS BIGINT) AS simple_sentences, CAST(sum(n) AS BIGINT) AS standard_sentences FROM f GROUP BY ROLLUP (site)")
def aligned_counts(spark: SparkSession, folder: str, production: bool = False) -> DataFrame:
    """Aligned sentences per site and of all."""
    inputs, found = exported(spark, folder, production)
    return E.aligned_counts(A.with_sentences(found, inputs.pairs, inputs.sents))


# The same of the published corpus's configuration.
_PRODUCTION = (
    ordered_sql(SIM_SQL["maximum"], 1.5, "m")
    + ", full_ AS MATERIALIZED (SELECT f.*, p.site, p.simple, p.standard, a.sent AS simple_sent, b.sent AS normal_sent, 'bag_of_words' AS measure, 1.5 AS sd FROM m f JOIN used p USING (pair_hash) JOIN sents a ON a.fname = p.simple AND a.i = f.i JOIN sents b ON b.fname = p.standard AND b.i = f.j)"
)
for _query in (alignment_export, alignment_lines, aligned_counts):
    _tail = registry.oracles[_query.__name__].removeprefix(materialised(FULL_SQL))
    add(f"{_query.__name__}_production", _PRODUCTION + _tail)(partial(_query, production=True))


_LENGTHS = f"""{X.BASE}, {X.tokens_sql()}, sides AS (SELECT DISTINCT simple AS fname, 'simple' AS side, site FROM used UNION SELECT DISTINCT standard, 'standard', site FROM used),
d AS (SELECT s.fname, sum(length(s.sent)) AS chars, count(*) AS sentences, avg(length(s.sent)) AS chars_sentence, avg(len(t.words)) AS words_sentence FROM sents s JOIN tokens t USING (fname, i) GROUP BY s.fname),
w AS (SELECT fname, count(DISTINCT word) AS different_words, avg(length(word)) AS word_length FROM (SELECT fname, unnest(words) AS word FROM tokens) GROUP BY fname),
v AS (SELECT sides.side, sides.site, d.*, w.different_words, w.word_length FROM sides JOIN d USING (fname) JOIN w USING (fname)),
l AS (UNPIVOT (SELECT side, site, CAST(chars AS DOUBLE) AS chars, CAST(sentences AS DOUBLE) AS sentences, CAST(chars_sentence AS DOUBLE) AS chars_sentence, CAST(words_sentence AS DOUBLE) AS words_sentence, CAST(different_words AS DOUBLE) AS different_words, CAST(word_length AS DOUBLE) AS word_length FROM v) ON chars, sentences, chars_sentence, words_sentence, different_words, word_length INTO NAME what VALUE v)"""
_LENGTH_COLUMNS = ["chars", "sentences", "chars_sentence", "words_sentence", "different_words", "word_length"]
_LENGTH_OUT = "what, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(median(v), 6) AS median, count(*) AS n FROM l"


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    inputs = Inputs(spark, folder)
    tokens = X.tokens(inputs.sents)
    both = inputs.pairs.select("site", F.explode(F.array(F.struct(F.col("simple").alias("fname"), F.lit("simple").alias("side")), F.struct(F.col("standard").alias("fname"), F.lit("standard").alias("side")))).alias("x"))
    sides = both.select("site", "x.fname", "x.side").distinct()
    size = F.length("sent")
    files = inputs.sents.join(tokens, ["fname", "i"]).groupBy("fname").agg(
        F.sum(size).alias("chars"), F.count("*").alias("sentences"), F.avg(size).alias("chars_sentence"), F.avg(F.size("words")).alias("words_sentence")
    )
    words = tokens.select("fname", F.explode("words").alias("word")).groupBy("fname").agg(F.countDistinct("word").alias("different_words"), F.avg(F.length("word")).alias("word_length"))
    return sides.join(files, "fname").join(words, "fname")


@add("corpus_stats", f"{_LENGTHS} SELECT side, {_LENGTH_OUT} GROUP BY side, what")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of texts, sentences and words on both sides."""
    return E.length_statistics(_lengths(spark, folder), ["side"], _LENGTH_COLUMNS)


@add("corpus_stats_by_source", f"{_LENGTHS} SELECT site, side, {_LENGTH_OUT} GROUP BY site, side, what")
def corpus_stats_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The same per site."""
    return E.length_statistics(_lengths(spark, folder), ["site", "side"], _LENGTH_COLUMNS)


@add(
    "length_histogram",
    f"{X.BASE}, b AS (SELECT CASE WHEN c BETWEEN 0 AND 20000 THEN CAST(least(floor(c / 1000), 19) AS INTEGER) END AS bin FROM (SELECT sum(length(sent)) AS c FROM sents GROUP BY fname)) SELECT bin, count(*) AS n FROM b GROUP BY bin",
)
def length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by length in twenty bins."""
    sizes = X.sents(spark, folder).groupBy("fname").agg(F.sum(F.length("sent")).alias("c"))
    return sizes.select(E.histogram(F.col("c"), 0.0, 20000.0, 20).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


_SIDES = f"""{X.BASE}, {X.tokens_sql()}, sides AS (SELECT DISTINCT simple AS fname, 'simple' AS side FROM used UNION SELECT DISTINCT standard, 'standard' FROM used),
words AS (SELECT s.side, t.fname, unnest(t.words) AS word FROM tokens t JOIN sides s USING (fname))"""


def _side_words(spark: SparkSession, folder: str) -> DataFrame:
    """(side, fname, word) of the words of both sides."""
    inputs = Inputs(spark, folder)
    both = inputs.pairs.select(F.explode(F.array(F.struct(F.col("simple").alias("fname"), F.lit("simple").alias("side")), F.struct(F.col("standard").alias("fname"), F.lit("standard").alias("side")))).alias("x"))
    return X.tokens(inputs.sents).join(both.select("x.*").distinct(), "fname").select("side", "fname", F.explode("words").alias("word"))


@add(
    "words_histogram",
    f"{_SIDES}, b AS (SELECT side, CASE WHEN c <= 3000 THEN CAST(least(floor(c / 150), 19) AS INTEGER) END AS bin FROM (SELECT side, fname, count(DISTINCT word) AS c FROM words GROUP BY side, fname)) SELECT side, bin, count(*) AS n FROM b GROUP BY side, bin",
)
def words_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of either side by their different words, in twenty bins."""
    sizes = _side_words(spark, folder).groupBy("side", "fname").agg(F.countDistinct("word").alias("c"))
    return sizes.select("side", E.histogram(F.col("c"), 0.0, 3000.0, 20).alias("bin")).groupBy("side", "bin").agg(F.count("*").alias("n"))


@add(
    "word_length_histogram",
    f"{_SIDES}, b AS (SELECT side, CASE WHEN length(word) <= 25 THEN CAST(least(floor(length(word) / 2.5), 9) AS INTEGER) END AS bin FROM words) SELECT side, bin, count(*) AS n FROM b GROUP BY side, bin",
)
def word_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Words of either side by their length, in ten bins."""
    words = _side_words(spark, folder)
    return words.select("side", E.histogram(F.length("word"), 0.0, 25.0, 10).alias("bin")).groupBy("side", "bin").agg(F.count("*").alias("n"))


@add(
    "similarity_histogram",
    f"{FULL_SQL}, {X.VERDICTS}, b AS (SELECT v.verdict, CAST(least(floor((f.sim - 0) / 0.05), 19) AS INTEGER) AS bin FROM full_ f JOIN verdicts v USING (pair_hash, simple_sent, normal_sent) WHERE f.measure = 'bag_of_words' AND f.sd = 0 AND v.verdict IS NOT NULL) SELECT verdict, bin, count(*) AS n FROM b GROUP BY verdict, bin",
)
def similarity_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Similarities of right and wrong matches in twenty bins."""
    found, verdicts = _grid_with_verdicts(spark, folder)
    hit = found.filter("measure = 'bag_of_words' AND sd = 0").join(verdicts.filter(F.col("verdict").isNotNull()), ["pair_hash", "simple_sent", "normal_sent"])
    return hit.select("verdict", E.histogram(F.col("sim"), 0.0, 1.0, 20).alias("bin")).groupBy("verdict", "bin").agg(F.count("*").alias("n"))


@add("measure_labels", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{x}')" for m, x in S.LABELS.items()) + ") t(measure, label)")
def measure_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names that reports print for measures."""
    return spark.createDataFrame(list(S.LABELS.items()), "measure string, label string")
