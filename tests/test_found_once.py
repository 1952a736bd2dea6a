"""The whole grid finds no more than a query asks for."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry
from lingualoom.functions import text as X
from lingualoom.operators import align as A
from lingualoom.operators import similarity as S
from lingualoom.operators import whole_grid as G
from lingualoom.sources import files


def test_best_words_that_differ_are_the_assignment():
    queue, unit = G._Assignments(), np.eye(4)
    ends = np.array([0, 2, 4])
    out = G._by_words(unit, ends, unit[[1, 0, 3, 2]], ends, ("bipartite",), queue)
    # In the cells of zeros all words have the same best word, so these are queued and still right.
    queue.run()
    assert out["bipartite"].tolist() == [[1, 0], [0, 1]]
    only = G._by_words(unit[:2], ends[:2], unit[[1, 0]], ends[:2], ("bipartite",), queue)
    assert not queue.held and only["bipartite"].tolist() == [[1]]


def test_words_are_those_of_the_cleanings(spark):
    texts = ["", "  a  b ", "Web-Site der Leser*innen und Leser:in", "LeserInnen -A--B -Cd", "ΑΣ'Α ΣΑΣ", "İstanbul İ-İ x", "a\u00a0b\tc", "MitarbeiterIn*in:innen", "eine_in-Axe", "Ⅻ ß ẞ ǅ \U0001d400"]
    rows = G.cleaned_words(spark.createDataFrame([(x,) for x in texts], "sent string"), "sent")
    join = lambda o: F.array_join(F.regexp_extract_all(X.clean(F.col("sent"), o), F.lit(X.WORDLIKE + "+"), F.lit(0)), " ")
    for r in rows.select("sent", "g", "e", join(X.GRAM).alias("g2"), join(X.EMBEDDING).alias("e2")).collect():
        assert (r.g, r.e) == (r.g2, r.e2), r.sent


@pytest.mark.parametrize("block", [8_000_000, 16])
def test_files_with_each_term(monkeypatch, block):
    monkeypatch.setattr(G, "_BLOCK", block)
    terms = [np.array(x, np.int64) for x in ([5, 5, -1], [], [7], [7, 5], [9] * 40)]
    t, n, has = G._files_with(lambda k: (None, terms[k]), len(terms))
    assert (t.tolist(), n.tolist(), has) == ([-1, 5, 7, 9], [1, 2, 2, 1], 4)
    assert [x.tolist() for x in G._files_with(None, 0)[:2]] == [[], []]


@pytest.fixture
def no_matches(monkeypatch):
    def refuse(*_):
        raise AssertionError("matches leave the kernel one by one")

    monkeypatch.setattr(G, "matches", refuse)


def _random_sims() -> np.ndarray:
    sims = np.random.default_rng(5).normal(size=(3, 9, 7)).round(2)
    sims[1, 2] = np.nan
    sims[2] = -1
    return sims


def test_tallies_are_those_of_the_matches():
    sims, how = _random_sims(), (tuple(A.STRATEGIES), (0.0, 1.5))
    cells = {c: (n, float(np.sum(m[2]))) for c, n, m in G._matches(sims, *how, G.CELLS)}
    tallies = {c: (n, total) for c, n, total in G._matches(sims, *how, G.TALLY)}
    assert cells.keys() == tallies.keys() and all(np.allclose(cells[c], tallies[c]) for c in cells)


def test_grouped_statistics_need_no_matches(spark, data, no_matches):
    assert entry.queries()["match_stats_grouping_sets_whole"](spark, data).count() == 44


def test_having_matches_is_known_without_their_order(monkeypatch):
    sims, how = _random_sims(), (tuple(A.STRATEGIES), (0.0, 1.5))
    want = {c for c, *_ in G._matches(sims, *how, G.CELLS)}
    monkeypatch.setattr(A, "in_order", None)
    assert {c for c, *_ in G._matches(sims, *how, G.ANY)} == want


def test_skipping_needs_no_matches(spark, data, no_matches):
    assert entry.queries()["matched_skip_whole"](spark, data).count() == 1


def test_full_counts_need_no_matches(spark, data, no_matches):
    assert entry.queries()["matching_grid_full"](spark, data).count() == 32


def test_names_of_result_sets_need_no_matches(spark, data, no_matches):
    assert entry.queries()["matching_header_whole"](spark, data).count() == 20


def test_matches_are_written_unsorted_to_all_folders(spark, tmp_path, monkeypatch):
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(int(spark.conf.get(key))), write(self, path))[1])
    before = spark.conf.get(key)
    rows = [(f"p{k}", m, s, sd, k, 1, 0.5) for k in range(3) for m in S.MEASURES for s in A.STRATEGIES for sd in (0.0, 1.5)]
    files.write_matches(spark.createDataFrame(rows, "pair_hash string, measure string, strategy string, sd double, i int, j int, sim double"), str(tmp_path / "m"))
    assert seen[0] >= 32 and spark.conf.get(key) == before
    assert sorted(map(tuple, files.read_matches(spark, str(tmp_path / "m")).select("pair_hash", "measure", "strategy", "sd", "i", "j", "sim").collect())) == sorted(rows)
