"""The whole grid comes from one kernel, which writes no cells."""

import itertools

import numpy as np
import pytest

import __spark_entry__ as entry
from lingualoom.operators import similarity as S
from lingualoom.operators import whole_grid as G
from lingualoom.plans import similarity as P


@pytest.fixture
def no_cells(monkeypatch):
    def refuse(*_):
        raise AssertionError("cells are written")

    monkeypatch.setattr(P.Inputs, "written", refuse)
    monkeypatch.setattr(P.Inputs, "sim", refuse)


#: Queries and their rows on the smallest data.
ROWS = (
    ("judgment_prf_whole", 32),
    ("match_stats_whole", 768),
    ("matches_by_configuration", 157),
    ("matching_grid_full", 32),
    ("matching_header_whole", 20),
    ("precision_by_site_whole", 62),
    ("judgment_sims_whole", 7),
    ("match_stats_grouping_sets_whole", 44),
    ("matched_skip_whole", 1),
    ("matching_grid_whole", 9423),
    ("next_unjudged_whole", 632),
)


@pytest.mark.parametrize("name, rows", ROWS)
def test_no_cells_are_written(spark, data, no_cells, name, rows):
    assert entry.queries()[name](spark, data).count() == rows


def test_assignments_of_many_matrices_against_all_permutations():
    rng = np.random.default_rng(7)
    for _ in range(20):
        c = np.round(rng.normal(size=(30, 4, 6)), 1)
        sizes = rng.integers(1, 5, 30)
        want = [max(sum(m[r, p[r]] for r in range(k)) for p in itertools.permutations(range(6), k)) for m, k in zip(c, sizes.tolist())]
        assert np.allclose(G.assigned_sums(c, sizes), want)


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_word_measures_are_those_of_single_cells(monkeypatch, block):
    monkeypatch.setattr(G, "_BLOCK", block)
    rng = np.random.default_rng(8)
    unit = G._unit(np.round(rng.normal(size=(12, 3)), 1))
    left, right = np.array([0, 2, 2, 7]), np.array([0, 0, 3, 8, 9])
    x, y = unit[rng.integers(0, 12, 7)], unit[rng.integers(0, 12, 9)]
    queue = G._Assignments()
    got = G._by_words(x, left, y, right, S.BY_WORDS, queue)
    queue.run()
    both = np.concatenate([x, y])
    cos = np.round(both @ both.T, 12)
    want = S.word_measures(cos, [list(range(a, b)) for a, b in zip(left, left[1:])], [list(range(7 + a, 7 + b)) for a, b in zip(right, right[1:])])
    assert all(np.allclose(got[m], want[m]) for m in S.BY_WORDS)


def test_vectors_with_gaps_are_left_to_the_long_form(spark, tmp_path):
    inputs = object.__new__(P.Inputs)
    inputs.spark, inputs.folder = spark, str(tmp_path)
    for ids, whole in (((0, 1), True), ((0, 2), False)):
        spark.createDataFrame([(k, [1.0, 2.0]) for k in ids], "vec_id bigint, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        spark.catalog.refreshByPath(str(tmp_path))
        assert (inputs._vectors() is not None) == whole


def test_sentences_without_words_keep_their_place():
    import pyarrow as pa

    numbers, ends = G._Files._words(pa.array(["a b", "", "b"]), {}, lambda w: sum(map(ord, w)))
    assert numbers.tolist() == [97, 98, 98] and ends.tolist() == [0, 2, 2, 3]
