"""Goldens and brute force for alignment and similarities."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lingualoom.operators import align as A
from lingualoom.operators import similarity as S


def slow_increasing(js):
    """Of all longest non-decreasing subsequences that which ends first, then the one whose elements are nearest from the end."""
    for size in range(len(js), 0, -1):
        fits = [c for c in itertools.combinations(range(len(js)), size) if all(js[a] <= js[b] for a, b in zip(c, c[1:]))]
        if fits:
            return list(min(fits, key=lambda c: (c[-1], [-k for k in reversed(c[:-1])])))
    return []


def test_increasing_golden():
    assert A.increasing([3, 1, 2, 2, 5]) == [1, 2, 3, 4]
    assert A.increasing([]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=9))
def test_increasing_against_all_subsequences(js):
    assert A.increasing(js) == slow_increasing(js)


GOLDEN = np.array([[0.1, 0.1, 0.1], [0.1, 0.1, 0.1], [0.9, 0.2, 0.1], [0.1, 0.6, 0.8], [0.1, 0.7, 0.6]])


def test_ordered_golden_with_either_row_index():
    assert A.ordered_alignment(GOLDEN, 0.5) == [(2, 0), (3, 2)]
    assert A.ordered_alignment(GOLDEN, 0.5, fix_row_index=True) == [(2, 0), (3, 2), (4, 2)]
    assert A.ordered_alignment(np.zeros((2, 2)), 0.0) == []
    assert A.ordered_alignment(np.zeros((0, 3)), 0.0) == []


def sims(spark, matrix, key="p"):
    return spark.createDataFrame([(key, i, j, float(matrix[i][j])) for i in range(len(matrix)) for j in range(len(matrix[0]))], "pair_hash string, i int, j int, sim double")


def test_best_matches_thresholds_and_ties(spark):
    m = [[0.9, 0.1], [0.2, 0.2]]
    got = lambda sd: sorted((r.i, r.j) for r in A.best_matches(sims(spark, m), sd).collect())
    assert got(1.5) == [(0, 0)]
    assert got(0.0) == [(0, 0), (1, 0)]
    assert A.best_matches(sims(spark, [[0.0, 0.0]]), 0.0).count() == 0
    assert A.best_matches(sims(spark, [[float("nan"), 0.5]]), 1.5).count() == 0
    assert A.matches(sims(spark, m), "unknown", 0.0) is None


def test_ordered_matches_are_those_of_the_matrix(spark):
    rng = random.Random(3)
    frame, want = None, []
    for k in range(4):
        m = np.array([[round(rng.random(), 2) for _ in range(5)] for _ in range(7)])
        one = sims(spark, m, f"p{k}")
        frame = one if frame is None else frame.unionByName(one)
        thr = round(m.mean() + 1.5 * m.std(), 10)
        want += [(f"p{k}", i, j) for i, j in A.ordered_alignment(m, thr)]
    assert sorted((r.pair_hash, r.i, r.j) for r in A.ordered_matches(frame, 1.5).collect()) == sorted(want)


def test_word_matrix_golden():
    c = np.array([[0.9, 0.2], [0.8, 0.1]])
    cos = np.zeros((4, 4))
    cos[:2, 2:] = c
    got = S.word_measures(cos, [[0, 1], []], [[], [2, 3]])
    assert {k: v[0, 1].round(6) for k, v in got.items()} == {"maximum": 0.7, "bipartite": 0.5, "cwasa": round(1.9 / 3, 6)}
    assert all(v[0, 0] == v[1, 0] == v[1, 1] == 0.0 for v in got.values())


def slow_measures(c):
    rows, columns = range(len(c)), range(len(c[0]))
    maximum = (sum(max(c[i][j] for i in rows) for j in columns) / len(c[0]) + sum(max(c[i]) for i in rows) / len(c)) / 2
    short = min(len(c), len(c[0]))
    fits = [sum(c[i][j] for i, j in (zip(range(short), p) if len(c) == short else zip(p, range(short)))) for p in itertools.permutations(range(max(len(c), len(c[0]))), short)]
    best = [max(columns, key=lambda j: (c[i][j], -j)) for i in rows]
    back = [max(rows, key=lambda i: (c[i][j], -i)) for j in columns]
    kept = [c[i][best[i]] for i in rows if c[i][best[i]] > 0 and back[best[i]] != i] + [c[back[j]][j] for j in columns if c[back[j]][j] > 0]
    return {"maximum": maximum, "bipartite": max(fits) / short, "cwasa": sum(kept) / len(kept) if kept else 0.0}


def test_word_measures_against_their_definitions(monkeypatch):
    rng = np.random.default_rng(5)
    for k in range(40):
        monkeypatch.setattr(S, "_BLOCK", (4_000_000, 5)[k % 2])
        left = [list(range(a, a + n)) for a, n in ((0, 2), (2, 0), (2, 4))]
        right = [list(range(a, a + n)) for a, n in ((6, 3), (9, 1))]
        cos = np.round(rng.normal(size=(10, 10)), 1)
        got = S.word_measures(cos, left, right)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                want = slow_measures(cos[np.ix_(x, y)].tolist()) if x else dict.fromkeys(S.BY_WORDS, 0.0)
                assert all(abs(got[m][i, j] - want[m]) < 1e-9 for m in S.BY_WORDS)


def test_sparse_products_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2, (4, 9)) * rng.normal(size=(4, 9)), rng.integers(0, 2, (3, 9)) * rng.normal(size=(3, 9))
    (ia, ta), (ib, tb) = np.nonzero(a), np.nonzero(b)
    for block in (4_000_000, 3):
        monkeypatch.setattr(S, "_BLOCK", block)
        assert np.allclose(S._sparse_dots(ia, ta, a[ia, ta], ib, tb, b[ib, tb], 4, 3), a @ b.T)


@pytest.mark.parametrize("seed", range(12))
def test_assignment_against_all_permutations(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 5))
    m = int(rng.integers(n, 6))
    cost = np.round(rng.normal(size=(n, m)), 3)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    pick = S.assignment(cost)
    assert len(set(pick)) == n and abs(cost[np.arange(n), pick].sum() - best) < 1e-9
