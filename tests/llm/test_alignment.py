"""The chain, the gaps and the index of sentence alignment: brute force, goldens and size."""

import itertools
import resource

import numpy as np

from lingualoom.llm import sentence_pairs as S

NONE = S.Glossary([])


def slow_chain(anchors):
    best = (0.0, ())
    for size in range(1, len(anchors) + 1):
        for c in itertools.combinations(anchors, size):
            if all(a[1] <= b[1] for a, b in zip(c, c[1:])):
                best = max(best, (sum(x[2] for x in c), tuple(x[:2] for x in c)), key=lambda x: x[0])
    return best


def test_chain_against_all_subsequences():
    rng = np.random.default_rng(0)
    assert S.chain([]) == []
    assert S.chain([(0, 3, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 5, 1.0)]) == [(1, 1), (2, 2), (3, 2), (4, 5)]
    for _ in range(200):
        anchors = [(i, int(rng.integers(0, 6)), float(rng.integers(1, 5))) for i in range(int(rng.integers(1, 9)))]
        got = S.chain(anchors)
        weight = {x[:2]: x[2] for x in anchors}
        assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(got, got[1:]))
        assert sum(weight[x] for x in got) == slow_chain(anchors)[0]


def path_score(path, rows, before, after):
    total, last = 0.0, before
    step = lambda a, b: 0.0 if a is None else S.SAME if a == b else S.NEXT if b == a + 1 else S.ONWARD if b > a else S.BACK
    for j, (columns, odds) in zip(path, rows):
        if j >= 0:
            total += odds[columns.index(j)] + step(last, j)
            last = j
    return total + (step(last, after) if after is not None and last is not None else 0.0)


def test_gap_against_all_paths():
    rng = np.random.default_rng(1)
    for k in range(150):
        rows = [(list(range(4)), rng.normal(size=4).round(3).tolist()) for _ in range(3)]
        before, after = (None, 1)[k % 2], (None, 3)[k // 2 % 2]
        if before is None:
            after = None
        got = S.fill_gap(rows, before, after)
        best = max(path_score(p, rows, before, after) for p in itertools.product(range(-1, 4), repeat=3))
        assert abs(path_score(got, rows, before, after) - best) < 1e-9
    assert S.fill_gap([], None, None) == [] and S.fill_gap([([], [])], None, None) == [-1]


def test_order_decides_between_equal_sentences():
    """Sentences that are alike in themselves find their partners by the chain and the order in the gaps; the best cell of each row alone does not."""
    left, right = [], []
    for k in range(12):
        left += [f"Ort {chr(65 + k)}{'abcdefghijkl'[k] * 5}kirch baut {100 + k} Wege.", "Der Antrag kostet Geld."]
        right += [f"In {chr(65 + k)}{'abcdefghijkl'[k] * 5}kirch werden {100 + k} Wege gebaut.", "Für den Antrag fallen Gebühren an."]
    scorer = S.Scorer(NONE)
    a, b = [S.Sentence(t, NONE) for t in left], [S.Sentence(t, NONE) for t in right]
    ids, own, split, links = scorer.score(a, b)
    assert links == [(2 * k, 2 * k) for k in range(12)]
    n = len(right)
    top = {i: int(ids[ids // n == i][own[ids // n == i].argmax()] % n) for i in range(len(left))}
    got = dict(S.align(a, b, scorer))
    assert got == {i: i for i in range(len(left))}
    assert sum(top[i] != got[i] for i in got) >= 6


def test_sentences_out_of_order_keep_their_partner():
    left = [f"Haus {chr(65 + k) * 5}heim hat {1000 + k} Betten." for k in range(8)]
    right = [f"Über {1000 + k} Betten verfügt {chr(65 + k) * 5}heim." for k in range(8)]
    right = right[5:] + right[:5]
    assert S.aligned(left, right, S.Scorer(NONE)) == [(k, (k + 3) % 8) for k in range(8)]


def test_related_words_share_a_key():
    assert S.cognate("kommune") == S.cognate("communes") and S.cognate("anträge") == S.cognate("antrags") and S.cognate("photograph") == S.cognate("fotografie")
    assert S.cognate("haus") == ""


def test_five_thousand_sentences_a_side_in_bounded_memory():
    words = ["Weg", "Haus", "Stadt", "Antrag", "Leute", "Schule", "Bus", "Hilfe"]
    left = [f"In {words[k % 8]}{k % 97} kostet {words[k // 8 % 8]} {10_000 + k} Euro." for k in range(5000)]
    right = [f"{10_000 + k} Euro sind es für {words[k // 8 % 8]} in {words[k % 8]}{k % 97}." for k in range(5000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert S.aligned(left, right, S.Scorer(NONE)) == [(k, k) for k in range(5000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
    # Without any anchor the files are one gap.
    none = [f"Das ist {w} und gut." for w in words * 40]
    assert S.aligned(none, none[::-1], S.Scorer(NONE)) is not None
