"""Sentences of linked files that say the same.

Shared numbers, dates, names, glossary terms and cognates are keys. An index from key to sentences gives the cells (a
simple and a standard sentence of two linked files) that share a rare one; those whose keys are rare enough to tell a
sentence from all others are anchors, and the longest (heaviest) increasing subsequence of these is the chain. The
sentences between two links of the chain form a gap: only cells of gaps, and cells that share a rare key, get a score.
A link stays if its score is sure; what lies between is aligned by local dynamic programming, in which several simple
sentences may share one standard sentence (merges), sentences may stay without (omissions), and a sentence may leave
the order at a price, to a cell with a rare key (reordering). Sentences that sum up several others ("news from A and
from B") are no part of the order; they get a partner for each part they name.

The scores are a logistic regression of a cell by its keys and by words that judged pairs associate, and one more for the
cells of sentences that sum up others, fitted on people's verdicts, of which at most ``MAX_JUDGED`` file pairs (those of
smallest hash) are read.

Sizes: work and memory go with the cells of gaps and of rare keys, in blocks of rows of about ``_BLOCK`` cells; files without any
anchor are one gap. Files of any length are compared whole.

Defined results: null and blank sentences have no partner; a sentence stored twice counts once; files that are
linked but have no lines give nothing; a link listed twice counts once; a file linked to itself gives nothing; without verdicts fixed
weights are used; empty tables give an empty result; other columns do not matter. A glossary of more than ``MAX_TERMS`` terms is refused,
as it is sent to all tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.session import materialise

#: Most judged file pairs the scores are fitted on, and most terms of a glossary.
MAX_JUDGED, MAX_TERMS = 600, 100_000
#: Log odds from which a link of the chain is sure, and from which a part of a summing-up sentence has a partner.
SURE, LIKELY = 2.0, 0.0
#: A cell is an anchor if its keys are worth so much of a key that only these two sentences have.
ANCHOR = 0.75
#: A key makes cells of its own unless it has more than so many times the sentences of both files.
COMMON = 4
#: What the order is worth: the same partner as the sentence before, the next one, one further on, one back.
SAME, NEXT, ONWARD, BACK = 0.7, 0.5, -0.5, -1.2
#: Words are associated if they stand in more than two right pairs and in this share of them.
SUPPORT = 0.001

#: Month names of German and English, for dates.
_MONTHS = {
    m: k
    for k, names in enumerate(("januar january", "februar february", "märz march", "april", "mai may", "juni june", "juli july", "august", "september", "oktober october", "november", "dezember december"), 1)
    for m in names.split()
}
#: A date, a time of day or a number; the first digit stands apart, so that the search can look for digits alone.
_FIGURE = re.compile(
    rf"(\d)(?:(\d?)(?:\.?\s+({'|'.join(_MONTHS)})\s+(\d{{4}})|[:.](\d\d)(?![\d.,]*\d)(?:\s*([ap])\.?\s?m\b)?)|(\d*(?:[.,]\d+)*))", re.I
)
#: Words that join what a sentence sums up.
_AND = frozenset("und and sowie et".split())
_PART = re.compile(r",?\s(?:und|and|sowie|et)\s|,\s")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]{2,}")
_INNER = re.compile(r"(?<=[^\W\d_])[·­-](?=[^\W\d_])")


def number_keys(text: str) -> tuple[list[str], str]:
    """Dates, times of day and numbers in a form that does not depend on the language, and the text without them."""
    keys: list[str] = []

    def number(digits: str) -> None:
        head, _, tail = digits.replace(",", ".").rpartition(".")
        keys.append("n" + (digits.replace(",", "").replace(".", "") if not head or len(tail) == 3 else head.replace(".", "") + "." + tail))

    def take(m: re.Match[str]) -> str:
        one, two, month, year, minute, half, more = m.groups()
        if more is not None:
            number(one + more)
            return m[0]
        if month:
            keys.append(f"d{year}-{_MONTHS[month.lower()]}-{int(one + two)}")
            return " "
        hour = int(one + two)
        if int(minute) <= 59 and hour <= 24 and text[m.end() : m.end() + 2].strip()[:1] != "%" and text[m.start() - 1 : m.start()] not in (".", ","):
            keys.append(f"t{hour % 12 + 12 * (half in 'pP') if half else hour}:{minute}")
            return " "
        if m[0][len(one + two)] == ".":
            number(f"{one}{two}.{minute}")
        else:
            number(one + two)
            number(minute)
        return m[0]

    rest = _FIGURE.sub(take, text)
    return keys, rest


class Glossary:
    """Terms of one subject in several wordings, found by their words."""

    def __init__(self, rows: list[tuple]) -> None:
        self.first: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for term, *wordings in rows:
            for w in wordings:
                if w and (words := tuple(_WORD.findall(_INNER.sub("", w.lower())))):
                    self.first.setdefault(words[0], []).append((words, term))
        for own in self.first.values():
            own.sort(key=lambda x: -len(x[0]))

    def terms(self, words: tuple[str, ...]) -> list[int]:
        """Numbers of the terms that ``words`` hold; of several that begin at a word the longest."""
        out: list[int] = []
        if self.first.keys().isdisjoint(words):
            return out
        for k, w in enumerate(words):
            for own, term in self.first.get(w, ()):
                if words[k : k + len(own)] == own:
                    out.append(term)
                    break
        return out


_FOLD = str.maketrans({"k": "c", "y": "i", "z": "c", "ä": "a", "ö": "o", "ü": "u", "ß": "s", "é": "e", "è": "e", "ê": "e", "á": "a", "à": "a", "ç": "c", "ó": "o", "ñ": "n"})
_TWICE = re.compile(r"(.)\1+")


def cognate(word: str) -> str:
    """Key that related words of several languages, and forms of one word, have in common; empty for short words."""
    if len(word) < 6:
        return ""
    folded = _TWICE.sub(r"\1", word.replace("ph", "f").replace("th", "t").replace("sch", "s").translate(_FOLD))
    return "C" + folded[:5] if len(folded) > 4 else ""


@lru_cache(maxsize=200_000)
def _word_keys(word: str) -> tuple[str, str, str]:
    """(lower case, key if it is a name, key of its cognates) of a word."""
    low = word.lower()
    # Capitals are names in most languages, and nouns in German: what the other file does not have says little.
    return low, "N" + word if len(word) > 3 and not word[0].islower() else "", cognate(low)


KINDS = {"n": 0, "d": 1, "t": 1, "N": 2, "T": 3, "C": 4}


class Sentence:
    """What is compared of one sentence."""

    __slots__ = ("numbers", "names", "keys", "words", "low")

    def __init__(self, text: str, glossary: Glossary) -> None:
        numbers, rest = number_keys(text) if _DIGIT.search(text) else ((), text)
        joined = _INNER.sub("", rest) if "·" in rest or "-" in rest or "­" in rest else rest
        self.low = joined.lower()
        found = [_word_keys(w) for w in _WORD.findall(joined)]
        self.words, names, cognates = zip(*found) if found else ((), (), ())
        self.numbers = len(numbers)
        self.names = [w for w in names if w]
        self.names += [f"T{t}" for t in glossary.terms(self.words)]
        self.keys = {*numbers, *self.names, *cognates}
        self.keys.discard("")


CELL = (
    "numbers_shared", "dates_shared", "names_shared", "terms_shared", "cognates_shared", "rare_shared",
    "numbers_missing", "dates_missing", "names_missing", "terms_missing", "cognates_missing",
    "numbers_absent", "names_absent", "terms_absent", "association", "association_best", "no_numbers", "split", "split_shared", "split_rare",
)
_K = len(KINDS) - 1
_BLOCK = 200_000


class Keys:
    """The index of two files: which sentences share which keys."""

    def __init__(self, left: list[Sentence], right: list[Sentence]) -> None:
        self.m, self.n = m, n = len(left), len(right)
        number: dict[str, int] = {}
        rows, own = [], []
        for i, s in enumerate(left):
            for key in s.keys:
                rows.append(i)
                own.append(number.setdefault(key, len(number)))
        columns, theirs = [], []
        get = number.get
        for j, r in enumerate(right):
            for key in r.keys:
                if (k := get(key)) is not None:
                    columns.append(j)
                    theirs.append(k)
        kinds = np.fromiter((KINDS[k[0]] for k in number), np.int64, len(number))
        rows_, own_ = np.array(rows, np.int64), np.array(own, np.int64)
        theirs_ = np.array(theirs, np.int64)
        order = np.argsort(theirs_, kind="stable")
        columns_ = np.array(columns, np.int64)[order]
        a, b = np.bincount(own_, minlength=len(number)), np.bincount(theirs_, minlength=len(number))
        starts = np.cumsum(b) - b
        kind = kinds[own_]
        # Per row and kind: keys that the other file has somewhere, and keys it has nowhere.
        there = b[own_] > 0
        self.present = np.bincount((rows_ * _K + kind)[there], minlength=m * _K).reshape(m, _K)
        self.absent = np.bincount((rows_ * _K + kind)[~there], minlength=m * _K).reshape(m, _K)
        count = b.tolist()
        self.known = [sum(count[number[k]] > 0 for k in s.names) if len(s.names) > 1 else 0 for s in left]
        # Cells by key, those of keys that stand everywhere apart, as these say nothing about where a sentence belongs.
        rare = a * b <= COMMON * (m + n)
        worth = np.log(m * n / (a * np.maximum(b, 1)))
        self.looked_up = np.bincount(rows_, b[own_], m)
        self._rows, self._own, self._count, self._starts, self._columns, self._kind = rows_, own_, b, starts, columns_, kinds
        cells, which = self._cells(there & rare[own_])
        self.rare_cells, inverse = np.unique(cells, return_inverse=True)
        self.rare_worth = np.bincount(inverse, worth[which], len(self.rare_cells))

    def _cells(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, key) of every key that a cell shares, for some occurrences on the left."""
        own = self._own[some]
        size = self._count[own]
        cell = np.repeat(self._rows[some] * self.n - (np.cumsum(size) - size) + 0, size)
        at = np.arange(len(cell))
        place = np.repeat(self._starts[own] - (np.cumsum(size) - size), size) + at
        return np.repeat(self._rows[some] * self.n, size) + self._columns[place], np.repeat(own, size)

    def shared(self, ids: np.ndarray, first: int, end: int) -> np.ndarray:
        """Per cell of ``ids`` (sorted, rows from ``first`` to before ``end``): shared keys by kind, and those that one standard sentence alone has."""
        cell, key = self._cells((self._rows >= first) & (self._rows < end) & (self._count[self._own] > 0))
        at = np.searchsorted(ids, cell)
        hit = at < len(ids)
        hit[hit] = ids[at[hit]] == cell[hit]
        at, key = at[hit], key[hit]
        kind = self._kind[key]
        alone = (self._count[key] == 1) & (kind < 3)
        places = np.concatenate([at * (_K + 1) + kind, at[alone] * (_K + 1) + _K])
        return np.bincount(places, minlength=len(ids) * (_K + 1)).reshape(len(ids), _K + 1)

    def anchors(self) -> list[tuple[int, int, float]]:
        """Per row its cell of rarest shared keys, if that is worth enough and no other cell is worth as much."""
        cells, worth = self.rare_cells, self.rare_worth
        if not len(cells):
            return []
        rows = cells // self.n
        lead = np.flatnonzero(np.diff(rows, prepend=-1))
        top = np.repeat(np.maximum.reduceat(worth, lead), np.diff(np.append(lead, len(rows))))
        is_top = worth > top - 1e-9
        single = np.repeat(np.add.reduceat(is_top.astype(np.int64), lead) == 1, np.diff(np.append(lead, len(rows))))
        good = np.flatnonzero(is_top & single & (worth >= max(ANCHOR * np.log(self.m * self.n), 1e-9)))
        return list(zip(rows[good].tolist(), (cells[good] % self.n).tolist(), worth[good].tolist()))

    def cells(self, links: list[tuple[int, int]]) -> np.ndarray:
        """Sorted numbers of the cells that get a score: those of rare keys, and those of the gaps of the chain."""
        m, n = self.m, self.n
        low, high = np.zeros(m, np.int64), np.full(m, n - 1, np.int64)
        if links:
            at, to = np.array(links).T
            before, after = np.searchsorted(at, np.arange(m), "left") - 1, np.searchsorted(at, np.arange(m), "right")
            low = np.where(before >= 0, to[np.maximum(before, 0)], 0)
            high = np.where(after < len(at), to[np.minimum(after, len(at) - 1)], n - 1)
        size = high - low + 1
        gaps = np.repeat(np.arange(m) * n + low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.union1d(gaps, self.rare_cells)


class Associations:
    """Association of words of simple sentences with words of standard ones, from pairs that say the same."""

    def __init__(self, pairs: list[tuple[Sentence, Sentence]]) -> None:
        a, b = Counter(), Counter()
        for s, r in pairs:
            a.update(set(s.words))
            b.update(set(r.words))
        # By support, not by rank: how many words are kept does not grow with the pairs.
        least = max(3, SUPPORT * len(pairs))
        self.left = {w: k for k, w in enumerate(sorted(w for w, c in a.items() if c >= least))}
        self.right = {w: k for k, w in enumerate(sorted(w for w, c in b.items() if c >= least))}
        joint = np.zeros((len(self.left) + 1, len(self.right) + 1), np.float32)
        for s, r in pairs:
            x = [self.left[w] for w in set(s.words) if w in self.left]
            y = [self.right[w] for w in set(r.words) if w in self.right]
            if x and y:
                joint[np.ix_(x, y)] += 1
        total = max(1, len(pairs))
        ca = np.array([a[w] for w in self.left] + [0], float)[:, None]
        cb = np.array([b[w] for w in self.right] + [0], float)[None, :]
        expected = ca * cb / total
        self.table = np.log((joint + 0.6) / (expected + 0.6)).astype(np.float32)
        self.table[-1, :] = 0.0
        self.table[:, -1] = 0.0

    def score(self, left: list[Sentence], right: list[Sentence]) -> tuple[np.ndarray, np.ndarray]:
        """Per cell, over the words of the simple sentence: the mean and the largest of their best associations."""
        if not self.left or not self.right:
            return np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
        x, sx = self._ids(left, self.left)
        y, sy = self._ids(right, self.right)
        # In blocks of words, so that what is held at a time does not go with words by words.
        step = max(1, 20 * _BLOCK // len(y))
        parts = [np.maximum.reduceat(self.table[x[k : k + step, None], y[None, :]], sy, axis=1) for k in range(0, len(x), step)]
        best = parts[0] if len(parts) == 1 else np.concatenate(parts)
        size = np.diff(np.append(sx, len(x)))[:, None]
        return np.add.reduceat(best, sx, axis=0) / size, np.maximum.reduceat(best, sx, axis=0)

    @staticmethod
    def _ids(sentences: list[Sentence], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        none, ids, starts = len(index), [], []
        for s in sentences:
            starts.append(len(ids))
            own = [index[w] for w in s.words if w in index]
            ids += own or [none]
        return np.array(ids), np.array(starts)


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, scales) of a ridge logistic regression by Newton's method; the first weight is the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), weight)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w, mean, scale


class Scorer:
    """Log odds of cells."""

    def __init__(self, glossary: Glossary) -> None:
        self.glossary = glossary
        self.table = Associations([])
        # Fixed weights for the case that there are no verdicts to learn from, in the order of CELL after the constant.
        fixed = [-2.0, 1.5, 2.5, 0.8, 1.0, 0.3, 0.3, -2, -2.5, -0.8, -1.0, -0.1, -0.7, -0.1, -0.7, 0.0, 0.0, 1.2, -1.0, 2.0, 1.0]
        self.alone = (np.array(fixed), np.zeros(len(CELL)), np.ones(len(CELL)))
        self.several = (np.array([0.0, 1.0, -0.4, -0.2, 0.0]), np.zeros(len(SEVERAL)), np.ones(len(SEVERAL)))

    @staticmethod
    def _apply(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        w, mean, scale = model
        return ((x - mean) / scale) @ w[1:] + w[0]

    def features(self, left: list[Sentence], right: list[Sentence], keys: Keys, ids: np.ndarray, split: np.ndarray, first: int, end: int, table: Associations) -> np.ndarray:
        """Features of the cells ``ids``, whose rows go from ``first`` to before ``end``; marks rows that sum up several sentences in ``split``."""
        out = np.zeros((len(ids), len(CELL)))
        rows, columns = ids // keys.n, ids % keys.n
        out[:, : _K + 1] = shared = keys.shared(ids, first, end)
        out[:, _K + 1 : 2 * _K + 1] = keys.present[rows] - shared[:, :_K]
        absent = keys.absent[rows]
        out[:, 11] = absent[:, 0] + absent[:, 1]
        out[:, 12:14] = absent[:, 2:4]
        out[:, 16] = np.array([not s.numbers for s in left[first:end]])[rows - first]
        # A sentence that names what no single sentence of the other file holds together sums up several of these.
        for i in range(first, end):
            if not left[i].numbers and keys.known[i] > 1 and not _AND.isdisjoint(left[i].words):
                a, b = np.searchsorted(rows, (i, i + 1))
                both = shared[a:b, :4].sum(axis=1)
                if both.max(initial=0) < keys.known[i]:
                    split[i] = True
                    out[a:b, 17], out[a:b, 18], out[a:b, 19] = 1, both > 0, shared[a:b, _K] > 0
        if table.left and table.right:
            used, at = np.unique(columns, return_inverse=True)
            mean, best = table.score(left[first:end], [right[j] for j in used.tolist()])
            out[:, 14], out[:, 15] = mean[rows - first, at], best[rows - first, at]
        return np.minimum(out, 4.0)

    def score(self, left: list[Sentence], right: list[Sentence]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(cells, their log odds, whether a row sums up several sentences, chained anchors)."""
        keys = Keys(left, right)
        links = chain(keys.anchors())
        ids = keys.cells(links)
        split = np.zeros(keys.m, bool)
        own = np.empty(len(ids), np.float32)
        for first, end, a, b in _blocks(ids, keys):
            own[a:b] = self._apply(self.alone, self.features(left, right, keys, ids[a:b], split, first, end, self.table))
        return ids, np.clip(own, -12, 12), split, links


def _blocks(ids: np.ndarray, keys: Keys) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first cell, cell after the last) of blocks of whole rows, by their cells and the cells that their keys occur in."""
    ends = np.searchsorted(ids, np.arange(1, keys.m + 1) * keys.n)
    total = ends + np.cumsum(keys.looked_up)
    first = start = 0
    while first < keys.m:
        done = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, done + 4 * _BLOCK, "right")))
        yield first, end, start, int(ends[end - 1])
        first, start = end, int(ends[end - 1])


#: Features of the cells of a sentence that sums up others: its score, the best of its row and its column's best of other rows, and how far the neighbours' partners lie.
SEVERAL = ("own", "row_best", "column_rival", "away")


def several(ids: np.ndarray, own: np.ndarray, n: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, features) of the cells of one row."""
    a, b = np.searchsorted(ids, (row * n, (row + 1) * n))
    columns = ids[a:b] - row * n
    rival = np.full(n, -6.0)
    others = np.concatenate([own[:a], own[b:]])
    np.maximum.at(rival, np.concatenate([ids[:a], ids[b:]]) % n, others)
    away = np.full(len(columns), 3.0)
    for near in (row - 1, row + 1):
        x, y = np.searchsorted(ids, (near * n, (near + 1) * n))
        if y > x and own[x:y].max() > 0:
            away = np.minimum(away, np.abs(ids[x + int(own[x:y].argmax())] - near * n - columns))
    f = np.column_stack([own[a:b], np.full(len(columns), own[a:b].max(initial=-6.0)), rival[columns], away])
    return columns, f


def fit(judged: list[tuple[list[str], list[str], list[tuple[int, int, bool]]]], glossary: Glossary) -> Scorer:
    """A scorer from (simple sentences, standard sentences, verdicts on cells) of judged file pairs."""
    out = Scorer(glossary)
    known = [([Sentence(t, glossary) for t in a], [Sentence(t, glossary) for t in b], v) for a, b, v in judged if v]
    if sum(x[2] for _, _, v in known for x in v) < 20:
        return out
    # Each half of the pairs is scored with associations of the other, else these would look better than they are.
    halves = [Associations([(a[i], b[j]) for a, b, v in known[k::2] for i, j, ok in v if ok]) for k in (0, 1)]
    rows, truth, places = [], [], []
    for k, (a, b, v) in enumerate(known):
        keys = Keys(a, b)
        ids = np.union1d(keys.cells(chain(keys.anchors())), [i * keys.n + j for i, j, _ in v])
        split = np.zeros(keys.m, bool)
        x = np.concatenate([out.features(a, b, keys, ids[p:q], split, first, end, halves[1 - k % 2]) for first, end, p, q in _blocks(ids, keys)])
        at = np.searchsorted(ids, [i * keys.n + j for i, j, _ in v])
        rows.append(x[at])
        truth += [ok for *_, ok in v]
        if split.any():
            places.append((ids, x, split, keys.n, v))
    out.alone = logistic(np.concatenate(rows), np.array(truth, float))
    marks, right = [], []
    for ids, x, split, n, v in places:
        own = np.clip(out._apply(out.alone, x), -12, 12)
        for i in np.flatnonzero(split).tolist():
            columns, f = several(ids, own, n, i)
            for r, j, ok in v:
                if r == i:
                    marks.append(f[np.searchsorted(columns, j)])
                    right.append(ok)
    if 5 <= sum(right) <= len(right) - 5:
        out.several = logistic(np.array(marks), np.array(right, float))
    out.table = Associations([(a[i], b[j]) for a, b, v in known for i, j, ok in v if ok])
    return out


def chain(anchors: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The heaviest sequence of anchors (row, column, weight; rows distinct and sorted) that never goes back in columns, in n log n.

    ``tops`` holds the columns at which a heavier sequence ends than at any before, with weights that rise with the columns.
    """
    tops: list[int] = []
    weights: list[float] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j, w) in enumerate(anchors):
        at = bisect_right(tops, j)
        back.append(last[at - 1] if at else -1)
        total = w + (weights[at - 1] if at else 0.0)
        end = at
        while end < len(tops) and weights[end] <= total:
            end += 1
        start = at - 1 if at and tops[at - 1] == j else at
        tops[start:end], weights[start:end], last[start:end] = [j], [total], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(anchors[k][:2])
        k = back[k]
    return out[::-1]


_NEVER = -1e9


def fill_gap(rows: list[tuple[list[int], list[float]]], before: int | None, after: int | None) -> list[int]:
    """Partner (column, or -1) of each row of a gap: the best path through (columns, log odds) of its rows.

    The state is the column used last, ``before`` at first; ``after`` is the one that follows. Steps count as the constants at the head of the module say.
    """
    used = [c for columns, _ in rows for c in columns]
    used += [c for c in (before, after) if c is not None]
    if not used:
        return [-1] * len(rows)
    low, width = min(used), max(used) - min(used) + 1
    reach = [_NEVER] * width
    fresh = 0.0
    if before is not None:
        reach[before - low], fresh = 0.0, _NEVER
    steps: list[dict[int, int]] = []  # per row: column taken, and the state before it (-1: none)
    for columns, odds in rows:
        up, down = list(accumulate(reach, max)), list(accumulate(reversed(reach), max))
        came: dict[int, int] = {}
        gains = []
        for c, x in zip(columns, odds):
            c -= low
            best, source = reach[c] + SAME, c
            if c:
                if reach[c - 1] + NEXT > best:
                    best, source = reach[c - 1] + NEXT, c - 1
                if c > 1 and up[c - 2] + ONWARD > best:
                    best, source = up[c - 2] + ONWARD, -2
            if c + 1 < width and down[width - 2 - c] + BACK > best:
                best, source = down[width - 2 - c] + BACK, -3
            if fresh > best:
                best, source = fresh, -1
            if best + x > reach[c]:
                if source == -2:
                    source = reach.index(up[c - 2])
                elif source == -3:
                    source = reach.index(down[width - 2 - c], c + 1)
                came[c] = source
                gains.append((c, best + x))
        steps.append(came)
        for c, x in gains:
            reach[c] = x
    if after is not None:
        end = after - low
        reach = [x + (SAME if c == end else NEXT if c + 1 == end else ONWARD if c < end else BACK) for c, x in enumerate(reach)]
    top = max(reach)
    state = reach.index(top) if top > fresh else -1
    out = [-1] * len(rows)
    for r in range(len(rows) - 1, -1, -1):
        if state >= 0 and state in steps[r]:
            out[r] = state + low
            state = steps[r][state]
    return out


def align(left: list[Sentence], right: list[Sentence], scorer: Scorer) -> list[tuple[int, int]]:
    """Cells that say the same: sure links of the chain, gaps filled between them, and the parts of sentences that sum up others."""
    m, n = len(left), len(right)
    ids, own, split, links = scorer.score(left, right)
    starts = np.searchsorted(ids, np.arange(m + 1) * n)
    columns, odds = (ids % n).tolist(), own.tolist()
    rows = [(columns[a:b], odds[a:b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
    fixed: list[tuple[int, int]] = []
    for i, j in links:
        columns, odds = rows[i]
        top = max(odds)
        if not split[i] and top > SURE and columns[odds.index(top)] == j:
            fixed.append((i, j))
    found = list(fixed)
    ends = [(-1, None), *fixed, (m, None)]
    for (i0, j0), (i1, j1) in zip(ends, ends[1:]):
        gap = [i for i in range(i0 + 1, i1) if not split[i]]
        if gap:
            found += [(i, j) for i, j in zip(gap, fill_gap([rows[i] for i in gap], j0, j1)) if j >= 0]
    # One partner for each part, wherever these stand.
    for i in np.flatnonzero(split).tolist():
        columns, f = several(ids, own, n, i)
        odds = scorer._apply(scorer.several, f)
        parts = max(2, 1 + len(_PART.findall(left[i].low)))
        found += [(i, int(columns[k])) for k in np.argsort(-odds, kind="stable")[:parts].tolist() if odds[k] > LIKELY]
    return sorted(found)


def aligned(left: list[str], right: list[str], scorer: Scorer) -> list[tuple[int, int]]:
    a = [Sentence(t, scorer.glossary) for t in left]
    b = [Sentence(t, scorer.glossary) for t in right]
    return align(a, b, scorer) if a and b else []


def linked_files(header: DataFrame) -> DataFrame:
    """(simple, standard) file names: links of simple files, by the first row of each file."""
    first = header.filter(F.col("fname").isNotNull()).groupBy("fname").agg(F.min_by(F.struct("easy", "matching_files"), F.struct("ingested_at", "header_id")).alias("f"))
    links = first.filter("f.easy").select(F.col("fname").alias("simple"), F.explode(F.array_distinct("f.matching_files")).alias("standard"))
    links = links.filter(F.col("standard").isNotNull() & (F.col("standard") != F.col("simple")))
    simple_too = first.filter("f.easy").select(F.col("fname").alias("standard"))
    return links.join(simple_too, "standard", "left_anti").select("simple", "standard")


def file_sentences(lines: DataFrame) -> DataFrame:
    """(fname, ids, texts): per file its sentences in order, blank ones left out; a sentence stored twice may be there twice."""
    kept = lines.filter(F.col("fname").isNotNull() & F.col("sent_id").isNotNull() & F.col("sent").rlike(r"[^\s\p{Z}]"))
    own = kept.groupBy("fname").agg(F.array_sort(F.collect_set(F.struct("line_no", "sent_id", "sent"))).alias("s"))
    return own.select("fname", F.transform("s", lambda x: x.sent_id).alias("ids"), F.transform("s", lambda x: x.sent).alias("texts"))


def _once(ids: list[int], texts: list[str]) -> tuple[list[int], list[str]]:
    """Each sentence by its first row."""
    if len(set(ids)) == len(ids):
        return ids, texts
    first = {k: t for k, t in zip(reversed(ids), reversed(texts))}
    order = list(dict.fromkeys(ids))
    return order, [first[k] for k in order]


def judged_pairs(links: DataFrame, lines: DataFrame, judgments: DataFrame) -> list[tuple[list[str], list[str], list[tuple[int, int, bool]]]]:
    """Sentences and verdicts of the judged file pairs of smallest hash."""
    votes = judgments.filter(F.col("verdict").isNotNull() & F.col("simple_sent").isNotNull() & F.col("normal_sent").isNotNull())
    some = votes.select("pair_hash").distinct().orderBy("pair_hash").limit(MAX_JUDGED)
    # Added up first, so that a pair which holds many repeated rows is no large one.
    votes = votes.join(F.broadcast(some), "pair_hash", "left_semi").groupBy("pair_hash", F.trim("simple_sent").alias("simple_sent"), F.trim("normal_sent").alias("normal_sent"))
    votes = votes.agg(F.sum(F.when(F.col("verdict"), 1).otherwise(-1)).alias("votes"))
    keyed = links.withColumn("pair_hash", F.sha1(F.concat("simple", F.lit(".txt___"), "standard", F.lit(".txt"))))
    # At most MAX_JUDGED pairs, so their names can be sent to where the lines are, and only their lines move.
    keyed = [tuple(r) for r in keyed.join(F.broadcast(some), "pair_hash", "left_semi").select("pair_hash", "simple", "standard").collect()]
    if not keyed:
        return []
    spark = lines.sparkSession
    wanted = spark.createDataFrame(sorted({(n,) for _, *names in keyed for n in names}), "fname string")
    files = {r.fname: _once(r.ids, r.texts)[1] for r in file_sentences(lines.join(F.broadcast(wanted), "fname", "left_semi")).collect()}
    verdicts: dict[str, list] = {}
    for r in votes.collect():
        verdicts.setdefault(r.pair_hash, []).append(r)
    out = []
    for key, simple, standard in sorted(keyed):
        a, b = files.get(simple, []), files.get(standard, [])
        at, bt = {t.strip(): i for i, t in enumerate(a)}, {t.strip(): j for j, t in enumerate(b)}
        count: dict[tuple[int, int], int] = {}
        for v in verdicts.get(key, []):
            i, j = at.get(v.simple_sent.strip()), bt.get(v.normal_sent.strip())
            if i is not None and j is not None:
                count[i, j] = count.get((i, j), 0) + v.votes
        out.append((a, b, [(i, j, c > 0) for (i, j), c in sorted(count.items()) if c]))
    return out


_AT_ONCE = 200


def _matched(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    scorer = sent.value
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            low, high = [], []
            for a, u, b, v in zip(*(part.column(k).to_pylist() for k in range(4))):
                (ia, ta), (ib, tb) = _once(a, u), _once(b, v)
                for i, j in aligned(ta, tb, scorer):
                    low.append(min(ia[i], ib[j]))
                    high.append(max(ia[i], ib[j]))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["sent_id_a", "sent_id_b"])


def sentence_pairs(header: DataFrame, lines: DataFrame, judgments: DataFrame, glossary: DataFrame) -> DataFrame:
    """(sent_id_a, sent_id_b): pairs of sentences of linked files that say the same, smaller id first, each once."""
    files = file_sentences(lines)
    # Read by two plans below, so found once.
    links = materialise(linked_files(header), "linked_files")
    left = files.select(F.col("fname").alias("simple"), F.col("ids").alias("a"), F.col("texts").alias("u"))
    right = files.select(F.col("fname").alias("standard"), F.col("ids").alias("b"), F.col("texts").alias("v"))
    listed = glossary.select("term_id", "de", "de_easy", "en", "en_easy").limit(MAX_TERMS + 1).collect()
    if len(listed) > MAX_TERMS:
        raise ValueError(f"a glossary of more than {MAX_TERMS} terms does not fit every task")
    terms = Glossary(sorted((tuple(r) for r in listed), key=repr))
    sent = lines.sparkSession.sparkContext.broadcast(fit(judged_pairs(links, lines, judgments), terms))
    pairs = links.join(left, "simple").join(right, "standard").select("a", "u", "b", "v")
    return pairs.mapInArrow(lambda it: _matched(it, sent), "sent_id_a long, sent_id_b long").distinct()
