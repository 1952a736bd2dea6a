"""Reading level of documents by smoothed unigram language models.

One model per language and level, with words and the length of the sentence as its events, and two more per language,
for lines that pages of a site share and for headings, items and rows, which are no sentences. They are fitted on
labelled documents, a level being the median of its annotators, or where a level has too few of these on documents whose
level a readability formula (LIX) seeds. Labels are of whole documents, which may mix levels, so a few rounds move
sentences to the level that explains them best. Every sentence of the corpus then gets its posterior over levels; a
document's level is the one of highest posterior of all its sentences together, with the prior of levels counted once.

Fitting reads at most ``MAX_LABELLED`` labelled documents, those of smallest hash, and as many more where the formula has
to seed; scoring covers all documents.

Defined results: null, empty and blank texts, and texts that are no German or English prose, have level null; null or
impossible labels and labels without a document do not count; a document labelled twice counts once; without any
labels all levels are seeded by the formula; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.llm.sentence_units import units

LEVELS, LANGUAGES = (1, 2, 3), ("de", "en")
#: Most labelled documents the models are fitted on, and rounds of the fit.
MAX_LABELLED, ROUNDS = 1000, 4
#: A language's level with fewer labelled documents than this is seeded by the formula.
MIN_LABELLED = 3
SMOOTHING, OWN_LEVEL = 0.5, 2.0
#: A unit is a sentence of the language if so much of its words the models know; a document is prose if sentences make up so much of it.
KNOWN, PROSE = 0.55, 0.5
#: With fewer closed units than this share a document has lost its final marks, and units without them count as well.
OPEN = 0.3
#: LIX up to the first is simple, from the second on specialist.
LIX = (38.0, 66.0)

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_DIGIT = re.compile(r"\d")
#: A line counts as shared from so many of the labelled documents on, and from this share of them, so that larger samples behave alike.
_SHARED, _SHARED_PART = 3, 0.005


def tokens(sentence: str) -> list[str]:
    """Lower-case words, numbers as one token each, and the sentence's length in steps."""
    words = _TOKEN.findall(sentence.replace("·", "").replace("­", "").lower())
    if _DIGIT.search(sentence):
        words = ["#" if w.isdigit() else w for w in words]
    return [*words, f"<{min(12, math.isqrt(2 * len(words)))}>"] if words else []


def lix(sentences: list[list[str]]) -> float:
    """Words per sentence plus the percentage of words of more than six letters."""
    words = [w for s in sentences for w in s[:-1]]
    return len(words) / max(1, len(sentences)) + 100.0 * sum(len(w) > 6 for w in words) / max(1, len(words))


def _line_key(line: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", line.lower())).strip()


_LOWER = re.compile(r"(?<!\w)[^\W\d_A-ZÄÖÜ]\w*")


def may_be_sentence(unit: str) -> bool:
    """Whether a unit without a final mark reads like a sentence: enough words in lower case, no row or address."""
    words = len(_TOKEN.findall(unit))
    return words >= 4 and not _ROW.search(unit) and len(_LOWER.findall(unit)) * 3 >= words


class Models:
    """Log probabilities: a row per word, a column per class. Class 0 to 2 are levels of the first language, 3 its shared lines, 4 its items, and so on."""

    def __init__(self, counts: list[Counter[str]], weights: list[float]) -> None:
        total: Counter[str] = Counter()
        for c in counts:
            total.update(c)
        kept = sorted(w for w, n in total.items() if n > 1)
        self.index = {w: k for k, w in enumerate(kept)}
        table = np.array([[c[w] for c in counts] for w in kept] + [[0] * len(counts)], float).reshape(-1, len(counts)) + SMOOTHING
        self.log = np.log(table / table.sum(axis=0))
        self.prior = np.log(np.array(weights) + 1.0) - np.log(sum(weights) + len(weights))
        self.unknown = len(kept)

    def score(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihoods, share of known words, number of words) of every sentence."""
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        get, none = self.index.get, self.unknown
        ids = np.fromiter((get(w, none) for s in sentences for w in s), np.int64, int(sizes.sum()))
        if not len(ids):
            return np.zeros((0, len(self.prior))), np.zeros(0), np.zeros(0)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        known = np.add.reduceat((ids != none).astype(float), starts)
        return np.add.reduceat(self.log[ids], starts, axis=0), (known - 1) / np.maximum(sizes - 1, 1), sizes - 1


SHARED, ITEM = len(LEVELS), len(LEVELS) + 1
_WIDE = len(LEVELS) + 2
_ENDS = frozenset(".!?…“”»\"")


_ROW = re.compile(r"://|[|\t{}]|;\S| {3,}")
_ITEM = re.compile(r"(?:[-–—*•·▪►●]|\(?\d{1,3}(?:\.\)|[.)])|\(?[a-z]\))\s")


def is_closed(unit: str) -> bool:
    """Whether a unit ends as sentences do, and is no item or row."""
    return unit[-1] in _ENDS and unit.rstrip("“”»\" \u00a0")[-1:] in (".", "!", "?", "…") and not _ROW.search(unit) and not _ITEM.match(unit)


def fit(rows: list[tuple[str, str, int]]) -> Models:
    """Models from (text, language, level)."""
    seen: Counter[str] = Counter()
    documents = []
    for text, language, level in rows:
        cut = [text[a:b] for a, b in units(text)]
        documents.append((LANGUAGES.index(language), level, cut))
        seen.update({_line_key(u) for u in cut})
    shared = max(_SHARED, math.ceil(_SHARED_PART * len(documents)))
    sentences, own, at = [], [], []
    for language, level, cut in documents:
        closed = [is_closed(u) for u in cut]
        open_too = sum(closed) < OPEN * len(cut)  # a document that has lost its marks: what is open may be a sentence
        for u, end in zip(cut, closed):
            if t := tokens(u):
                kind = SHARED if seen[_line_key(u)] >= shared else level - 1 if end else ITEM
                if kind == ITEM and open_too:
                    continue
                sentences.append(t)
                own.append(language * _WIDE + kind)
                at.append((language, kind >= SHARED))
    classes = np.array(own, dtype=int)
    models = _count(sentences, classes)
    language = np.array([x[0] for x in at], dtype=int)
    free = np.array([not x[1] for x in at], dtype=bool)
    first = np.array(own, dtype=int)
    for _ in range(ROUNDS if len(sentences) else 0):
        scores = models.score(sentences)[0] + models.prior
        scores[np.arange(len(first)), first] += OWN_LEVEL
        for k in range(len(LANGUAGES)):
            rows_ = np.flatnonzero(free & (language == k))
            classes[rows_] = k * _WIDE + scores[rows_, k * _WIDE : k * _WIDE + len(LEVELS)].argmax(axis=1)
        models = _count(sentences, classes)
    return models


def _count(sentences: list[list[str]], classes: np.ndarray) -> Models:
    counts: list[Counter[str]] = [Counter() for _ in range(_WIDE * len(LANGUAGES))]
    for s, c in zip(sentences, classes):
        counts[c].update(s)
    return Models(counts, [float((classes == k).sum()) for k in range(len(counts))])


def _chosen(own: DataFrame, keys: DataFrame) -> list:
    """(text, language, level) of the MAX_LABELLED documents of smallest hash in ``keys`` (doc_id, level). Only the texts of these come to the driver."""
    some = keys.groupBy("doc_id").agg(F.min("level").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # At most MAX_LABELLED keys; of documents that share one a single text counts.
    return own.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("language").alias("language"), F.min("level").alias("level")).orderBy("doc_id").collect()


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[str, str, int]]:
    """Labelled documents, and for levels that lack them documents seeded by the formula."""
    language = F.lower(F.substring("lang", 1, 2))
    level = labels.filter(F.col("reading_level").isin(*LEVELS)).groupBy(F.col("doc_id").alias("_id")).agg(F.expr("percentile(reading_level, 0.5)").alias("level"))
    own = documents.filter(F.col("text").isNotNull() & language.isin(*LANGUAGES)).select("doc_id", "text", language.alias("language"))
    keys = documents.select("doc_id", language.alias("language"))
    wanted = keys.filter(F.col("language").isin(*LANGUAGES)).join(level, F.col("doc_id") == F.col("_id")).select("doc_id", "level")
    labelled = _chosen(own, wanted)
    rows = [(r.text, r.language, math.floor(r.level)) for r in labelled]
    have = Counter((x[1], x[2]) for x in rows)
    lacking = {(a, b) for a in LANGUAGES for b in LEVELS if have[a, b] < MIN_LABELLED}
    if lacking:
        some = keys.filter(F.col("language").isin(*{a for a, _ in lacking})).select("doc_id", F.lit(0).alias("level"))
        for r in _chosen(own, some):
            found = [t for a, b in units(r.text) if r.text[b - 1] in ".!?" and (t := tokens(r.text[a:b]))]
            if len(found) >= 3:
                x = lix(found)
                seeded = 1 if x <= LIX[0] else 3 if x >= LIX[1] else 2
                if (r.language, seeded) in lacking:
                    rows.append((r.text, r.language, seeded))
    return rows


def _summarise(texts: list[str | None], models: Models) -> dict[str, list]:
    sentences, owner, chars, closed, alike = [], [], [], [], []
    wordless = np.zeros(len(texts))
    for k, text in enumerate(texts):
        if not text:
            continue
        found = []
        for a, b in units(text):
            unit = text[a:b]
            if t := tokens(unit):
                sentences.append(t)
                found.append(unit)
                owner.append(k)
                chars.append(b - a)
            else:
                wordless[k] += b - a
        ends = [is_closed(u) for u in found]
        closed += ends
        # Only a document that may have lost its marks needs a look at what has none.
        alike += [e or may_be_sentence(u) for u, e in zip(found, ends)] if sum(ends) * 10 < 7 * len(ends) else ends
    n = len(texts)
    scores, known, words = models.score(sentences)
    out = {"level": [None] * n, "language": [None] * n, "sentences": [0] * n, "simple": [0] * n, "prose": [0.0] * n}
    if not sentences:
        return out
    # What a sentence is by itself has the prior of its class; a document's level counts the prior of levels once.
    by_language = (scores + models.prior).reshape(len(sentences), len(LANGUAGES), _WIDE)
    best_language = by_language.max(axis=2).argmax(axis=1)
    own = by_language[np.arange(len(sentences)), best_language]
    owners, size, ends, kind = np.array(owner), np.array(chars, float), np.array(closed), own.argmax(axis=1)
    shared = (known >= KNOWN) & (kind == SHARED)
    kept = np.bincount(owners[~shared], minlength=n)
    lost = np.bincount(owners[~shared & ends], minlength=n) < OPEN * kept
    counted = (known >= KNOWN) & (words >= 3) & ~shared & (ends | lost[owners] & (kind != ITEM) & np.array(alike))
    levels = own[:, : len(LEVELS)]
    top = levels.argmax(axis=1)
    total = np.bincount(owners[~shared], size[~shared], n) + wordless
    good = np.bincount(owners[counted], size[counted], n)
    number = np.bincount(owners[counted], minlength=n)
    simple = np.bincount(owners[counted & (top == 0)], minlength=n)
    english = np.bincount(owners[counted & (best_language == 1)], minlength=n)
    prior = models.prior.reshape(len(LANGUAGES), _WIDE)[:, : len(LEVELS)]
    sums = np.zeros((n, len(LEVELS)))
    np.add.at(sums, owners[counted], levels[counted] - prior[best_language[counted]])
    sums += prior[(english * 2 > number).astype(int)]
    share = np.divide(good, total, out=np.zeros(n), where=total > 0)
    for k in np.flatnonzero((number > 0) & (share >= PROSE)):
        out["level"][k] = int(LEVELS[sums[k].argmax()])
        out["language"][k] = LANGUAGES[int(english[k] * 2 > number[k])]
    out["sentences"], out["simple"], out["prose"] = number.tolist(), simple.tolist(), share.tolist()
    return out


_AT_ONCE = 512


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    models = sent.value
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            found = _summarise(part.column(1).to_pylist(), models)
            columns = [part.column(0), pa.array(found["level"], pa.int32()), pa.array(found["language"], pa.string())]
            columns += [pa.array(found["sentences"], pa.int32()), pa.array(found["simple"], pa.int32()), pa.array(found["prose"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "level", "language", "sentences", "simple", "prose"])


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level, language, sentences, simple, prose) of every document.

    ``sentences``: German or English sentences of the text itself; ``simple``: those of level 1; ``prose``: their share of the letters.
    """
    models = fit(training_rows(documents, labels))
    sent = documents.sparkSession.sparkContext.broadcast(models)
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        lambda it: _scored(it, sent), f"doc_id {kind}, level int, language string, sentences int, simple int, prose double"
    )


def disagreements(levels: DataFrame, easy: DataFrame) -> DataFrame:
    """Rows of ``levels`` whose flag in ``easy`` (doc_id, easy) disagrees with most of their sentences; null flags never do."""
    most_simple = F.col("simple") * 2 > F.col("sentences")
    least_simple = F.col("simple") * 2 < F.col("sentences")
    both = levels.filter(F.col("level").isNotNull()).join(easy.filter(F.col("easy").isNotNull()), "doc_id")
    return both.filter(F.when(F.col("easy"), least_simple).otherwise(most_simple))
