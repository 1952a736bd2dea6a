"""Sentence units of texts in any script.

A text is cut into stretches first: a line each, or, where paragraphs are wrapped to a fixed width, all lines of a
paragraph. Lines that are no running text (list items, table rows, code, noise) are one unit. Of every other stretch
a semi-Markov dynamic program selects whole spans between all places where a sentence could end: a span is scored by
its closing word and mark, by the opening word of what follows and by its length, and its quotations have to be
balanced: a span that would begin or end within a quotation has no score at all, however long the quotation is. Marks
without a partner in the stretch bind nothing.

The program is exact and takes linear time: as a length takes away at most one point, the best place before is looked for
backwards only until none farther off can be better.

Defined results: null, empty and blank texts have no units; positions count code points, the end is exclusive, and
no unit begins or ends with a blank; a text without any end mark is one unit per line; any length of text is read
whole; repeated rows stay repeated; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on, and those that may also close one; without the last dot.
INNER = frozenset(
    "abs art az bd bspw bzw ca cf co dipl dr evtl fr geb gem ggf h hr hrsg inkl ing insb kap lt max min mind nr prof sog st tel u usf v verf vgl z zz"
    " approx bldg capt col dept e.g eg fig gen gov i.e ie inc jr lt mr mrs ms mt no p pp rev sec sen sr vol vs"
    " chap env m mlle mm mme n ok ок ул д т е стр см им р пр напр проф др гл د م أ डॉ श्री प्रो पं सु".split()
)
CLOSING = frozenset("a.m p.m am pm bf dgl etc e.v inc jh jhd jr ltd mio mrd sec str std tsd u.a usw usf г гг чел тыс млн млрд руб".split())
#: Words that follow a number with a dot which counts, and does not end anything.
AFTER_ORDINAL = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär mrz apr jun jul aug sep sept okt nov dez"
    " jahrhundert jahrhunderts jahrhunderte jh jhd jahrtausend quartal klasse stock stockwerk etage platz mal januar". split()
)
#: Words that open sentences, and with a capital after an abbreviation hardly anything else.
STARTERS = frozenset(
    "aber alle als am an auch auf aus bei bis da dabei damit dann das dem den der die dies diese dieser doch dort ein eine einem einen einer er es für haben hat ich"
    " ihre im in ist jetzt kommen man mit nach noch nun nur ob ohne rufen sagen sein seit sie sind so stellen und unter viele vom von vor was weil wenn wer wie wir wird wo"
    " zu zum zur a all an and as at but by for from he how if in it many most no now on or send she since that the then there these they this to under we what when with you"
    " au avec ce ces cette dans des elle en et il ils la le les mais nous on où par pour pourquoi quand que qui selon si son sur un une vous"
    " а в во для и как когда к мы на но он она они по с то что это".split()
)
_ENDS = re.compile(
    r"(?:[.!?…]+|[。！？｡।॥؟۔]+)"  # final marks
    r"(?:[\"”“’'»«)\]』」〉》]|[  ]»)*"  # and what closes with them
)
_STRONG = frozenset("!?。！？｡।॥؟۔")
_WIDE = frozenset("。！？｡")
_OPENERS, _CLOSERS = frozenset("„«「『‚"), {"„": "“”", "«": "»", "“": "”", "「": "」", "『": "』", '"': '"', "»": "«"}
_QUOTES = re.compile("[„“”«»「」『』\"]")
_MARKER = re.compile(r"\s*(?:[-–—*•·▪►●○‣◦]\s|\(?\d{1,3}(?:\.\)|[.)])\s+(?=\S)|\(?[a-zA-Z]\)\s)")
_DATE_START = re.compile(r"\s*\d{1,2}\.\s+(\w+)")
_COLUMNS = re.compile(r"\S\t+\S|\S {3,}\S.*\S {3,}\S|\S;\S+;\S")
_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile("(?<=[฀-๿๐-๙])[  　]+(?=\\S)|(?<=\\S)[  　]+(?=[฀-๿])")
_WORD_AFTER = re.compile(r"[\s]*([„“«»「『\"'(\[]*)([^\W\d_]+|\d+|\S)?")


@lru_cache(maxsize=200_000)
def _closing(word: str, mark: str) -> float:
    """How readily a sentence ends with ``word`` and ``mark``."""
    if mark[-1] in _STRONG or mark[0] in _STRONG:
        return 4.0
    if mark[0] == "…" or len(mark) > 1:
        return -1.0
    low = word.lower()
    core = low.rpartition(".")[2].rpartition("-")[2]
    if low.isdigit() or core.isdigit():
        return 0.0 if len(core) <= 2 and core == low else 2.5
    if low in CLOSING or core in CLOSING:
        return -1.5
    if low in INNER or core in INNER:
        return -7.0
    if len(core) == 1 and core.isalpha():
        return -5.0
    if low.startswith("www") or "://" in low:
        return -2.0
    return 3.0


@lru_cache(maxsize=200_000)
def _opening(quote: str, word: str, number_before: bool, gap: bool, quoted: bool, core: str, cased: bool) -> float:
    """How readily the next sentence opens with ``quote`` and ``word``."""
    first, strong, wide = word[:1], core[-1] in _STRONG, core[-1] in _WIDE
    if first and first in ",;:)—–/" and not quote:
        return -9.0 if first in ",;:)" or quoted else 0.0
    if number_before and word.lower() in AFTER_ORDINAL:
        return -9.0
    if first == "と" and quoted:
        return -9.0
    if not gap and not quote:
        # Without a blank only a capital, or a script without blanks, opens a sentence.
        if not (first.isupper() or (first.isalpha() and not first.islower())):
            return 0.0 if (strong and not first.islower() and quoted or wide) else -9.0
        return 1.0
    if first.islower() and cased:
        return -9.0 if quoted else -2.5 if strong else -6.0
    if quote:
        return 2.0
    if first.isupper():
        return 2.5 if word.lower() in STARTERS else 1.5
    if first.isdigit():
        return -0.5 if number_before else 0.5
    return 0.5


def _quotations(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(opening, closing) positions of the outermost quotations of the stretch, in order."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _QUOTES.finditer(text, start, end):
        q, at = m[0], m.start()
        if q == '"':
            opens = (at == start or not text[at - 1].isalnum()) and at + 1 < end and not text[at + 1].isspace()
            closes = at > start and not text[at - 1].isspace()
            partner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == q), -1) if closes else -1
            if partner < 0 and opens:
                stack.append((q, at))
            if partner < 0:
                continue
            del stack[partner + 1 :]
        elif not (stack and q in _CLOSERS.get(stack[-1][0], "")):
            if q in _OPENERS or q == "“" or q == "»" and not stack:
                stack.append((q, at))
            continue
        _, opened = stack.pop()
        while found and found[-1][0] > opened:
            found.pop()
        found.append((opened, at))
    return found


def _length_score(chars: int) -> float:
    """Spans of a few letters, or of a thousand, are less likely to be sentences."""
    return -1.0 if chars < 4 else -0.3 if chars < 12 else 0.0 if chars < _LONG else -0.4


_LONG = 600


def _select(start: int, end: int, places: list[tuple[int, float]]) -> list[int]:
    """The semi-Markov program: of ``places`` (position, score) those at which a span ends, so that spans and ends score most."""
    at, best, back, lead = [start], [0.0], [0], [0]  # lead: of the places so far that with the best score
    # Without a place two spans are one, which takes away no more than the length of a long one does: a place that costs more is in no best choice.
    for place, gain in (*(x for x in places if x[1] >= -0.4), (end, 0.0)):
        # A span ends here and began at an earlier place: at the best one so far, if its length is an ordinary one.
        source = lead[-1]
        top = best[source] + _length_score(place - at[source])
        if top < best[source]:
            # Else backwards; none is better than the best place before it, nor than that with what a long span loses.
            i, top = len(at) - 1, -1e18
            while i >= 0 and top < best[lead[i]]:
                if place - at[i] >= _LONG:
                    i = lead[i]
                value = best[i] + _length_score(place - at[i])
                if value >= top:
                    top, source = value, i
                i = -1 if place - at[i] >= _LONG else i - 1
        at.append(place)
        best.append(top + gain)
        back.append(source)
        lead.append(len(at) - 1 if best[-1] > best[lead[-1]] else lead[-1])
    cuts, j = [], back[-1]
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


_ANY_END = re.compile("[.!?…。！？｡।॥؟۔]")
_SPACED = "\"”“’'»«)]』」〉》 \u00a0\u202f"


_TAIL = 48


def _word_before(text: str, start: int, at: int) -> str:
    """The word text[start:at], of a very long one its beginning and its end, which is all that closing words are told by."""
    return text[start:at] if at - start <= 2 * _TAIL else text[start : start + _TAIL] + text[at - _TAIL : at]


def _sentences(text: str, start: int, end: int, thai: bool, out: list[tuple[int, int]]) -> None:
    """Units of the stretch text[start:end] of running text."""
    cuts: list[int] = []
    if thai and _THAI.search(text, start, end):
        cuts = [m.start() for m in _THAI_GAP.finditer(text, start, end)]
    stretch = text[start:end]
    cased = not (stretch.islower() or stretch.isupper())
    quoted = _quotations(text, start, end) if _QUOTES.search(stretch) is not None else []
    quote_at = 0
    places: list[tuple[int, float]] = []
    began = seen = start  # where the word at hand began, and up to where blanks were looked for
    for m in _ENDS.finditer(text, start, end):
        stop = m.end()
        if stop >= end:
            break
        at, mark, following = m.start(), m[0], text[stop]
        gap = following.isspace()
        if mark == "." and not gap and (following.islower() or following.isdigit() or following in "-,;:/)%&=_"):
            continue
        piece = text[seen:at]
        seen = stop
        if len(parts := piece.rsplit(None, 1)) > 1 or piece[:1].isspace():
            began = at - len(parts[-1]) if parts else at
        if piece[-1:].isspace() or at == start:
            word, began = "", at
        else:
            word = _word_before(text, began, at).lstrip("([„“«»\"'‚")
            if word == "V" and text[at - 4 : at - 1] in ("e. ", "e.\n", "e.\u00a0"):
                word = "e.V"
        core = mark.rstrip(_SPACED)
        if core[-1:] in _WIDE:
            began = stop
        if core == "." and (not word or not gap and word.lower() in ("www", "http", "https")):
            continue
        while quote_at < len(quoted) and quoted[quote_at][1] < stop:
            quote_at += 1
        if quote_at < len(quoted) and quoted[quote_at][0] < stop:
            continue
        after = _WORD_AFTER.match(text, stop, end)
        quote, following = after[1], after[2] or ""
        if not gap and core == "." and not quote and not following[:1].isalpha():
            continue
        score = _closing(word, core) + _opening(quote, following, word[-1:].isdigit(), gap, len(mark) > len(core), core, cased)
        if score > -8.0:
            places.append((stop, score))
    if places:
        cuts += _select(start, end, places)
    if not cuts:
        _add(text, start, end, out)
        return
    cuts.sort()
    at = start
    for cut in (*cuts, end):
        _add(text, at, cut, out)
        at = max(at, cut)


def _add(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        out.append((a, b))


def _is_single(line: str) -> bool:
    """Whether the line is an item, a row, code or noise, and so one unit whatever marks are in it."""
    if _MARKER.match(line):
        date = _DATE_START.match(line)
        return not (date and date[1].lower() in AFTER_ORDINAL)
    if line.count("|") > 1 or _COLUMNS.search(line) or "{" in line or "}" in line or "&&" in line:
        return True
    letters = sum(map(str.isalpha, line)) + line.count(" ")
    return letters * 2 < len(line)


_STOPS = frozenset(".!?…”“»\"。！？।؟)")
_FINAL = frozenset(".!?…:;”“»\"。！？।؟")


def _fits(lines: list[str], width: int) -> bool:
    """Whether a line filled up to ``width`` would have broken just where these do."""
    for a, b in zip(lines, lines[1:]):
        if len(a) + 1 + len(b.split(None, 1)[0]) <= width:
            return False
    return True


def _stretches(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, wrapped) of every line, or wrapped paragraph, that is not blank."""
    spans, at = [], 0
    for raw in text.split("\n"):
        spans.append((at, at + len(raw), raw.strip()))
        at += len(raw) + 1
    blocks: list[list[tuple[int, int, str]]] = [[]]
    for s in spans:
        if s[2]:
            blocks[-1].append(s)
        elif blocks[-1]:
            blocks.append([])

    def candidate(block: list, least: int) -> int:
        """Width of the block if it could be wrapped, else 0."""
        if len(block) < least:
            return 0
        lines = [s[2] for s in block]
        width = max(map(len, lines))
        if not 30 <= width <= 130 or any(_MARKER.match(x) or _COLUMNS.search(x) for x in lines[:2]) or not _fits(lines, width):
            return 0
        broken = sum(x[-1] not in _FINAL for x in lines[:-1])
        return width if broken * 2 > len(lines) - 1 and lines[-1][-1] in _STOPS else 0

    widths = [w for b in blocks if (w := candidate(b, 3))]
    most = max(widths, default=0)
    for block in blocks:
        if len(block) > 1:
            lines = [s[2] for s in block]
            wrapped = candidate(block, 3) > 0
            if not wrapped and most and max(map(len, lines)) <= most + 2 and lines[-1][-1] in _STOPS and not _MARKER.match(lines[0]) and not _COLUMNS.search(lines[0]):
                wrapped = _fits(lines, most) or _fits(lines, max(map(len, lines))) and len(lines) > 2
            if not wrapped and not most and len(block) == 2:
                wrapped = candidate(block, 2) >= 45 and lines[0][-1] not in _FINAL and lines[1][0].islower()
            if wrapped:
                yield block[0][0], block[-1][1], True
                continue
        for a, b, _ in block:
            yield a, b, False


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of one text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    thai = _THAI.search(text) is not None
    for a, b, wrapped in _stretches(text):
        if not wrapped and (not thai and not _ANY_END.search(text, a, b) or _is_single(text[a:b])):
            _add(text, a, b, out)
        else:
            _sentences(text, a, b, thai, out)
    return out


_AT_ONCE = 1024


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            found = [units(t) for t in part.column(1).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
            keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))], names=["key", "start_pos", "end_pos"])


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos): one row per sentence unit of every row's text."""
    kind = df.select(F.col(f"`{key}`")).dtypes[0][1]
    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    return own.mapInArrow(_cut, f"key {kind}, start_pos int, end_pos int").withColumnRenamed("key", key)
