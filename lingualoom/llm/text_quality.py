"""Quality statistics of documents, and whether a text is natural prose, a list, a table or junk.

Each text gets a row of statistics. Standardised, they are fitted with a Gaussian mixture by expectation-maximisation
over all documents: every round sums responsibilities, first and second moments per component in the executors, and
only these sums, whose size does not depend on the data, come to the driver. Components begin at the statistics of
inspected examples, written for this purpose; the beginning counts as little as ``HOLD`` documents. Rounds end when the mean
log likelihood gains less than ``GAIN``, ``ROUNDS`` at most; components that hold next to no documents are dropped. In the end a
component bears the kind of the examples that it explains best. A document's kind is the one with the largest posterior.

Statistics: ``words`` (runs of letters and digits; in Thai, Japanese and Chinese function words and short runs between them),
``mean_word_length`` (30 at most), ``symbol_ratio`` and ``digit_ratio`` (of the visible characters), ``ended_share`` (of the
lines that are not blank, those that end in final punctuation, with or without closing quotes), ``common_share`` (function
words of the words), ``running_share`` and ``row_share`` (of the letters, those in lines of running text, and in items, rows and
code), ``line_words`` (logarithm of the mean words of a line), ``distinct_share``, ``odd_share`` (of the different words those that no language has),
``lower_share``.

Defined results: null, empty and blank texts are of kind ``empty``, have 0 in all statistics and take no part in the fit; texts
of any length are read whole; repeated documents count each; an empty table gives an empty result; other columns do not
matter. With fewer documents than components the mixture keeps its beginning.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.session import materialise

#: Most rounds of the fit, and the gain of the mean log likelihood below which it ends.
ROUNDS, GAIN = 12, 0.01
#: What is added to variances (of standardised statistics), and how many documents a component's beginning counts for.
RIDGE, HOLD = 0.15, 2.0
#: Components that hold less than this share of the documents, or less than one document, are dropped.
DEAD = 1e-4
STATISTICS = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_share", "common_share", "running_share",
    "row_share", "line_words", "distinct_share", "odd_share", "lower_share",
)
#: The statistics the mixture is fitted on.
FITTED = STATISTICS[1:]

#: Frequent function words of the languages of the corpus.
COMMON = frozenset(
    "aber alle am an auf aus bei bis da das dass dem den der des die dort du durch ein eine einem einen einer er es für gegen haben hat ich ihr ihre im in ist kann kein"
    " können man mehr mit muss müssen nach nicht noch nur oder sagt sein sich sie sind so über um und uns unter viele vom von vor war waren was wenn werden wie wir wird wo wurde zu zum zur"
    " a about all an and are as at be been but by can for from had has have he her his if in is it many more most no not of on or our she so such than that the their there these they"
    " this to under up want was we were what when where which while who will with you your"
    " au aux avec ce ces cette dans de des dont du elle en est et il ils la le les leur mais ne nous on ont ou où par pas plus pour pourquoi que qui se selon ses son sont sur un une vous à été"
    " а без бы был в во все для до его за и из или их к как когда ко мы на не но о об он она они от по при с со так то у что это"
    " का के की को में है हैं से पर और ने यह कि एक हो नहीं लिए क्या आपको ही भी तक कृपया"
    " في من على إن أن إلى عن مع هذا هذه التي الذي كان هل منذ قال قبل بعد خلال ما لا".split()
)
#: The same of languages that are written without blanks.
COMMON_DENSE = frozenset(
    "ที่ และ ใน ของ เป็น ได้ ไม่ มี ให้ ว่า จะ กับ จาก ไป มา แต่ ก็ นี้ นั้น หรือ โดย ซึ่ง อยู่ ต้อง คุณ เรา เขา เพื่อ ตั้งแต่ ทุก แก่ ไปยัง ภายใน เมื่อ แล้ว ถ้า คือ ถึง ตาม ด้วย กว่า การ ความ ผู้ อย่าง ยัง เคย ไหม ครับ ค่ะ"
    " は が を に で と の も へ や から まで より です ます でした ました ません ない した して する いる ある いた など この その あの これ それ ここ ください ため こと もの よう か ね よ"
    " 的 了 在 是 我 我们 你 你们 您 他 她 它 他们 不 没 没有 有 和 与 就 都 也 很 到 说 要 会 能 可以 这 那 为 被 把 从 对 吗 呢 吧 请 已经 比 每 及 或 但 而 于 之 所以 因为 如果 什么 怎么 将 并 个 年 上 中 下 多 大家 需要".split()
)
_COMMON = COMMON | COMMON_DENSE
_WORD = re.compile(r"[^\W_]+")
_CELLS = re.compile(r";\S")
_TIMED = re.compile(r"\s*\d{1,2}[:.]\d\d\s")
_PHONE = re.compile(r"(?<!\w)[0+]\d[\d /()-]{5,}\d\W*$")
_CAPITAL = re.compile(r"(?<![^\W_])[^\W_a-zß-öø-ÿа-яё\u0590-\uffff]")
_ITEM = re.compile(r"\s*(?:[-–—*•·▪►●]|\(?\d{1,3}(?:\.\)|[.)])|\(?[a-z]\))\s")
_ITEM_STARTS = frozenset("-–—*•·▪►●(0123456789abcdefghijklmnopqrstuvwxyz")
_ENTRY = re.compile(r"[^.!?]{2,60}: [\d.,]+ \S+$")
_NAMES = re.compile(r"(?:[^\W\d_][\w-]*, ){3,}[\w-]+,?$")
_ENDED = re.compile(r"[.!?…。！？।؟][“”»\"')\]」 ]*$")
#: Letters of scripts without blanks between words.
_DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_FUNCTION = "(?:" + "|".join(sorted(COMMON_DENSE, key=lambda w: (-len(w), w))) + ")(?![ぁぃぅぇぉゃゅょーะ-ฺ็-๎ๅ])"
#: Words of such scripts: function words; else runs of one script up to the next of these, no longer than words are. Other words as everywhere.
_PIECE = re.compile(
    f"{_FUNCTION}|[゠-ヿ]+|(?:(?!{_FUNCTION})[぀-ゟ]){{1,3}}|(?:(?!{_FUNCTION})[㐀-鿿]){{1,2}}"
    f"|(?:(?!{_FUNCTION})[เ-ไ]?[ก-ฮ][ะ-ฺ็-๎ๅ]*){{1,3}}|[฀-๿]|(?:(?![฀-๿぀-ヿ㐀-鿿])[^\\W_])+"
)
_ODD_PIECE = re.compile(r"[㐀-䶿]|([฀-๿぀-ヿ㐀-鿿])\1{2}|[ぁぃぅぇぉゃゅょー]|[ะ-ฺ็-๎ๅเ-ไ](?:$|[ะ-ฺ็-๎ๅ])")
_UNCASED = re.compile("[֐-෿฀-๿぀-ヿ㐀-鿿]")
_ODD = re.compile(r"(?:\d+[a-z]\w*|[a-z]+\d\w*|[bcdfghjklmnpqrstvwxz]{3,}|\w*[ãâÃÂŒ-ž]\w*|\w{30,}|(\w{1,3})\1{4,}\w{0,2})$")
_CLOSERS = frozenset(".!?…。！？।؟“”»\"')]」")
_NOISE = re.compile(r"[ÃÂâï¬€Ÿž¤¶§¼½¿‚„]")


def _is_row(line: str) -> bool:
    """Whether a line is a row of cells, an address, code, an entry or an item. Cheap looks come first."""
    if "|" in line or "\t" in line or "://" in line or "   " in line or "{" in line or "}" in line:
        return True
    if line[0] in _ITEM_STARTS and _ITEM.match(line) or ";" in line and _CELLS.search(line):
        return True
    if ":" in line and _ENTRY.match(line) or line[0].isdigit() and _TIMED.match(line):
        return True
    return _PHONE.search(line) is not None or line.count(", ") > 2 and _NAMES.match(line) is not None


@lru_cache(maxsize=200_000)
def _is_odd(word: str) -> bool:
    """Whether a word is none that languages have: letters among digits, no vowels, wrong encoding, endless or stuttering."""
    return _ODD.match(word) is not None or _ODD_PIECE.match(word) is not None


_VISIBLE = re.compile(r"[\w\s]+")
_DIGITS = re.compile(r"\d+")


def statistics(text: str) -> list[float]:
    """The statistics of one text that is not blank, in the order of ``STATISTICS``."""
    foreign = _UNCASED.search(text) is not None
    dense = len(_DENSE.findall(text)) if foreign else 0
    visible = max(1, len("".join(text.split())))
    signs = _VISIBLE.sub("", text)
    # Marks of vowels in Indic, Arabic and Thai texts are no symbols.
    symbols = sum(1 for c in signs if not "\u0300" <= c <= "\u0e7f") if foreign else len(signs)
    digits = sum(map(len, _DIGITS.findall(text)))
    lowered: list[str] = []
    upper = len(_CAPITAL.findall(text))
    lines = total = ended = running = rows = letters = commons = 0
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            continue
        lines += 1
        size = len(line)
        total += size
        words = (_PIECE if dense and _DENSE.search(line) else _WORD).findall(line.lower())
        lowered += words
        letters += sum(map(len, words))
        common = sum(map(_COMMON.__contains__, words))
        commons += common
        closed = line[-1] in _CLOSERS and _ENDED.search(line) is not None
        ended += closed
        if _is_row(line):
            rows += size
            continue
        if len(words) >= 3 and common * (6 if closed or size > 55 else 4) >= len(words) and len(_NOISE.findall(line)) * 12 <= size:
            # Running text has function words; lines of it that are long, or end as sentences do, need fewer.
            running += size
    count = max(1, len(lowered))
    unique = set(lowered)
    share, lines = 1.0 / max(1, total), max(1, lines)
    distinct = len(unique) / count * min(1.0, 0.55 + count / 500)
    odd = sum(map(_is_odd, unique)) / max(1, len(unique))
    return [
        float(len(lowered)), min(letters / count, 30.0), symbols / visible, digits / visible, ended / lines, commons / count, running * share,
        rows * share, math.log1p(count / lines), distinct, odd, 1 - upper / count,
    ]


def _many(texts: list[str | None]) -> np.ndarray:
    none = [0.0] * len(STATISTICS)
    return np.array([statistics(t) if t and not t.isspace() else none for t in texts], float).reshape(-1, len(STATISTICS))


_AT_ONCE = 1024
_SHAPE = ", ".join(f"{s} double" for s in STATISTICS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            texts = part.column(1).to_pylist()
            found = _many(texts)
            empty = pa.array([not t or t.isspace() for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), empty, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(found.shape[1]))], names=["doc_id", "empty", *STATISTICS])


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, empty, statistics) of every document."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_counted, f"doc_id {kind}, empty boolean, {_SHAPE}")


def _rows(pattern: str, n: int, values: list[str]) -> str:
    return "\n".join(pattern.format(*(values[(k * (j + 3) + j) % len(values)] for j in range(6)), k=k, n=k * 37 % 91 + 1) for k in range(n))


_TERMS = ["Wohnberatung", "Schulessen", "Radwege", "Stadtfest", "Impfbus", "Lesehilfe", "Kurzzeitpflege", "Müllabfuhr", "Fahrplan", "Sportplatz", "Hallenbad"]
_PLACES = ["Altdorf", "Bergheim", "Talkirch", "Neuhof", "Seefeld", "Brückau", "Waldsee", "Hagenau", "Rodenbach", "Lindach", "Ostheim", "Felden", "Krumbach"]
_STANDARD = (
    "Nach Angaben der Verwaltung wird das Gebäude in Altdorf bis zum Herbst für rund 1,2 Millionen Euro saniert, obwohl die Mittel dafür im Haushalt noch nicht eingeplant sind."
    " Die Bürgermeisterin erklärte am 3. Mai 2019: „Wir haben lange auf diese Entscheidung gewartet.“ Interessierte können sich bis Ende des Monats für die Veranstaltung anmelden."
)
_SIMPLE = "In Altdorf gibt es einen neuen Bus.\nDer Bus fährt alle 20 Minuten.\nHaben Sie Fragen?\nDann rufen Sie uns an.\nDas Büro ist in der Talstraße 4.\nEs öffnet um 9 Uhr.\nViele Menschen finden das gut."
_ENGLISH = (
    "According to the council, the old school in Bergheim will be repaired by the end of the year at a cost of 300,000 euros, which is more than was planned."
    " Residents who want to comment on the plans can do so until 4 June. The court has yet to decide on the complaint that was brought by the neighbours."
)

#: Inspected examples of each kind, where the components begin.
EXAMPLES: list[tuple[str, str]] = [
    ("prose", "\n".join([_STANDARD, _STANDARD.replace("Altdorf", "Seefeld"), "Artikel drucken"])),
    ("prose", _SIMPLE + "\n" + _SIMPLE.replace("Altdorf", "Neuhof")),
    ("prose", _SIMPLE.replace(".", "").replace("?", "")),
    ("prose", _STANDARD + "\n- Radwege in Talkirch\n- Stadtfest in Neuhof\n- Impfbus in Seefeld\n" + _STANDARD),
    ("prose", _ENGLISH + "\nHow to comment\n" + _ENGLISH),
    ("prose", "Selon la mairie, les travaux de la gare vont durer plus de deux ans. Pourquoi la ville a-t-elle attendu si longtemps ? « Nous avons besoin d'argent », a déclaré le maire devant les habitants."),
    ("prose", "По словам мэра, новая школа откроется в этом году. Когда начнётся ремонт улицы? Жители ждали этого семь лет, но денег в бюджете не было."),
    ("prose", "市立図書館は毎日九時に開きます。申し込みは窓口でお願いします。駅から歩いて十分です。新しいバスは来月から走ります。"),
    ("prose", "شارع المدرسة مغلق منذ عام. قال رئيس البلدية إن العمل سينتهي قبل الشتاء. هل تريد تقديم طلب في المكتب خلال أيام؟ تفتح المكتبة في الصباح."),
    ("prose", "नई बस हर दिन सुबह चलती है। क्या आपको कार्यालय में आवेदन देना है? कृपया फोन करें। गाँव में पानी की कमी है और लोग इंतजार कर रहे हैं।"),
    ("list", _rows("- {0} in {1}", 24, _TERMS + _PLACES)),
    ("list", _rows("{k}. {0}, {1}", 24, _TERMS + _PLACES)),
    ("list", "Übersicht Altdorf\n" + _rows("{0} {1}", 28, _TERMS + _PLACES)),
    ("list", _rows("{0} {1}", 28, ["home help", "bus shelters", "free school meals", "arts grants", "street cleaning services", "debt advice"])),
    ("list", _rows("{0}, {1}, {2}, {3}, {4}, {5}", 8, _PLACES)),
    ("list", _rows("https://www.{0}.example/{1}/{n}", 24, [x.lower() for x in _PLACES])),
    ("list", _rows("Ida {0}er, {1}, 0{n}1 / 2{n}04", 24, _PLACES)),
    ("list", _rows("{0}: {n}40 Euro", 24, _TERMS)),
    ("list", _STANDARD[:170] + "\n" + _rows("* {0} in {1};", 26, _TERMS + _PLACES)),
    ("list", _rows("{0} | {1} | Suche | {2} | Kontakt | {3}", 7, _TERMS + _PLACES)),
    ("list", _rows("1{k}:2{k} {0} – {1} Linie {n}", 9, _PLACES)),
    ("table", _rows("{0}\t{n}\tja\t{n}.1{n}\t{1}", 24, _PLACES)),
    ("table", _rows("| {0} | {n} | k. A. | {n} % |", 24, _PLACES)),
    ("table", _rows("{0};{n};nein;{n},5;{1}", 24, _PLACES)),
    ("table", _rows("{0}      {n}        {n} %        ja       {1}", 24, _PLACES)),
    ("table", _STANDARD[:170] + "\n" + _rows("{0}\t{n}\t{n} %\t{1}", 26, _PLACES)),
    ("junk", _rows(".c{n}{{margin:{n}px;color:#a{n}f{n}c;width:{n}%}}", 22, _PLACES)),
    ("junk", _rows("var v{n}=function(e){{return e.a{n}&&window._q[{n}]||{n}00;}};", 14, _PLACES)),
    ("junk", _rows("{n}xQz8Rk{n}LpWv+Tb3Nc9Yh{n}Gf5Ds/Km2Jx7Vq{n}Zt6Hn4Bw{n}Pc1Mg", 14, _PLACES)),
    ("junk", _rows("Ãbq€zt wÂ„klm xŸrv¬ yÃp¼dh âqžw nÃ½ch{n} fâ¤gk zÃmÂt ¿lr§vs Ãk€px", 14, _PLACES)),
    ("junk", _rows("+~#@}}{{*<$%|^&/=[_]°>\\+~@#*{{}}<|$%&=/^", 20, _PLACES)),
    ("junk", _rows("r1lnt0 wvI fo1mc n0ltvw i1 ufrc0 mnIl tw1v0 oc nrf1l mIwt0 vu", 14, _PLACES)),
    ("junk", ("radwege stadtfest impfbus lesehilfe " * 40).strip() + "\n" + ("stadtfest fahrplan impfbus radwege " * 20).strip()),
    ("junk", "\n".join(["tra" * 40] * 8)),
]


class Mixture:
    """Weights, means and covariances of standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, kinds: list[str]) -> None:
        self.centre, self.scale, self.weights, self.means, self.covariances, self.kinds = centre, scale, weights, means, covariances, kinds
        # Per component what whitens its values, and its constant, once instead of per batch.
        factors = np.linalg.cholesky(covariances)
        self.whiten = np.linalg.inv(factors)
        self.constant = np.log(weights) - np.log(np.einsum("kii->ki", factors)).sum(axis=1)

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8.0, 8.0)

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.whiten, self.means, self.constant)):
            y = (z - m) @ w.T
            out[:, k] = c - 0.5 * np.einsum("nd,nd->n", y, y)
        return out

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        return self._responsible(self.standardised(x))[0]

    def _responsible(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log likelihoods)."""
        joint = self.log_joint(z)
        top = joint.max(axis=1, keepdims=True)
        p = np.exp(joint - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]

    def moments(self, x: np.ndarray) -> np.ndarray:
        """Per component: sum of responsibilities, of responsible values, of their outer products; and of log likelihoods, in the first one's row."""
        z = self.standardised(x)
        r, likelihood = self._responsible(z)
        d = z.shape[1]
        rows, columns = np.triu_indices(d)
        half = r.T @ (z[:, rows] * z[:, columns])
        second = np.empty((r.shape[1], d, d))
        second[:, rows, columns] = half
        second[:, columns, rows] = half
        scores = np.zeros((r.shape[1], 1))
        scores[0] = likelihood.sum()
        return np.concatenate([r.sum(axis=0)[:, None], r.T @ z, second.reshape(len(second), -1), scores], axis=1)

    def only(self, kept: np.ndarray) -> Mixture:
        """The mixture of some of its components."""
        weights = self.weights[kept]
        return Mixture(self.centre, self.scale, weights / weights.sum(), self.means[kept], self.covariances[kept], [k for k, ok in zip(self.kinds, kept) if ok])


def start_mixture(centre: np.ndarray, scale: np.ndarray) -> Mixture:
    """The mixture before the first round: a component at each inspected example."""
    kinds = [k for k, _ in EXAMPLES]
    rows = _many([t for _, t in EXAMPLES])[:, 1:]
    out = Mixture(centre, scale, np.full(len(kinds), 1 / len(kinds)), rows, np.array([np.eye(rows.shape[1])] * len(kinds)), kinds)
    out.means = out.standardised(rows)
    return out


def _next(now: Mixture, begun: Mixture, sums: np.ndarray) -> Mixture:
    """The mixture after a round; ``begun``: the components as they began, which count as HOLD documents each."""
    d = now.means.shape[1]
    mass = sums[:, 0] + HOLD
    means = (sums[:, 1 : 1 + d] + HOLD * begun.means) / mass[:, None]
    second = sums[:, 1 + d : -1].reshape(-1, d, d) + HOLD * (np.einsum("ki,kj->kij", begun.means, begun.means) + np.eye(d) * 0.25)
    covariances = second / mass[:, None, None] - np.einsum("ki,kj->kij", means, means) + np.eye(d) * RIDGE
    return Mixture(now.centre, now.scale, mass / mass.sum(), means, covariances, now.kinds)


def fitted(begun: Mixture, documents: int, summed: Callable[[Mixture], np.ndarray]) -> tuple[Mixture, list[float]]:
    """(mixture after the last round, mean log likelihood before each round); ``summed`` gives a mixture's moments over all documents."""
    mixture, scores = begun, []
    for _ in range(ROUNDS):
        sums = summed(mixture)
        scores.append(float(sums[0, -1]) / documents)
        alive = sums[:, 0] >= max(1.0, DEAD * documents)
        if not alive.all():
            mixture, begun, sums = mixture.only(alive), begun.only(alive), sums[alive]
        mixture = _next(mixture, begun, sums)
        if len(scores) > 1 and abs(scores[-1] - scores[-2]) < GAIN:
            break
    return mixture, scores


def _summed(stats: DataFrame, mixture: Mixture) -> np.ndarray:
    """Moments over all documents; each partition gives one row, and these are added up by Spark."""
    width, size = 2 + len(FITTED) + len(FITTED) ** 2, len(mixture.weights)
    sent = stats.sparkSession.sparkContext.broadcast(mixture)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value.weights), width))
        for b in batches:
            if b.num_rows:
                total += sent.value.moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "v"])

    rows = stats.select(*FITTED).mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * width)
    for r in rows:
        out[r.k] = r.v
    return out.reshape(-1, width)


def fit(stats: DataFrame) -> Mixture:
    """The mixture of the documents in ``stats`` that are not empty."""
    full = stats.filter("NOT empty")
    row = full.agg(F.count("*").alias("n"), *[F.avg(s).alias(f"a_{s}") for s in FITTED], *[F.stddev_pop(s).alias(f"s_{s}") for s in FITTED]).first()
    if row.n == 0:
        rows = _many([t for _, t in EXAMPLES])[:, 1:]
        return start_mixture(rows.mean(axis=0), rows.std(axis=0) + 1e-3)
    centre = np.array([row[f"a_{s}"] for s in FITTED], float)
    # The examples bound the scale below, so that a corpus of one kind is not blown up.
    spread = _many([t for _, t in EXAMPLES])[:, 1:].std(axis=0)
    scale = np.maximum(np.array([row[f"s_{s}"] for s in FITTED], float), 0.4 * spread + 1e-3)
    begun = start_mixture(centre, scale)
    if row.n < len(EXAMPLES):
        return begun
    return fitted(begun, row.n, lambda mixture: _summed(full, mixture))[0]


def component_kinds(mixture: Mixture) -> list[str]:
    """The kind of each component: that of the examples which it explains, by their posteriors, or, of one that explains none, of the example nearest to it."""
    z = mixture.standardised(_many([t for _, t in EXAMPLES])[:, 1:])
    r = mixture._responsible(z)[0]
    near = mixture.log_joint(z)
    kinds = []
    for k in range(r.shape[1]):
        weight: dict[str, float] = {}
        for (kind, _), p in zip(EXAMPLES, r[:, k]):
            weight[kind] = weight.get(kind, 0.0) + p
        best = max(weight, key=lambda x: weight[x])
        kinds.append(best if weight[best] > 0.5 else EXAMPLES[int(near[:, k].argmax())][0])
    return kinds


KINDS = ("prose", "list", "table", "junk")


def judged(stats: DataFrame, mixture: Mixture) -> DataFrame:
    """``stats`` with ``kind`` and ``certainty``, the posterior that the text is prose or is not."""
    named = component_kinds(mixture)
    member = np.array([[k == kind for kind in KINDS] for k in named], float)
    sent = stats.sparkSession.sparkContext.broadcast((mixture, member))
    key = dict(stats.dtypes)["doc_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = sent.value
        for b in batches:
            empty = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]) if b.num_rows else np.zeros((0, len(STATISTICS)))
            p = m.responsibilities(x[:, 1:]) @ own if len(x) else np.zeros((0, len(KINDS)))
            prose = p[:, 0]
            best = p[:, 1:].argmax(axis=1) + 1 if len(p) else np.zeros(0, int)
            kinds = np.where(empty, "empty", np.where(prose >= 0.5, "prose", np.array(KINDS)[best]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds.tolist(), pa.string()), pa.array(np.maximum(prose, 1 - prose))], names=["doc_id", "empty", *STATISTICS, "kind", "certainty"])

    return stats.select("doc_id", "empty", *STATISTICS).mapInArrow(judge, f"doc_id {key}, empty boolean, {_SHAPE}, kind string, certainty double")


def text_quality(documents: DataFrame) -> DataFrame:
    """(doc_id, empty, statistics, kind, certainty) of every document."""
    stats = materialise(document_statistics(documents), "text_statistics")
    return judged(stats, fit(stats))
