"""Page content, alignment, reading level and quality: held-out accuracy and defined cases."""

import numpy as np

from lingualoom.llm import page_content as P
from lingualoom.llm import reading_level as R
from lingualoom.llm import sentence_pairs as S
from lingualoom.llm import text_quality as Q


def page(k, disguised=False):
    c = (lambda x: f"x{abs(hash((x, k))) % 16**5:05x}") if disguised else (lambda x: x)
    box = ("<div class=\"%s\">" % c("art"), "</div>") if disguised else ('<article class="sectbody" itemprop="articleBody">', "</article>")
    nav = (f'<div class="{c("nav")}">', "</div>") if disguised else ("<nav>", "</nav>")
    body = [f"<p>Satz {n} über Ort {k} und das Geld der Stadt im Jahr {2000 + n}.</p>" for n in range(2 + k % 4)]
    lines = [
        "<!DOCTYPE html>", f"<html><head><title>Streit um Platz {k} | Blatt</title></head>", "<body>", nav[0], "<ul>", '<li><a href="/1">Politik</a></li>', '<li><a href="/2">Kultur</a>', "</ul>", nav[1],
        box[0], f"<h1>Streit um Platz {k}</h1>", f'<p class="{c("autor")}">Von Ida Meier</p>', *body, f'<div class="{c("ad")}">Anzeige</div>', "<h2>Was nun kommt</h2>", "<ul>", "<li>Radwege in Ort</li>", "</ul>", box[1],
        f'<div class="{c("randspalte")}">', "<h3>Mehr zum Thema</h3>", '<li><a href="/7">Streit um den Bus</a></li>', '<li><a href="/8">Neues vom Amt</a></li>', "</div>",
        f'<div class="{c("fuss")}">', '<li><a href="/3">Impressum</a></li>', "<p>© 2020 Blatt</p>", "</div>", "</body></html>",
    ]
    want = [i for i, x in enumerate(lines, 1) if x.startswith(("<h1>", "<h2>Was", "<li>Radwege")) or x in body]
    return "\n".join(lines), want


def test_page_content_on_plain_disguised_and_bare_pages(spark):
    plain = [page(k) for k in range(30)]
    models = P.train([h for h, _ in plain[:20]])
    for pages in (plain[20:], [page(k, True) for k in range(30, 40)]):
        assert P.content_lines([h for h, _ in pages], models, ({}, {})) == [w for _, w in pages]
    bare, want = [], []
    for h, w in plain[20:]:
        p = P.parse(h)
        kept = [(p.text[n], p.line[n] in w) for n in range(1, len(p.parent)) if p.line[n] and p.tag[n] != "title"]
        bare.append("\n".join(t for t, _ in kept))
        want.append([i for i, (_, ok) in enumerate(kept, 1) if ok])
    assert P.content_lines(bare, models, ({}, {})) == want
    rows = [(k, h, "x") for k, (h, _) in enumerate(plain)] + [(99, None, "x"), (98, "", "x"), (97, "  \n", "x"), (0, plain[0][0], "x"), (96, "<p>" + "wort " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, key string")
    got = P.page_content(df).collect()
    assert sorted(r.line_no for r in got if r.page_id == 3) == plain[3][1] and sum(r.page_id == 0 for r in got) == 2 * len(plain[0][1])
    assert not {97, 98, 99} & {r.page_id for r in got}
    assert P.page_content(df.limit(0)).count() == 0
    assert P.page_content(df.filter("page_id >= 96")).count() >= 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    parent, n, k = np.array([-1, 0, 0, 1, 1, 3]), 6, 3
    unary, pair = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    total = np.zeros((n, k))
    for x in np.ndindex(*[k] * n):
        w = np.exp(sum(unary[i, x[i]] for i in range(n)) + sum(pair[x[parent[i]], x[i]] for i in range(1, n)))
        for i in range(n):
            total[i, x[i]] += w
    assert np.allclose(P.marginals(parent, unary, pair), total / total.sum(axis=1, keepdims=True))


def test_numbers_do_not_depend_on_language():
    assert S.number_keys("am 2. November 2015 um 15.00 Uhr, 1.433.583 Euro, 28,9 %")[0] == ["d2015-11-2", "t15:00", "n1433583", "n28.9"]
    assert S.number_keys("on 2 November 2015 at 3.00 p.m., 1,433,583 euros, 28.9%")[0] == ["d2015-11-2", "t15:00", "n1433583", "n28.9"]


def test_alignment_without_verdicts_and_defined_cases(spark):
    header = spark.createDataFrame([(1, "s", True, ["n", "n", None, "s", "gone"], 1, "x"), (2, "s", True, [], 2, "x"), (3, "n", False, ["s"], 1, "x"), (4, "t", None, ["n"], 1, "x"), (5, None, True, ["n"], 1, "x")], "header_id long, fname string, easy boolean, matching_files array<string>, ingested_at long, simple string")
    lines = spark.createDataFrame(
        [(10, "s", 0, "Der Bus 59 fährt von Sonnenkirch nach Waldstedt. "), (10, "s", 0, "Der Bus 59 fährt von Sonnenkirch nach Waldstedt. "), (11, "s", 1, "Ilka Meier hat am 2. Mai 2015 geholfen."), (12, "s", 2, "  "), (13, "s", 3, None), (14, "s", 4, "Das ist schön."),
         (3, "n", 0, "Am 2. Mai 2015 war Dr. Ilka Meier zugegen."), (4, "n", 1, "Die Linie 59 verkehrt zwischen Sonnenkirch und Waldstedt."), (5, "n", 2, "Sonst ist nichts zu berichten.")],
        "sent_id long, fname string, line_no int, sent string",
    )
    none = spark.createDataFrame([], "pair_hash string, simple_sent string, normal_sent string, verdict boolean")
    terms = spark.createDataFrame([], "term_id int, de string, de_easy string, en string, en_easy string")
    got = sorted(map(tuple, S.sentence_pairs(header, lines, none, terms).collect()))
    assert got == [(3, 11), (4, 10)]
    assert S.sentence_pairs(header, lines.limit(0), none, terms).count() == 0
    assert S.sentence_pairs(header.limit(0), lines, none, terms).count() == 0


SIMPLE = ["Der Bus fährt nach {0}.", "Viele Menschen helfen in {0}.", "Haben Sie Fragen zu {0}?", "Das Büro ist in {0}.", "Es gibt Hilfe für alle in {0}."]
STANDARD = ["Nach Angaben der Verwaltung wird das denkmalgeschützte Gebäude in {0} bis zum Jahresende saniert und anschließend genutzt.", "Interessierte können sich für die Veranstaltung zum Thema Förderung in {0} anmelden, deren Teilnehmerzahl begrenzt ist.", "Gegenüber dem Haushaltsjahr erhöhen sich die in {0} veranschlagten Mittel um mehrere Prozent."]


def test_reading_levels_held_out_and_defined_cases(spark):
    places = [a + b for a in ("Alt", "Berg", "See", "Neu", "Tal", "Hagen", "Wald", "Ost") for b in ("dorf", "heim", "feld", "hof", "kirch", "au", "bach")]
    text = lambda forms, k: " ".join(forms[(k + n) % len(forms)].format(places[(7 * k + 11 * n) % 56]) for n in range(6))
    rows = [(k, text(SIMPLE if k % 2 else STANDARD, k), "de", "x") for k in range(40)]
    rows += [(100, None, "de", "x"), (101, "", "de", "x"), (102, " \n", None, "x"), (103, "\n".join(f"- Radwege, {p}" for p in places), "de", "x"), (104, "Кто это? Это мы. Где они? Они тут.", "ru", "x"), (105, text(SIMPLE, 1), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, level string")
    labels = spark.createDataFrame([(k, 1 if k % 2 else 2) for k in range(20)] + [(1, 1), (999, 3), (2, None), (3, 7)], "doc_id long, reading_level int")
    got = {r.doc_id: r for r in R.reading_levels(docs, labels).collect()}
    assert all((got[k].level == 1) == bool(k % 2) for k in range(20, 40))
    assert all(got[k].level is None for k in (100, 101, 102, 103, 104)) and got[105].level == 1
    easy = spark.createDataFrame([(20, True), (21, True), (22, False), (23, False), (24, None), (103, True)], "doc_id long, easy boolean")
    assert sorted(r.doc_id for r in R.disagreements(R.reading_levels(docs, labels), easy).collect()) == [20, 23]
    assert R.reading_levels(docs.limit(0), labels.limit(0)).count() == 0
    assert R.reading_levels(docs, labels.limit(0)).count() == len(rows)


def test_quality_kinds(spark):
    rows = [(k, t, "x") for k, (_, t) in enumerate(Q.EXAMPLES)] + [(900, None, "x"), (901, "", "x"), (902, " \t\n", "x"), (903, "wort " * 100_000, "x"), (0, Q.EXAMPLES[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = Q.text_quality(df).collect()
    kinds = {r.doc_id: r.kind for r in got}
    assert len(got) == len(rows) and all(kinds[k] == "empty" for k in (900, 901, 902))
    wrong = [k for k, (kind, _) in enumerate(Q.EXAMPLES) if (kinds[k] == "prose") != (kind == "prose")]
    assert wrong == []
    assert Q.text_quality(df.limit(0)).count() == 0
    assert Q.text_quality(df.filter("doc_id >= 900 AND doc_id < 903")).count() == 3


def test_mixture_finds_two_clouds():
    rng = np.random.default_rng(0)
    d = len(Q.FITTED)
    x = np.concatenate([rng.normal(0.2, 0.05, (300, d)), rng.normal(0.8, 0.05, (300, d))])
    m = b = Q.start_mixture(x.mean(axis=0), x.std(axis=0))
    before = np.log(np.exp(m.log_joint(m.standardised(x))).sum(axis=1) + 1e-300).mean()
    for _ in range(6):
        m = Q._next(m, b, m.moments(x))
    assert np.log(np.exp(m.log_joint(m.standardised(x))).sum(axis=1) + 1e-300).mean() > before
