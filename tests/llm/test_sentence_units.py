"""Goldens of sentence units in several scripts."""

import pytest

from lingualoom.llm.sentence_units import sentence_units, units

CASES = [
    ("Dr. Ulla X kam am 3. Mai 2010 um 9.30 Uhr. Sie ging z. B. nach Hof.", ["Dr. Ulla X kam am 3. Mai 2010 um 9.30 Uhr.", "Sie ging z. B. nach Hof."]),
    ("Kitas, Schulen usw. Am 23. März kam er.", ["Kitas, Schulen usw.", "Am 23. März kam er."]),
    ("Das kostet 1.218.367 Euro; mehr als 2008. Er sagte: „Gut! Ja.“ Dann ging er.", ["Das kostet 1.218.367 Euro; mehr als 2008.", "Er sagte: „Gut! Ja.“", "Dann ging er."]),
    ("„Wir warten! Jetzt geht es los“, sagte sie. Ende.", ["„Wir warten! Jetzt geht es los“, sagte sie.", "Ende."]),
    ("Es endet hier.Der Rest folgt! Gut?Ja.", ["Es endet hier.", "Der Rest folgt!", "Gut?", "Ja."]),
    ("Siehe www.Amt.example, Kap. 35. Seit 2012 geht das.", ["Siehe www.Amt.example, Kap. 35.", "Seit 2012 geht das."]),
    ("It opens at 3.00 p.m. in Hall 5. Mr. Smith, i.e. the boss, left. Then we go.", ["It opens at 3.00 p.m. in Hall 5.", "Mr. Smith, i.e. the boss, left.", "Then we go."]),
    ("« Nous attendons ! » a dit M. Petit. Pourquoi ? Selon Mme X, env. 20 sont là.", ["« Nous attendons ! » a dit M. Petit.", "Pourquoi ?", "Selon Mme X, env. 20 sont là."]),
    ("По словам И. П. Остер, ок. 62 чел., т. е. больше. Ждали?", ["По словам И. П. Остер, ок. 62 чел., т. е. больше.", "Ждали?"]),
    ("डॉ. आउर ने कहा। क्या यह सही है?", ["डॉ. आउर ने कहा।", "क्या यह सही है?"]),
    ("قال د. أوستر إن هذا صحيح. اتصل الآن!", ["قال د. أوستر إن هذا صحيح.", "اتصل الآن!"]),
    ("市は行いました。担当者は「必要です。忘れないで。」と説明しました。駅まで歩けますか？2020年です。", ["市は行いました。", "担当者は「必要です。忘れないで。」と説明しました。", "駅まで歩けますか？", "2020年です。"]),
    ("负责人说：“已经收到。请等待！”去年上涨了7.7%。", ["负责人说：“已经收到。请等待！”", "去年上涨了7.7%。"]),
    ("ค่าเช่าเพิ่มขึ้น10.7เปอร์เซ็นต์ รถเมล์สาย7วิ่งไป", ["ค่าเช่าเพิ่มขึ้น10.7เปอร์เซ็นต์", "รถเมล์สาย7วิ่งไป"]),
    ("Eine Überschrift\n- Punkt eins. Und mehr\n1. Zweiter Punkt\n\nText ohne Punkt", ["Eine Überschrift", "- Punkt eins. Und mehr", "1. Zweiter Punkt", "Text ohne Punkt"]),
    ("Ort\tk. A.\t5. Mai\nA | b. C | d", ["Ort\tk. A.\t5. Mai", "A | b. C | d"]),
    ("Das Büro ist in der Straße 73. Es öffnet früh.", ["Das Büro ist in der Straße 73.", "Es öffnet früh."]),
    ("hat ihnen das geholfen? ja / nein", ["hat ihnen das geholfen?", "ja / nein"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in units(text)] == want


def test_wrapped_paragraphs_are_joined():
    text = "Die Linie 47 verkehrt zwischen Eichenrode und Riedtal\nvoraussichtlich ab dem 18. April 2024, sofern die\nBauarbeiten im Abschnitt 606 fertig sind. Die Stadt hat\ndas bestätigt.\n\nEin Satz.\nNoch ein Satz."
    assert [text[a:b].replace("\n", " ") for a, b in units(text)] == [
        "Die Linie 47 verkehrt zwischen Eichenrode und Riedtal voraussichtlich ab dem 18. April 2024, sofern die Bauarbeiten im Abschnitt 606 fertig sind.",
        "Die Stadt hat das bestätigt.", "Ein Satz.", "Noch ein Satz.",
    ]


def test_units_cover_the_text_without_blanks():
    for text, _ in CASES:
        found = units(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        assert "".join(text[a:b] for a, b in found).replace(" ", "").replace("\n", "") == "".join(text.split()).replace(" ", "") or "\t" in text


def test_extremes(spark):
    long = "Dr. A. B. C. " * 20_000 + "Ende."
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A."), (4, "A."), (5, long), (6, "!" * 5000), (7, "„" * 300 + "a. B" * 300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = sentence_units(df).collect()
    assert sorted({r.doc_id for r in got}) == [4, 5, 6, 7] and sum(r.doc_id == 4 for r in got) == 2
    assert max(r.end_pos for r in got if r.doc_id == 5) == len(long)
    assert sentence_units(df.limit(0)).count() == 0
