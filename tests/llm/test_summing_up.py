"""Sentences that sum up several others."""

from lingualoom.llm import sentence_pairs as S

NONE = S.Glossary([])


def test_a_sentence_has_a_partner_for_each_part_it_names():
    right = [f"{w}stadt erhält {n} Euro für Radwege." for w, n in (("Altenau", 11), ("Bergheim", 22), ("Cadolz", 33), ("Dornbach", 44))]
    simple = ["Es gibt Neues aus Altenaustadt, Dornbachstadt und aus Cadolzstadt.", "Bergheimstadt bekommt 22 Euro."]
    assert S.aligned(simple, right, S.Scorer(NONE)) == [(0, 0), (0, 2), (0, 3), (1, 1)]
    assert [1 + len(S._PART.findall(x)) for x in ("neues aus a und aus b.", "news from a, b and c.", "news from a, b, and c.")] == [2, 3, 3]
