"""The sentence program against brute force; quotations and long lines."""

import itertools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lingualoom.llm import sentence_units as S


def value(start, end, places, chosen):
    at = [start, *(places[k][0] for k in chosen), end]
    return sum(places[k][1] for k in chosen) + sum(S._length_score(b - a) for a, b in zip(at, at[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 700), st.floats(-3, 3)), max_size=8), st.integers(1, 900))
def test_program_against_all_subsets(steps, rest):
    places, at = [], 0
    for step, gain in steps:
        at += step
        places.append((at, round(gain, 2)))
    end = at + rest
    cuts = S._select(0, end, places)
    chosen = [k for k, (p, _) in enumerate(places) if p in set(cuts)]
    best = max(value(0, end, places, c) for n in range(len(places) + 1) for c in itertools.combinations(range(len(places)), n))
    assert abs(value(0, end, places, chosen) - best) < 1e-9


@pytest.mark.parametrize("n", range(1, 51, 7))
@pytest.mark.parametrize("quotes", ["„“", "“”", "«»", "»«", '""', "「」"])
def test_a_quotation_of_any_number_of_sentences_ends_nothing(n, quotes):
    inner = " ".join(f"Wir haben {k} Tage lang gewartet." for k in range(n))
    first = f"{quotes[0]}{inner[:-1]}{quotes[1]}, sagte die Leiterin."
    text = f"{first} Dann ging sie nach Hause. Er rief: {quotes[0]}{inner}{quotes[1]} Alle lachten."
    assert [text[a:b] for a, b in S.units(text)] == [first, "Dann ging sie nach Hause.", f"Er rief: {quotes[0]}{inner}{quotes[1]}", "Alle lachten."]


def test_marks_without_a_partner_bind_nothing():
    for text in ('Das Rohr misst 5" und ist alt. Er sagte "ja" dazu. Sie ging.', "Er sagte „ja. Sie ging. Es regnet.", "Das ist gut.“ Sie ging. Es regnet."):
        assert len(S.units(text)) == 3


@pytest.mark.parametrize("n", [40, 60, 200, 5000])
def test_a_unit_may_pass_over_any_number_of_doubtful_marks(n):
    assert len(S.units("Die Preise: " + "5 mio. euro " * n + "und mehr.")) == 1


def test_long_words_and_lines_take_linear_time():
    began = time.perf_counter()
    S.units("A.B." * 100_000)
    S.units("5 mio. euro " * 50_000)
    S.units("„" + "Ja. Nein! " * 50_000 + "“")
    S.units("行きます。" * 50_000)
    S.units('"a. B" ' * 50_000)
    assert time.perf_counter() - began < 30
    assert [b - a for a, b in S.units("Seite " + "x" * 500 + ".de ist neu. Mehr dort.")] == [518, 10]
