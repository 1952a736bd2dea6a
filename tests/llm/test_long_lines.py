"""Lines of any length are read whole."""

from lingualoom.llm import page_content as P


def test_all_words_of_a_long_line_count():
    p = P.parse("<html><body><p>" + "wort " * 3000 + "schlusswort</p></body></html>")
    found = P.features(p)
    assert max(len(words) for _, words in found) == 3001 and any("schlusswort" in words for _, words in found)
