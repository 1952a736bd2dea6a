"""What counts as a shared line when the sample of labelled documents grows."""

from lingualoom.llm import reading_level as R

OFTEN, SELDOM = "Lesen Sie mehr auf unserer Seite.", "Gudrun mag ihren gelben Roller."


def kinds(n, seldom):
    rows = [(f"{OFTEN}\nHerr Nummer{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} wohnt hier gern.{chr(10) + SELDOM if k < seldom else ''}", "de", 1 + k % 3) for k in range(n)]
    models = R.fit(rows)
    scores = models.score([R.tokens(OFTEN), R.tokens(SELDOM)])[0] + models.prior
    return (scores[:, : R.ITEM].argmax(axis=1) == R.SHARED).tolist()


def test_shared_lines_are_a_share_of_the_labelled_documents():
    assert kinds(100, 2) == [True, False]
    assert kinds(1600, 5) == [True, False]
