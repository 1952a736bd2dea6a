"""Text functions as Column expressions: cleaning, tokens, n-grams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
WORDLIKE = r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class Preprocessing:
    """Which cleaning steps apply; the two standard profiles are ``GRAM`` and ``EMBEDDING``."""

    remove_hyphens: bool = True
    lowercase: bool = True
    remove_gender: bool = True
    remove_stopwords: bool = False
    remove_punctuation: bool = False


GRAM = Preprocessing(remove_punctuation=True)
EMBEDDING = Preprocessing(lowercase=False, remove_punctuation=True)

#: A short list of German and English stop words; any other list can be passed.
STOPWORDS = ("der", "die", "das", "und", "in", "im", "zu", "ist", "ein", "eine", "für", "mit", "auf", "von", "the", "and", "of", "to", "a", "is", "for", "with")


def collapse(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def split_lines(text: Column) -> Column:
    """Sentence-like pieces: the text cut behind each of ``? . : !`` that a blank follows, which stays with its piece."""
    return F.filter(F.split(collapse(text), r"(?<=[?.:!] )", -1), lambda x: F.trim(x) != "")


def join_hyphens(text: Column) -> Column:
    """A hyphen before an ASCII capital goes, and the capital becomes small."""
    for k in range(26):
        text = F.replace(text, F.lit("-" + chr(65 + k)), F.lit(chr(97 + k)))
    return text


def neutral(text: Column) -> Column:
    """Without gender suffixes after ``*``, ``:`` or ``_`` and without a capital I inside a word."""
    for mark in (r"\*", ":", "_"):
        text = F.regexp_replace(text, mark + "in(nen)?", "")
    return F.regexp_replace(text, "([a-z])In(nen)?", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def without_punctuation(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike(WORDLIKE))


def without_stopwords(words: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def clean(text: Column, options: Preprocessing) -> Column:
    """The text after all steps but those on tokens."""
    text = collapse(text)
    if options.remove_hyphens:
        text = join_hyphens(text)
    if options.remove_gender:
        text = neutral(text)
    if options.lowercase:
        text = F.lower(text)
    return F.regexp_replace(text, " +", " ")


def words(text: Column, options: Preprocessing, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens after preprocessing. A text without any gives an empty array, so that no sentence loses its place."""
    out = tokens(clean(text, options))
    if options.remove_stopwords:
        out = without_stopwords(out, stopwords)
    return without_punctuation(out) if options.remove_punctuation else out


def char_ngrams(text: Column, n: int) -> Column:
    """Sliding n-grams of characters; none if the text is shorter than n.

    A look-ahead matches at every character, so one pass of a compiled pattern gives all of them; half a character (a low surrogate) begins none.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1))


def token_ngrams(words_: Column, n: int) -> Column:
    """Sliding n-grams of tokens, joined by blanks; none if there are fewer than n."""
    return _slide(words_, n, " ")


def _slide(parts: Column, n: int, glue: str) -> Column:
    # Shifted copies are zipped, so that no lambda looks into the whole array: what a lambda
    # takes from outside is computed anew for each element.
    out = parts
    for d in range(1, n):
        out = F.zip_with(out, F.slice(parts, d + 1, F.size(parts)), lambda x, y: F.concat(x, F.lit(glue), y))
    return F.slice(out, 1, F.greatest(F.size(parts) - (n - 1), F.lit(0)))
