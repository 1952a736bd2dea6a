"""Goldens of text and URL functions."""

import hashlib

from pyspark.sql import functions as F

from lingualoom.functions import text as T
from lingualoom.functions import urls as U


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_lines_keep_their_blank(spark):
    assert one(spark, "Ja! ? Nein: gut. Ende.", T.split_lines) == ["Ja! ", "? ", "Nein: ", "gut. ", "Ende."]
    assert one(spark, "  \n ", T.split_lines) == []
    assert one(spark, None, T.split_lines) is None


def test_hyphens_and_gender(spark):
    assert one(spark, "Bürger-Meister St-Ärzte E-Mail", T.join_hyphens) == "Bürgermeister St-Ärzte Email"
    assert one(spark, "Pilot*innen Leser:in Autor_innen BäckerInnen", T.neutral) == "Pilot Leser Autor Bäcker"


def test_profiles(spark):
    assert one(spark, "Die Leser:innen, und Pilot*in!", lambda c: T.words(c, T.GRAM)) == ["die", "leser", "und", "pilot"]
    assert one(spark, "Die Leser:innen, und!", lambda c: T.words(c, T.EMBEDDING)) == ["Die", "Leser", "und"]
    assert one(spark, "!!", lambda c: T.words(c, T.GRAM)) == []
    assert one(spark, "die Katze und der Hund", lambda c: T.words(c, T.Preprocessing(remove_stopwords=True))) == ["katze", "hund"]


def test_ngrams(spark):
    assert one(spark, "abcdabcd", lambda c: T.char_ngrams(c, 4)) == ["abcd", "bcda", "cdab", "dabc", "abcd"]
    assert one(spark, "abc", lambda c: T.char_ngrams(c, 4)) == []
    assert one(spark, "", lambda c: T.char_ngrams(c, 4)) == []
    assert one(spark, "a😀bé", lambda c: T.char_ngrams(c, 2)) == ["a😀", "😀b", "bé"]
    assert one(spark, "a b c", lambda c: T.token_ngrams(F.split(c, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: T.token_ngrams(F.split(c, " "), 2)) == []


def test_names_of_urls(spark):
    archived = "http://archiv.webspeicher.example/web/20220721041209/https://www.a.example/x/y/?q=1#z"
    assert one(spark, archived, U.site_folder) == "www.a.example"
    assert one(spark, archived, U.file_name) == "a.example__x__y.html"
    assert one(spark, "a.example/x.html", U.file_name) == "a.example__x.html"
    assert one(spark, "http://a.example/x;s=1", U.until_semicolon) == "http://a.example/x"


def test_absolute_addresses(spark):
    base = F.lit("https://a.example/b/c")
    for url, want in (("/x", "https://a.example/x"), ("x", "https://a.example/b/x"), ("http://z.example/", "http://z.example/"), ("//y.example/q", "https://y.example/q")):
        assert one(spark, url, lambda c: U.absolute(c, base)) == want


def test_decimal_digest(spark):
    for value in ("a.txt___b.txt", "", "ü" * 50, "simple_1.txt___normal_7.txt"):
        assert one(spark, value, U.decimal_digest) == str(int(hashlib.sha1(value.encode()).hexdigest(), 16))
