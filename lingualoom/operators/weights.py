"""Term frequencies, inverse document frequencies and their products, for words and character n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import text as X


def token_table(sents: DataFrame, options: X.Preprocessing) -> DataFrame:
    """(fname, i, words) of each sentence."""
    return sents.select("fname", "i", X.words(F.col("sent"), options).alias("words"))


def lemmatised(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(fname, i, words) with each word that stands in ``lemmas`` (word, lemma) replaced; sentences without words stay."""
    long = tokens.select("fname", "i", F.posexplode_outer("words").alias("k", "word"))
    own = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    done = long.join(own, "word", "left").select("fname", "i", "k", F.coalesce("lemma", "word").alias("w"))
    words = F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("k", "w"))))
    return done.groupBy("fname", "i").agg(words.alias("x")).select("fname", "i", F.transform("x", lambda s: s.w).alias("words"))


def joined_text(tokens: DataFrame) -> DataFrame:
    """(fname, text): all words of a file, sentences joined by a blank."""
    own = F.array_sort(F.collect_list(F.struct("i", F.array_join("words", " ").alias("t"))))
    return tokens.groupBy("fname").agg(F.array_join(F.transform(own, lambda x: x.t), " ").alias("text"))


def word_tf(tokens: DataFrame) -> DataFrame:
    """(fname, term, tf): share of each word in its file."""
    counts = tokens.select("fname", F.explode("words").alias("term")).groupBy("fname", "term").agg(F.count("*").alias("c"))
    sizes = tokens.groupBy("fname").agg(F.sum(F.size("words")).alias("n"))
    return counts.join(sizes, "fname").select("fname", "term", (F.col("c") / F.col("n")).alias("tf"))


def ngram_tf(tokens: DataFrame, n: int = 4) -> DataFrame:
    """(fname, term, tf): share of each character n-gram in its file; n-grams run across the ends of sentences."""
    texts = joined_text(tokens).withColumn("grams", X.char_ngrams(F.col("text"), n))
    grams = texts.select("fname", F.size("grams").alias("total"), F.explode("grams").alias("term"))
    return grams.groupBy("fname", "term").agg((F.count("*") / F.first("total")).alias("tf"))


def idf(tf: DataFrame, files: DataFrame) -> DataFrame:
    """(term, idf): ln(files / files with the term) over the distinct files in ``files`` (fname) that have text."""
    own = tf.join(files, "fname", "left_semi")
    total = own.select("fname").distinct().agg(F.count("*").alias("d"))
    # One row: the number of files.
    return own.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", F.log(F.col("d") / F.col("df")).alias("idf"))


def weights(tf: DataFrame, idf_: DataFrame) -> DataFrame:
    """(fname, term, w): tf times idf; a term missing in either has no row, which is weight 0."""
    return tf.join(idf_, "term").select("fname", "term", (F.col("tf") * F.col("idf")).alias("w"))


def sentence_terms(tokens: DataFrame, measure: str, n: int = 4) -> DataFrame:
    """(fname, i, term, c): how often each sentence has each term; n-grams stay within the sentence."""
    terms = F.col("words") if measure == "bag_of_words" else X.char_ngrams(F.array_join("words", " "), n)
    return tokens.select("fname", "i", F.explode(terms).alias("term")).groupBy("fname", "i", "term").agg(F.count("*").alias("c"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(files, fingerprint): whether stored frequencies still belong to these files. Digests are added up, so no list of files is gathered."""
    part = F.conv(F.substring(F.sha1("fname"), 1, 12), 16, 10).cast("decimal(38,0)")
    return files.select("fname").distinct().agg(F.count("*").alias("files"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))
