"""Queries of text cleaning and of term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import text as T
from lingualoom.operators import catalog
from lingualoom.operators import weights as W
from lingualoom.plans import fixture as X
from lingualoom.plans.registry import Registry
from lingualoom.session import materialise
from lingualoom.sources.tables import table

registry = Registry()
add = registry.add

_COLLAPSED = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"


@add(
    "sentence_split",
    rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace({_COLLAPSED}, '([?.:!] )', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, list_filter(ps, lambda x: trim(x) <> '') AS ps FROM p)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS i, unnest(ps) AS line FROM q""",
)
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence-like lines of every document."""
    docs = table(spark, folder, "documents", "doc_id", "text").filter(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("i", "line"))


@add(
    "lemmatised",
    f"""WITH {X.SENTS}, {X.tokens_sql()}, lem AS (SELECT lower(de) AS word, min(lower(de_easy)) AS lemma FROM glossary WHERE NOT contains(de, ' ') GROUP BY lower(de))
SELECT t.fname, t.i, coalesce(list(coalesce(l.lemma, w.word) ORDER BY w.k) FILTER (w.word IS NOT NULL), []) AS words FROM tokens t
LEFT JOIN (SELECT fname, i, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM tokens) w USING (fname, i) LEFT JOIN lem l ON l.word = w.word GROUP BY t.fname, t.i""",
)
def lemmatised(spark: SparkSession, folder: str) -> DataFrame:
    """Words with those of a table replaced; here it is the glossary, any table of lemmas does."""
    lemmas = table(spark, folder, "glossary", "de", "de_easy").filter(~F.contains("de", F.lit(" "))).select(F.lower("de").alias("word"), F.lower("de_easy").alias("lemma"))
    return W.lemmatised(X.tokens(X.sents(spark, folder)), lemmas)


_DECORATED = "sent || ' Bürger-Meister Pilot*innen Leser:in Autor_innen BäckerInnen'"


@add("kill_hyphen", rf"WITH {X.SENTS} SELECT fname, i, " + "replace(" * 26 + _DECORATED + "".join(f", '-{chr(65 + k)}', '{chr(97 + k)}')" for k in range(26)) + " AS line FROM sents")
def kill_hyphen(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with joined hyphens; each also gets words that have every pattern."""
    return X.sents(spark, folder).select("fname", "i", T.join_hyphens(F.concat("sent", F.lit(" Bürger-Meister Pilot*innen Leser:in Autor_innen BäckerInnen"))).alias("line"))


@add(
    "remove_gender",
    rf"WITH {X.SENTS} SELECT fname, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DECORATED}, '\*in(nen)?', '', 'g'), ':in(nen)?', '', 'g'), '_in(nen)?', '', 'g'), '([a-z])In(nen)?', '\1', 'g') AS line FROM sents",
)
def remove_gender(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences without gender suffixes; each also gets words that have every pattern."""
    return X.sents(spark, folder).select("fname", "i", T.neutral(F.concat("sent", F.lit(" Bürger-Meister Pilot*innen Leser:in Autor_innen BäckerInnen"))).alias("line"))


@add("tokens", rf"WITH {X.SENTS} SELECT fname, i, regexp_extract_all({X.clean_sql('sent', True)}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS words FROM sents")
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every sentence, punctuation included."""
    return X.sents(spark, folder).select("fname", "i", T.words(F.col("sent"), T.Preprocessing()).alias("words"))


@add("preprocess_gram", f"WITH {X.SENTS}, {X.tokens_sql()} SELECT * FROM tokens")
def preprocess_gram(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every sentence by the profile for n-grams."""
    return X.tokens(X.sents(spark, folder))


@add("preprocess_embed", f"WITH {X.SENTS}, {X.tokens_sql(False)} SELECT * FROM tokens")
def preprocess_embed(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every sentence by the profile for vectors."""
    return X.tokens(X.sents(spark, folder), T.EMBEDDING)


@add("stopwords", f"WITH {X.SENTS}, {X.tokens_sql()} SELECT fname, i, list_filter(words, lambda w: w NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)})) AS words FROM tokens")
def stopwords(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every sentence without stop words."""
    return X.tokens(X.sents(spark, folder)).select("fname", "i", T.without_stopwords(F.col("words")).alias("words"))


@add("original_sentences", rf"WITH {X.SENTS} SELECT fname, i, trim(regexp_replace(sent, '[\s\p{{Z}}]+', ' ', 'g')) AS sent FROM sents")
def original_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences as they are, white space apart."""
    return X.sents(spark, folder).select("fname", "i", T.collapse(F.col("sent")).alias("sent"))


@add(
    "char_ngrams",
    rf"WITH {X.SENTS}, {X.tokens_sql()}, t AS (SELECT fname, i, array_to_string(words, ' ') AS s FROM tokens), g AS (SELECT fname, unnest(list_transform(range(1, length(s) - 2), lambda k: substr(s, CAST(k AS BIGINT), 4))) AS gram FROM t WHERE length(s) >= 4) SELECT gram, count(*) AS n FROM g GROUP BY gram",
)
def char_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Character 4-grams of sentences and how often each occurs."""
    texts = X.tokens(X.sents(spark, folder)).select(F.explode(T.char_ngrams(F.array_join("words", " "), 4)).alias("gram"))
    return texts.groupBy("gram").agg(F.count("*").alias("n"))


@add(
    "token_ngrams",
    rf"WITH {X.SENTS}, {X.tokens_sql()}, g AS (SELECT unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS gram FROM tokens WHERE len(words) >= 2) SELECT gram, count(*) AS n FROM g GROUP BY gram",
)
def token_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of words that follow each other and how often each occurs."""
    grams = X.tokens(X.sents(spark, folder)).select(F.explode(T.token_ngrams(F.col("words"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


WORD_TF = "word_tf AS (SELECT fname, term, count(*) / any_value(total) AS tf FROM (SELECT fname, unnest(words) AS term, total FROM tokens JOIN (SELECT fname, sum(len(words)) AS total FROM tokens GROUP BY fname) USING (fname)) GROUP BY fname, term)"
GRAM_TF = (
    "joined AS (SELECT fname, string_agg(array_to_string(words, ' '), ' ' ORDER BY i) AS s FROM tokens GROUP BY fname),"
    " gram_tf AS (SELECT fname, term, count(*) / any_value(total) AS tf FROM (SELECT fname, length(s) - 3 AS total, unnest(list_transform(range(1, length(s) - 2), lambda k: substr(s, CAST(k AS BIGINT), 4))) AS term FROM joined WHERE length(s) >= 4) GROUP BY fname, term)"
)
USED_FILES = "used_files AS (SELECT simple AS fname FROM used UNION SELECT standard FROM used)"


def idf_sql(name: str, tf: str) -> str:
    return f"{name} AS (SELECT term, ln((SELECT count(DISTINCT fname) FROM {tf} WHERE fname IN (SELECT fname FROM used_files)) / count(*)) AS idf FROM {tf} WHERE fname IN (SELECT fname FROM used_files) GROUP BY term)"


@add("word_tf", f"WITH {X.SENTS}, {X.tokens_sql()}, {WORD_TF} SELECT fname, term, round(tf, 9) AS tf FROM word_tf")
def word_tf(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each word in its file."""
    return W.word_tf(X.tokens(X.sents(spark, folder))).withColumn("tf", F.round("tf", 9))


@add("ngram_tf", f"WITH {X.SENTS}, {X.tokens_sql()}, {GRAM_TF} SELECT fname, term, round(tf, 9) AS tf FROM gram_tf")
def ngram_tf(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each character 4-gram in its file."""
    return W.ngram_tf(X.tokens(X.sents(spark, folder))).withColumn("tf", F.round("tf", 9))


def _used(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # Read for the pairs and for the terms, so written once.
    sents = materialise(X.sents(spark, folder), "sents")
    return sents, X.used_pairs(X.pairs(spark, folder), sents)


@add("word_idf", f"{X.BASE}, {X.tokens_sql()}, {USED_FILES}, {WORD_TF}, {idf_sql('word_idf', 'word_tf')} SELECT term, round(idf, 9) AS idf FROM word_idf")
def word_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse document frequency of words over the files of pairs."""
    sents, used = _used(spark, folder)
    return W.idf(materialise(W.word_tf(X.tokens(sents)), "tf"), catalog.unnested(used)).withColumn("idf", F.round("idf", 9))


@add("ngram_idf", f"{X.BASE}, {X.tokens_sql()}, {USED_FILES}, {GRAM_TF}, {idf_sql('gram_idf', 'gram_tf')} SELECT term, round(idf, 9) AS idf FROM gram_idf")
def ngram_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse document frequency of 4-grams over the files of pairs."""
    sents, used = _used(spark, folder)
    return W.idf(materialise(W.ngram_tf(X.tokens(sents)), "tf"), catalog.unnested(used)).withColumn("idf", F.round("idf", 9))


@add("tfidf_weight", f"{X.BASE}, {X.tokens_sql()}, {USED_FILES}, {WORD_TF}, {idf_sql('word_idf', 'word_tf')} SELECT fname, term, round(tf * idf, 9) AS w FROM word_tf JOIN word_idf USING (term)")
def tfidf_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of each word in its file."""
    sents, used = _used(spark, folder)
    tf = materialise(W.word_tf(X.tokens(sents)), "tf")
    return W.weights(tf, W.idf(tf, catalog.unnested(used))).withColumn("w", F.round("w", 9))


@add(
    "kept_sentences",
    f"{X.BASE}, {X.tokens_sql()} SELECT s.fname, count(*) AS sentences, count(t.words) AS kept, CAST(count(*) FILTER (len(t.words) = 0) AS BIGINT) AS wordless FROM sents s LEFT JOIN tokens t USING (fname, i) GROUP BY s.fname",
)
def kept_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of each file before and after preprocessing, which loses none: one without words stays as an empty one."""
    sents = X.sents(spark, folder)
    both = sents.join(X.tokens(sents), ["fname", "i"], "left")
    return both.groupBy("fname").agg(F.count("*").alias("sentences"), F.count("words").alias("kept"), F.count_if(F.size("words") == 0).alias("wordless"))
