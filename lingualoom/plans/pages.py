"""Queries of pages and of file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import urls
from lingualoom.operators import align as A
from lingualoom.operators import html as H
from lingualoom.operators.catalog import article_texts
from lingualoom.plans import fixture as X
from lingualoom.plans.registry import Registry
from lingualoom.plans.similarity import FULL_SQL, WHOLE, exported, grid_matches
from lingualoom.session import own_folder
from lingualoom.sources import files as S
from lingualoom.sources.tables import table

registry = Registry()
add = registry.add

_HREF = "<a\\s[^<>]*href=\"([^\"]*)\""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawled_pages", "page_id", "site", "html")


@add("page_links", f"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{_HREF}', 1))) AS href FROM crawled_pages")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Different links of each page."""
    return H.hrefs(_pages(spark, folder))


@add("absolute_links", f"SELECT DISTINCT page_id, CASE WHEN href LIKE '/%' THEN 'https://' || site || href ELSE href END AS url FROM (SELECT page_id, site, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href FROM crawled_pages)")
def absolute_links(spark: SparkSession, folder: str) -> DataFrame:
    """Different links of each page as full addresses."""
    pages = _pages(spark, folder)
    links = H.hrefs(pages).join(pages.select("page_id", "site"), "page_id")
    return links.select("page_id", urls.absolute(F.col("href"), F.concat(F.lit("https://"), "site", F.lit("/"))).alias("url")).distinct()


@add(
    "node_tags",
    "SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<div[ >]')) AS BIGINT) AS boxes FROM crawled_pages WHERE regexp_matches(html, '<[a-z]')",
)
def node_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and boxes of each page, counted on the table of nodes."""
    nodes = H.nodes(_pages(spark, folder))
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag") == "div").alias("boxes"))


@add(
    "single_article_pages",
    "SELECT page_id FROM crawled_pages WHERE len(regexp_extract_all(html, '<article [^>]*itemprop=\"articleBody\"')) = 1",
)
def single_article_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with just one block that the rule for article elements takes."""
    nodes = H.nodes(_pages(spark, folder))
    return nodes.filter(H.site_rules()["article"].block).groupBy("page_id").agg(F.count("*").alias("n")).filter("n = 1").select("page_id")


@add("page_lines")
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence-like lines of the articles that the site rules find."""
    return H.extracted_lines(H.extract(H.nodes(_pages(spark, folder)), H.site_rules()))


@add("parsed_files")
def parsed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each article that the site rules find, over all rules, lines in order."""
    lines = H.extracted_lines(H.extract(H.nodes(_pages(spark, folder)), H.site_rules()))
    own = lines.groupBy("page_id", "rule").agg(F.array_sort(F.collect_list(F.struct("node", "k", "line"))).alias("l"))
    return own.select("page_id", "rule", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))


@add("counterpart_links")
def counterpart_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links that by the rule of a site lead to the same or a further article."""
    return H.counterpart_links(H.nodes(_pages(spark, folder)), H.counterpart_rules())


@add("headers_round_trip", f"WITH {X.FILES} SELECT site, fname, url, crawl_date, easy, publication_date, matching_files, type FROM files")
def headers_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog written as a JSON object per site and read again."""
    path = own_folder(spark, "headers")
    S.write_headers(X.files(spark, folder), path)
    return S.read_headers(spark, f"{path}/*/*")


@add("matches_by_configuration", None)
def matches_by_configuration(spark: SparkSession, folder: str) -> DataFrame:
    """Matches written in folders by configuration; one configuration read again without reading others."""
    path = own_folder(spark, "matches")
    S.write_matches(grid_matches(spark, folder, *WHOLE)[1], path)
    return S.read_matches(spark, path, "bag_of_words", "max", 1.5).select("pair_hash", "i", "j", F.round("sim", 6).alias("sim"))


@add("match_files_round_trip", FULL_SQL + " SELECT pair_hash, measure, strategy, sd, i, j, simple_sent, normal_sent, round(sim, 6) AS sim FROM full_")
def match_files_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Result sets written as JSON, one object per pair and configuration, and read again."""
    inputs, found = grid_matches(spark, folder)
    path = own_folder(spark, "match_files")
    S.write_match_files(A.with_sentences(found.withColumn("sim", F.round("sim", 6)), inputs.pairs, inputs.sents), path)
    return S.read_match_files(spark, path)


@add("alignment_json_round_trip", FULL_SQL + " SELECT standard, j, simple_sent, normal_sent, round(sim, 6) AS dist FROM full_ WHERE measure = 'bag_of_words' AND sd = 1.5")
def alignment_json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The exported corpus written as nested JSON by standard file and sentence, and read again."""
    inputs, found = exported(spark, folder, False)
    path = own_folder(spark, "alignments")
    S.write_alignments(A.export(A.with_sentences(found.withColumn("sim", F.round("sim", 6)), inputs.pairs, inputs.sents)), path)
    return S.read_alignments(spark, path)


@add("parallel_round_trip", FULL_SQL + " SELECT replace(replace(simple_sent, chr(13), ' '), chr(10), ' ') AS simple_sent, replace(replace(normal_sent, chr(13), ' '), chr(10), ' ') AS normal_sent FROM full_ WHERE measure = 'bag_of_words' AND sd = 1.5")
def parallel_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The exported corpus written as two folders of text whose lines belong together, and read again side by side."""
    inputs, found = exported(spark, folder, False)
    path = own_folder(spark, "parallel")
    S.write_parallel(A.with_sentences(found, inputs.pairs, inputs.sents).select("pair_hash", "i", "simple_sent", "normal_sent"), path)
    return S.read_parallel(spark, path)


@add(
    "articles_round_trip",
    f"WITH {X.FILES}, {X.SENTS}, texts AS (SELECT fname, string_agg(sent, chr(10) ORDER BY i) AS text FROM sents GROUP BY fname) SELECT f.site, f.fname, t.text, f.url, f.easy, f.type FROM texts t JOIN files f USING (fname)",
)
def articles_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed texts written in a folder per site beside the header of the files that have one, and both read again."""
    path, texts = own_folder(spark, "parsed"), article_texts(X.sents(spark, folder))
    f = X.files(spark, folder)
    S.write_articles(texts.join(f.select("site", "fname"), "fname"), f"{path}/texts")
    S.write_headers(f.join(texts.select("fname"), "fname", "left_semi"), f"{path}/header")
    return S.read_articles(spark, f"{path}/texts").join(S.read_headers(spark, f"{path}/header/*/*").select("fname", "url", "easy", "type"), "fname")


@add(
    "stored_pages_first",
    f"WITH {X.FILES}, p AS (SELECT url, min(page_id) AS page_id FROM crawled_pages WHERE url IS NOT NULL GROUP BY url) SELECT f.fname, f.url, p.page_id, c.html, p.page_id IS NULL AS to_fetch FROM files f LEFT JOIN p USING (url) LEFT JOIN crawled_pages c ON c.page_id = p.page_id WHERE f.url IS NOT NULL",
)
def stored_pages_first(spark: SparkSession, folder: str) -> DataFrame:
    """The page of each catalog entry: as stored first, if it is, else marked as still to be fetched."""
    pages = table(spark, folder, "crawled_pages", "page_id", "url", "html").filter(F.col("url").isNotNull())
    first = pages.groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p"))
    entries = X.files(spark, folder).select("fname", "url").filter(F.col("url").isNotNull())
    return entries.join(first, "url", "left").select("fname", "url", "p.page_id", "p.html", F.col("p").isNull().alias("to_fetch"))
