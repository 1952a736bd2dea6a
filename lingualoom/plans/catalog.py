"""Queries of the catalog: files, links, pairs, names, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import urls
from lingualoom.operators import catalog
from lingualoom.plans import fixture as X
from lingualoom.plans.registry import Registry
from lingualoom.session import materialise, own_folder
from lingualoom.sources.tables import table

registry = Registry()
add = registry.add


@add("article_pairs", f"WITH {X.PAIRS} SELECT * FROM pairs")
def article_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of simple and standard files."""
    return X.pairs(spark, folder)


@add("article_pairs_filtered", f"WITH {X.PAIRS} SELECT * FROM pairs WHERE contains(site, 'bote') AND type = 'LS'")
def article_pairs_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of some sites and one type."""
    return catalog.article_pairs(X.files(spark, folder), ["bote"], "LS")


@add("exemplary_pairs", f"WITH {X.FILES} SELECT DISTINCT f.fname, u.m AS other FROM files f, unnest(f.matching_files) AS u(m) WHERE u.m IS NOT NULL")
def exemplary_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all files, whichever side they are on."""
    return catalog.links(X.files(spark, folder)).select("fname", "other").distinct()


@add("unnested_articles", f"WITH {X.PAIRS} SELECT simple AS fname FROM pairs UNION SELECT standard FROM pairs")
def unnested_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every article that is in a pair."""
    return catalog.unnested(X.pairs(spark, folder))


@add("website_hashes", f"WITH {X.PAIRS} SELECT site, pair_hash FROM pairs")
def website_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the pairs of each site, a row per key, so that no row grows with a site."""
    return X.pairs(spark, folder).select("site", "pair_hash")


_TEXTS = "texts AS (SELECT fname, string_agg(sent, chr(10) ORDER BY i) AS text FROM sents GROUP BY fname)"


@add("article_texts", f"WITH {X.SENTS}, {_TEXTS} SELECT * FROM texts")
def article_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each parsed file."""
    return catalog.article_texts(X.sents(spark, folder))


@add(
    "paired_texts",
    f"WITH {X.PAIRS}, {X.SENTS}, {_TEXTS} SELECT p.pair_hash, a.text AS simple_text, b.text AS standard_text FROM pairs p"
    " JOIN texts a ON a.fname = p.simple JOIN texts b ON b.fname = p.standard WHERE a.text <> b.text",
)
def paired_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of each pair; exact copies are skipped."""
    both = catalog.paired_texts(X.pairs(spark, folder), catalog.article_texts(X.sents(spark, folder)))
    return both.filter(F.col("simple_text") != F.col("standard_text")).select("pair_hash", "simple_text", "standard_text")


@add(
    "identical_pairs",
    f"WITH {X.PAIRS}, {X.SENTS}, {_TEXTS} SELECT count(*) AS found, CAST(count(*) FILTER (a.text = b.text) AS BIGINT) AS identical FROM pairs p"
    " JOIN texts a ON a.fname = p.simple JOIN texts b ON b.fname = p.standard",
)
def identical_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs have the same text twice."""
    both = catalog.paired_texts(X.pairs(spark, folder), catalog.article_texts(X.sents(spark, folder)))
    return both.agg(F.count("*").alias("found"), F.count_if(F.col("simple_text") == F.col("standard_text")).alias("identical"))


@add("sentences_per_site", f"WITH {X.SENTS}, sites_of AS (SELECT DISTINCT site, fname FROM parsed_lines WHERE fname IS NOT NULL) SELECT site, count(*) AS sentences FROM sents JOIN sites_of USING (fname) GROUP BY site")
def sentences_per_site(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of each site."""
    where = table(spark, folder, "parsed_lines", "site", "fname").filter(F.col("fname").isNotNull()).distinct()
    return X.sents(spark, folder).join(where, "fname").groupBy("site").agg(F.count("*").alias("sentences"))


@add(
    "sample_pairs",
    f"WITH {X.PAIRS} SELECT pair_hash FROM pairs WHERE pair_hash NOT IN (SELECT pair_hash FROM judgments WHERE pair_hash IS NOT NULL)"
    " ORDER BY md5(pair_hash), pair_hash LIMIT (SELECT CAST(ceil(0.05 * count(*)) AS BIGINT) FROM pairs)",
)
def sample_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of the pairs, drawn from those that nobody has judged."""
    pairs = materialise(X.pairs(spark, folder).select("pair_hash"), "all_pairs")
    fresh = materialise(pairs.join(table(spark, folder, "judgments", "pair_hash"), "pair_hash", "left_anti"), "fresh_pairs")
    return catalog.smallest_digests(fresh, "pair_hash", -(-pairs.count() // 20))


@add("stored_sample", "sample_pairs")
def stored_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample as stored once and read again: a second draw finds it and draws no other."""
    path = own_folder(spark, "sample")
    catalog.stored(spark, path, lambda: sample_pairs(spark, folder))
    return catalog.stored(spark, path, lambda: X.pairs(spark, folder).select("pair_hash").limit(0))


_OWN = r"regexp_replace(url, '^\w+://[\w.-]+/web/\d+/', '')"
_FULL = f"CASE WHEN {_OWN} LIKE 'http%' THEN {_OWN} ELSE 'https://' || {_OWN} END"


@add(
    "url_names",
    f"""WITH u AS (SELECT header_id, {_FULL} AS f FROM archive_header WHERE url IS NOT NULL),
p AS (SELECT header_id, regexp_extract(f, '^[A-Za-z]+://([^/?#]*)', 1) AS host, regexp_extract(f, '^[A-Za-z]+://[^/?#]*([^?#;]*)', 1) AS path FROM u),
n AS (SELECT *, replace(host || path, '/', '__') AS name FROM p)
SELECT header_id, CASE WHEN host LIKE 'www.%' THEN host ELSE 'www.' || host END AS folder,
  regexp_replace(replace(CASE WHEN name LIKE '%.html' THEN name ELSE name || '.html' END, '__.html', '.html'), '^www\\.', '') AS file FROM n""",
)
def url_names(spark: SparkSession, folder: str) -> DataFrame:
    """Folder and file of each address."""
    header = table(spark, folder, "archive_header", "header_id", "url").filter(F.col("url").isNotNull())
    return header.select("header_id", urls.site_folder(F.col("url")).alias("folder"), urls.file_name(F.col("url")).alias("file"))


@add("file_paths", f"WITH {X.FILES} SELECT fname, site || '/crawled/' || fname AS crawled, site || '/parsed/' || fname || '.txt' AS parsed, site || '/archive_header.json' AS header FROM files")
def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Where the stages of each file are kept."""
    f = X.files(spark, folder)
    return f.select("fname", urls.site_path(F.col("site"), "crawled", F.col("fname")).alias("crawled"), urls.site_path(F.col("site"), "parsed", F.col("fname")).alias("parsed"), F.concat("site", F.lit("/archive_header.json")).alias("header"))


@add("session_free_urls", "SELECT header_id, split_part(url, ';', 1) AS address FROM archive_header")
def session_free_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses without session ids."""
    return table(spark, folder, "archive_header", "header_id", "url").select("header_id", urls.until_semicolon(F.col("url")).alias("address"))


@add(
    "filter_new_urls",
    f"WITH {X.FILES}, l AS (SELECT page_id, site, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^<>]*href=\"([^\"]*)\"', 1))) AS href FROM crawled_pages)"
    ", a AS (SELECT DISTINCT page_id, CASE WHEN href LIKE '/%' THEN 'https://' || site || href ELSE href END AS url, site FROM l)"
    " SELECT page_id, url FROM a WHERE contains(url, site) AND url NOT IN (SELECT url FROM files WHERE url IS NOT NULL) AND NOT contains(url, 'index.php?menuid=')",
)
def filter_new_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Links of pages that stay on their site and are not in the catalog yet."""
    from lingualoom.operators.html import hrefs

    pages = table(spark, folder, "crawled_pages", "page_id", "site", "html")
    links = hrefs(pages).join(pages.select("page_id", "site"), "page_id")
    base = F.concat(F.lit("https://"), "site")
    full = links.select("page_id", "site", F.when(F.col("href").startswith("/"), urls.absolute(F.col("href"), base)).otherwise(F.col("href")).alias("url")).distinct()
    kept = full.filter(F.contains("url", "site") & ~F.contains("url", F.lit("index.php?menuid=")))
    return kept.join(X.files(spark, folder).select("url"), "url", "left_anti").select("page_id", "url")


@add("section_urls", f"WITH {X.FILES} SELECT fname, url FROM files WHERE contains(url, '/ls/') AND NOT contains(url, 'index.php?menuid=')")
def section_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of the section that a site keeps for simple language, downloads left out."""
    return X.files(spark, folder).filter(urls.in_section(F.col("url"), "/ls/")).select("fname", "url")


@add(
    "header_upsert",
    f"WITH {X.FILES}, u AS (SELECT fname, ingested_at AS t, header_id AS h, unnest(matching_files) AS m, unnest(range(len(matching_files))) AS k FROM archive_header WHERE fname IS NOT NULL), m AS (SELECT fname, m, min(struct_pack(t := t, h := h, k := k)) AS o FROM u GROUP BY fname, m)"
    ", g AS (SELECT fname, list(m ORDER BY o) AS ms FROM m GROUP BY fname)"
    " SELECT f.site, f.fname, f.url, f.crawl_date, f.easy, f.publication_date, f.type, coalesce(g.ms, []) AS matching_files FROM files f LEFT JOIN g USING (fname)",
)
def header_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog after all rows came in: first fields, all links."""
    return catalog.upsert(table(spark, folder, "archive_header"))


@add(
    "reciprocal_rows",
    f"WITH {X.PAIRS} SELECT site, standard AS fname, false AS easy, simple AS matching_file FROM pairs UNION ALL SELECT site, simple, true, standard FROM pairs",
)
def reciprocal_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Both rows that saving a pair of pages makes."""
    return catalog.reciprocal(X.pairs(spark, folder))


_LINKS = f"{X.FILES}, links AS (SELECT f.site, f.fname, u.m AS other FROM files f, unnest(f.matching_files) AS u(m) WHERE u.m IS NOT NULL)"


@add(
    "cascade_delete",
    f"""WITH {_LINKS}, gone AS (SELECT fname FROM files WHERE publication_date IS NULL),
kept AS (SELECT site, fname, list_sort(list(DISTINCT other)) AS matching_files FROM links WHERE fname NOT IN (SELECT fname FROM gone) AND other NOT IN (SELECT fname FROM gone) GROUP BY site, fname)
SELECT * FROM kept UNION ALL SELECT site, fname, [] FROM files WHERE coalesce(len(matching_files), 0) = 0 AND fname NOT IN (SELECT fname FROM gone)""",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog after files without a publication date were deleted with their links."""
    f = X.files(spark, folder)
    return catalog.delete_cascading(f, f.filter(F.col("publication_date").isNull()))


@add(
    "orphan_prune",
    f"WITH {_LINKS} SELECT site, fname, list_sort(list(DISTINCT other)) AS matching_files FROM links WHERE fname IN (SELECT fname FROM documents WHERE trim(text) <> '') AND other IN (SELECT fname FROM documents WHERE trim(text) <> '') GROUP BY site, fname",
)
def orphan_prune(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose both ends have a parsed text."""
    parsed = table(spark, folder, "documents", "fname", "text").filter(F.trim("text") != "").select("fname").filter(F.col("fname").isNotNull())
    return catalog.prune_orphans(X.files(spark, folder), parsed)


_EDGES = r"""e AS (SELECT DISTINCT 'https://' || site || '/' || page_id AS src, 'https://' || site || '/' || regexp_extract(h.href, '^/0*(\d+)$', 1) AS dst
  FROM (SELECT page_id, site, unnest(regexp_extract_all(html, '<a\s[^<>]*href="([^"]*)"', 1)) AS href FROM crawled_pages) h WHERE regexp_matches(h.href, '^/\d+$'))"""


@add(
    "site_closure",
    f"WITH RECURSIVE {_EDGES}, s AS (SELECT 'https://' || site || '/' || min(page_id) AS node FROM crawled_pages GROUP BY site), r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r",
)
def site_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that can be reached on each site from its first one, with page and link numbers as they are."""
    pages = table(spark, folder, "crawled_pages", "page_id", "site", "html")
    from lingualoom.operators.html import hrefs

    link = hrefs(pages).join(pages.select("page_id", "site"), "page_id").filter(F.col("href").rlike(r"^/\d+$"))
    name = lambda k: F.concat(F.lit("https://"), "site", F.lit("/"), k.cast("string"))
    edges = link.select(name(F.col("page_id")).alias("src"), name(F.regexp_replace("href", r"^/0*(?=\d)", "")).alias("dst"))
    return catalog.closure(edges, pages.groupBy("site").agg(F.min("page_id").alias("first")).select(name(F.col("first")).alias("node")))


@add("missing_pages", f"WITH {X.FILES} SELECT site, fname, url FROM files WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM crawled_pages WHERE url IS NOT NULL)")
def missing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog entries whose page still has to be fetched."""
    pages = table(spark, folder, "crawled_pages", "url").filter(F.col("url").isNotNull())
    return X.files(spark, folder).filter(F.col("url").isNotNull()).join(pages, "url", "left_anti").select("site", "fname", "url")


@add("first_pages", "SELECT url, min(page_id) AS page_id FROM crawled_pages WHERE url IS NOT NULL GROUP BY url")
def first_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Of pages stored more than once the first write stays."""
    return table(spark, folder, "crawled_pages", "page_id", "url").filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("page_id").alias("page_id"))


@add(
    "unarchived",
    f"WITH {X.FILES} SELECT fname, url, crawl_date, easy, publication_date FROM files WHERE url IS NOT NULL AND NOT regexp_matches(url, '/web/\\d+/')",
)
def unarchived(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that have no copy in the web archive yet, with the fields that go there."""
    f = X.files(spark, folder).filter(F.col("url").isNotNull() & ~F.col("url").rlike(r"/web/\d+/"))
    return f.select("fname", "url", "crawl_date", "easy", "publication_date")


@add("pair_digests", f"WITH {X.PAIRS} SELECT pair_hash, CAST(CAST(('0x' || substr(pair_hash, 1, 15)) AS BIGINT) AS VARCHAR) AS head FROM pairs")
def pair_digests(spark: SparkSession, folder: str) -> DataFrame:
    """First 60 bits of each pair's key in decimal."""
    return X.pairs(spark, folder).select("pair_hash", F.conv(F.substring("pair_hash", 1, 15), 16, 10).alias("head"))


@add("decimal_keys")
def decimal_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair's key as the decimal number that names result files."""
    p = X.pairs(spark, folder)
    return p.select("pair_hash", urls.decimal_digest(F.concat("simple", F.lit(".txt___"), "standard", F.lit(".txt"))).alias("decimal_key"))


@add(
    "judged_progress",
    f"WITH {X.PAIRS}, j AS (SELECT pair_hash, count(*) AS n, count(verdict) AS v FROM judgments GROUP BY pair_hash)"
    " SELECT p.site, count(*) AS pairs, count(j.pair_hash) AS started, CAST(count(*) FILTER (j.n = j.v) AS BIGINT) AS finished FROM pairs p LEFT JOIN j USING (pair_hash) GROUP BY p.site",
)
def judged_progress(spark: SparkSession, folder: str) -> DataFrame:
    """File pairs per site, those with verdicts, and those without open ones."""
    j = table(spark, folder, "judgments", "pair_hash", "verdict").groupBy("pair_hash").agg(F.count("*").alias("n"), F.count("verdict").alias("v"))
    both = X.pairs(spark, folder).join(j, "pair_hash", "left")
    return both.groupBy("site").agg(F.count("*").alias("pairs"), F.count("n").alias("started"), F.count_if(F.col("n") == F.col("v")).alias("finished"))


@add("progress_intersect", f"{X.BASE} SELECT site, count(*) AS pairs FROM (SELECT DISTINCT site, pair_hash FROM used INTERSECT SELECT DISTINCT p.site, j.pair_hash FROM judgments j JOIN pairs p USING (pair_hash)) GROUP BY site")
def progress_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs per site that have sentences and verdicts."""
    pairs = X.pairs(spark, folder)
    used = X.used_pairs(pairs, X.sents(spark, folder)).select("site", "pair_hash")
    judged = pairs.join(table(spark, folder, "judgments", "pair_hash"), "pair_hash", "left_semi").select("site", "pair_hash")
    return used.intersect(judged).groupBy("site").agg(F.count("*").alias("pairs"))


@add("article_counts", f"WITH {X.PAIRS} SELECT site, count(DISTINCT simple) AS simple_files, count(DISTINCT standard) AS standard_files FROM pairs GROUP BY ROLLUP (site)")
def article_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Different files per site and of all."""
    from lingualoom.operators.evaluate import article_counts as run

    return run(X.pairs(spark, folder))


@add("idf_fingerprint", f"WITH {X.PAIRS}, f AS (SELECT simple AS fname FROM pairs UNION SELECT standard FROM pairs) SELECT count(*) AS files, CAST(sum(CAST(CAST(('0x' || substr(sha1(fname), 1, 12)) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM f")
def idf_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Whether stored document frequencies still belong to the files at hand."""
    from lingualoom.operators.weights import fingerprint

    return fingerprint(catalog.unnested(X.pairs(spark, folder)))
