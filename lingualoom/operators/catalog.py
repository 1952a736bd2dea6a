"""The catalog of files: upsert, links, pairs, deletion, incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.functions import urls
from lingualoom.session import materialise


def first_rows(header: DataFrame) -> DataFrame:
    """Each file's row as first stored; later rows of a file do not count."""
    fields = [c for c in header.columns if c != "fname"]
    own = F.min_by(F.struct(*fields), F.struct("ingested_at", "header_id")).alias("_f")
    return header.filter(F.col("fname").isNotNull()).groupBy("fname").agg(own).select("fname", "_f.*")


def upsert(header: DataFrame) -> DataFrame:
    """One row per file: fields of its first row, and the links of all of its rows, each once, as they came."""
    order = F.struct("ingested_at", "header_id")
    grouped = header.filter(F.col("fname").isNotNull()).groupBy("site", "fname").agg(
        F.min_by(F.struct("url", "crawl_date", "easy", "publication_date", "type"), order).alias("_f"),
        F.array_sort(F.collect_list(F.when(F.size("matching_files") > 0, F.struct(order.alias("o"), F.col("matching_files").alias("m"))))).alias("_m"),
    )
    links = F.array_distinct(F.flatten(F.transform("_m", lambda x: x.m)))
    return grouped.select("site", "fname", "_f.*", links.alias("matching_files"))


def reciprocal(pairs: DataFrame) -> DataFrame:
    """Both header rows of each saved pair of pages: (site, fname, easy, matching_file)."""
    both = F.array(
        F.struct(F.col("standard").alias("fname"), F.lit(False).alias("easy"), F.col("simple").alias("matching_file")),
        F.struct(F.col("simple").alias("fname"), F.lit(True).alias("easy"), F.col("standard").alias("matching_file")),
    )
    return pairs.select("site", F.explode(both).alias("r")).select("site", "r.*")


def links(files: DataFrame) -> DataFrame:
    return files.select("site", "fname", F.explode("matching_files").alias("other")).filter(F.col("other").isNotNull())


def delete_cascading(files: DataFrame, gone: DataFrame) -> DataFrame:
    """(site, fname, matching_files) after the files in ``gone`` (fname) went: they, links to them, and partners left without any."""
    left = links(files).join(gone.select("fname"), "fname", "left_anti").join(gone.select(F.col("fname").alias("other")), "other", "left_anti")
    kept = left.groupBy("site", "fname").agg(F.array_sort(F.collect_set("other")).alias("matching_files"))
    lone = files.filter(F.coalesce(F.size("matching_files"), F.lit(0)) <= 0).join(gone.select("fname"), "fname", "left_anti")
    return kept.unionByName(lone.select("site", "fname", F.array().cast("array<string>").alias("matching_files")))


def prune_orphans(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(site, fname, matching_files): files and links of which both ends have text (``parsed``: fname); one pass."""
    has = parsed.select("fname").distinct()
    both = links(files).join(has, "fname", "left_semi").join(has.select(F.col("fname").alias("other")), "other", "left_semi")
    return both.groupBy("site", "fname").agg(F.array_sort(F.collect_set("other")).alias("matching_files"))


def article_pairs(files: DataFrame, sources: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """(site, simple, standard, type, pair_hash) of each link of a simple file; optionally only sites that contain one of ``sources`` and files of a type."""
    rows = files.filter("easy")
    if sources:
        hit: Column = F.lit(False)
        for s in sources:
            hit = hit | F.contains("site", F.lit(s))
        rows = rows.filter(hit)
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    out = rows.select("site", F.col("fname").alias("simple"), F.explode(F.array_distinct("matching_files")).alias("standard"), "type").filter(F.col("standard").isNotNull())
    return out.withColumn("pair_hash", urls.pair_hash(F.col("simple"), F.col("standard")))


def unnested(pairs: DataFrame) -> DataFrame:
    """(fname): every article of the pairs, once."""
    return pairs.select(F.explode(F.array("simple", "standard")).alias("fname")).distinct()


def sentences(lines: DataFrame) -> DataFrame:
    """(fname, i, sent): sentences of each file, each stored row once and blank ones left out, numbered from 0."""
    one = lines.filter(F.col("fname").isNotNull()).groupBy("fname", "sent_id").agg(F.min(F.struct("parsed_at", "line_no", "sent")).alias("s"))
    one = one.filter(F.col("s.sent").rlike(r"[^\s\p{Z}]"))
    # A file is one article, so what one task gets for it is an article's sentences.
    files = one.groupBy("fname").agg(F.array_sort(F.collect_list(F.struct("s.line_no", "sent_id", "s.sent"))).alias("all"))
    return files.select("fname", F.posexplode("all").alias("i", "x")).select("fname", "i", F.col("x.sent").alias("sent"))


def article_texts(sents: DataFrame) -> DataFrame:
    """(fname, text): sentences of each file in order, joined by line ends."""
    own = F.array_sort(F.collect_list(F.struct("i", "sent")))
    return sents.groupBy("fname").agg(F.array_join(F.transform(own, lambda x: x.sent), "\n").alias("text"))


def paired_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with both texts; pairs of which one has none drop out."""
    a = texts.select(F.col("fname").alias("simple"), F.col("text").alias("simple_text"))
    b = texts.select(F.col("fname").alias("standard"), F.col("text").alias("standard_text"))
    return pairs.join(a, "simple").join(b, "standard")


def smallest_digests(rows: DataFrame, key: str, k: int, digits: int = 3) -> DataFrame:
    """The ``k`` rows of smallest MD5 of ``key``, without a sort: a threshold is refined, some hexadecimal digits at a time.

    Each round counts only rows that share the digits found so far, in 16 ** ``digits`` classes at most; that many numbers come to
    the driver. The threshold is final when it parts classes of which the last is taken whole. Equal keys go together: with repeated
    keys at the threshold there may be more than ``k`` rows.
    """
    coded = rows.withColumn("_d", F.md5(key))
    prefix, left = "", k
    while left > 0 and len(prefix) < 32:
        within = coded.filter(F.col("_d").startswith(prefix)) if prefix else coded
        counts = within.groupBy(F.substring("_d", 1, len(prefix) + digits).alias("p")).agg(F.count("*").alias("n")).collect()
        threshold = None
        for p, n in sorted(map(tuple, counts)):
            if n >= left:
                threshold = p
                break
            left -= n
        if threshold is None:  # fewer rows than wanted
            return rows
        prefix = threshold
        if n == left:
            break
    if left <= 0:
        return rows.limit(0)
    return coded.filter(F.substring("_d", 1, len(prefix)) <= prefix).drop("_d")


def stored(spark: SparkSession, path: str, draw: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none yet, that which ``draw`` gives, stored there first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        draw().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): all that can be reached from ``start`` (node) over ``edges`` (src, dst), a frontier per round.

    Each round shuffles only the new nodes; the reached ones are written, so lineage does not grow. It ends when none are new.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "closure_edges")
    reached = materialise(start.select("node").distinct(), "closure")
    frontier = reached
    while True:
        new = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        new = materialise(new.join(reached, "node", "left_anti"), "closure_new")
        if new.isEmpty():
            return reached
        reached = materialise(reached.unionByName(new), "closure")
        frontier = new
