"""Reading and writing the file formats in which a corpus is exchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.session import materialise

ENTRY = "map<string, struct<url: string, crawl_date: string, easy: boolean, publication_date: string, matching_files: array<string>, type: string>>"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(site, fname, url, crawl_date, easy, publication_date, matching_files, type) from a JSON object per site, keyed by file.

    The site is the folder of the JSON file. A missing ``type`` is null; broken files and a path without any give no rows.
    """
    try:
        raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
        # A folder that was written by partition is named site=..., and a file may hold an object per line.
        raw = raw.select("file", F.explode(F.split("value", r"(?<=\})\n(?=\{)")).alias("value"))
        rows = raw.select(F.regexp_extract("file", r"(?:site=)?([^/]+)/[^/]+$", 1).alias("site"), F.explode(F.from_json("value", ENTRY)).alias("fname", "e"))
        return rows.select("site", "fname", "e.*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fields = "site string, fname string, url string, crawl_date string, easy boolean, publication_date string, matching_files array<string>, type string"
    return spark.createDataFrame([], fields)


def write_headers(files: DataFrame, path: str, at_most: int = 50_000) -> None:
    """JSON objects keyed by file, in a folder per site; a site of more than about ``at_most`` files has several, so that no task holds a whole large site."""
    sizes = files.groupBy("site").agg(F.ceil(F.count("*") / at_most).alias("_parts"))
    part = F.pmod(F.xxhash64("fname"), F.col("_parts")).alias("_part")
    entry = F.struct("url", "crawl_date", "easy", "publication_date", "matching_files", "type")
    grouped = files.join(sizes, "site").groupBy("site", part)
    objects = grouped.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("fname", entry.alias("e")))), {"ignoreNullFields": "false"}).alias("value"))
    objects.select("site", "value").write.mode("overwrite").partitionBy("site").text(path)


def read_judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((pair_hash, simple_sent, normal_sent, verdict), (pair_hash, finished)) from JSON objects of simple sentence, standard sentence, verdict.

    The mark ``finished`` stands among the sentences and is split off.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.results$", 1).alias("pair_hash"))
    one = raw.select("pair_hash", F.explode(F.from_json("value", "map<string, string>")).alias("simple_sent", "rest"))
    verdicts = one.filter("simple_sent <> 'finished'").select("pair_hash", "simple_sent", F.explode(F.from_json("rest", "map<string, boolean>")).alias("normal_sent", "verdict"))
    done = raw.select("pair_hash", F.coalesce(F.from_json("value", "map<string, string>")["finished"] == "true", F.lit(False)).alias("finished"))
    return verdicts, done


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """(pair_hash, line_no, simple_sent, normal_sent) from pairs of files ``.simple`` and ``.normal``, line by line.

    A file that ends with a line end has an empty last line, as the truth it was made from has.
    """
    raw = spark.read.text([f"{path}/*.simple", f"{path}/*.normal"], wholetext=True)
    named = raw.select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.(simple|normal)$", 1).alias("pair_hash"), F.regexp_extract(F.input_file_name(), r"\.(simple|normal)$", 1).alias("side"))
    lines = named.select("pair_hash", "side", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
    a = lines.filter("side = 'simple'").select("pair_hash", "line_no", F.col("line").alias("simple_sent"))
    return a.join(lines.filter("side = 'normal'").select("pair_hash", "line_no", F.col("line").alias("normal_sent")), ["pair_hash", "line_no"])


def truth_by_sentence(aligned: DataFrame) -> DataFrame:
    """(pair_hash, simple_sent, normal_sent): of a simple sentence that stands there twice the last line counts."""
    return aligned.groupBy("pair_hash", "simple_sent").agg(F.max_by("normal_sent", "line_no").alias("normal_sent"))


#: Folders that a task writes to at a time; the whole grid has 32.
OPEN_FOLDERS = 64


def write_matches(found: DataFrame, path: str) -> None:
    """Matches in folders by configuration, so that reading one of them reads no other.

    A task holds a file of each configuration open, so that its rows need no sort by folder; if there are more folders, Spark sorts the rest.
    """
    conf, key = found.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, max(int(before), OPEN_FOLDERS))
    try:
        found.write.mode("overwrite").partitionBy("measure", "strategy", "sd").parquet(path)
    finally:
        conf.set(key, before)


def read_matches(spark: SparkSession, path: str, measure: str | None = None, strategy: str | None = None, sd: float | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    for name, value in (("measure", measure), ("strategy", strategy), ("sd", sd)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def write_match_files(found: DataFrame, path: str) -> None:
    """A JSON line per result set (pair, measure, strategy, threshold): its name, and its matches as [[[i, j], [sentence, sentence], similarity], ...]."""
    keys = ["pair_hash", "measure", "strategy", "sd"]
    one = F.concat(F.lit("[["), "i", F.lit(","), "j", F.lit("],"), F.to_json(F.array("simple_sent", "normal_sent")), F.lit(","), F.col("sim").cast("string"), F.lit("]"))
    sets = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", one.alias("m")))).alias("ms"))
    text = F.concat(F.lit("["), F.array_join(F.transform("ms", lambda x: x.m), ","), F.lit("]"))
    name = F.concat_ws("--", "pair_hash", "measure", "strategy", F.format_string("%.1f", "sd"))
    sets.select(name.alias("name"), text.alias("matches")).write.mode("overwrite").json(path)


def read_match_files(spark: SparkSession, path: str) -> DataFrame:
    """(pair_hash, measure, strategy, sd, i, j, simple_sent, normal_sent, sim) from what ``write_match_files`` wrote."""
    raw = spark.read.schema("name string, matches string").json(path)
    key = F.split("name", "--")
    rows = raw.select(key.alias("k"), F.explode(F.from_json("matches", "array<array<string>>")).alias("m"))
    place, texts = F.from_json(F.col("m")[0], "array<int>"), F.from_json(F.col("m")[1], "array<string>")
    rows = rows.select("k", place.alias("p"), texts.alias("t"), F.col("m")[2].cast("double").alias("sim"))
    k, p, t = F.col("k"), F.col("p"), F.col("t")
    return rows.select(
        k[0].alias("pair_hash"), k[1].alias("measure"), k[2].alias("strategy"), k[3].cast("double").alias("sd"), p[0].alias("i"), p[1].alias("j"), t[0].alias("simple_sent"), t[1].alias("normal_sent"), "sim"
    )


def write_alignments(nested: DataFrame, path: str) -> None:
    """A JSON object per standard file: {file: {sentence number: [{"sent": [simple, standard], "dist": similarity}, ...]}}."""
    items = F.transform("aligned", lambda x: F.struct(F.array(x.simple_sent, x.normal_sent).alias("sent"), x.dist.alias("dist")))
    files = nested.groupBy("standard").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("j").cast("string").alias("j"), items.alias("x"))))).alias("sentences"))
    files.select(F.to_json(F.create_map("standard", "sentences")).alias("value")).write.mode("overwrite").text(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(standard, j, simple_sent, normal_sent, dist) from nested JSON."""
    shape = "map<string, map<string, array<struct<sent: array<string>, dist: double>>>>"
    rows = spark.read.text(path).select(F.explode(F.from_json("value", shape)).alias("standard", "s")).select("standard", F.explode("s").alias("j", "x"))
    rows = rows.select("standard", F.col("j").cast("int").alias("j"), F.explode("x").alias("x"))
    return rows.select("standard", "j", F.col("x.sent")[0].alias("simple_sent"), F.col("x.sent")[1].alias("normal_sent"), "x.dist")


def write_articles(texts: DataFrame, path: str) -> None:
    """(site, fname, text) as Parquet in a folder per site."""
    texts.write.mode("overwrite").partitionBy("site").parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(fname, text, site) of parsed texts."""
    return spark.read.parquet(path)


def write_parallel(exported: DataFrame, path: str) -> None:
    """Two folders of text files whose lines belong together, in the order of pair and sentence.

    The rows are written once in that order, so that both sides are cut from the same files.
    """
    rows = exported.repartitionByRange("pair_hash", "i").sortWithinPartitions("pair_hash", "i")
    flat = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    rows = materialise(rows.select(flat("simple_sent").alias("simple"), flat("normal_sent").alias("normal")), "parallel")
    for side in ("simple", "normal"):
        rows.select(F.col(side).alias("value")).write.mode("overwrite").text(f"{path}/{side}")


def read_parallel(spark: SparkSession, path: str) -> DataFrame:
    """(simple_sent, normal_sent) line by line: files of both folders in the order of their names, and lines in the order of a file."""
    sides = []
    for side in ("simple", "normal"):
        raw = spark.read.text(f"{path}/{side}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("part"), "value")
        sides.append(raw.select("part", F.posexplode(F.split("value", "\n")).alias("k", f"{side}_sent")))
    both = sides[0].join(sides[1], ["part", "k"])
    # What follows the last line end is no line.
    return both.filter((F.col("simple_sent") != "") | (F.col("normal_sent") != "")).select("simple_sent", "normal_sent")
