"""Queries of the operator for lines repeated within a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualoom.llm import site_lines
from lingualoom.plans.fixture import FILES
from lingualoom.plans.registry import Registry
from lingualoom.sources.tables import table

registry = Registry()

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(l), '[ \t\x{A0}\r]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ')"
_FOUND_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT doc_id, source, CAST(line_no AS INTEGER) AS line_no, {_NORMAL} AS k FROM lines),
sizes AS (SELECT source, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY source),
often AS (
  SELECT k.source, k.k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY source, k) k
  JOIN sizes s ON s.source = k.source WHERE k.n >= 3 AND k.n * 20 >= s.docs)
"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "source", "text")


@registry.add("p2_found", _FOUND_SQL + "SELECT doc_id, line_no FROM keyed JOIN often USING (source, k)")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of a line that returns in an excessive share of its source's documents."""
    found, _ = site_lines.repeated_lines(_documents(spark, folder), F.col("source"))
    return found.select("doc_id", "line_no")


_BLOCKS_SQL = rf"""{_FOUND_SQL.replace("WITH lines", "WITH RECURSIVE lines")}, filled AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM keyed WHERE k <> ''),
kept AS (SELECT f.* FROM filled f JOIN often USING (source, k)),
edges AS (SELECT e.source, a, b FROM (SELECT x.source, x.k AS a, y.k AS b, count(DISTINCT x.doc_id) AS n FROM kept x JOIN kept y ON y.doc_id = x.doc_id AND y.rn = x.rn + 1 WHERE x.k <> y.k GROUP BY ALL) e
  JOIN sizes s ON s.source = e.source WHERE e.n >= 3 AND e.n * 20 >= s.docs),
both_ways AS (SELECT source, a, b FROM edges UNION SELECT source, b, a FROM edges),
reach AS (SELECT source, k AS a, k AS b FROM often UNION SELECT r.source, r.a, w.b FROM reach r JOIN both_ways w ON w.source = r.source AND w.a = r.b),
ends AS (SELECT source, a AS line, min(b) AS first FROM reach GROUP BY source, a),
support AS (SELECT source, k AS line, count(DISTINCT doc_id) AS docs_with FROM keyed GROUP BY source, k)
SELECT source, line, docs_with, dense_rank() OVER (PARTITION BY source ORDER BY first) - 1 AS block FROM ends JOIN support USING (source, line)"""


@registry.add("p2_blocks", _BLOCKS_SQL)
def p2_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The boilerplate blocks of each source: their lines and in how many documents these are."""
    _, blocks = site_lines.repeated_lines(_documents(spark, folder), F.col("source"))
    return blocks.withColumnRenamed("grp", "source")


@registry.add(
    "p2_clean",
    _FOUND_SQL + """, kept AS (
  SELECT k.doc_id, string_agg(l.l, chr(10) ORDER BY k.line_no) AS text, count(*) AS n FROM keyed k
  JOIN lines l ON l.doc_id = k.doc_id AND l.line_no = k.line_no
  WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.source = k.source AND o.k = k.k) GROUP BY k.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
  CASE WHEN d.text IS NOT NULL THEN CAST(len(string_split(d.text, chr(10))) - coalesce(kept.n, 0) AS INTEGER) END AS removed
FROM documents d LEFT JOIN kept USING (doc_id)""",
)
def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its source's repeated lines."""
    docs = _documents(spark, folder)
    _, blocks = site_lines.repeated_lines(docs, F.col("source"))
    return site_lines.without_repeated_lines(docs, F.col("source"), blocks)


_BY_TYPE_SQL = rf"""WITH {FILES}, lines AS (
  SELECT d.doc_id, d.source, f.type, unnest(string_split(d.text, chr(10))) AS l, generate_subscripts(string_split(d.text, chr(10)), 1) AS line_no
  FROM documents d LEFT JOIN files f ON f.fname = d.fname WHERE d.text IS NOT NULL),
keyed AS (SELECT doc_id, source, type, CAST(line_no AS INTEGER) AS line_no, {_NORMAL} AS k FROM lines),
sizes AS (SELECT d.source, f.type, count(*) AS docs FROM documents d LEFT JOIN files f ON f.fname = d.fname WHERE d.text IS NOT NULL GROUP BY ALL),
often AS (SELECT k.* FROM (SELECT source, type, k, count(DISTINCT doc_id) AS n FROM keyed WHERE k <> '' GROUP BY ALL) k
  JOIN sizes s ON s.source IS NOT DISTINCT FROM k.source AND s.type IS NOT DISTINCT FROM k.type WHERE k.n >= 3 AND k.n * 20 >= s.docs)
SELECT k.doc_id, k.line_no, k.source, k.type FROM keyed k JOIN often o ON o.k = k.k AND o.source IS NOT DISTINCT FROM k.source AND o.type IS NOT DISTINCT FROM k.type"""


@registry.add("p2_by_type", _BY_TYPE_SQL)
def p2_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated lines within each source and type of file (``type`` of the file's first header row)."""
    header = table(spark, folder, "archive_header", "fname", "type", "ingested_at", "header_id")
    kinds = header.groupBy("fname").agg(F.min(F.struct("ingested_at", "header_id", "type")).alias("h")).select("fname", "h.type")
    docs = table(spark, folder, "documents", "doc_id", "source", "text", "fname").join(kinds, "fname", "left")
    # Both names in one key that can be taken apart, whatever signs are in them.
    found, _ = site_lines.repeated_lines(docs, F.to_json(F.struct("source", "type")))
    return found.select("doc_id", "line_no", F.from_json("grp", "source string, type string").alias("g")).select("doc_id", "line_no", "g.source", "g.type")
