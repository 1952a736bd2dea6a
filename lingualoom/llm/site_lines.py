"""Lines that return in an excessive share of one site's documents, and texts without them.

Per group (site, or site and type) the lines of all documents form a weighted graph: a node is a line after
normalisation, weighted by the documents it occurs in, an edge joins two lines that follow each other, weighted
by the documents in which they do. Nodes and edges below the support are dropped; the connected components that
remain are the boilerplate blocks, and all occurrences of lines of a block are deleted. A supported line without supported
edges is a block by itself: the support of its own is what makes a line repeated, whatever stands around it, so edges say which
lines belong together, and not which ones go.

Sizes: a node stays only if it is in ``min_share`` of the group's documents, so a group keeps at most
(mean number of different lines per document) / ``min_share`` nodes, and per node no more edges than that; that
is what one task gets for the components. Everything that grows with the corpus is counted by partial
aggregation on 8-byte hashes; the strings are compared only for the lines whose hash reached the support.

Defined results: documents with null ``text`` count nowhere and have no lines; empty texts count as documents and
have none either; a null group is a group of its own; repeated documents count each; lines that are empty after
normalisation never count; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.session import bounded_broadcast, lookup_join, materialise

MIN_SHARE, MIN_DOCS = 0.05, 3
#: Most rows that are broadcast; beyond it the join is a shuffled one.
MAX_BLOCK_LINES, MAX_GROUPS = 200_000, 100_000


def normal_lines(text: Column) -> Column:
    """The text's lines, lower case, digit runs as one digit, blank runs as one blank, trimmed."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[ \t\u00a0\r]+", " "), "[0-9]+", "0")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def _grouped(documents: DataFrame, group: Column) -> DataFrame:
    return documents.select("doc_id", F.coalesce(group.cast("string"), F.lit("\x00")).alias("grp"), "text").filter(F.col("text").isNotNull())


def _reaches(n: Column, documents: Column, share: float, least: int) -> Column:
    return (n >= least) & (n.cast("double") >= documents.cast("double") * share - 1e-9)


def repeated_occurrences(documents: DataFrame, group: Column, share: float = MIN_SHARE, least: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(per document its lines whose hash reaches the support, each with the line before; documents per group)."""
    docs = _grouped(documents, group)
    sizes = materialise(docs.groupBy("grp").agg(F.count("*").alias("docs")), "line_groups")
    hashed = docs.select("grp", F.explode(F.array_distinct(F.transform(F.filter(normal_lines(F.col("text")), lambda x: x != ""), lambda x: F.xxhash64(x)))).alias("h"))
    counts = hashed.groupBy("grp", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    often = counts.join(bounded_broadcast(sizes, MAX_GROUPS), "grp").filter(_reaches(F.col("n"), F.col("docs"), share, least))
    # One row per group with its few hashes, so that documents are read, not exploded and shuffled, for the join.
    often = materialise(often.groupBy("grp").agg(F.collect_list("h").alias("hs")), "line_hashes")
    found = lookup_join(docs, often, "grp", MAX_GROUPS, 8 * F.size("hs") + F.length("grp")).select("doc_id", "grp", "hs", normal_lines(F.col("text")).alias("norm"))
    # Each step below is one pass over a text's lines, however many there are.
    numbered = F.transform("norm", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    found = found.select("doc_id", "grp", "hs", F.filter(numbered, lambda s: s.line != "").alias("filled"))
    placed = F.transform("filled", lambda s, k: F.struct(s.line_no.alias("line_no"), s.line.alias("line"), k.alias("k")))
    found = found.select("doc_id", "grp", F.filter(placed, lambda s: F.array_contains(F.col("hs"), F.xxhash64(s.line))).alias("ls")).filter(F.size("ls") > 0)
    # The line before, among those that are not empty, makes the edge.
    shifted = F.slice(F.concat(F.array(F.lit(None).cast("struct<line_no: int, line: string, k: int>")), "ls"), 1, F.size("ls"))
    joined = F.zip_with("ls", shifted, lambda s, p: F.struct(s.line_no.alias("line_no"), s.line.alias("line"), F.when(p.k + 1 == s.k, p.line).alias("before")))
    return found.select("doc_id", "grp", joined.alias("ls")), sizes


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one group's surviving lines."""
    nodes = pdf[pdf.line_before.isna()].sort_values("line")
    root = {line: line for line in nodes.line}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pdf.loc[pdf.line_before.notna(), ["line_before", "line"]].itertuples(index=False):
        if a in root and b in root:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    ends = [find(x) for x in nodes.line]
    number = {x: k for k, x in enumerate(dict.fromkeys(ends))}
    return pd.DataFrame({"grp": nodes.grp, "line": nodes.line, "docs_with": nodes.n, "block": [number[x] for x in ends]})


def boilerplate_blocks(occurrences: DataFrame, sizes: DataFrame, share: float = MIN_SHARE, least: int = MIN_DOCS) -> DataFrame:
    """(grp, line, docs_with, block): the lines of the blocks."""
    once = lambda x: F.explode(F.array_distinct(x))
    nodes = occurrences.select("grp", once(F.transform("ls", lambda s: s.line)).alias("line"))
    nodes = nodes.groupBy("grp", F.lit(None).cast("string").alias("line_before"), "line").agg(F.count("*").alias("n"))
    pairs = F.filter("ls", lambda s: s.before.isNotNull() & (s.before != s.line))
    edges = occurrences.select("grp", once(F.transform(pairs, lambda s: F.struct(s.before.alias("line_before"), s.line.alias("line")))).alias("e"))
    edges = edges.groupBy("grp", "e.line_before", "e.line").agg(F.count("*").alias("n"))
    graph = nodes.unionByName(edges).join(bounded_broadcast(sizes, MAX_GROUPS), "grp").filter(_reaches(F.col("n"), F.col("docs"), share, least))
    return graph.select("grp", "line_before", "line", "n").groupBy("grp").applyInPandas(_components, "grp string, line string, docs_with long, block long")


def repeated_lines(documents: DataFrame, group: Column, share: float = MIN_SHARE, least: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line_no, grp, block, line) of every line to remove, and the blocks."""
    occurrences, sizes = repeated_occurrences(documents, group, share, least)
    kept = materialise(occurrences, "line_occurrences")
    blocks = materialise(boilerplate_blocks(kept, sizes, share, least), "line_blocks")
    lines = kept.select("doc_id", "grp", F.explode("ls").alias("l")).select("doc_id", "grp", "l.line_no", "l.line")
    found = lookup_join(lines, blocks, ["grp", "line"], MAX_BLOCK_LINES, 4 * (F.length("line") + F.length("grp")) + 16).select("doc_id", "line_no", "grp", "block", "line")
    return found, blocks


def without_repeated_lines(documents: DataFrame, group: Column, blocks: DataFrame) -> DataFrame:
    """(doc_id, text, removed): every document, its text without the lines of its group's blocks; null stays null."""
    lists = blocks.groupBy("grp").agg(F.collect_list("line").alias("_lines"))
    docs = documents.select("doc_id", F.coalesce(group.cast("string"), F.lit("\x00")).alias("grp"), "text")
    docs = lookup_join(docs, lists, "grp", MAX_GROUPS, 4 * F.aggregate("_lines", F.lit(0), lambda n, x: n + F.length(x)) + F.length("grp"), "left")
    gone = F.transform(normal_lines(F.col("text")), lambda x: (x != "") & F.coalesce(F.array_contains(F.col("_lines"), x), F.lit(False)))
    docs = docs.select("doc_id", "text", F.split("text", "\n", -1).alias("raw"), gone.alias("gone"))
    kept = F.filter("raw", lambda x, i: ~F.get("gone", i))
    return docs.select("doc_id", F.array_join(kept, "\n").alias("text"), (F.size("raw") - F.size(kept)).alias("removed"))
