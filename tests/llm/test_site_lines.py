"""Repeated lines against a plain count in Python."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from lingualoom.llm import site_lines as L

SHAPE = "doc_id long, source string, text string, grp string, line string"


def key(line):
    return re.sub("[0-9]+", "0", re.sub("[ \t \r]+", " ", line.lower())).strip(" ")


def brute(rows, share=0.05, least=3):
    docs, seen = defaultdict(int), defaultdict(set)
    for i, s, t, *_ in rows:
        if t is not None:
            docs[s] += 1
            for x in t.split("\n"):
                if key(x):
                    seen[s, key(x)].add(i)
    often = {k for k, v in seen.items() if len(v) >= least and len(v) >= share * docs[k[0]] - 1e-9}
    return sorted((i, n) for i, s, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n"), 1) if (s, key(x)) in often)


def build():
    rows = []
    for i in range(60):
        lines = [f"Eigener Satz {'x' * i}.", "Stand:  01.0%d.2020" % (i % 9), "NEWSLETTER bestellen\r" if i % 2 else "newsletter bestellen", "", "  "]
        if i % 15 == 0:
            lines = ["dreimal im Ganzen", "dreimal im Ganzen", *lines]
        if i < 2:
            lines.append("nur zweimal")
        rows.append((i, "a", "\n".join(lines), "g", "l"))
    rows += [(100 + i, "b", "Fuß\nzeile", "g", "l") for i in range(3)]
    rows += [(200, "c", None, "g", "l"), (201, "c", "", "g", "l"), (202, None, "allein", "g", "l"), (203, "a", "w " * 200_000, "g", "l")]
    return rows


def test_found_blocks_and_cleaning(spark):
    rows = build()
    docs = spark.createDataFrame(rows, SHAPE)
    found, blocks = L.repeated_lines(docs, F.col("source"))
    assert sorted((r.doc_id, r.line_no) for r in found.collect()) == brute(rows)
    by = {(r.grp, r.line): r.block for r in blocks.collect()}
    assert by["a", "stand: 0.0.0"] == by["a", "newsletter bestellen"] and by["b", "fuß"] == by["b", "zeile"]
    assert by["a", "dreimal im ganzen"] != by["a", "stand: 0.0.0"]
    clean = {r.doc_id: (r.text, r.removed) for r in L.without_repeated_lines(docs, F.col("source"), blocks).collect()}
    assert clean[5] == ("Eigener Satz xxxxx.\n\n  ", 2)
    assert clean[100] == ("", 2) and clean[200][0] is None and clean[201] == ("", 0) and clean[202] == ("allein", 0)


def test_empty_table(spark):
    found, blocks = L.repeated_lines(spark.createDataFrame([], SHAPE), F.col("source"))
    assert found.count() == 0 and blocks.count() == 0


def test_results_are_the_same_without_broadcasts(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else "s|t", "Impressum 1\nKontakt\n" + f"Satz {chr(97 + k)}\nAlles neu") for k in range(12)] + [(50, "hot", None), (51, None, "Impressum 1")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")

    def run():
        found, blocks = L.repeated_lines(docs, F.col("source"))
        clean = L.without_repeated_lines(docs, F.col("source"), blocks)
        return sorted(map(repr, found.collect())), sorted(map(repr, clean.collect()))

    want = run()
    monkeypatch.setattr(L, "MAX_GROUPS", 0)
    monkeypatch.setattr(L, "MAX_BLOCK_LINES", 0)
    assert run() == want and want[0]
