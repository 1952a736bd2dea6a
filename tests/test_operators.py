"""Catalog, evaluation, pages, files and streams on small tables."""

import json

from pyspark.sql import functions as F

from lingualoom.operators import catalog as C
from lingualoom.operators import evaluate as E
from lingualoom.operators import html as H
from lingualoom.sources import files as S
from lingualoom.streaming import incremental as I

FILE = "site string, fname string, matching_files array<string>, easy boolean, type string"


def test_deletion_cascades(spark):
    files = spark.createDataFrame([("s", "a", ["b", "c"], True, "LS"), ("s", "b", ["a"], False, "AS"), ("s", "c", ["a", "d"], False, "AS"), ("s", "d", ["c"], True, "LS"), ("s", "e", [], True, "LS")], FILE)
    got = {r.fname: r.matching_files for r in C.delete_cascading(files, files.filter("fname = 'a'")).collect()}
    assert got == {"c": ["d"], "d": ["c"], "e": []}


def test_orphans_go_with_their_links(spark):
    files = spark.createDataFrame([("s", "a", ["b", "c"], True, "LS"), ("s", "b", ["a"], False, "AS"), ("s", "c", ["a"], False, "AS")], FILE)
    parsed = spark.createDataFrame([("a",), ("b",)], "fname string")
    assert {r.fname: r.matching_files for r in C.prune_orphans(files, parsed).collect()} == {"a": ["b"], "b": ["a"]}


def test_pairs_filters_and_nulls(spark):
    files = spark.createDataFrame([("s1", "a", ["b", "b", None], True, "LS"), ("s2", "x", ["y"], True, None), ("s2", "y", ["x"], None, "AS"), ("s3", "z", None, True, "LS")], FILE)
    assert sorted((r.simple, r.standard) for r in C.article_pairs(files).collect()) == [("a", "b"), ("x", "y")]
    assert C.article_pairs(files, ["s1"], "LS").count() == 1
    assert C.article_pairs(files, kind="AS").count() == 0


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert sorted(r.node for r in C.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()) == ["a", "b", "c"]


def test_sentences_number_what_is_left(spark):
    lines = spark.createDataFrame([(1, "f", 0, "A. ", 1), (1, "f", 0, "A. ", 1), (2, "f", 1, "   ", 1), (3, "f", 2, "B.", 2), (4, "f", 3, None, 2), (5, None, 0, "C.", 2)], "sent_id long, fname string, line_no int, sent string, parsed_at long")
    assert sorted((r.i, r.sent) for r in C.sentences(lines).collect()) == [(0, "A. "), (1, "B.")]


def test_two_kinds_of_f1(spark):
    configs = [("m", "max", 0.0)]
    found = spark.createDataFrame([("p", "m", "max", 0.0, "a", "x"), ("p", "m", "max", 0.0, "b", "z"), ("q", "m", "max", 0.0, "c", "c")], "pair_hash string, measure string, strategy string, sd double, simple_sent string, normal_sent string")
    truth = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("q", "c", "c"), ("r", "d", "d")], "pair_hash string, simple_sent string, normal_sent string")
    row = E.macro_means(E.precision_recall(found, truth, configs)).first()
    assert (row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5)
    verdicts = spark.createDataFrame([("p", "a", "x", True), ("p", "b", "z", None), ("q", "c", "c", False)], "pair_hash string, simple_sent string, normal_sent string, verdict boolean")
    row = E.judged_means(E.judged_scores(found, verdicts)).first()
    assert (row.precision, row.recall, round(row.f1, 6)) == (0.5, 0.5, 0.5)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.999,), (1.0,), (20.0,), (20.1,), (-1.0,)], "v double")
    assert [r.b for r in df.select(E.histogram(F.col("v"), 0.0, 20.0, 20).alias("b")).collect()] == [0, 0, 1, 19, None, None]


PAGE = '<html><body><nav><ul><li><a href="/n">N</a><li>M</ul></nav><article class="sectbody" itemprop="articleBody"><h1>Kopf &amp; Fuß</h1><p class="autor">Von X</p><p>Eins. Zwei<p>Drei</article></body></html>'


def test_nodes_and_rules(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "nur Text"), (5, PAGE + PAGE)], "page_id long, html string")
    nodes = H.nodes(pages)
    assert {r.page_id for r in nodes.select("page_id").distinct().collect()} == {1, 5}
    lines = H.extracted_lines(H.extract(nodes, H.site_rules()))
    assert [(r.page_id, r.line) for r in lines.orderBy("page_id", "node", "k").collect()] == [(1, "Kopf & Fuß"), (1, "Eins. "), (1, "Zwei"), (1, "Drei")]
    assert sorted(r.href for r in H.hrefs(pages).filter("page_id = 1").collect()) == ["/n"]


def test_rules_by_parents_and_colour(spark):
    detail = '<div class="section sectionDetailPage cssBoxContent"><h1><span class="headline">Kopf</span></h1><p class="einleitung">A</p><p>no</p><div class="paragraph"><ul><li>L</li></ul></div></div>'
    fold = '<main id="x-inhalt" role="main"><div class="accordionhead"><h2>H</h2></div><div class="tinyblock"><p>P</p></div><p>no</p></main>'
    two = '<section class="textblock container"><p>Normal·wort</p><p><span style="color: #ff0000;">Ein·fach</span></p></section>'
    nodes = H.nodes(spark.createDataFrame([(1, detail), (2, fold), (3, two)], "page_id long, html string"))
    rules = H.site_rules()
    got = lambda r: [x.text for x in H.extract(nodes, {r: rules[r]}).orderBy("node").collect()]
    assert got("detail_page") == ["Kopf", "A", "L"]
    assert got("accordion") == ["H", "P"]
    assert [(r.easy, r.text) for r in H.split_by_colour(nodes).orderBy("node").collect()] == [(False, "Normal-wort"), (True, "Ein·fach")]


def test_header_json(spark, tmp_path):
    (tmp_path / "www.a").mkdir()
    (tmp_path / "www.a" / "archive_header.json").write_text(json.dumps({"x.html": {"url": "u", "crawl_date": "2022-01-29", "easy": True, "publication_date": None, "matching_files": ["y.html"]}}))
    row = S.read_headers(spark, f"{tmp_path}/*/archive_header.json").first()
    assert (row.site, row.fname, row.easy, row.matching_files, row.type) == ("www.a", "x.html", True, ["y.html"], None)
    assert S.read_headers(spark, f"{tmp_path}/none/*.json").count() == 0


def test_judgments_and_truth_files(spark, tmp_path):
    (tmp_path / "12.results").write_text(json.dumps({"a": {"x": True, "y": None}, "finished": True}))
    verdicts, done = S.read_judgments(spark, str(tmp_path / "*.results"))
    assert sorted(map(tuple, verdicts.collect()), key=str) == [("12", "a", "x", True), ("12", "a", "y", None)]
    assert [tuple(r) for r in done.collect()] == [("12", True)]
    (tmp_path / "7.simple").write_text("a\nb\na\n")
    (tmp_path / "7.normal").write_text("x\ny\nz\n")
    truth = S.truth_by_sentence(S.read_aligned(spark, str(tmp_path)))
    assert sorted((r.simple_sent, r.normal_sent) for r in truth.collect()) == [("", ""), ("a", "z"), ("b", "y")]


def test_matches_are_kept_by_configuration(spark, tmp_path):
    found = spark.createDataFrame([("p", "m", "max", 0.0, 1, 2, 0.5), ("p", "m", "max", 1.5, 1, 2, 0.5)], "pair_hash string, measure string, strategy string, sd double, i int, j int, sim double")
    S.write_matches(found, str(tmp_path / "m"))
    assert S.read_matches(spark, str(tmp_path / "m"), sd=1.5).count() == 1


def test_streams_add_each_pair_once(spark, tmp_path):
    schema = "site string, fname string, matching_files array<string>, easy boolean"
    incoming, done = str(tmp_path / "in"), str(tmp_path / "done")
    for rows in ([("s", "a", ["b"], True)], [("s", "a", ["b", "c"], True), ("s", "c", ["a"], False)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(incoming)
        query = I.new_pairs(spark, incoming, done, str(tmp_path / "check"), schema)
        query.awaitTermination(120)
    assert sorted((r.simple, r.standard) for r in spark.read.parquet(done).collect()) == [("a", "b"), ("a", "c")]


def test_verdict_stream(spark, tmp_path):
    schema = "pair_hash string, simple_sent string, normal_sent string, verdict boolean"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"pair_hash":"p","simple_sent":"a","normal_sent":"x","verdict":true}\n')
    I.record_verdicts(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), schema).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
