"""File formats, samples by threshold, links between language levels and streams of verdicts."""

import datetime
import hashlib

from pyspark.sql import functions as F

from lingualoom.operators import catalog as C
from lingualoom.operators import html as H
from lingualoom.sources import files as S
from lingualoom.streaming.incremental import verdict_counts


def test_match_files_keep_any_text(spark, tmp_path):
    rows = [("p", "m", "max", 1.5, 0, 2, 'Er sagt "a,b" \\ [1]', "ü\n]]", 0.25), ("p", "m", "max", 1.5, 1, 0, "", "x", 1.0), ("q", "m", "max", 0.0, 0, 0, "a", "b", -0.5)]
    df = spark.createDataFrame(rows, "pair_hash string, measure string, strategy string, sd double, i int, j int, simple_sent string, normal_sent string, sim double")
    S.write_match_files(df, f"{tmp_path}/m")
    assert sorted(map(tuple, S.read_match_files(spark, f"{tmp_path}/m").collect())) == sorted(rows)
    S.write_match_files(df.limit(0), f"{tmp_path}/none")
    assert S.read_match_files(spark, f"{tmp_path}/none").count() == 0


def test_headers_of_large_sites_have_several_objects(spark, tmp_path):
    rows = [("www.a.de", f"f{k}", None if k % 2 else "u", "c", bool(k % 2), None, ["x", "y"], "LS") for k in range(25)] + [("www.b.de", "g", "u", "c", None, "p", None, None)]
    df = spark.createDataFrame(rows, "site string, fname string, url string, crawl_date string, easy boolean, publication_date string, matching_files array<string>, type string")
    for at_most in (50_000, 4):
        S.write_headers(df, f"{tmp_path}/{at_most}", at_most)
        assert sorted(map(repr, S.read_headers(spark, f"{tmp_path}/{at_most}/*/*").collect())) == sorted(map(repr, df.collect()))


def test_smallest_digests_without_a_sort(spark):
    rows = [(f"k{k}",) for k in range(300)]
    df = spark.createDataFrame(rows, "key string")
    order = sorted((hashlib.md5(k.encode()).hexdigest(), k) for (k,) in rows)
    for k in (0, 1, 17, 299, 300, 500):
        for digits in (1, 3):
            assert sorted(r.key for r in C.smallest_digests(df, "key", k, digits).collect()) == sorted(x for _, x in order[:k])


def test_a_stored_sample_is_not_drawn_again(spark, tmp_path):
    draw = lambda n: (lambda: spark.range(n).toDF("key"))
    assert C.stored(spark, f"{tmp_path}/s", draw(3)).count() == 3
    assert C.stored(spark, f"{tmp_path}/s", draw(9)).count() == 3


PAGES = [
    (1, '<div class="con cssBoxTeaserStandard conInline"><a href="/a">Auch in schwerer Sprache</a><a href="/b">auch in schwerer Sprache</a></div><a href="/c">auch in schwerer Sprache</a>'),
    (2, '<div class="modul" id="mod_menue_top"><li><a title="Auf Alltags-Sprache umstellen" href="/d">x</a></li></div>'),
    (3, '<a class="c-language-switch__l c-language-switch__l--as" title="Lesen Sie den Artikel X in Alltagssprache" href="/e">Alltagssprache</a>'),
    (4, '<a hreflang="de-DE" class="underline easy" href="/f">In Standardsprache</a><a hreflang="en" href="/g">Standardsprache</a>'),
    (5, '<p xmlns="" class="x"><em>Hier: </em><a href="/h">1</a><a href="/i">2</a></p><p xmlns="" class="x"><a href="/j">3</a></p><p class="x"><em>k</em><a href="/k">4</a></p>'),
    (6, '<a title="hier" href="/einfache-sprache/x">a</a><a title="hier" href="/l">b</a><a title="hier">c</a>'),
    (7, "<p>nichts</p>"), (8, None), (9, ""),
]


def test_links_to_the_other_level_by_site(spark):
    nodes = H.nodes(spark.createDataFrame(PAGES, "page_id long, html string"))
    got = sorted((r.page_id, r.rule, r.href) for r in H.counterpart_links(nodes, H.counterpart_rules()).collect())
    assert got == [(1, "teaser", "/a"), (2, "top_menu", "/d"), (3, "switch", "/e"), (4, "language", "/f"), (5, "paragraph", "/h"), (5, "paragraph", "/i"), (6, "here", "/l")]


def test_nodes_have_the_text_between_their_ends(spark):
    html = "<div>a<p>b<i>c</i><p>d</div>e<b>f"
    got = {(r.node, r.tag): (r.parent, r.last, r.text) for r in H.nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert got == {(0, "div"): (-1, 3, "abcd"), (1, "p"): (0, 2, "bc"), (2, "i"): (1, 2, "c"), (3, "p"): (0, 3, "d"), (4, "b"): (-1, 4, "f")}


def test_verdicts_per_day_from_a_stream(spark, tmp_path):
    day = datetime.datetime(2024, 5, 1)
    rows = [(day, True), (day, False), (day + datetime.timedelta(days=1), None), (day + datetime.timedelta(days=9), True)]
    spark.createDataFrame(rows, "judged_at timestamp, verdict boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("judged_at timestamp, verdict boolean").parquet(f"{tmp_path}/in")
    query = verdict_counts(stream).writeStream.format("memory").queryName("verdict_days").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.n, r.right) for r in spark.table("verdict_days").select(F.col("n"), F.col("right")).collect()) == [(1, 0), (1, 1), (2, 1)]
