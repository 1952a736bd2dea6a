"""Reachability on sites that are deep and whose page numbers are large."""

import __spark_entry__ as entry
from lingualoom.operators import catalog


def test_closure_of_a_deep_site(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(55)] + [("55", "0")], "src string, dst string")
    start = spark.createDataFrame([("0",)], "node string")
    assert {r.node for r in catalog.closure(edges, start).collect()} == {str(k) for k in range(56)}


def test_pages_that_differ_by_997_stay_apart(spark, tmp_path):
    link = lambda k: f'<a href="/{k}">x</a>'
    rows = [(5, "a.example", link(1500)), (503, "a.example", link(7)), (1500, "a.example", link("012345678901234567890123")), (40, "b.example", link(41))]
    spark.createDataFrame(rows, "page_id long, site string, html string").write.parquet(f"{tmp_path}/crawled_pages.parquet")
    got = sorted(r.node for r in entry.queries()["site_closure"](spark, str(tmp_path)).collect())
    assert got == ["https://a.example/12345678901234567890123", "https://a.example/1500", "https://a.example/5", "https://b.example/40", "https://b.example/41"]
