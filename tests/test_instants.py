"""Timestamps against the standard library's own zone rules."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lingualoom.operators.instants import header_instants, resolve_instants, zone_intervals

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*args, tz="UTC", off=None):
    t = datetime(*args)
    t = t.replace(tzinfo=timezone.utc) - timedelta(minutes=off) if off is not None else t.replace(tzinfo=ZoneInfo(tz), fold=0).astimezone(timezone.utc)
    return (t - EPOCH) // timedelta(microseconds=1)


B, N = "Europe/Berlin", "America/New_York"
CASES = [
    ("2012-01-05", B, True, us(2012, 1, 5, tz=B)), ("2012-07-05T08:09:10", B, True, us(2012, 7, 5, 8, 9, 10, tz=B)),
    ("2012-07-05 08:09", N, False, us(2012, 7, 5, 8, 9, tz=N)), ("2012-07-05T08:09:10.123456789Z", B, True, us(2012, 7, 5, 8, 9, 10, 123456)),
    ("2012-07-05T08:09:10.5", B, True, us(2012, 7, 5, 8, 9, 10, 500000, tz=B)), ("2012-07-05T08:09:10+0530", B, True, us(2012, 7, 5, 8, 9, 10, off=330)),
    ("2012-07-05T08:09-04", B, True, us(2012, 7, 5, 8, 9, off=-240)), ("2012-07-05T08:09:10+02:00[Europe/Berlin]", N, True, us(2012, 7, 5, 8, 9, 10, off=120)),
    ("2012-07-05 08:09:10 MESZ", N, True, us(2012, 7, 5, 8, 9, 10, off=120)), ("2012-07-05 08:09:10 Asia/Kolkata", N, True, us(2012, 7, 5, 8, 9, 10, off=330)),
    ("Fri, 01 Feb 2013 19:13:45 +0100", B, True, us(2013, 2, 1, 19, 13, 45, off=60)), ("Fri, 01 Feb 2013 19:13:45 GMT", B, True, us(2013, 2, 1, 19, 13, 45)),
    ("Dienstag, 11. September 2012", B, True, us(2012, 9, 11, tz=B)), ("3. Mrz. 2014", B, True, us(2014, 3, 3, tz=B)), ("10. April 2021 um 08:36 Uhr", B, True, us(2021, 4, 10, 8, 36, tz=B)),
    ("10. August 2021, 5.00 Uhr", B, True, us(2021, 8, 10, 5, 0, tz=B)), ("Stand: 31.10.2023 | 00:59 Uhr", B, True, us(2023, 10, 31, 0, 59, tz=B)),
    ("1.4.09", B, True, us(2009, 4, 1, tz=B)), ("04/05/2012", B, True, us(2012, 5, 4, tz=B)), ("04/05/2012", N, False, us(2012, 4, 5, tz=N)),
    ("1/14/2018 12:58 AM", N, False, us(2018, 1, 14, 0, 58, tz=N)), ("May 30, 2011", N, False, us(2011, 5, 30, tz=N)), ("March 4, 2022 12:50 pm", N, False, us(2022, 3, 4, 12, 50, tz=N)),
    ("20130112024814", B, True, us(2013, 1, 12, 2, 48, 14)), ("1236122841", B, True, 1236122841 * 10**6), ("1384926043019", B, True, 1384926043019 * 10**3),
    (" 2012-01-05 ", B, True, us(2012, 1, 5, tz=B)), ("2016-02-29", B, True, us(2016, 2, 29, tz=B)),
    # Twice, never, at the edges.
    ("2010-10-31 02:30", B, True, us(2010, 10, 31, 2, 30, off=120)), ("2010-03-28 02:30", B, True, us(2010, 3, 28, 2, 30, off=60)),
    ("2010-03-28 03:00", B, True, us(2010, 3, 28, 3, 0, off=120)), ("2010-10-31 03:00", B, True, us(2010, 10, 31, 3, 0, off=60)), ("2010-11-07 01:30", N, True, us(2010, 11, 7, 1, 30, off=-240)),
    # Centuries away, zones with digits, long epochs.
    ("2150-05-01 10:00", B, True, us(2150, 5, 1, 10, 0, tz=B)), ("2150-12-01 10:00", B, True, us(2150, 12, 1, 10, 0, tz=B)), ("1890-05-01", B, True, us(1890, 5, 1, tz=B)), ("0001-01-01 12:00", N, True, us(1, 1, 1, 12, tz=N)),
    ("1066-10-14 09:00", B, True, us(1066, 10, 14, 9, tz=B)), ("9998-07-01 00:00", B, True, us(9998, 7, 1, tz=B)), ("2650-03-27 02:30", B, True, us(2650, 3, 27, 2, 30, tz=B)), ("2501-01-01 00:30", N, True, us(2501, 1, 1, 0, 30, tz=N)),
    ("2012-07-05 08:09 Etc/GMT+5", B, True, us(2012, 7, 5, 8, 9, off=-300)), ("2012-07-05 08:09[Etc/GMT-14]", B, True, us(2012, 7, 5, 8, 9, off=840)), ("2012-07-05 08:09 EST5EDT", B, True, us(2012, 7, 5, 8, 9, off=-240)),
    ("12361228410", B, True, 12361228410 * 10**6), ("123612284100", B, True, 123612284100 * 10**3),
    *[(v, B, True, None) for v in ("", "  ", "--", "unbekannt", "2021-13-40", "31.02.2021", "30. Februar 2019", "heute, 25:70 Uhr", "n/a", "1. Quartal", "2015-02-29", "2012-01-05 24:00", "2012-01-05 08:09 XYZ", "20131312024814", None, "x" * 100_000)],
    ("2012-01-05", None, True, None), ("2012-01-05", "Nowhere/Atall", True, None), ("2012-01-05T00:00:00Z", None, True, us(2012, 1, 5)),
]


def test_formats_zones_and_clock_changes(spark):
    rows = [(k, v, z, d) for k, (v, z, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "c0 int, value string, zone string, spans boolean")  # names the operator uses itself
    got = {r.c0: r.utc_us for r in resolve_instants(df, "value", F.col("zone"), F.col("spans")).collect()}
    assert [(CASES[k][0], got[k]) for k in got if got[k] != CASES[k][3]] == []


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "UTC", "Australia/Lord_Howe", "Pacific/Apia"])
def test_intervals_agree_with_the_zone_database(zone):
    spans = zone_intervals(zone)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for a, b, off in spans[::7]:
        for t in (a, (a + b) // 2, b - 1_000_000):
            local = datetime.fromtimestamp(t // 1_000_000, timezone.utc).astimezone(ZoneInfo(zone))
            assert local.utcoffset() == timedelta(microseconds=off)


def test_the_zone_of_the_session_does_not_matter(spark):
    df = spark.createDataFrame([("2012-12-31 23:30", B), ("2012-01-01 00:10", N)], "value string, zone string")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
    try:
        assert [r.utc_us for r in resolve_instants(df, "value", F.col("zone"), F.lit(True)).collect()] == [us(2012, 12, 31, 23, 30, tz=B), us(2012, 1, 1, 0, 10, tz=N)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_header_rows_nulls_duplicates_and_empty_tables(spark):
    sites = spark.createDataFrame([("a", B, "DMY"), ("a", B, "DMY"), ("b", N, "MDY"), ("c", None, None)], "site string, time_zone string, date_order string")
    header = spark.createDataFrame(
        [(1, "a", "2012-01-05", None, "x"), (2, "b", "04/05/2012", "TBA", "x"), (2, "b", "04/05/2012", "TBA", "x"), (3, "c", "2012-01-05", "1236122841", "x"), (4, None, "2012-01-05", None, "x"), (5, "zz", None, "2012-01-05Z", "x")],
        "header_id long, site string, crawl_date string, publication_date string, time_zone string",
    )
    got = sorted(map(tuple, header_instants(header, sites).collect()))
    assert got == sorted([(1, "crawl_date", us(2012, 1, 5, tz=B)), (2, "crawl_date", us(2012, 4, 5, tz=N)), (2, "crawl_date", us(2012, 4, 5, tz=N)), (3, "publication_date", 1236122841 * 10**6), (5, "publication_date", us(2012, 1, 5))])
    assert header_instants(header.limit(0), sites).count() == 0
    assert header_instants(header, sites.limit(0)).count() == 2
