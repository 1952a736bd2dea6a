"""Mixed timestamp texts to one UTC instant.

A value is parsed in the JVM to its wall-clock microseconds and, if it names one, its zone. Values without
an offset of their own are resolved by an as-of join against zone-offset intervals, exploded to one row per
zone and local year: two intervals that hold the wall time mean it happened twice (the first one counts),
none means the clocks skipped it (the interval that ended last gives the offset, which moves the time forward
by the skipped span), one gives the offset directly.

Years: all from 1 to 9999. The first interval of a zone reaches back without end. Rules of zones repeat with the
calendar, every 400 years, so a year after ``LAST_YEAR`` has the intervals of the same year of the last 400 listed.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingualoom.session import bounded_broadcast

#: Years whose intervals are listed: before the first no zone has changed, and the last 400 stand for all later ones.
FIRST_YEAR, LAST_YEAR = 1800, 2500
MAX_SITES = 200_000
_CYCLE_DAYS, _ENDLESS = 146_097, 2**62
_DAY, _HOUR, _MINUTE, _SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000

#: Offsets in minutes of the zone abbreviations that pages print.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "OEZ": 120, "EEST": 180, "OESZ": 180, "MSK": 180, "IST": 330, "JST": 540,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

#: Month names and their short forms in German and English, lower case.
MONTHS = {
    "januar": 1, "jänner": 1, "january": 1, "jan": 1, "februar": 2, "february": 2, "feb": 2, "märz": 3, "march": 3, "mrz": 3, "mär": 3, "mar": 3,
    "april": 4, "apr": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "jun": 6, "juli": 7, "july": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9, "oktober": 10, "october": 10, "okt": 10, "oct": 10, "november": 11, "nov": 11,
    "dezember": 12, "december": 12, "dez": 12, "dec": 12,
}

_TIME = r"(\d{1,2})[:.](\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*(?:Uhr|([AaPp])\.?[Mm]\.?))?"
_ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3}\d[A-Z]{3}|[A-Z]{2,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?(?:\[([^\]]+)\])?"


def _shape(date: str, gap: str, fields: str, first: int) -> tuple[str, str]:
    tail = "|".join(f"${first + k}" for k in range(7))
    return f"^{date}(?:{gap}{_TIME})?{_ZONE}$", f"{fields}|{tail}"


_SHAPES = {
    "iso": _shape(r"(\d{4})-(\d{1,2})-(\d{1,2})", r"[T\s]\s*", "$1|$2|$3", 4),
    "dots": _shape(r"(?:\p{L}+:\s*)?(?:\p{L}+,\s*)?(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4}|\d{2})", r"(?:\s*[,|]\s*|\s+)(?:um\s+)?", "$3|$2|$1", 4),
    "slash": _shape(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", r",?\s+", "$3|$1|$2", 4),
    "day_name": _shape(r"(?:\p{L}+\.?,\s*)?(\d{1,2})\.?\s+(\p{L}+)\.?,?\s+(\d{4})", r"(?:\s*[,|]\s*|\s+)(?:um\s+)?", "$3|$2|$1", 4),
    "name_day": _shape(r"(?:\p{L}+\.?,\s*)?(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", r"(?:\s*,\s*|\s+)(?:at\s+)?", "$3|$1|$2", 4),
}


def _int(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c).try_cast("long")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a proleptic Gregorian date, by arithmetic only, so nothing can raise."""
    a = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(a / 400)
    yoe = a - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def parse_wall_time(df: DataFrame, value: str, day_first: Column) -> DataFrame:
    """Add ``epoch_us`` (values that are instants by themselves), ``wall_us``, ``offset_min`` and ``zone_name``.

    ``day_first``: whether slashes mean day before month. What is no date gets nulls in all four.
    """
    text = F.regexp_replace(F.regexp_replace(value, r"[\s\u00a0\u202f]+", " "), r"^ | $", "")
    out = df.withColumn("_t", text)
    t = F.col("_t")
    shaped = F.lit(None).cast("string")
    for name, (pattern, form) in reversed(_SHAPES.items()):
        shaped = F.when(t.rlike(pattern), F.concat(F.lit(name + "|"), F.regexp_replace(t, pattern, form))).otherwise(shaped)
    digits = F.when(t.rlike(r"^\d{14}$"), F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "iso|$1|$2|$3|$4|$5|$6|||Z|"))
    plain = t.rlike(r"^\d{9,13}$")
    out = out.withColumn("_f", F.when(t.rlike(r"^\d+$"), digits).otherwise(F.split(shaped, "x^").getItem(0)))
    out = out.withColumn("_f", F.split("_f", r"\|", -1))
    f = lambda k: F.col("_f").getItem(k)
    name = F.lower(F.when(f(0) == "day_name", f(2)).when(f(0) == "name_day", f(2)))
    swap = (f(0) == "slash") & day_first
    out = out.select(
        "*",
        _int(f(1)).alias("_y0"),
        F.when(f(0).isin("day_name", "name_day"), _lookup(MONTHS)[name].cast("long")).when(swap, _int(f(3))).otherwise(_int(f(2))).alias("_m"),
        F.when(swap, _int(f(2))).otherwise(_int(f(3))).alias("_d"),
        F.coalesce(_int(f(4)), F.lit(0)).alias("_h0"),
        F.coalesce(_int(f(5)), F.lit(0)).alias("_mi"),
        F.coalesce(_int(f(6)), F.lit(0)).alias("_s"),
        F.coalesce(_int(F.substring(F.rpad(f(7), 6, "0"), 1, 6)), F.lit(0)).alias("_us"),
        F.lower(f(8)).alias("_half"),
        F.coalesce(f(9), F.lit("")).alias("_z"),
        F.coalesce(f(10), F.lit("")).alias("_b"),
    )
    c = F.col
    y = F.when((c("_y0") < 100) & (F.length(f(1)) <= 2), c("_y0") + 2000).otherwise(c("_y0"))
    half = c("_half")
    h = F.when(half == "p", c("_h0") % 12 + 12).when(half == "a", c("_h0") % 12).otherwise(c("_h0"))
    fits = F.when(half.isin("a", "p"), c("_h0").between(1, 12)).otherwise(c("_h0") <= 23)
    real = (
        y.between(1, 9999) & c("_m").between(1, 12) & (c("_d") >= 1) & (c("_d") <= _month_length(y, c("_m")))
        & fits & (c("_mi") <= 59) & (c("_s") <= 59)
    )
    wall = _days(y, c("_m"), c("_d")) * _DAY + h * _HOUR + c("_mi") * _MINUTE + c("_s") * _SECOND + c("_us")
    sign = F.when(c("_z").startswith("-"), -1).otherwise(1)
    signed = c("_z").rlike("^[+-]")
    bare = F.regexp_replace("_z", "[^0-9]", "")
    minutes = sign * (_int(F.substring(bare, 1, 2)) * 60 + F.coalesce(_int(F.substring(bare, 3, 2)), F.lit(0)))
    named = F.when(c("_z").rlike("[/0-9]") & ~signed, c("_z")).when((c("_z") == "") & (c("_b") != ""), c("_b"))
    offset = F.when(signed, minutes).when((c("_z") != "") & named.isNull(), _lookup(ABBREVIATIONS)[c("_z")].cast("long"))
    known = (c("_z") == "") | signed | named.isNotNull() | offset.isNotNull()
    wall = F.when(real & known, wall)
    number = t.try_cast("long")
    return (
        out.withColumn("epoch_us", F.when(plain, F.when(F.length(t) <= 11, number * 1_000_000).otherwise(number * 1_000)))
        .withColumn("wall_us", wall)
        .withColumn("offset_min", F.when(c("wall_us").isNotNull(), offset))
        .withColumn("zone_name", F.when(c("wall_us").isNotNull() & c("offset_min").isNull(), named))
        .drop("_t", "_f", "_y0", "_m", "_d", "_h0", "_mi", "_s", "_us", "_half", "_z", "_b")
    )


@lru_cache(maxsize=1024)
def zone_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(start, end, offset) in microseconds of UTC for ``zone``, over all years of the table, in order."""
    tz = ZoneInfo(zone)
    offset = lambda us: int(datetime.fromtimestamp(us // _SECOND, timezone.utc).astimezone(tz).utcoffset() / timedelta(microseconds=1))
    low = int(datetime(FIRST_YEAR - 1, 12, 1, tzinfo=timezone.utc).timestamp()) * _SECOND
    high = int(datetime(LAST_YEAR + 1, 2, 1, tzinfo=timezone.utc).timestamp()) * _SECOND
    step = 14 * _DAY
    found, start, now = [], low, offset(low)
    at = low
    while at < high:
        after = min(at + step, high)
        if offset(after) != now:
            a, b = at, after
            while b - a > _SECOND:
                mid = (a + b) // 2 // _SECOND * _SECOND
                mid = mid if mid > a else a + _SECOND
                if mid >= b:
                    break
                a, b = (a, mid) if offset(mid) != now else (mid, b)
            found.append((start, b, now))
            start, now, at = b, offset(b), b
        else:
            at = after
    return (*found, (start, high, now))


def _year_of(us: int) -> int:
    return (datetime(1970, 1, 1) + timedelta(microseconds=us)).year


@lru_cache(maxsize=1024)
def _zone_rows(zone: str) -> tuple[tuple, ...]:
    by_year: dict[int, list[tuple[int, int, int]]] = {}
    spans = [(a + off, b + off, off) for a, b, off in zone_intervals(zone)]
    # The first one has no beginning; what it began with stands for all years before.
    spans[0] = (-_ENDLESS, *spans[0][1:])
    for k, span in enumerate(spans):
        until = max(_year_of(span[1] - 1), _year_of(spans[k + 1][0]) if k + 1 < len(spans) else 0)
        for year in range(FIRST_YEAR if k == 0 else max(FIRST_YEAR, _year_of(span[0])), min(LAST_YEAR, until) + 1):
            by_year.setdefault(year, []).append(span)
    return tuple((zone, year, rows) for year, rows in sorted(by_year.items()))


_INTERVALS = T.StructType([
    T.StructField("tz", T.StringType()), T.StructField("local_year", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("off", T.LongType())]))),
])


def resolve_instants(values: DataFrame, value: str, zone: Column, day_first: Column, out: str = "utc_us") -> DataFrame:
    """``values`` with a column ``out``: the UTC microseconds ``value`` means, null if it means none.

    Defined results: nulls, blanks, words and impossible dates give null; numbers of 9 to 11 digits are seconds, of 12 and 13
    milliseconds; an unknown zone name, or no zone at
    all where one is needed, gives null; leading and trailing blanks do not count; repeated rows stay repeated;
    an empty table stays empty; other columns are kept, whatever their names.
    """
    spark = values.sparkSession
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(values.columns)]
    kept = values.select(*own, F.col(f"`{value}`").alias("_value"), zone.alias("_site_zone"), F.coalesce(day_first, F.lit(True)).alias("_dmy"))
    parsed = parse_wall_time(kept, "_value", F.col("_dmy"))
    parsed = parsed.withColumn("_tz", F.when(F.col("wall_us").isNotNull() & F.col("offset_min").isNull(), F.coalesce("zone_name", "_site_zone")))
    # Of zone names there are fewer than 700 in all, so what comes to the driver is bounded by the zone database.
    # They are looked for before parsing, which would have to be done twice otherwise.
    named = kept.select(F.explode(F.array("_site_zone", F.regexp_extract("_value", r"([A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)*|[A-Z]{3}\d[A-Z]{3})\]?\s*$", 1))).alias("z"))
    everything = available_timezones()
    names = sorted(r.z for r in named.filter(F.col("z").isin(*everything)).distinct().collect())
    rows = [r for z in names for r in _zone_rows(z)]
    intervals = F.broadcast(spark.createDataFrame(rows, _INTERVALS))
    # By the day alone, so that the zone of the session does not matter.
    year = F.year(F.date_from_unix_date(F.floor(F.col("wall_us") / _DAY).cast("int")))
    cycles = F.greatest(F.ceil((year - LAST_YEAR) / 400), F.lit(0))
    parsed = parsed.withColumn("_back", cycles * _CYCLE_DAYS * _DAY)
    same = F.greatest(year - 400 * cycles, F.lit(FIRST_YEAR)).cast("int")
    joined = parsed.withColumn("_year", F.when(F.col("_tz").isNotNull(), same)).join(intervals, (F.col("_tz") == F.col("tz")) & (F.col("_year") == F.col("local_year")), "left")
    wall = F.col("wall_us")
    listed = wall - F.col("_back")
    hits = F.filter("spans", lambda s: (s.a <= listed) & (listed < s.b))
    ended = F.filter("spans", lambda s: s.b <= listed)
    # The first of two hits is the earlier interval; without any, the last that ended.
    span = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))).otherwise(F.get(ended, F.size(ended) - 1))
    instant = F.coalesce("epoch_us", wall - F.col("offset_min") * _MINUTE, wall - span.off)
    return joined.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(values.columns)], instant.alias(out))


def header_instants(header: DataFrame, sites: DataFrame, fields: tuple[str, ...] = ("crawl_date", "publication_date")) -> DataFrame:
    """(header_id, field, utc_us): one row per header row and date field that means a point in time.

    The site's zone and order of day and month come from ``sites``. A site that is missing there, or has no
    zone, leaves values without an offset unresolved; of a site listed twice one row counts.
    """
    own = sites.groupBy("site").agg(F.min(F.struct("time_zone", "date_order")).alias("_s")).select(F.col("site").alias("_site"), "_s.time_zone", "_s.date_order")
    long = header.select("header_id", "site", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x"))
    long = long.select("header_id", "site", "x.field", F.col("x.v").alias("value")).filter(F.col("value").isNotNull())
    long = long.join(bounded_broadcast(own, MAX_SITES), F.col("site") == F.col("_site"), "left")
    found = resolve_instants(long, "value", F.col("time_zone"), F.coalesce(F.col("date_order") != "MDY", F.lit(True)))
    return found.filter(F.col("utc_us").isNotNull()).select("header_id", "field", "utc_us")
