"""Names, paths and hashes of files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_archive(url: Column) -> Column:
    """The address itself, without the prefix of a web archive."""
    return F.regexp_replace(url, r"^\w+://[\w.-]+/web/\d+/", "")


def site_folder(url: Column) -> Column:
    """Folder of a site: its host, always with ``www.``."""
    host = F.regexp_extract(_absolute(url), r"^[A-Za-z]+://([^/?#]*)", 1)
    return F.when(host.startswith("www."), host).otherwise(F.concat(F.lit("www."), host))


def file_name(url: Column) -> Column:
    """File of a page: host and path with ``__`` for slashes and ``.html`` at the end; query and fragment go."""
    full = _absolute(url)
    where = F.concat(F.regexp_extract(full, r"^[A-Za-z]+://([^/?#]*)", 1), F.regexp_extract(full, r"^[A-Za-z]+://[^/?#]*([^?#;]*)", 1))
    name = F.replace(where, F.lit("/"), F.lit("__"))
    name = F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html")))
    return F.regexp_replace(F.replace(name, F.lit("__.html"), F.lit(".html")), r"^www\.", "")


def _absolute(url: Column) -> Column:
    own = without_archive(url)
    return F.when(own.startswith("http"), own).otherwise(F.concat(F.lit("https://"), own))


def absolute(url: Column, base: Column) -> Column:
    """``url`` under ``base`` unless it is a full address already."""
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    return F.when(url.rlike(r"^[A-Za-z]+://"), url).when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(root, url)).otherwise(
        F.concat(F.regexp_replace(base, r"[^/]*$", ""), url)
    )


def until_semicolon(url: Column) -> Column:
    """The address without a session id."""
    return F.substring_index(url, ";", 1)


def pair_hash(simple: Column, standard: Column) -> Column:
    """Key of a pair of files, whatever their folder."""
    return F.sha1(F.concat(simple, F.lit(".txt___"), standard, F.lit(".txt")))


def decimal_digest(text: Column) -> Column:
    """SHA-1 as a decimal number in text; it is wider than any number type."""
    # Long division of 40 hex digits, ten at a time, in decimals of 20 digits that cannot overflow.
    chunks = [F.conv(F.substring(F.sha1(text), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(5)]
    base, low = F.lit(4294967296).cast("decimal(20,0)"), F.lit(10**12).cast("decimal(20,0)")
    digits = [F.lit(0).cast("decimal(38,0)") for _ in range(5)]
    for c in chunks:
        carry, out = c, []
        for d in digits:
            v = (d * base + carry).cast("decimal(38,0)")
            out.append((v % low).cast("decimal(38,0)"))
            carry = F.floor(v / low).cast("decimal(38,0)")
        digits = out
    whole = F.concat(*[F.lpad(d.cast("string"), 12, "0") for d in reversed(digits)])
    return F.when(F.ltrim(whole, F.lit("0")) == "", "0").otherwise(F.ltrim(whole, F.lit("0")))


def matches_path(root: str, key: Column, measure: Column, strategy: Column, sd: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), key, F.lit("--"), measure, F.lit("--"), strategy, F.lit("--"), F.format_string("%.1f", sd), F.lit(".matches"))


def site_path(site: Column, stage: str, name: Column) -> Column:
    """Path of a page's file at a stage (``crawled`` or ``parsed``)."""
    return F.concat_ws("/", site, F.lit(stage), F.concat(name, F.lit(".txt")) if stage == "parsed" else name)


def in_section(url: Column, section: str) -> Column:
    """Whether an address lies in a section of its site and is no menu of downloads."""
    return F.contains(url, F.lit(section)) & ~F.contains(url, F.lit("index.php?menuid="))
