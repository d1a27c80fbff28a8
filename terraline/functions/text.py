"""Parsing of requests, locators, coordinates and map files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: day, month, year, time and ticker, with / or - in the date and a comma or blank between parts.
REQUEST = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s*[,\s]\s*(\d{1,2}):(\d{2}):(\d{2})\s*[,\s]\s*([A-Za-z0-9.\-^=]+)\s*$"


def parse_requests(requests: DataFrame, raw: str = "raw", zone: str = "Asia/Bangkok") -> DataFrame:
    """Adds ts_utc, ticker, stamp and status ("ok" or "invalid"); dates that don't exist are invalid."""
    part = lambda k: F.regexp_extract(raw, REQUEST, k)
    num = lambda k: F.expr(f"try_cast(regexp_extract({raw}, r'{REQUEST}', {k}) as int)")
    local = F.try_make_timestamp_ntz(num(3), num(1) * 0 + num(2), num(1), num(4), num(5), num(6).cast("decimal(8,6)"))
    stamp = F.concat(F.lpad(part(1), 2, "0"), F.lit("/"), F.lpad(part(2), 2, "0"), F.lit("/"), part(3), F.lit(","), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), part(6), F.lit(","), F.upper(part(7)))
    known = F.col("_local").isNotNull()
    out = requests.withColumn("_local", local)
    return out.withColumns({"ts_utc": F.to_utc_timestamp(F.col("_local").cast("timestamp"), zone), "ticker": F.when(known, F.upper(part(7))), "stamp": F.when(known, stamp), "status": F.when(known, "ok").otherwise("invalid")}).drop("_local")


def coordinates(text: Column) -> Column:
    """array<struct<lon, lat>> of "lon,lat[,alt]" tokens; malformed ones are dropped."""
    tokens = F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.split(t, ","))
    points = F.transform(tokens, lambda p: F.when(F.size(p) >= 2, F.struct(p[0].try_cast("double").alias("lon"), p[1].try_cast("double").alias("lat"))))
    return F.filter(points, lambda p: p.isNotNull() & p["lon"].isNotNull() & p["lat"].isNotNull())


def kml_shapes(files: DataFrame, text: str = "value") -> DataFrame:
    """(the files' other columns, kind, points): lines of 2 points or more and outer rings of 4 or more."""
    line = F.xpath(text, F.lit('//*[local-name()="LineString"]/*[local-name()="coordinates"]/text()'))
    ring = F.xpath(text, F.lit('//*[local-name()="Polygon"]/*[local-name()="outerBoundaryIs"]/*[local-name()="LinearRing"]/*[local-name()="coordinates"]/text()'))
    kinds = F.concat(F.transform(line, lambda c: F.struct(F.lit("LineString").alias("kind"), c.alias("c"))), F.transform(ring, lambda c: F.struct(F.lit("Polygon").alias("kind"), c.alias("c"))))
    rest = [c for c in files.columns if c != text]
    shapes = files.select(*rest, F.explode(kinds).alias("s")).select(*rest, "s.kind", coordinates(F.col("s.c")).alias("points"))
    return shapes.where(F.size("points") >= F.when(F.col("kind") == "Polygon", 4).otherwise(2))


def locator(text: Column) -> Column:
    """struct<kind, url> of a repository locator. A web address is raw as it is, but one of a file's page becomes raw and
    any other page of the site is to be browsed. owner/repo/path@ref (master without a ref, branches without their
    prefix) is raw for a .json file, else a listing; less than owner and repo is nothing."""
    t = F.trim(text)
    blob = r"^https?://github\.com/([^/?#]+)/([^/?#]+)/(?:[^?#]*?/)?blob/([^/?#]+)/([^?#]+)"
    g = lambda p, k: F.regexp_extract(t, p, k)
    left = F.split_part(t, F.lit("@"), F.lit(1))
    ref = F.when(t.contains("@") & (F.length(left) < F.length(t) - 1), F.replace(F.substring(t, F.length(left) + 2, F.length(t)), F.lit("refs/heads/"), F.lit(""))).otherwise("master")
    parts = F.filter(F.split(left, "/"), lambda s: s != "")
    path = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    raw = lambda o, r, b, p: F.concat(F.lit("https://raw.githubusercontent.com/"), o, F.lit("/"), r, F.lit("/"), b, F.lit("/"), p)
    s = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    return (
        F.when(t.rlike("^https?://") & t.contains("raw.githubusercontent.com"), s("raw", t))
        .when(t.rlike(blob), s("raw", raw(g(blob, 1), g(blob, 2), g(blob, 3), g(blob, 4))))
        .when(t.rlike("^https?://") & t.contains("github.com"), s("browse", t))
        .when(t.rlike("^https?://"), s("raw", t))
        .when(F.size(parts) >= 2, F.when(path.endswith(".json"), s("raw", raw(parts[0], parts[1], ref, path))).otherwise(s("api", listing_url(parts[0], parts[1], path, ref))))
    )


def listing_url(owner: Column, repo: Column, path: Column, ref: Column) -> Column:
    return F.concat(F.lit("https://api.github.com/repos/"), owner, F.lit("/"), repo, F.lit("/contents/"), path, F.lit("?ref="), ref)


def browse_listing(url: Column) -> Column:
    """The listing behind a page of a repository: of a folder's page its own, of any other the root of master."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"[?#].*$", ""), "/"), lambda s: s != "")
    at = F.array_position(parts, "tree").cast("int")
    below = F.array_join(F.slice(parts, F.greatest(at + 2, F.lit(1)), F.greatest(F.size(parts) - at - 1, F.lit(0))), "/")
    ref = F.get(parts, at)
    return F.when((at > 0) & ref.isNotNull(), listing_url(parts[0], parts[1], below, ref)).when(F.size(parts) >= 2, listing_url(parts[0], parts[1], F.lit(""), F.lit("master")))


#: How a moment is written in a price answer, a kept bundle, an export and a file's name.
STAMPS = {"price": "yyyy-MM-dd HH:mm:ss", "bundle": "yyyy-MM-dd'T'HH:mm:ss'Z'", "export": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "file": "yyyyMMdd_HHmmss"}


def stamp(at: Column, kind: str) -> Column:
    """A moment as text, in the session's time zone; a null one gives null. An export leaves out a fraction that is 0."""
    said = F.date_format(at, STAMPS[kind])
    return F.regexp_replace(said, r"\.000000Z$", "Z") if kind == "export" else said


def requested_ranges(minutes: Column) -> Column:
    """An array of minutes as a request's seconds, ascending, joined by commas; nulls are left out."""
    seconds = F.transform(F.array_sort(F.filter(minutes, lambda m: m.isNotNull())), lambda m: (m * 60).cast("string"))
    return F.array_join(seconds, ",")
