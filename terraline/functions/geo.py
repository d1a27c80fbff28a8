"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in metres, and kilometres in a degree of latitude and, at the equator, of longitude.
EARTH_M = 6_371_000.0
KM_PER_DEGREE_LAT, KM_PER_DEGREE_LON = 110.574, 111.320


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000


def degrees_of_longitude(lat: Column, radius_km: Column | float) -> Column:
    """Degrees east or west of a place at ``lat`` that nothing within the radius is beyond; 180 where a pole is within."""
    radius = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    share = F.sin(radius * 1000 / EARTH_M) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    return F.when(share < 1, F.degrees(F.asin(F.least(F.lit(1.0), share))) * (1 + 1e-9)).otherwise(F.lit(180.0))


def circle(lat: Column, lon: Column, radius_km: Column, points: int = 73) -> Column:
    """array<struct<lon, lat>> of a closed ring."""
    dlat = radius_km / KM_PER_DEGREE_LAT
    dlon = radius_km / (KM_PER_DEGREE_LON * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct((lon + dlon * F.cos(i * (2 * 3.141592653589793 / (points - 1)))).alias("lon"), (lat + dlat * F.sin(i * (2 * 3.141592653589793 / (points - 1)))).alias("lat")),
    )


def _shoelace(ring: Column) -> Column:
    """Sum of cross products of consecutive (lon, lat) points; twice the signed area in square degrees."""
    following = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    crossed = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), following, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return F.aggregate(crossed, F.lit(0.0), lambda s, x: s + x)


def area_km2(ring: Column, lat: Column) -> Column:
    """Planar area of a closed ring, scaled at ``lat``."""
    return F.abs(_shoelace(ring)) / 2 * KM_PER_DEGREE_LAT * KM_PER_DEGREE_LON * F.cos(F.radians(lat))


def inside(rings: Column, lat: Column, lon: Column) -> Column:
    """Whether a place lies in a polygon (array of rings of struct lon, lat), by the even-odd rule over all its rings, so holes
    are outside. A place on a southern or western edge is in, on a northern or eastern one it is not."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        crossed = F.filter(edges, lambda e: ((e["p"]["lat"] > lat) != (e["q"]["lat"] > lat)) & (lon < (e["q"]["lon"] - e["p"]["lon"]) * (lat - e["p"]["lat"]) / F.nullif(e["q"]["lat"] - e["p"]["lat"], F.lit(0.0)) + e["p"]["lon"]))
        return F.size(crossed)

    known = F.filter(rings, lambda r: F.size(r) > 1)
    return F.aggregate(F.transform(known, crossings), F.lit(0), lambda s, k: s + k) % 2 == 1


def travel_bucket(minutes: Column) -> Column:
    """Step 1 to 4 of a travel time: up to 10, 20, 30 minutes, beyond."""
    return F.when(minutes <= 10, "step1").when(minutes <= 20, "step2").when(minutes <= 30, "step3").otherwise("step4")


def border_colour(index: Column, palette: list[str], fallback: str = "#3388ff") -> Column:
    colours = F.array(*map(F.lit, palette))
    return F.when(index.isNull(), fallback).otherwise(F.element_at(colours, F.pmod(index, F.lit(len(palette))).cast("int") + 1))
