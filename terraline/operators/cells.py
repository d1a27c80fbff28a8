"""Polygon algebra over grid cells: approximate areas whose error falls with the cell size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraline.functions import geo


def disc_cells(discs: DataFrame, cell_deg: float = 0.001) -> DataFrame:
    """(id, cy, cx) of the cells whose centre lies in each disc (id, lat, lon, radius_km), at any latitude and across the
    date line, where cells count on from the other side."""
    dy = F.degrees(F.col("radius_km") * 1000 / geo.EARTH_M) / cell_deg
    dx = geo.degrees_of_longitude(F.least(F.lit(90.0), F.abs("lat") + F.degrees(F.col("radius_km") * 1000 / geo.EARTH_M)), F.col("radius_km")) / cell_deg
    span = lambda c, d: F.sequence(F.floor(F.col(c) / cell_deg - d), F.floor(F.col(c) / cell_deg + d))
    around = round(360 / cell_deg)
    cells = discs.withColumn("cy", F.explode(span("lat", dy))).withColumn("cx", F.explode(span("lon", dx)))
    centre = lambda c: (F.col(c) + F.lit(0.5)) * cell_deg
    inside = cells.where((F.abs(centre("cy")) <= 90) & (geo.haversine_km(F.col("lat"), F.col("lon"), centre("cy"), centre("cx")) <= F.col("radius_km")))
    return inside.select("id", "cy", (F.pmod(F.col("cx") + around // 2, F.lit(around)) - around // 2).alias("cx")).distinct()


def polygon_cells(polygons: DataFrame, cell_deg: float = 0.001) -> DataFrame:
    """(id, cy, cx) of the cells whose centre lies inside polygons (id, rings: array of rings of struct<lon, lat>), by
    the even-odd rule over all rings, so holes are outside."""
    points = F.flatten("rings")
    ends = lambda c: (F.array_min(F.transform(points, lambda p: p[c])), F.array_max(F.transform(points, lambda p: p[c])))
    span = lambda c: F.sequence(*[F.floor(e / cell_deg) for e in ends(c)])
    cells = polygons.withColumn("cy", F.explode(span("lat"))).withColumn("cx", F.explode(span("lon")))
    y, x = (F.col("cy") + F.lit(0.5)) * cell_deg, (F.col("cx") + F.lit(0.5)) * cell_deg
    return cells.where(geo.inside(F.col("rings"), y, x)).select("id", "cy", "cx")


def union(cells: DataFrame) -> DataFrame:
    return cells.select("cy", "cx").distinct()


def intersection(cells: DataFrame, n: int) -> DataFrame:
    """Cells that all ``n`` ids have; none if n is under 2."""
    return cells.groupBy("cy", "cx").agg(F.count_distinct("id").alias("_n")).where((F.col("_n") == n) & F.lit(n >= 2)).select("cy", "cx")


def area_km2(cells: DataFrame, cell_deg: float = 0.001) -> DataFrame:
    """One row (n_cells, area_km2, lat, lon): the cells' area and centroid. Cells on both sides of the date line, over half
    the globe apart by their numbers, have their mean across it."""
    lat, lon = (F.col("cy") + F.lit(0.5)) * cell_deg, (F.col("cx") + F.lit(0.5)) * cell_deg
    one = F.lit(geo.KM_PER_DEGREE_LAT * geo.KM_PER_DEGREE_LON * cell_deg * cell_deg) * F.cos(F.radians(lat))
    east = F.avg(F.when(lon < 0, lon + 360).otherwise(lon))
    mean = F.when(F.max(lon) - F.min(lon) <= 180, F.avg(lon)).otherwise(F.when(east > 180, east - 360).otherwise(east))
    return cells.agg(F.count("*").alias("n_cells"), F.sum(one).alias("area_km2"), F.avg(lat).alias("lat"), mean.alias("lon"))
