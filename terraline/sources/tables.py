"""Readers: price bars, GeoJSON features, street graphs kept by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "array<double>"


def bars(spark: SparkSession, path: str, ticker: str, interval: str, start: str, end: str) -> DataFrame:
    """Bars of [start, end); stored by ticker and interval, so the filter prunes folders and row groups."""
    df = spark.read.parquet(path).where((F.col("ticker") == ticker) & (F.col("interval") == interval))
    return df.where((F.col("ts") >= F.to_timestamp(F.lit(start))) & (F.col("ts") < F.to_timestamp(F.lit(end)))).select("ticker", "interval", "ts", "close")


def isochrones(texts: DataFrame, text: str = "value", marker: str | None = None) -> DataFrame:
    """(orig_idx, minutes, rings) of the polygons in GeoJSON feature collections; a multipolygon gives all its rings. The
    marker is a feature's own property or the column ``marker`` of the texts."""
    prop = "properties struct<value: double, original_index: int>"
    one = F.from_json(text, f"features array<struct<geometry struct<type: string, coordinates: array<array<{_POINT}>>>, {prop}>>".replace("geometry struct", "geometry: struct").replace("properties struct", "properties: struct"))
    many = F.from_json(text, f"features array<struct<geometry: struct<type: string, coordinates: array<array<array<{_POINT}>>>>, {prop.replace('properties struct', 'properties: struct')}>>")
    rings = lambda r: F.transform(r, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    of = [F.col(marker).alias("_marker")] if marker else []
    a = texts.select(*of, F.explode(one["features"]).alias("f")).where("f.geometry.type = 'Polygon'").select("*", "f.properties.*", rings(F.col("f.geometry.coordinates")).alias("rings"))
    b = texts.select(*of, F.explode(many["features"]).alias("f")).where("f.geometry.type = 'MultiPolygon'").select("*", "f.properties.*", rings(F.flatten("f.geometry.coordinates")).alias("rings"))
    both = a.drop("f").unionByName(b.drop("f"))
    return both.select(F.col("_marker" if marker else "original_index").alias("orig_idx"), (F.col("value") / 60).alias("minutes"), "rings")


def graph_key(south: Column, west: Column, north: Column, east: Column, network: Column) -> Column:
    """The folder of a street graph: md5 of the bounds at three decimals and the network's kind."""
    return F.md5(F.concat_ws("_", *[F.format_string("%.3f", c) for c in (west, south, east, north)], network))


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, key: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/{key}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/{key}/edges")


def load_graph(spark: SparkSession, folder: str, key: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{key}/nodes"), spark.read.parquet(f"{folder}/{key}/edges")
