"""The layers of a street network: roads by betweenness, crossings by closeness, the top node and the golden spots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraline.functions import geo
from terraline.functions.rent import ramp_colour
from terraline.operators import graph
from terraline.session import written
from terraline.sources import tables

#: The network's kind by travel mode, widths of roads and sizes of crossings, and the sizes from which
#: betweenness and closeness are sampled.
NETWORK_OF = {"drive": "drive", "walk": "walk", "bicycle": "bike", "transit": "drive"}
ROAD_WIDTH, CROSSING_SIZE = (2.0, 4.0), (2.0, 6.0)
SAMPLED_BETWEENNESS, SAMPLED_CLOSENESS = 2000, 3000


@dataclass(frozen=True)
class Layers:
    """``roads`` (src, dst, betweenness, stroke_weight, colour, line), ``crossings`` (node, lat, lon, closeness, radius),
    ``top`` (node, lat, lon, closeness), ``golden`` (rank, node, lat, lon, ...), ``stats`` (one row), and the whole
    ``closeness`` and ``betweenness`` tables."""

    roads: DataFrame
    crossings: DataFrame
    top: DataFrame
    golden: DataFrame
    stats: DataFrame
    closeness: DataFrame
    betweenness: DataFrame


def over_most(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``column`` over its most; 0 where that is 0."""
    most = df.agg(F.max(column).alias("_most"))
    return df.join(F.broadcast(most)).withColumn(out, F.when(F.col("_most") > 0, F.col(column) / F.col("_most")).otherwise(0.0)).drop("_most")


def line_of(geometry: Column | None, from_: Column, to: Column) -> Column:
    """A road's own line (array of lon, lat), or the straight one between its ends (structs with lon, lat)."""
    straight = F.array(F.array(from_["lon"], from_["lat"]), F.array(to["lon"], to["lat"]))
    return straight if geometry is None else F.coalesce(geometry, straight)


def top_node(nodes: DataFrame, close: DataFrame) -> DataFrame:
    """(node, lat, lon, closeness): the node of the highest closeness, ties to the smaller one."""
    return nodes.withColumnRenamed("id", "node").join(close.select("node", "closeness"), "node").orderBy(F.desc("closeness"), "node").limit(1).select("node", "lat", "lon", "closeness")


def layers(nodes: DataFrame, edges: DataFrame, golden: int = 10) -> Layers:
    """Of nodes (id, lat, lon) and edges (src, dst, length, maybe geometry). The centralities are written once."""
    close = written(graph.closeness(edges, SAMPLED_CLOSENESS), "closeness")
    between = written(graph.edge_betweenness(edges, SAMPLED_BETWEENNESS), "betweenness")
    place = nodes.select(F.col("id").alias("node"), "lat", "lon")
    norm = over_most(between, "betweenness", "norm").select("a", "b", "norm")
    end = lambda c: place.select(F.col("node").alias(c), F.struct("lat", "lon").alias(f"_{c}"))
    roads = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(norm, ["a", "b"], "left").join(end("src"), "src").join(end("dst"), "dst")
    share = F.coalesce("norm", F.lit(0.0))
    line = line_of(F.col("geometry") if "geometry" in edges.columns else None, F.col("_src"), F.col("_dst"))
    roads = roads.select("src", "dst", share.alias("betweenness"), (ROAD_WIDTH[0] + share * ROAD_WIDTH[1]).alias("stroke_weight"), ramp_colour(share).alias("colour"), line.alias("line"))
    shown = over_most(place.join(close, "node", "left").fillna(0, ["closeness"]), "closeness", "norm").where("norm > 0")
    crossings = shown.select("node", "lat", "lon", F.col("norm").alias("closeness"), (CROSSING_SIZE[0] + F.col("norm") * CROSSING_SIZE[1]).alias("radius"))
    spots = graph.golden_spots(edges, close, between, golden).join(place, "node")
    n = nodes.count()
    method = close.agg(F.first("method").alias("closeness_method"))
    stats = edges.agg(F.count("*").alias("edges_count")).join(F.broadcast(method)).select(F.lit(n).cast("long").alias("nodes_count"), "edges_count", F.lit(n > SAMPLED_BETWEENNESS).alias("used_approximation"), "closeness_method", F.when(F.lit(n) < 2, "too few nodes").otherwise("ok").alias("status"))
    return Layers(roads, crossings, top_node(nodes, close), spots, stats, close, between)


def in_area(nodes: DataFrame, edges: DataFrame, areas: DataFrame, tile_deg: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) that lie in any of the areas (rings), and edges (src, dst) with both ends among them. Areas go
    to the tiles of their boxes, so a node meets only areas near it; a node without a place is in none."""
    points = F.flatten("rings")
    ends = lambda c: [F.floor(f(F.transform(points, lambda p: p[c])) / tile_deg) for f in (F.array_min, F.array_max)]
    tiles = areas.where(F.size(points) > 0).select("rings", F.explode(F.sequence(*ends("lat"))).alias("_ty"), F.sequence(*ends("lon")).alias("_txs")).withColumn("_tx", F.explode("_txs")).drop("_txs")
    placed = nodes.select("id", "lat", "lon", F.floor(F.col("lat") / tile_deg).alias("_ty"), F.floor(F.col("lon") / tile_deg).alias("_tx"))
    found = written(placed.join(tiles, ["_ty", "_tx"]).where(geo.inside(F.col("rings"), F.col("lat"), F.col("lon"))).select("id").distinct(), "nodes-in-area")
    both = edges.join(found.withColumnRenamed("id", "src"), "src", "left_semi").join(found.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(found, "id", "left_semi"), both.select(*edges.columns)


def graph_of_area(spark: SparkSession, folder: str, areas: DataFrame, network: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes and edges of the areas, and whether they were kept in ``folder`` already: by the areas' bounds and the network's
    kind. What isn't kept is cut from all nodes and edges and kept."""
    p = areas.select(F.explode(F.flatten("rings")).alias("p"))
    box = p.agg(F.min("p.lat").alias("s"), F.min("p.lon").alias("w"), F.max("p.lat").alias("n"), F.max("p.lon").alias("e"))
    key = box.select(tables.graph_key(F.col("s"), F.col("w"), F.col("n"), F.col("e"), F.lit(network))).first()[0]
    try:
        return *tables.load_graph(spark, folder, key), True
    except AnalysisException as lost:
        if lost.getCondition() != "PATH_NOT_FOUND":
            raise
    tables.save_graph(*in_area(nodes, edges, areas), folder, key)
    return *tables.load_graph(spark, folder, key), False
