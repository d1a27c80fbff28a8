"""The whole analysis as layers that ``refresh`` keeps up to date: what travel areas, network, places and samples give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraline.operators import candidates, graph, location, network, overlay
from terraline.operators.refresh import Layer
from terraline.sources import listings, tables


def scanned(markers: DataFrame, answers: DataFrame) -> DataFrame:
    """(orig_idx, status, minutes, rings) of the active markers: the areas of answers (orig_idx, code, body), and one row
    without rings for a marker whose answer failed, holds no area or isn't there, with why."""
    asked = location.active(markers).select(F.col("idx").alias("orig_idx")).join(answers, "orig_idx", "left")
    found = tables.isochrones(asked.where("code = 200").select("orig_idx", "body"), "body", marker="orig_idx").where(F.size(F.flatten("rings")) > 0)
    whole = found.select("orig_idx", F.lit("ok").alias("status"), "minutes", "rings")
    lost = asked.join(found.select("orig_idx").distinct(), "orig_idx", "left_anti")
    why = F.when(F.col("code").isNull(), "no answer").when(F.col("code") == 200, "no areas").otherwise(listings.fetch_status(F.col("code")))
    return whole.unionByName(lost.select("orig_idx", why.alias("status")), allowMissingColumns=True)


def zone(markers: DataFrame, isochrone: DataFrame) -> DataFrame:
    """(area_deg2, area_km2, lat, lon, south, north, west, east) of what all active markers reach; no row without any."""
    areas = isochrone.where("rings is not null").select("orig_idx", "rings")
    return overlay.measured(location.centre_zone(areas, markers)).where("area_deg2 > 0")


def centres(nodes: DataFrame, edges: DataFrame, closeness: DataFrame, betweenness: DataFrame, places: DataFrame) -> DataFrame:
    """The primary centre and the secondary ones of a network: candidates, the places near them, their score and role."""
    found = candidates.network_candidates(nodes, edges, closeness, betweenness)
    return candidates.detected(found, candidates.places_near(found, places))


def rent(markers: DataFrame, samples: DataFrame, isochrone: DataFrame, intersection: DataFrame, top: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """The rent model's row: around the primary centre if one is given, else the zone, the network's top node, the areas or
    the markers, whichever comes first."""
    areas = isochrone.where("rings is not null").select("orig_idx", "rings")
    return location.rent_model(markers, samples, areas=areas, centre=intersection, top=top, primary=primary).model


#: Areas and their zone rest on markers and answers; the network on nodes and edges alone, so a marker's move leaves it as
#: it is; the rent model on both.
AREAS = [Layer("isochrone", ("markers", "answers"), scanned), Layer("intersection", ("markers", "isochrone"), zone)]
NETWORK = [
    Layer("closeness", ("edges",), lambda edges: graph.closeness(edges, network.SAMPLED_CLOSENESS)),
    Layer("betweenness", ("edges",), lambda edges: graph.edge_betweenness(edges, network.SAMPLED_BETWEENNESS)),
    Layer("top", ("nodes", "closeness"), network.top_node),
]
RENT = [Layer("rent", ("markers", "samples", "isochrone", "intersection", "top"), rent), Layer("rent_nodes", ("nodes", "rent"), location.rent_at_nodes)]
#: The same with the primary centre as the anchor: a new choice of centres makes a new rent model.
CENTRES = [Layer("centres", ("nodes", "edges", "closeness", "betweenness", "places"), centres), Layer("rent", ("markers", "samples", "isochrone", "intersection", "top", "centres"), rent, "primary"), RENT[1]]


def analysis(by_centre: bool = False) -> list[Layer]:
    """All layers over markers (idx, lat, lng, active), answers (orig_idx, code, body), nodes (id, lat, lon), edges (src, dst,
    length), samples (lat, lon, rent) and, if the rent model stands on the primary centre, places (lat, lon, categories)."""
    return AREAS + NETWORK + (CENTRES if by_centre else RENT)
