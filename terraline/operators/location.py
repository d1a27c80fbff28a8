"""Markers, travel areas and the rent model around their common centre."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraline.functions import geo, rent
from terraline.operators import cells, overlay, rings
from terraline.session import written

#: The marker that a reset leaves, and the results that a change makes stale.
DEFAULT_MARKER = (20.219443, 100.403630)
LAYERS = ("isochrone", "intersection", "network", "rent")
STALE = {"marker": ("isochrone", "intersection", "rent"), "isochrone": ("intersection", "rent"), "network": ("rent",), "reset": LAYERS}


def active(markers: DataFrame) -> DataFrame:
    """The active markers (idx, lat, lng, active), which keep their idx, with active_idx from 0; a missing flag is on."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("idx")) - 1
    return markers.where(F.coalesce("active", F.lit(True))).withColumn("active_idx", place)


def _numbered(markers: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("idx")) - 1
    return markers.select(place.alias("idx"), "lat", "lng", F.coalesce("active", F.lit(True)).alias("active"))


def add_marker(markers: DataFrame, lat: float, lng: float) -> DataFrame:
    one = markers.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).cast("int").alias("idx")).select("idx", F.lit(float(lat)).alias("lat"), F.lit(float(lng)).alias("lng"), F.lit(True).alias("active"))
    return _numbered(markers.unionByName(one))


def remove_marker(markers: DataFrame, idx: int) -> DataFrame:
    """Without the marker at a position; later ones move up. A position that isn't there removes nothing."""
    return _numbered(markers.where(F.col("idx") != idx))


def pop_marker(markers: DataFrame) -> DataFrame:
    last = markers.agg(F.max("idx").alias("_last"))
    return _numbered(markers.join(F.broadcast(last)).where("idx < _last").drop("_last"))


def set_active(markers: DataFrame, idx: int, on: bool) -> DataFrame:
    return markers.withColumn("active", F.when(F.col("idx") == idx, F.lit(on)).otherwise(F.col("active")))


def reset_markers(spark) -> DataFrame:
    return spark.createDataFrame([(0, *DEFAULT_MARKER, True)], "idx int, lat double, lng double, active boolean")


def lat_lng(text: Column) -> Column:
    """struct<lat, lng> of "lat, lng"; null if it isn't two numbers."""
    parts = F.split(F.trim(text), ",")
    number = lambda k: F.trim(F.get(parts, k)).try_cast("double")
    return F.when((F.size(parts) == 2) & number(0).isNotNull() & number(1).isNotNull(), F.struct(number(0).alias("lat"), number(1).alias("lng")))


def stale(results: DataFrame, change: str) -> DataFrame:
    """Results (layer, value) without the values that a change makes stale."""
    return results.withColumn("value", F.when(~F.col("layer").isin(*STALE[change]), F.col("value")))


def still_fresh(results: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Kept results (written_at) that are younger than their time to live."""
    return results.where(F.col("written_at") > now - F.make_interval(secs=F.lit(float(seconds))))


def travel_areas(parts: list[DataFrame]) -> DataFrame:
    """All markers' features (orig_idx, minutes, rings) in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centre_cells(areas: DataFrame, markers: DataFrame, cell_deg: float = 0.001) -> DataFrame:
    """(cy, cx) of the cells that lie in an area of every active marker; none with under two active markers, or if one
    of them has no area. areas: (orig_idx, rings)."""
    of = active(markers).select(F.col("idx").alias("orig_idx"), "active_idx")
    known = areas.join(F.broadcast(of), "orig_idx")
    wanted = of.agg(F.count("*").alias("_wanted"))
    covered = cells.polygon_cells(known.select(F.col("active_idx").alias("id"), "rings"), cell_deg)
    found = covered.groupBy("cy", "cx").agg(F.count_distinct("id").alias("_n")).join(F.broadcast(wanted))
    return found.where("_wanted >= 2 and _n = _wanted").select("cy", "cx")


def centre_zone(areas: DataFrame, markers: DataFrame, tile_deg: float = 0.05) -> DataFrame:
    """The same zone exactly, as trapezoids (``overlay``): what the areas of every active marker cover."""
    of = active(markers).select(F.col("idx").alias("orig_idx"), "active_idx")
    known = areas.join(F.broadcast(of), "orig_idx")
    return overlay.intersection(overlay.coverage(known.select(F.col("active_idx").alias("id"), "rings"), tile_deg=tile_deg), of.count())


def d_max_km(areas: DataFrame, anchor: DataFrame | tuple[float, float]) -> DataFrame:
    """(d_max_km) from the anchor to the farthest corner of the areas' boxes; the default without areas, never below the
    least. areas: (rings)."""
    points = F.flatten("rings")
    ends = lambda c: (F.array_min(F.transform(points, lambda p: p[c])), F.array_max(F.transform(points, lambda p: p[c])))
    corner = F.explode(F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a in ends("lat") for b in ends("lon")]))
    corners = areas.where(F.size(F.flatten("rings")) > 0).select(corner.alias("c")).select("c.*")
    if isinstance(anchor, tuple):
        lat, lon = map(F.lit, anchor)
    else:
        corners = corners.join(F.broadcast(anchor.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))))
        lat, lon = F.col("_lat"), F.col("_lon")
    far = F.max(geo.haversine_km(lat, lon, F.col("lat"), F.col("lon")))
    return corners.agg(F.greatest(F.lit(rent.MIN_D_MAX), F.when(far > 0, far).otherwise(F.lit(rent.DEFAULT_D_MAX))).alias("d_max_km"))


def anchor(centre: DataFrame | None, top: DataFrame | None, areas: DataFrame | None, markers: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """(lat, lon): the primary centre if one is given, else the centroid of the centre (its cells, trapezoids, or a row
    with its lat and lon), the network's top node, the centroid of all areas, the mean of the active markers; no row
    without any."""
    steps = []
    if primary is not None:
        steps.append(primary.where("role = 'primary'").select("lat", "lon"))
    if centre is not None:
        measured = cells.area_km2(centre) if "cy" in centre.columns else overlay.measured(centre) if "y0" in centre.columns else centre
        steps.append(measured.select("lat", "lon"))
    if top is not None:
        steps.append(top.where("closeness >= 0").select("lat", "lon"))
    if areas is not None:
        steps.append(overlay.measured(overlay.union(overlay.coverage(areas.select(F.col("orig_idx").alias("id"), "rings")))).select("lat", "lon"))
    steps.append(active(markers).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lon")))
    return rings.first_anchor(steps).where("lat is not null")


@dataclass(frozen=True)
class RentModel:
    """``model`` (one row with the anchor, r0, lam, r2, n, d_max_km, half_dist_km, is_index, inverted, status), ``curve``,
    ``shapes`` (rings with n_nodes), ``samples`` (d_km, rent) and ``nodes`` (rent at each)."""

    model: DataFrame
    curve: DataFrame
    shapes: DataFrame
    samples: DataFrame
    nodes: DataFrame


def rent_at_nodes(nodes: DataFrame, models: DataFrame) -> DataFrame:
    """Adds d_km, rent (two decimals) and colour to nodes (lat, lon) from a one-row model with its anchor."""
    m = F.broadcast(models.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "r0", "lam", "d_max_km"))
    ends = rent.rent_at(F.lit(0.0), F.col("r0"), F.col("lam")), rent.rent_at(F.col("d_max_km"), F.col("r0"), F.col("lam"))
    low, high = F.least(*ends), F.greatest(*ends)
    out = nodes.join(m).withColumn("d_km", geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).withColumn("rent", rent.rent_at(F.col("d_km"), F.col("r0"), F.col("lam")))
    norm = (F.col("rent") - low) / F.when(high > low, high - low).otherwise(1.0)
    return out.withColumn("colour", rent.ramp_colour(norm)).withColumn("rent", F.round("rent", 2)).drop("_lat", "_lon", "r0", "lam", "d_max_km")


def rent_model(markers: DataFrame, samples: DataFrame, areas: DataFrame | None = None, nodes: DataFrame | None = None, centre: DataFrame | None = None, top: DataFrame | None = None, primary: DataFrame | None = None) -> RentModel:
    """The whole model: anchor, reach, fit or index, curve, rings and rent at the nodes. samples: (lat, lon, rent);
    nodes: (lat, lon, ...). Without an anchor all tables are empty. The anchor is one row, which the driver reads."""
    spark = markers.sparkSession
    at = anchor(centre, top, areas, markers, primary).first()
    place = (at.lat, at.lon) if at else (0.0, 0.0)
    known = F.lit(at is not None)
    areas = areas if areas is not None else spark.createDataFrame([], "rings array<array<struct<lon:double,lat:double>>>")
    reach = d_max_km(areas, place).withColumnRenamed("d_max_km", "_reach")
    fit = rings.fit_rents(samples, place).join(F.broadcast(reach))
    models = rings.model(fit, F.col("_reach")).drop("_reach").withColumns({"lat": F.lit(place[0]), "lon": F.lit(place[1]), "n": F.when(F.col("is_index"), F.lit(0).cast("long")).otherwise(F.col("n"))}).where(known)
    models = written(models, "rent-model")
    shapes = rings.ring_shapes(models, place)
    found = rings.with_distance(samples.where("rent > 0 and not isnan(rent)"), place).join(F.broadcast(models.where("not is_index").select("lam"))).drop("lam")
    if nodes is None:
        nodes = spark.createDataFrame([], "lat double, lon double")
    else:
        step = models.select((F.col("d_max_km") / rent.RINGS).alias("_step"))
        counted = rings.with_distance(nodes, place).join(F.broadcast(step)).groupBy((rent.ring_index(F.col("d_km"), F.col("_step")) + 1).alias("ring")).agg(F.count("*").alias("n_nodes"))
        shapes = shapes.join(F.broadcast(counted), "ring", "left").withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
    return RentModel(models, rings.curve(models), shapes, found, rent_at_nodes(nodes, models))


def _estimated(points: DataFrame, models: DataFrame, lat: str, lon: str) -> DataFrame:
    m = F.broadcast(models.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "r0", "lam", "is_index"))
    return points.join(m, how="left").withColumn("d_km", geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col(lat), F.col(lon))).withColumn("estimate", rent.rent_at(F.col("d_km"), F.col("r0"), F.col("lam")))


def golden_table(golden: DataFrame, models: DataFrame) -> DataFrame:
    """(rank, score, lat, lon, closeness, degree, d_km, estimate, value_gap), rounded for show. golden: (rank, score, lat,
    lon, closeness_norm, degree_norm); the last three are null without a model."""
    share = F.when(F.col("r0") != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("estimate") / F.col("r0")))).otherwise(F.when(F.col("r0").isNotNull(), 0.0))
    r = lambda c, k, name=None: F.round(c, k).alias(name or c)
    return _estimated(golden, models, "lat", "lon").select("rank", r("score", 4), r("lat", 5), r("lon", 5), r("closeness_norm", 3, "closeness"), r("degree_norm", 3, "degree"), r("d_km", 2), r("estimate", 1), F.round(F.col("closeness_norm") - share, 3).alias("value_gap"))


def marker_table(markers: DataFrame, models: DataFrame, unit: str = "") -> DataFrame:
    """(place from 1, active, lat, lng, d_km, estimate as a label)."""
    label = F.when(F.col("is_index"), rent.rent_label(F.col("estimate"), True)).otherwise(rent.rent_label(F.col("estimate"), False, unit))
    return _estimated(markers, models, "lat", "lng").select((F.col("idx") + 1).alias("place"), F.coalesce("active", F.lit(True)).alias("active"), F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.round("d_km", 2).alias("d_km"), F.when(F.col("r0").isNotNull(), label).alias("estimate"))


def summary(markers: DataFrame, centre: DataFrame, stats: DataFrame, models: DataFrame) -> DataFrame:
    """One row: active markers, the centre's area (null without one), nodes, lam and half distance."""
    out = active(markers).agg(F.count("*").alias("n_active"))
    area = cells.area_km2(centre).select(F.when(F.col("n_cells") > 0, F.round("area_km2", 2)).alias("centre_km2"))
    return out.join(F.broadcast(area)).join(F.broadcast(stats.select("nodes_count")), how="left").join(F.broadcast(models.select(F.round("lam", 4).alias("lam"), F.round("half_dist_km", 2).alias("half_dist_km"))), how="left")
