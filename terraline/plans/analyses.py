"""Queries of the layered analysis and of exact overlays, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraline.operators import analysis, location, overlay
from terraline.operators.refresh import Store, refresh
from terraline.plans.catalogue import POINTS, points, query, samples, squares
from terraline.plans.places import MARKERS, NODES, areas, markers, model_sql, street_edges, street_nodes
from terraline.plans.places import km as km_sql
from terraline.session import run_folder


def answers(spark, sf_dir, moved: float = 0.0):
    """What a source of travel areas says to each marker, as GeoJSON: a square; marker 2's may be moved north."""
    corner = lambda a, b: F.array(F.col("lng") + b, F.col("lat") + a + F.when(F.col("idx") == 2, moved).otherwise(0.0))
    square = F.array(F.array(*[corner(a, b) for a, b in ((-0.02, -0.02), (-0.02, 0.02), (0.02, 0.02), (0.02, -0.02), (-0.02, -0.02))]))
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), square.alias("coordinates")).alias("geometry"), F.struct(F.lit(600.0).alias("value")).alias("properties"))
    return markers(spark, sf_dir).select(F.col("idx").alias("orig_idx"), F.lit(200).alias("code"), F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))


def inputs(spark, sf_dir, moved: float = 0.0):
    at = markers(spark, sf_dir).withColumn("lat", F.col("lat") + F.when(F.col("idx") == 2, moved).otherwise(0.0))
    return {"markers": at, "answers": answers(spark, sf_dir, moved), "nodes": street_nodes(spark, sf_dir), "edges": street_edges(spark, sf_dir), "samples": samples(spark, sf_dir)}


def store(spark) -> Store:
    return Store(spark, f"{run_folder(spark)}/layers-{uuid.uuid4().hex}")


COUNTED = f"""(values ('isochrone', 'computed', 2), ('intersection', 'computed', 1), ('closeness', 'kept', (select count(*) from {NODES})), ('betweenness', 'kept', (select count(*) from (select distinct least(l_partkey % 200, (l_partkey % 200 + 1 + l_suppkey % 7) % 200), greatest(l_partkey % 200, (l_partkey % 200 + 1 + l_suppkey % 7) % 200) from lineitem))),
  ('top', 'kept', 1), ('rent', 'computed', 1), ('rent_nodes', 'computed', (select count(*) from {NODES}))) t(layer, status, rows)"""


@query(f"select layer, status, rows from {COUNTED}")
def layers_after_a_marker_moves(spark, sf_dir):
    """A marker moves: areas, zone and rent are computed again, the network is kept."""
    kept = store(spark)
    refresh(analysis.analysis(), inputs(spark, sf_dir), kept)
    return refresh(analysis.analysis(), inputs(spark, sf_dir, 0.001), kept).statuses.select("layer", "status", "rows")


ZONE = f"(select max(lat) - 0.02e0 as s, min(lat) + 0.02e0 as n, max(lng) - 0.02e0 as w, min(lng) + 0.02e0 as e from {MARKERS} where active)"


@query(f"select round((n - s)*(e - w), 10) as area_deg2, round((n - s)*(e - w)*110.574e0*111.320e0*cos(radians((n + s)/2)), 7) as area_km2, round((n + s)/2, 9) as lat, round((w + e)/2, 9) as lon, round(s, 9) as south, round(e, 9) as east from {ZONE}")
def exact_zone(spark, sf_dir):
    r = lambda c, k: F.round(c, k).alias(c)
    m = overlay.measured(location.centre_zone(areas(spark, sf_dir), markers(spark, sf_dir)))
    return m.select(r("area_deg2", 10), r("area_km2", 7), r("lat", 9), r("lon", 9), r("south", 9), r("east", 9))


@query(f"""with b as (select c_nationkey as g, lat - 0.003e0 as y0, lat + 0.003e0 as y1, lon - 0.003e0 as x0, lon + 0.003e0 as x1 from {POINTS}),
  y as (select g, v as a, lead(v) over (partition by g order by v) as b from (select g, y0 as v from b union select g, y1 from b)),
  x as (select g, v as a, lead(v) over (partition by g order by v) as b from (select g, x0 as v from b union select g, x1 from b)),
  s as (select distinct y.g, y.a as ya, y.b as yb, b.x0, b.x1 from y join b on y.g = b.g and b.y0 <= y.a and b.y1 >= y.b),
  c as (select distinct s.g, ya, yb, x.a as xa, x.b as xb from s join x on x.g = s.g and s.x0 <= x.a and s.x1 >= x.b)
  select g as nation, round(sum((yb - ya)*(xb - xa)), 9) as area_deg2, round(sum((yb - ya)*(xb - xa)*(ya + yb)/2)/sum((yb - ya)*(xb - xa)), 7) as lat, round(sum((yb - ya)*(xb - xa)*(xa + xb)/2)/sum((yb - ya)*(xb - xa)), 7) as lon from c group by 1""")
def united_areas(spark, sf_dir):
    """A square around each customer, united within each nation."""
    p = points(spark, sf_dir).select(F.col("c_nationkey").alias("nation"), "id", squares(F.col("lat"), F.col("lon"), 0.003).alias("rings"))
    r = lambda c, k: F.round(c, k).alias(c)
    return overlay.measured(overlay.union(overlay.coverage(p, by="nation", tile_deg=0.02)), "nation").select("nation", r("area_deg2", 9), r("lat", 7), r("lon", 7))


A_LAT, A_LON = f"(select (n + s)/2 from {ZONE})", f"(select (w + e)/2 from {ZONE})"
CORNERS = f"(select unnest([lat-0.02e0, lat-0.02e0, lat+0.02e0, lat+0.02e0]) as lat, unnest([lng-0.02e0, lng+0.02e0, lng-0.02e0, lng+0.02e0]) as lon from {MARKERS} where active)"


@query(f"""with place as (select {A_LAT} as a, {A_LON} as o), m as (select * from {model_sql('(select a from place)', '(select o from place)', '(select max(' + km_sql('(select a from place)', '(select o from place)', 'lat', 'lon') + ') from ' + CORNERS + ')')})
  select round(a_lat, 8) as lat, round(a_lon, 8) as lon, n, round(r0, 6) as r0, round(lam, 8) as lam, round(r2, 8) as r2, round(d_max, 6) as d_max_km from m""")
def layered_rent_model(spark, sf_dir):
    """From markers, answers, network and samples to the rent model, layer by layer."""
    r = lambda c, k: F.round(c, k).alias(c)
    model = refresh(analysis.analysis(), inputs(spark, sf_dir), store(spark)).tables["rent"]
    return model.select(r("lat", 8), r("lon", 8), "n", r("r0", 6), r("lam", 8), r("r2", 8), r("d_max_km", 6))


@query("select r_regionkey as orig_idx, case when r_regionkey = 0 then 'too many requests' when r_regionkey = 2 then 'ok' end as status, case when r_regionkey = 2 then 10.0e0 end as minutes, case when r_regionkey = 2 then 5 end as corners from region where r_regionkey in (0, 2)")
def marker_statuses(spark, sf_dir):
    """A marker whose answer failed shows with why; one that is off isn't asked."""
    told = answers(spark, sf_dir).withColumn("code", F.when(F.col("orig_idx") == 0, 429).otherwise(F.col("code")))
    return analysis.scanned(markers(spark, sf_dir), told).select("orig_idx", "status", "minutes", F.when(F.col("rings").isNotNull(), F.size(F.flatten("rings"))).alias("corners"))
