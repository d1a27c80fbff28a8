"""Queries of the location, network and price pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraline.functions import geo, rent
from terraline.operators import candidates, cells, density, graph, location, network, prices, rings
from terraline.plans.catalogue import CATS, D, EDGES, FIT, PAIRS, PATHS, POINTS, SAMPLES, km, points, query, samples, squares, street_edges, suppressed_sql, table
from terraline.sources import listings, tables

KIND = "case event_type when 'purchase' then '1m' when 'click' then '5m' when 'signup' then '15m' else '60m' end"


def bars_and_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ticker", F.concat(F.lit("U"), F.col("user_id")))
    bars = e.where("event_type <> 'view'").select("ticker", F.expr(KIND).alias("interval"), "ts", F.col("value").alias("close"))
    said = F.concat(F.date_format(F.from_utc_timestamp("ts", "Asia/Bangkok"), "d/M/yyyy H:mm:ss"), F.lit(" u"), F.col("user_id"))
    asked = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 11 == 0, "31/02/2024 1:00:00 X").otherwise(said).alias("raw"))
    return bars, asked


@query(f"""with r as (select event_id, user_id, date_trunc('second', ts) as ts, event_id % 11 = 0 as bad from events where event_type='view'),
  b as (select user_id, ts, value, case {KIND} when '1m' then 0 when '5m' then 1 when '15m' then 2 else 3 end as lvl from events where event_type<>'view'),
  w as (select * from (values (0,2700,60),(1,7200,3600),(2,21600,7200),(3,172800,86400)) t(lvl,a,z)),
  m as (select r.event_id, b.lvl, coalesce(max_by(b.value, b.ts) filter (b.ts<=r.ts), min_by(b.value, b.ts)) as price
    from r join b on r.user_id=b.user_id join w on w.lvl=b.lvl and b.ts >= r.ts - to_seconds(w.a) and b.ts < r.ts + to_seconds(w.z) where not bad group by 1,2),
  f as (select event_id, min_by(price, lvl) as price, min(lvl) as lvl from m group by 1)
  select r.event_id as request_id, case when not bad then strftime(ts + interval 7 hour, '%d/%m/%Y,%H:%M:%S') || ',U' || user_id end as stamp, round(f.price, 6) as price, ['1m','5m','15m','60m'][f.lvl+1] as level, case when bad then 'invalid' when f.lvl is null then 'no bar' else 'ok' end as status from r left join f on r.event_id=f.event_id""")
def spot_price_relaxed(spark, sf_dir):
    bars, asked = bars_and_requests(spark, sf_dir)
    return prices.spot_prices(asked, bars, strict=False).withColumn("price", F.round("price", 6))


@query("""with r as (select event_id, user_id, date_trunc('minute', ts) as m, event_id % 11 = 0 as bad from events where event_type='view'),
  p as (select user_id, date_trunc('minute', ts) as m, max_by(value, ts) as price from events where event_type='purchase' group by 1,2)
  select r.event_id as request_id, round(p.price, 6) as price, case when bad then 'invalid' when p.price is null then 'no bar' else 'ok' end as status from r left join p on r.user_id=p.user_id and r.m=p.m and not bad""")
def spot_price_strict(spark, sf_dir):
    bars, asked = bars_and_requests(spark, sf_dir)
    return prices.spot_prices(asked, bars).select("request_id", F.round("price", 6).alias("price"), "status")


def street_nodes(spark, sf_dir):
    n = graph.nodes_of(street_edges(spark, sf_dir)).withColumnRenamed("node", "id")
    return n.select("id", (20.0 + F.col("id") % 20 * 0.005).alias("lat"), (100.0 + F.expr("id div 20") * 0.005).alias("lon"))


NODES = f"(select node as id, 20.0e0 + node % 20 * 0.005e0 as lat, 100.0e0 + (node // 20) * 0.005e0 as lon from (select src as node from {EDGES} union select dst from {EDGES}))"
CLOSE = "k as (select dst as node, (count(*)-1)/sum(d) as closeness from p group by 1)"


@query(f"with recursive {PATHS}, {CLOSE} select node, lat, lon, round(closeness, 8) as closeness from k join {NODES} n on n.id = k.node order by k.closeness desc, node limit 1")
def network_top_node(spark, sf_dir):
    return network.layers(street_nodes(spark, sf_dir), street_edges(spark, sf_dir)).top.withColumn("closeness", F.round("closeness", 8))


@query(f"""with recursive {PATHS} select src, dst, count(*) as n, round(coalesce(max(betweenness), 0)/(select max(betweenness) from bet), 8) as betweenness, round(2 + 4*coalesce(max(betweenness), 0)/(select max(betweenness) from bet), 8) as stroke_weight, min(20.0e0 + src % 20 * 0.005e0) as from_lat, min(100.0e0 + (dst // 20) * 0.005e0) as to_lon
  from {EDGES} left join bet on a = least(src, dst) and b = greatest(src, dst) group by 1, 2""")
def network_roads(spark, sf_dir):
    roads = network.layers(street_nodes(spark, sf_dir), street_edges(spark, sf_dir)).roads
    return roads.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.max("betweenness"), 8).alias("betweenness"), F.round(F.max("stroke_weight"), 8).alias("stroke_weight"), F.min(F.col("line")[0][1]).alias("from_lat"), F.min(F.col("line")[1][0]).alias("to_lon"))


@query(f"with recursive {PATHS}, {CLOSE} select node, lat, lon, round(closeness/(select max(closeness) from k), 8) as closeness, round(2 + 6*closeness/(select max(closeness) from k), 8) as radius from k join {NODES} n on n.id = k.node")
def network_crossings(spark, sf_dir):
    return network.layers(street_nodes(spark, sf_dir), street_edges(spark, sf_dir)).crossings.select("node", "lat", "lon", F.round("closeness", 8).alias("closeness"), F.round("radius", 8).alias("radius"))


@query(f"select (select count(*) from {NODES}) as nodes_count, (select count(*) from lineitem) as edges_count, false as used_approximation, 'exact' as closeness_method, 'ok' as status")
def network_stats(spark, sf_dir):
    return network.layers(street_nodes(spark, sf_dir), street_edges(spark, sf_dir)).stats


HOPS = "(select s_suppkey as src, s_suppkey * 7 % 31 as dst from supplier union all select s_suppkey, (s_suppkey + 1) % 31 from supplier)"


@query(f"""with recursive n as (select src as v from {HOPS} union select dst from {HOPS}),
  p(src, dst, d) using key (src, dst) as (select v, v, 0 from n union
    select m.src, m.dst, m.d from (select p.src, e.src as dst, min(p.d + 1) as d from p join {HOPS} e on e.dst = p.dst and e.src <> e.dst group by 1, 2) m left join recurring.p r on r.src = m.src and r.dst = m.dst where r.d is null or m.d < r.d)
  select src as node, round(case when sum(d) > 0 then (count(*)-1.0e0)/sum(d) * (count(*)-1.0e0)/((select count(*) from n)-1.0e0) else 0 end, 8) as closeness from p group by 1""")
def hop_closeness(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    edges = s.select(k.alias("src"), (k * 7 % 31).alias("dst")).unionByName(s.select(k.alias("src"), ((k + 1) % 31).alias("dst")))
    return graph.hop_closeness(edges).select("node", F.round("closeness", 8).alias("closeness"))


def markers(spark, sf_dir):
    """Three markers, the second one off, and where each lies."""
    n = table(spark, sf_dir, "region").where("r_regionkey < 3")
    return n.select(F.col("r_regionkey").alias("idx"), (20.04 + F.col("r_regionkey") * 0.01).alias("lat"), (100.04 + F.col("r_regionkey") * 0.005).alias("lng"), (F.col("r_regionkey") != 1).alias("active"))


MARKERS = "(select r_regionkey as idx, 20.04e0 + r_regionkey * 0.01e0 as lat, 100.04e0 + r_regionkey * 0.005e0 as lng, r_regionkey <> 1 as active from region where r_regionkey < 3)"


def areas(spark, sf_dir, half: float = 0.02):
    return markers(spark, sf_dir).select(F.col("idx").alias("orig_idx"), F.lit(10.0).alias("minutes"), squares(F.col("lat"), F.col("lng"), half).alias("rings"))


CENTRE = f"(select cy.range as cy, cx.range as cx from range(19900, 20300) cy, range(99900, 100300) cx where (select count(*) from {MARKERS} where active and (cy.range + 0.5e0)*0.001e0 between lat - 0.02e0 and lat + 0.02e0 and (cx.range + 0.5e0)*0.001e0 between lng - 0.02e0 and lng + 0.02e0) = 2)"


@query(f"select cy, cx from {CENTRE}")
def cbd_zone(spark, sf_dir):
    return location.centre_cells(areas(spark, sf_dir), markers(spark, sf_dir))


@query("select cast(null as bigint) as cy, cast(null as bigint) as cx where false")
def cbd_zone_missing_area(spark, sf_dir):
    """An active marker without an area: there is no zone."""
    return location.centre_cells(areas(spark, sf_dir).where("orig_idx > 0"), markers(spark, sf_dir))


def model_sql(lat: str, lon: str, reach: str) -> str:
    d = km(lat, lon, "lat", "lon")
    return f"(select *, greatest({reach}, 1.05e0*d_far) as d_max, {lat} as a_lat, {lon} as a_lon from (select count(*) as n, exp(regr_intercept(ln(rent), {d})) as r0, -regr_slope(ln(rent), {d}) as lam, regr_r2(ln(rent), {d}) as r2, max({d}) as d_far from {SAMPLES} where rent > 0))"


#: The zone's centroid is the middle of cells at 0.001 degrees: markers 0 and 2, squares of 0.02.
A_LAT, A_LON = f"(select avg((cy + 0.5e0)*0.001e0) from {CENTRE})", f"(select avg((cx + 0.5e0)*0.001e0) from {CENTRE})"
CORNERS = f"(select unnest([lat-0.02e0, lat-0.02e0, lat+0.02e0, lat+0.02e0]) as lat, unnest([lng-0.02e0, lng+0.02e0, lng-0.02e0, lng+0.02e0]) as lon from {MARKERS})"
ANCHOR_SQL = f"with place as (select {A_LAT} as a, {A_LON} as o), m as (select * from {model_sql('(select a from place)', '(select o from place)', '(select max(' + km('(select a from place)', '(select o from place)', 'lat', 'lon') + ') from ' + CORNERS + ')')})"


def rent_run(spark, sf_dir):
    m, a = markers(spark, sf_dir), areas(spark, sf_dir)
    return location.rent_model(m, samples(spark, sf_dir), areas=a, nodes=points(spark, sf_dir).select("id", "lat", "lon"), centre=location.centre_cells(a, m))


@query(f"{ANCHOR_SQL} select round(a_lat, 8) as lat, round(a_lon, 8) as lon, n, round(r0, 6) as r0, round(lam, 8) as lam, round(r2, 8) as r2, round(d_max, 6) as d_max_km, round(ln(2.0e0)/abs(lam), 6) as half_dist_km, false as is_index, lam < 0 as inverted from m")
def rent_model_run(spark, sf_dir):
    r = lambda c, k: F.round(c, k).alias(c)
    return rent_run(spark, sf_dir).model.select(r("lat", 8), r("lon", 8), "n", r("r0", 6), r("lam", 8), r("r2", 8), r("d_max_km", 6), r("half_dist_km", 6), "is_index", "inverted")


DM = km("a_lat", "a_lon", "lat", "lon")


@query(f"""{ANCHOR_SQL}, c as (select case when floor({DM}/(d_max/6)) < 6 then floor({DM}/(d_max/6)) when {DM} <= d_max + 1e-9 then 5 end as ring, count(*) as n from {POINTS}, m group by 1)
  select cast(k as integer) as ring, round(r0*exp(-lam*((k-0.5e0)*d_max/6)), 2) as mid_rent, coalesce(c.n, 0) as n_nodes from m, (select range as k from range(1,7)) left join c on c.ring = k - 1""")
def rent_ring_nodes(spark, sf_dir):
    return rent_run(spark, sf_dir).shapes.select("ring", "mid_rent", "n_nodes")


@query(f"{ANCHOR_SQL} select id, round({DM}, 6) as d_km, round(r0*exp(-lam*{DM}), 2) as rent from {POINTS}, m")
def rent_at_nodes(spark, sf_dir):
    return rent_run(spark, sf_dir).nodes.select("id", F.round("d_km", 6).alias("d_km"), "rent")


@query(f"""{ANCHOR_SQL}, g as (select lat, lon, (c_custkey % 97)/97.0e0 as c, (c_custkey % 13)/13.0e0 as g, row_number() over (order by (c_custkey % 97)/97.0e0 desc, c_custkey) as rank from {POINTS} qualify rank <= 10)
  select cast(rank as integer) as rank, round(c, 4) as score, round(lat, 5) as lat, round(lon, 5) as lon, round(c, 3) as closeness, round(g, 3) as degree, round({DM}, 2) as d_km, round(r0*exp(-lam*{DM}), 1) as estimate, round(c - least(1, greatest(0, exp(-lam*{DM}))), 3) as value_gap from g, m""")
def golden_values(spark, sf_dir):
    from pyspark.sql import Window

    c = (F.col("c_custkey") % 97) / 97.0
    top = points(spark, sf_dir).select("id", "lat", "lon", c.alias("closeness_norm"), c.alias("score"), ((F.col("c_custkey") % 13) / 13.0).alias("degree_norm")).orderBy(F.desc("score"), "id").limit(10)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))
    return location.golden_table(top, rent_run(spark, sf_dir).model)


@query(f"{ANCHOR_SQL} select idx + 1 as place, active, round(lat, 5) as lat, round(lng, 5) as lng, round({km('a_lat', 'a_lon', 'lat', 'lng')}, 2) as d_km, format('{{:,}} THB', cast(round(r0*exp(-lam*{km('a_lat', 'a_lon', 'lat', 'lng')})) as bigint)) as estimate from {MARKERS}, m")
def marker_rents(spark, sf_dir):
    return location.marker_table(markers(spark, sf_dir), rent_run(spark, sf_dir).model, "THB")


@query(f"{ANCHOR_SQL} select 2::bigint as n_active, round((select sum(110.574e0*111.320e0*1e-6*cos(radians((cy+0.5e0)*0.001e0))) from {CENTRE}), 2) as centre_km2, (select count(*) from {NODES}) as nodes_count, round(lam, 4) as lam, round(ln(2.0e0)/abs(lam), 2) as half_dist_km from m")
def location_summary(spark, sf_dir):
    m, a = markers(spark, sf_dir), areas(spark, sf_dir)
    stats = graph.nodes_of(street_edges(spark, sf_dir)).agg(F.count("*").alias("nodes_count"))
    return location.summary(m, location.centre_cells(a, m), stats, rent_run(spark, sf_dir).model)


@query(f"select idx, lat, lng, active from (select cast(row_number() over (order by k) - 1 as integer) as idx, lat, lng, active from (select idx as k, lat, lng, active or idx = 1 as active from {MARKERS} where idx <> 0 union all select 3, 20.5e0, 100.5e0, true)) where idx < 2")
def marker_moves(spark, sf_dir):
    """Add one, switch one on, remove the first, drop the last."""
    m = location.add_marker(markers(spark, sf_dir), 20.5, 100.5)
    m = location.remove_marker(location.set_active(m, 1, True), 0)
    return location.pop_marker(m).select(F.col("idx").cast("int").alias("idx"), "lat", "lng", "active")


@query("select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey % 90 + 0.5e0 end as lat, case when o_orderkey % 3 > 0 then o_orderkey % 180 + 0.25e0 end as lng from orders")
def lat_lng_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(", x"))).when(k % 3 == 1, F.concat(F.lit(" "), (k % 90 + 0.5).cast("string"), F.lit(","), (k % 180 + 0.25).cast("string"))).otherwise(F.concat((k % 90 + 0.5).cast("string"), F.lit(" , "), (k % 180 + 0.25).cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", location.lat_lng(said).alias("p")).select("o_orderkey", "p.lat", "p.lng")


#: Roads between neighbouring customers, with a betweenness from the key.
CHAIN = "(select c_custkey as src, c_custkey + 1 as dst from customer where c_custkey < (select max(c_custkey) from customer))"
NETWORK_SQL = f"""pool as (select id, lat, lon, closeness from (select *, c_acctbal/10000 as closeness, row_number() over (partition by cast(trunc(lat/{density.CELL_KM / density.KM_PER_DEGREE!r}e0) as bigint), cast(trunc(lon/{density.CELL_KM / density.KM_PER_DEGREE!r}e0) as bigint) order by c_acctbal desc, id) as rk from {POINTS}) where rk = 1 order by closeness desc, id limit 600),
  dens as (select a.id, count_if({km('a.lat','a.lon','b.lat','b.lon')} <= 0.5e0) as n_0, count_if({km('a.lat','a.lon','b.lat','b.lon')} <= 1.0e0) as n_1, count_if({km('a.lat','a.lon','b.lat','b.lon')} <= 2.0e0) as n_2 from pool a, {POINTS} b group by 1),
  road as (select node, avg(x) as q from (select unnest([src, dst]) as node, (src % 13)/12.0e0 as x from {CHAIN}) group by 1),
  s as (select pool.*, n_0, n_1, n_2, closeness/(select max(c_acctbal/10000) from customer) as acc, q/(select max(q) from road) as imp, n_1::double/(select max(n_1) from dens) as den,
    {", ".join(f"(row_number() over (order by n_{k}, pool.id) - 1)/(count(*) over () - 1)::double as p_{k}" for k in range(3))} from pool join dens on dens.id = pool.id join road on road.node = pool.id),
  c as (select *, 0.45e0*den + 0.35e0*acc + 0.2e0*imp as net, 1 - (greatest(p_0, p_1, p_2) - least(p_0, p_1, p_2)) as stab from s),
  {suppressed_sql("select id, lat, lon, net as score from c")}"""


def network_picks(spark, sf_dir):
    p = points(spark, sf_dir)
    nodes = p.select("id", "lat", "lon")
    edges = p.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    between = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), ((F.col("src") % 13) / 12.0).alias("betweenness"))
    return candidates.network_candidates(nodes, edges, p.select(F.col("id").alias("node"), (F.col("c_acctbal") / 10000).alias("closeness")), between)


@query(f"with recursive {NETWORK_SQL} select c.id, round(net, 8) as network_score, round(acc, 8) as accessibility_norm, round(imp, 8) as road_importance_norm, round(stab, 8) as stability_score, n_1 from c join kept on kept.id = c.id")
def network_candidates(spark, sf_dir):
    r = lambda c: F.round(c, 8).alias(c)
    return network_picks(spark, sf_dir).select("id", r("network_score"), r("accessibility_norm"), r("road_importance_norm"), r("stability_score"), "n_1")


NEAR = f"""near as (select k.id, {CATS} as c from c k join kept on kept.id = k.id join (select *, 20.0e0 + (p_partkey*37 % 1000)/10000.0e0 as lat, 100.0e0 + (p_partkey*91 % 1000)/10000.0e0 as lon from part) x on {km('k.lat','k.lon','x.lat','x.lon')} <= 0.5e0)"""
EVIDENCE = f"""{NEAR},
  w as (select id, coalesce(list_max(list_transform(c, lambda x: case x when 'commercial.supermarket' then 1.0e0 when 'catering.cafe' then 0.55e0 when 'office' then 0.45e0 when 'accommodation.hotel' then 0.85e0 when 'commercial' then 0.6e0 when 'healthcare' then 0.4e0 else 0e0 end)), 0e0) as w,
    list_distinct(list_transform(list_filter(c, lambda x: x like 'commercial%' or x like 'catering%' or x like 'accommodation%'), lambda x: split_part(x, '.', 1))) as t from near),
  ev as (select id, least(1, sum(w)/15) as econ, least(1, sum((len(t)>0)::int)*1.3e0/count(*)) as comm, least(1, len(list_distinct(flatten(list(t))))/6.0e0) as land, count(*) as n from w group by 1),
  v as (select c.id, c.lat, c.lon, stab, net, coalesce(n, 0) as n, 0.3e0*acc + 0.3e0*coalesce(econ,0) + 0.2e0*coalesce(comm,0) + 0.1e0*coalesce(land,0) + 0.1e0*net as score from c join kept on kept.id = c.id left join ev on ev.id = c.id),
  f as (select *, case when n = 0 then 'LOW' when score >= 0.6e0 and stab >= 0.7e0 then 'HIGH' when score >= 0.4e0 and stab >= 0.4e0 then 'MEDIUM' else 'LOW' end as confidence, row_number() over (order by score desc, id) as rk from v)"""


def pois(spark, sf_dir):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = F.col("p_size") % 6
    cats = F.when(r == 0, a("commercial.supermarket")).when(r == 1, a("catering.cafe", "catering")).when(r == 2, a("office")).when(r == 3, a("accommodation.hotel", "commercial")).when(r == 4, a("healthcare")).otherwise(a())
    return points(spark, sf_dir, "part", "p_partkey").select("lat", "lon", cats.alias("categories"))


def centre_candidates(spark, sf_dir):
    picks = network_picks(spark, sf_dir)
    return candidates.validated(picks, candidates.places_near(picks, pois(spark, sf_dir), most=10**6))


@query(f"with recursive {NETWORK_SQL}, {EVIDENCE} select id, round(score, 8) as cbd_score, confidence, n as poi_count, rk = 1 as is_primary from f")
def centre_diagnostics(spark, sf_dir):
    found = centre_candidates(spark, sf_dir)
    primary = density.primary_and_secondary(found).where("role = 'primary'")
    return candidates.diagnostics(found, primary).select("id", F.round("cbd_score", 8).alias("cbd_score"), "confidence", "poi_count", "is_primary")


@query(f"with recursive {NETWORK_SQL}, {EVIDENCE}, far as (select f.*, {km('p.lat','p.lon','f.lat','f.lon')} as d from f, (select lat, lon from f where rk = 1) p) select id, role, round(score, 8) as cbd_score from (select id, score, 'primary' as role from far where rk = 1 union all (select id, score, 'secondary' from far where rk > 1 and d > 0.3e0 order by score desc, id limit 5))")
def centre_detection(spark, sf_dir):
    picks = network_picks(spark, sf_dir)
    found = candidates.detected(picks, candidates.places_near(picks, pois(spark, sf_dir), most=10**6))
    return found.select("id", "role", F.round("cbd_score", 8).alias("cbd_score"))


@query(f"with recursive {NETWORK_SQL}, {EVIDENCE}, b as (select *, least(1, score + 0.25e0*greatest(0, 1-{D}/1.5e0)) as boosted from f), r as (select *, row_number() over (order by boosted desc, id) as place from b) select id, round(boosted, 8) as cbd_score from r where place = 1")
def centre_in_future(spark, sf_dir):
    found = candidates.future(centre_candidates(spark, sf_dir), 20.05, 100.05)
    return found.where("role = 'primary'").select("id", F.round("cbd_score", 8).alias("cbd_score"))


@query(f"with recursive {NETWORK_SQL}, {EVIDENCE} select c.id, round(coalesce(f.score, c.net), 8) as score, coalesce(f.confidence, 'not validated') as label from c join kept on kept.id = c.id left join f on f.id = c.id and c.id % 2 = 0")
def candidate_labels(spark, sf_dir):
    found = centre_candidates(spark, sf_dir)
    return candidates.with_scores(network_picks(spark, sf_dir), found.where("id % 2 = 0")).select("id", F.round("score", 8).alias("score"), "label")


@query(f"""select c.id as candidate_id, count(*) as n from {POINTS} c join (select 20.0e0 + (p_partkey*37 % 1000)/10000.0e0 as lat, 100.0e0 + (p_partkey*91 % 1000)/10000.0e0 as lon from part) x on {km('c.lat','c.lon','x.lat','x.lon')} <= 0.3e0 group by 1""")
def places_within(spark, sf_dir):
    return candidates.places_counted(points(spark, sf_dir), pois(spark, sf_dir), 0.3, 10**6).select("candidate_id", "n")


@query(f"""with near as (select c.id, {km('c.lat','c.lon','x.lat','x.lon')} as d from {POINTS} c join (select 20.0e0 + (p_partkey*37 % 1000)/10000.0e0 as lat, 100.0e0 + (p_partkey*91 % 1000)/10000.0e0 as lon from part) x on {km('c.lat','c.lon','x.lat','x.lon')} <= 3.0e0)
  select id as candidate_id, count(*) as n, round(max(d), 6) as farthest_km from (select *, row_number() over (partition by id order by d) as place from near) where place <= 100 group by 1""")
def nearest_hundred_places(spark, sf_dir):
    """The cap on a candidate's places, which its radius exceeds here."""
    return candidates.places_counted(points(spark, sf_dir), pois(spark, sf_dir), 3.0).select("candidate_id", "n", F.round("farthest_km", 6).alias("farthest_km"))


#: An L, with a hole in its foot.
L_SHAPE = [[(100.01005, 20.01005), (100.09005, 20.01005), (100.09005, 20.04005), (100.05005, 20.04005), (100.05005, 20.08005), (100.01005, 20.08005), (100.01005, 20.01005)], [(100.06005, 20.02005), (100.08005, 20.02005), (100.08005, 20.03005), (100.06005, 20.03005), (100.06005, 20.02005)]]
IN_L = "((lat between 20.01005e0 and 20.04005e0 and lon between 100.01005e0 and 100.09005e0 and not (lat between 20.02005e0 and 20.03005e0 and lon between 100.06005e0 and 100.08005e0)) or (lat between 20.04005e0 and 20.08005e0 and lon between 100.01005e0 and 100.05005e0))"


def graph_parts(spark, sf_dir):
    """Roads between customers, cut to the L."""
    said = F.array(*[F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ring]) for ring in L_SHAPE])
    areas = table(spark, sf_dir, "region").where("r_regionkey = 0").select(said.alias("rings"))
    edges = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), F.expr("(o_custkey * 31 + o_orderkey) % 150").alias("dst"))
    return network.in_area(points(spark, sf_dir).select("id", "lat", "lon"), edges, areas)


@query(f"select id, lat, lon from {POINTS} where {IN_L}")
def nodes_in_area(spark, sf_dir):
    return graph_parts(spark, sf_dir)[0]


@query(f"with n as (select id from {POINTS} where {IN_L}) select o_orderkey, o_custkey as src, (o_custkey * 31 + o_orderkey) % 150 as dst from orders where o_custkey in (from n) and (o_custkey * 31 + o_orderkey) % 150 in (from n)")
def edges_in_area(spark, sf_dir):
    return graph_parts(spark, sf_dir)[1]


OWN_LINE = "o_orderkey % 3 = 0"


@query(f"""with e as (select *, 100 + (o_custkey % 50)/100.0e0 as x0, 20 + (o_custkey % 40)/100.0e0 as y0, 100 + (o_orderkey % 50)/100.0e0 as x1, 20 + (o_orderkey % 40)/100.0e0 as y1 from orders)
  select o_orderkey, case when {OWN_LINE} then 3 else 2 end as n_points, round(x0, 6) as first_lon, round(case when {OWN_LINE} then 20.5e0 else y1 end, 6) as second_lat, round(y1, 6) as last_lat from e""")
def road_lines(spark, sf_dir):
    """Roads with a line of their own, and straight ones."""
    at = lambda k: F.struct((100 + (F.col(k) % 50) / 100.0).alias("lon"), (20 + (F.col(k) % 40) / 100.0).alias("lat"))
    a, b = at("o_custkey"), at("o_orderkey")
    own = F.when(F.expr(OWN_LINE), F.array(F.array(a["lon"], a["lat"]), F.array(F.lit(100.5), F.lit(20.5)), F.array(b["lon"], b["lat"])))
    line = network.line_of(own, a, b)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(line).alias("n_points"), F.round(line[0][0], 6).alias("first_lon"), F.round(line[1][1], 6).alias("second_lat"), F.round(F.element_at(line, -1)[1], 6).alias("last_lat"))


@query("select o_orderkey, case when o_orderkey % 45 <= 10 then 'step1' when o_orderkey % 45 <= 20 then 'step2' when o_orderkey % 45 <= 30 then 'step3' else 'step4' end as bucket, case when o_orderkey % 9 = 0 then '#3388ff' else ['red','green','blue'][o_orderkey % 3 + 1] end as border from orders")
def map_styles(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", geo.travel_bucket(k % 45).alias("bucket"), geo.border_colour(F.when(k % 9 > 0, k), ["red", "green", "blue"]).alias("border"))


@query("select p_partkey, round(2.0e0 * p_size * 2.0e0 * p_size * 110.574e0 * 111.320e0 * 1e-6 * cos(radians(20.0e0)), 5) as area_km2, 73 as n_points, round(20.0e0 + 1.5e0/110.574e0, 8) as top, round(100.0e0 + 1.5e0/(111.320e0*cos(radians(20.0e0))), 8) as east from part")
def polygon_areas(spark, sf_dir):
    size = F.col("p_size") * 0.001
    corner = lambda a, b: F.struct((100.0 + b * size).alias("lon"), (20.0 + a * size).alias("lat"))
    square = F.array(*[corner(a, b) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))])
    disc = geo.circle(F.lit(20.0), F.lit(100.0), F.lit(1.5))
    most = lambda c: F.round(F.array_max(F.transform(disc, lambda p: p[c])), 8)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geo.area_km2(square, F.lit(20.0)), 5).alias("area_km2"), F.size(disc).alias("n_points"), most("lat").alias("top"), most("lon").alias("east"))


RAMP_SQL = "[" + ", ".join(f"'{c}'" for c in rent.RAMP) + "]"


@query(f"select p_partkey, {RAMP_SQL}[cast(round_even(least(1, greatest(0, (p_partkey % 1003)/1000.0e0))*6, 0) as integer) + 1] as colour, printf('%.1f/100', (p_partkey % 1003) + 0.25e0) as label from part".replace("+ 0.25e0", "+ 0.3e0"))
def rent_colours(spark, sf_dir):
    v = F.col("p_partkey") % 1003
    return table(spark, sf_dir, "part").select("p_partkey", rent.ramp_colour(v / 1000.0).alias("colour"), rent.rent_label(v + 0.3, True).alias("label"))


@query("select s_suppkey, md5(printf('%.3f_%.3f_%.3f_%.3f_', 100.0e0 + s_suppkey*0.01e0, 20.0e0, 101.0e0 + s_suppkey*0.01e0, 21.0e0) || 'drive') as cache_key from supplier")
def graph_cache_keys(spark, sf_dir):
    k = F.col("s_suppkey") * 0.01
    return table(spark, sf_dir, "supplier").select("s_suppkey", tables.graph_key(F.lit(20.0), 100.0 + k, F.lit(21.0), 101.0 + k, F.lit("drive")).alias("cache_key"))


@query("select n_nationkey as request, case when n_nationkey % 4 = 3 then null when n_nationkey % 2 = 0 then 'a' else 'b' end as mirror, case when n_nationkey % 4 = 3 then 'none reachable' when n_nationkey % 4 = 0 then 'failed' else 'ok' end as status from nation")
def mirror_failover(spark, sf_dir):
    """Mirror a answers even requests (every fourth with a failure that no mirror mends), b the others but every fourth."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    one = lambda m, ok, retriable: n.select(k.alias("request"), F.lit(m).alias("mirror"), ok.alias("ok"), retriable.alias("retriable"), F.lit("e").alias("error"))
    answers = one("b", k % 4 != 3, F.lit(True)).unionByName(one("a", k % 4 == 2, k % 4 != 0))
    order = listings.mirrors_in_order(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.lit("a"))
    return listings.first_answer(answers, order).select("request", "mirror", "status")


@query("select 'f' || n_nationkey || case n_nationkey % 3 when 0 then '.JSON' else '.json' end as name, 'u' || n_nationkey as url from nation where n_nationkey % 3 < 2 and n_nationkey % 5 > 0")
def listing_json_files(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".JSON").when(k % 3 == 1, ".json").otherwise(".txt"))
    entries = table(spark, sf_dir, "nation").select(F.when(k % 5 > 0, "file").otherwise("dir").alias("type"), name.alias("name"), F.concat(F.lit("u"), k.cast("string")).alias("download_url"))
    return listings.json_files(entries)


@query("select 'g' || n_nationkey || '_cache.zip' as name, n_nationkey * 1000 // 1024 as size_kb from nation where n_nationkey % 2 = 0")
def listing_cache_archives(spark, sf_dir):
    k = F.col("n_nationkey")
    entries = table(spark, sf_dir, "nation").select(F.concat(F.lit("g"), k.cast("string"), F.when(k % 2 == 0, "_cache.zip").otherwise(".zip")).alias("name"), F.lit("u").alias("download_url"), (k * 1000).cast("long").alias("size"))
    return listings.cache_archives(entries).drop("url")


@query("select c_custkey as cache_key, case when c_custkey % 3 = 0 then 'skipped' else 'imported' end as action from customer")
def cache_imports(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cache_key"))
    return listings.to_import(c, c.where("cache_key % 3 = 0"))


@query("select count(*) as count, sum(o_orderkey * 1000)/(1024.0e0*1024.0e0) as size_mb from orders")
def cache_statistics(spark, sf_dir):
    return listings.cache_stats(table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000).alias("length")))


@query("select n_name as key, case when n_nationkey % 2 = 0 then 'remote' else 'default' end as value from nation")
def merged_settings(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    remote = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.lit("remote").alias("value")).union(n.select(F.concat(F.lit("other"), "n_name"), F.lit("x")))
    return listings.merged(n.select(F.col("n_name").alias("key"), F.lit("default").alias("value")), remote)


@query("select n_nationkey, ['ok','wrong key','no access','too many requests','error 500'][n_nationkey % 5 + 1] as status from nation")
def fetch_statuses(spark, sf_dir):
    code = F.array(*map(F.lit, (200, 401, 403, 429, 500)))[F.col("n_nationkey") % 5]
    return table(spark, sf_dir, "nation").select("n_nationkey", listings.fetch_status(code).alias("status"))
