"""Queries of room plans, payoff settings, configurations and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraline.functions import payoff, text
from terraline.operators import drawing, jsondoc, keyed, location, rules
from terraline.plans.catalogue import GRID, ROOM_SQL, ROOMS, Y1, Y8, Y9, project_edges, projects, query, scenarios, table
from terraline.sources import configs, listings


def plan_documents(spark, sf_dir):
    """A plan for each nation: three rooms, a rule that is said twice, one with a room that isn't there; every fifth plan
    has no rules, every seventh is no JSON."""
    k = F.col("n_nationkey").cast("string")
    rooms = F.concat(F.lit('"Space_Requirement": [{"room": "Kitchen", "net_area_sqm": 10}, {"room": "Dining", "net_area_sqm": '), k, F.lit('.5}, {"room": "Bedroom", "net_area_sqm": 12}]'))
    said = F.concat(F.lit('"Adjacency_Rules": [{"room1": "Dining", "room2": "Kitchen", "Connectivity_C": -1, "Importance_W": 1}, {"room1": "Kitchen", "room2": "Attic", "Connectivity_C": 1, "Importance_W": 3}, {"room1": "Kitchen", "room2": "Dining", "Connectivity_C": 1, "Importance_W": '), F.expr("cast(n_nationkey % 4 as string)"), F.lit("}]"))
    edges = F.concat(F.lit('"Adjacency": [{"room1": "Kitchen", "room2": "Dining", "score": '), F.expr("cast(n_nationkey % 5 - 1 as string)"), F.lit('}, {"room1": "Attic", "room2": "Dining", "score": 3}, {"room1": "Dining", "room2": "Bedroom", "score": 2}]'))
    whole = F.concat(F.lit("{"), rooms, F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit(", "), said)).otherwise(""), F.lit(", "), edges, F.lit("}"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.when(F.col("n_nationkey") % 7 == 6, "{broken").otherwise(whole).alias("value"))


def plans(spark, sf_dir):
    return rules.plans(plan_documents(spark, sf_dir))


@query("select n_nationkey as project, case when n_nationkey % 7 = 6 then 'invalid' when n_nationkey % 5 = 0 then 'no rules' else 'ok' end as status from nation")
def plan_statuses(spark, sf_dir):
    return plans(spark, sf_dir).select("project", "status")


@query("select n_nationkey as project, 'Dining' as room1, 'Kitchen' as room2, 1 as c, n_nationkey % 4 as w from nation where n_nationkey % 5 > 0 and n_nationkey % 7 < 6")
def plan_rules(spark, sf_dir):
    return rules.plan_rules(plans(spark, sf_dir))


@query("""select n_nationkey as project, room1, room2, c, w from nation, (values ('Kitchen','Dining',1,3),('Kitchen','Bedroom',-1,3),('Dining','Bedroom',0,0)) d(room1, room2, c, w) where not (n_nationkey % 2 = 0 and n_nationkey % 7 < 6)
  union all select n_nationkey, room1, room2, case when room1 = 'Kitchen' and room2 = 'Dining' and n_nationkey % 5 > 0 then 1 else 0 end, case when room1 = 'Kitchen' and room2 = 'Dining' and n_nationkey % 5 > 0 then n_nationkey % 4 else 0 end from nation, (values ('Kitchen','Dining'),('Kitchen','Bedroom'),('Dining','Bedroom')) d(room1, room2) where n_nationkey % 2 = 0 and n_nationkey % 7 < 6
  union all select n_nationkey, room1, room2, c, w from nation, (values ('Kitchen','Closet',0,0),('Dining','Closet',0,0),('Bedroom','Closet',1,3)) d(room1, room2, c, w) where n_nationkey % 2 = 1""")
def pairs_of_plans(spark, sf_dir):
    """The plan's rules where its rooms are the chosen ones: even nations choose them, odd ones a closet too."""
    rooms = F.posexplode(F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, ("Kitchen", "Dining", "Bedroom")))).otherwise(F.array(*map(F.lit, ("Kitchen", "Dining", "Bedroom", "Closet")))))
    chosen = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), rooms.alias("ord", "room"))
    return rules.pairs_of_plans(chosen, plans(spark, sf_dir)).select("project", "room1", "room2", "c", "w")


@query("select n_nationkey as project, unnest(['Kitchen','Dining']) as room1, unnest(['Dining','Bedroom']) as room2, unnest([n_nationkey % 5 - 1, 2]) as score, unnest([[0.02e0, 1.0e0, 1.0e0, 2.5e0, 4.0e0][n_nationkey % 5 + 1], 2.5e0]) as pull from nation where n_nationkey % 7 < 6")
def plan_edges(spark, sf_dir):
    return rules.plan_edges(plans(spark, sf_dir))


@query("select n_nationkey as project, unnest(['Kitchen','Dining','Bedroom']) as room, unnest([n_nationkey % 5 - 1, 0, 2]) as with_dining, unnest([0, 2, 0]) as with_bedroom from nation where n_nationkey % 7 < 6")
def plan_matrix(spark, sf_dir):
    m = rules.adjacency_matrix(plans(spark, sf_dir))
    return m.select("project", "room", F.col("scores")["Dining"].alias("with_dining"), F.col("scores")["Bedroom"].alias("with_bedroom"))


@query("""select project, room, round(net, 6) as net, round(net*0.2e0, 6) as circulation, round(net*1.2e0, 6) as gross, round(net*1.2e0*72/(sum(net) over (partition by project)*1.2e0), 6) as area
  from (select n_nationkey as project, unnest(['Kitchen','Dining','Bedroom']) as room, unnest([10.0e0, n_nationkey + 0.5e0, 12.0e0]) as net from nation where n_nationkey % 7 < 6)""")
def plan_space(spark, sf_dir):
    t = rules.space_table(rules.plan_rooms(plans(spark, sf_dir)), 0.2, 72.0)
    return t.select("project", "room", *[F.round(c, 6).alias(c) for c in ("net", "circulation", "gross", "area")])


@query("select n_nationkey as project, round(22.5e0 + n_nationkey, 6) as net, round((22.5e0 + n_nationkey)*1.2e0, 6) as gross, round(72/((22.5e0 + n_nationkey)*1.2e0), 6) as scale, round(100*(22.5e0 + n_nationkey)*1.2e0/72, 6) as coverage from nation where n_nationkey % 7 < 6")
def plan_totals(spark, sf_dir):
    t = rules.site_totals(rules.plan_rooms(plans(spark, sf_dir)), 0.2, 72.0)
    return t.select("project", *[F.round(c, 6).alias(c) for c in ("net", "gross", "scale", "coverage")])


@query("""select n_nationkey as project, '{"Packed_Plan":[{"room":"Kitchen","x":0.0,"y":0.0,"w":12.0,"h":6.0}],"Openings":' || case when n_nationkey % 2 = 0 then '[{"id":"o","width_m":' || (n_nationkey + 0.5e0) || '}]' else '[]' end || ',"Furniture":[{"id":"f","w_m":0.5}],"metadata":{"site_width_m":12.0,"site_length_m":6.0,"scale_factor":1.5,"total_net_sqm":40.0,"total_gross_sqm":48.0}}' as design from nation""")
def design_documents(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"))
    rooms = n.select("project", F.lit(0).alias("ord"), F.lit("Kitchen").alias("room"), F.lit(40.0).alias("net"))
    totals = rules.site_totals(rooms, 0.2, 72.0)
    rects = rules.packed(rules.space_table(rooms, 0.2, 72.0), 12.0, 6.0)
    return rules.design_json(rects, n.where("project % 2 = 0").select("project", F.lit("o").alias("id"), (F.col("project") + F.lit(0.5)).alias("width_m")), n.select("project", F.lit("f").alias("id"), F.lit(0.5).alias("w_m")), totals, 12.0, 6.0)


EDGE_SQL = f"""(select n_nationkey as project, x.room as room1, y.room as room2 from nation, {ROOM_SQL} x(i,room) join {ROOM_SQL} y(i,room) on x.i<y.i where (n_nationkey + x.i*3 + y.i) % 3 > 0 and (n_nationkey % 4 > 0 or y.i < 5))"""


@query(f"""with recursive e as (select * from {EDGE_SQL} union all select project, room2, room1 from {EDGE_SQL}), r(project, room) as (select n_nationkey, 'Kitchen' from nation union select e.project, e.room2 from r join e on e.project = r.project and e.room1 = r.room)
  select project, count(*) = 6 as connected from r group by 1""")
def graph_connected(spark, sf_dir):
    edges = project_edges(spark, sf_dir).where("project % 4 > 0 or (room1 <> 'Closet' and room2 <> 'Closet')")
    return rules.connected(projects(spark, sf_dir), edges)


@query(f"""select project, string_agg('{{"room1":"' || room1 || '","room2":"' || room2 || '","score":' || case when q >= 3 then 3 when q >= 2 then 2 when q >= 1 then 1 else -1 end || ',"reason":"Q=' || q || ' (C=' || case when c = 1 then 'Direct' else 'Indirect' end || ', W=' || case w when 3 then 'High' when 2 then 'Medium' else 'Low' end || ')"}}', ',' order by room1, room2) as edges from (select *, c * w as q from (select n_nationkey as project, 'Kitchen' as room1, 'Dining' as room2, 1 as c, n_nationkey % 4 as w from nation union all select n_nationkey, 'Bedroom', 'Kitchen', -1, 3 from nation)) group by 1""")
def adjacency_documents(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("project"), F.lit("Kitchen").alias("room1"), F.lit("Dining").alias("room2"), F.lit(1).alias("c"), (F.col("n_nationkey") % 4).alias("w")).union(n.select("n_nationkey", F.lit("Bedroom"), F.lit("Kitchen"), F.lit(-1), F.lit(3)))
    return rules.adjacency_json(edges).select("project", F.regexp_extract("plan", r"^\{\"Adjacency\":\[(.*)\]\}$", 1).alias("edges"))


WALLS = "['south','north','west','odd']"


@query(f"""with o as (select n_nationkey as project, {WALLS}[n_nationkey % 4 + 1] as wall, n_nationkey * 0.1e0 as off from nation), c as (select project, case when wall in ('south','north') then 1 + off when wall = 'west' then 1.0e0 else 6.0e0 end as x0, case when wall = 'south' then 2.0e0 when wall = 'north' then 6.0e0 else 2 + off end as y0, wall in ('south','north') as flat from o)
  select project, round(x0, 6) as x0, round(y0, 6) as y0, round(case when flat then x0 + 0.9e0 else x0 end, 6) as x1, round(case when flat then y0 else y0 + 0.9e0 end, 6) as y1 from c""")
def opening_lines(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    openings = n.select(k.alias("project"), F.lit("Kitchen").alias("room"), F.array(*map(F.lit, ("south", "north", "west", "odd")))[k % 4].alias("wall"), (k * 0.1).alias("offset_m"), F.lit(None).cast("double").alias("width_m"))
    rects = n.select(k.alias("project"), F.lit("Kitchen").alias("room"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(5.0).alias("w"), F.lit(4.0).alias("h"))
    return rules.opening_lines(openings, rects).select("project", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("select n_nationkey as project, round(1 + n_nationkey*0.1e0, 6) as x0, 2.0e0 as y0, round(1.5e0 + n_nationkey*0.1e0, 6) as x1, 3.5e0 as y1, case when n_nationkey % 2 = 1 then round(0.7e0 + n_nationkey*0.1e0, 6) end as clear_x0, case when n_nationkey % 2 = 1 then 3.8e0 end as clear_y1 from nation")
def furniture_boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    f = n.select(k.alias("project"), F.lit("Kitchen").alias("room"), (k * 0.1).alias("x_m"), F.lit(None).cast("double").alias("y_m"), F.lit(None).cast("double").alias("w_m"), F.lit(1.5).alias("d_m"), F.when(k % 2 == 1, 0.3).alias("clearance_m"))
    rects = n.select(k.alias("project"), F.lit("Kitchen").alias("room"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    return rules.furniture_boxes(f, rects).select("project", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "clear_x0", "clear_y1")])


@query("select n_nationkey as project, n_nationkey % 3 < 2 as beside from nation")
def rooms_beside(spark, sf_dir):
    """Rectangles that touch, overlap the tolerance, or lie apart."""
    k = F.col("n_nationkey")
    box = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h"))
    return table(spark, sf_dir, "nation").select(k.alias("project"), rules.beside(box(F.lit(0.0)), box(2.0 + F.array(F.lit(0.0), F.lit(0.05), F.lit(0.5))[k % 3])).alias("beside"))


@query("""select n_nationkey, case when n_nationkey % 4 = 0 then 'invalid' when n_nationkey % 4 = 1 then 'empty' else 'ok' end as status, case when n_nationkey % 4 = 2 then '"walk"' when n_nationkey % 4 = 3 then '[5,10]' end as setting, case when n_nationkey % 4 = 2 then '{"new":1}' when n_nationkey % 4 = 3 then '{"old":2}' end as result, case when n_nationkey % 4 = 2 then 1 end as n_markers from nation""".replace("'\"walk\"'", "'walk'"))
def config_imports(spark, sf_dir):
    """Nested results, flat ones of the old form that win, settings that aren't on the list, no JSON, nothing."""
    k = F.col("n_nationkey") % 4
    new = '{"format_version": 2, "markers": [{"lat": 1.5, "lng": 2.5, "active": true}], "settings": {"travel_mode": "walk", "api_key": "k"}, "precomputed_results": {"network_data": {"new":1}}}'
    old = '{"settings": {"travel_mode": [5,10]}, "precomputed_results": {"network_data": {"new":1}}, "network_data": {"old":2}}'
    said = F.when(k == 0, "{no").when(k == 2, new).when(k == 3, old)
    found = configs.read_app_config(table(spark, sf_dir, "nation").select("n_nationkey", said.alias("value")))
    return found.select("n_nationkey", "status", F.try_element_at("settings", F.lit("travel_mode")).alias("setting"), F.try_element_at("results", F.lit("network_data")).alias("result"), F.when(F.col("markers").isNotNull(), F.size("markers")).alias("n_markers"))


@query("""select '{"format_version":2,"markers":[' || (select string_agg('{"lat":' || (20.5e0 + n_nationkey*0.25e0) || ',"lng":' || (100.5e0 + n_nationkey*0.25e0) || ',"active":' || (n_nationkey % 2 = 0) || '}', ',' order by n_nationkey) from nation)
  || '],"settings":{"travel_mode":"drive","time_intervals":[' || (select string_agg(cast(5*(r_regionkey + 1) as varchar), ',' order by r_regionkey) from region) || ']},"precomputed_results":{"isochrone_data":null,"intersection_data":null,"network_data":{"edges":' || (select count(*) from lineitem) || '},"rent_gradient_data":{"samples":' || (select count(*) from customer) || '}}}' as value""")
def config_export(spark, sf_dir):
    """Markers, settings and results as tables hold them; a key that isn't a setting stays behind."""
    k = F.col("n_nationkey")
    markers = table(spark, sf_dir, "nation").select(k.alias("idx"), (20.5 + k * 0.25).alias("lat"), (100.5 + k * 0.25).alias("lng"), (k % 2 == 0).alias("active"))
    minutes = table(spark, sf_dir, "region").agg(F.to_json(F.array_sort(F.collect_list(5 * (F.col("r_regionkey") + 1)))).alias("value")).select(F.lit("time_intervals").alias("key"), "value")
    fixed = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "travel_mode").otherwise("api_key").alias("key"), F.when(F.col("r_regionkey") == 0, '"drive"').otherwise('"never"').alias("value"))
    counted = lambda name, key, field: table(spark, sf_dir, name).agg(F.to_json(F.struct(F.count("*").alias(field))).alias("value")).select(F.lit(key).alias("key"), "value")
    return configs.app_config_from(markers, minutes.unionByName(fixed), counted("lineitem", "network_data", "edges").unionByName(counted("customer", "rent_gradient_data", "samples")))


@query("select p_partkey, least(50, greatest(0.1e0, p_size * 2.0e0)) as x0_1, least(10000, greatest(100.0e0, p_size * 10.0e0)) as constant1, cast(least(10000, p_size * 300) as double) as callContracts, p_size % 2 = 0 as showY2, true as showY1, p_size % 3 = 0 as known_version from part")
def payoff_imports(spark, sf_dir):
    s = F.col("p_size").cast("string")
    said = F.concat(F.lit('{"version": "'), F.when(F.col("p_size") % 3 == 0, "1.1.1").otherwise("9"), F.lit('", "params": {"x0_1": '), (F.col("p_size") * 2).cast("string"), F.lit(', "constant1": "'), (F.col("p_size") * 10).cast("string"), F.lit('", "callContracts": '), (F.col("p_size") * 300).cast("string"), F.lit('}, "toggles": {"showY2": '), (F.col("p_size") % 2 == 0).cast("string"), F.lit("}}"))
    found = configs.payoff_toggles(configs.payoff_scenarios(table(spark, sf_dir, "part").select("p_partkey", said.alias("value"))))
    return found.select("p_partkey", "x0_1", "constant1", "callContracts", "showY2", "showY1", "known_version")


@query("select p_partkey, 5.0e0 + p_size % 7 as x0_1, p_size * 3.0e0 as b1, true as showY3, false as showY1 from part")
def payoff_round_trip(spark, sf_dir):
    """Exported and read again, after the preset that shows the net only."""
    shown = payoff.preset(scenarios(spark, sf_dir), "net")
    said = configs.payoff_config(shown, "2025-01-01T00:00:00Z").select("p_partkey", "value")
    return configs.payoff_toggles(configs.payoff_scenarios(said)).select("p_partkey", "x0_1", "b1", "showY3", "showY1")


@query("select p_partkey, b1, b2 from (select p_partkey, -1000.0e0 as b1, 1000.0e0 as b2 from part)")
def payoff_demo_bias(spark, sf_dir):
    return payoff.preset(scenarios(spark, sf_dir), "demo bias").select("p_partkey", "b1", "b2")


def of_shown(spark, sf_dir, work):
    """``work`` on what the tab shows of each part's scenario."""
    s = payoff.preset(scenarios(spark, sf_dir), "none").withColumns({"showY1": F.lit(True), "showY8": F.lit(True), "showY9": F.col("p_partkey") % 2 == 0})
    return payoff.by_settings(s, "p_partkey", lambda some: work(payoff.tab_series(payoff.series(payoff.grid(some)), "p_partkey", "delta2")))


SHOWN = f"(select p_partkey, i, x, unnest(case when p_partkey % 2 = 0 then ['y1_d2', 'y8', 'y9'] else ['y1_d2', 'y8'] end) as series, unnest(case when p_partkey % 2 = 0 then [{Y1}, {Y8}, {Y9}] else [{Y1}, {Y8}] end) as y from {GRID})"


@query(f"select p_partkey, series, count(*) as n, round(sum(y), 4) as total from {SHOWN} group by 1, 2")
def payoff_tab_series(spark, sf_dir):
    return of_shown(spark, sf_dir, lambda shown: shown.groupBy("p_partkey", "series").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total")))


@query(f"select p_partkey, round(least(0, min(y)), 6) as low, round(greatest(0, max(y)), 6) as high from {SHOWN} group by 1")
def payoff_axis(spark, sf_dir):
    return of_shown(spark, sf_dir, lambda shown: payoff.axis(shown, "p_partkey").select("p_partkey", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")))


@query("select event_id, n + 29 as size_before, n + 6 as size_after, round(100.0e0*23/(n + 29), 6) as reduction from (select event_id, length(json_extract(props, '$.k')::varchar) as n from events)")
def json_reduction(spark, sf_dir):
    doc = F.concat(F.lit('{"a": '), F.get_json_object("props", "$.k"), F.lit(', "designer": {"x": 1}}'))
    docs = table(spark, sf_dir, "events").select("event_id", doc.alias("doc")).withColumn("minified", jsondoc.prune_minify(F.col("doc")))
    return jsondoc.reduction(docs, "doc", "minified").select("event_id", "size_before", "size_after", F.round("reduction", 6).alias("reduction"))


@query("select n_nationkey, ['ok','no data','format','no data'][n_nationkey % 4 + 1] as status from nation")
def coupon_statuses(spark, sf_dir):
    said = F.array(F.lit('{"a": {"status": "vip"}, "b": 1}'), F.lit("{}"), F.lit('[{"x": 1}]'), F.lit(None).cast("string"))[F.col("n_nationkey") % 4]
    return table(spark, sf_dir, "nation").select("n_nationkey", keyed.map_status(said).alias("status"))


@query("select 'c' || n_nationkey as code, case when n_nationkey % 2 = 0 then 'vip' end as status, case when n_nationkey % 2 = 1 then cast(n_nationkey as varchar) end as value from nation")
def coupon_union(spark, sf_dir):
    """Entries with different fields, as one table."""
    k = F.col("n_nationkey").cast("string")
    said = F.concat(F.lit('{"c'), k, F.when(F.col("n_nationkey") % 2 == 0, '": {"status": "vip"}, "odd": 3}').otherwise(F.concat(F.lit('": {"value": '), k, F.lit("}}"))))
    rows = table(spark, sf_dir, "nation").select(F.explode(keyed.json_rows(said)).alias("r")).select("r.*")
    return keyed.unioned(rows)


@query("""with held as (select cast(o_orderkey as varchar) as code, 'sold' as status, o_orderkey % 7 as value from orders where o_orderkey % 2 = 1)
  select code, status, cast(value as bigint) as value from held union all select code, 'vip', 5 from (select repeat(cast(range as varchar), 5) as code from range(1, 10)) where code not in (select code from held)""")
def coupon_repdigits(spark, sf_dir):
    """Repdigit codes go into a table of coupons that lacks them."""
    k = F.col("o_orderkey")
    held = table(spark, sf_dir, "orders").where(k % 2 == 1).select(k.cast("string").alias("code"), F.lit("sold").alias("status"), (k % 7).cast("long").alias("value"))
    new = keyed.repdigits(spark, 5, "vip", "2025-01-01").select("code", "status", F.col("value").cast("long").alias("value"))
    return keyed.insert_absent(held, new, "code")[0]


@query("""select n_nationkey, ['raw','raw','browse','raw','api','raw'][n_nationkey % 6 + 1] as kind, ['https://raw.githubusercontent.com/o/r/main/a.json','https://raw.githubusercontent.com/o/r/dev/x/b.json','https://github.com/o/r/tree/dev/x','https://other.example/c.json','https://api.github.com/repos/o/r/contents/x?ref=dev','https://raw.githubusercontent.com/o/r/master/x.json'][n_nationkey % 6 + 1] as url from nation""")
def repository_locators(spark, sf_dir):
    said = F.array(*map(F.lit, ("https://raw.githubusercontent.com/o/r/main/a.json", "https://github.com/o/r/blob/dev/x/b.json", "https://github.com/o/r/tree/dev/x", "https://other.example/c.json", "o/r/x@refs/heads/dev", "o/r/x.json")))[F.col("n_nationkey") % 6]
    return table(spark, sf_dir, "nation").select("n_nationkey", text.locator(said).alias("l")).select("n_nationkey", "l.kind", "l.url")


@query("select n_nationkey, ['https://api.github.com/repos/o/r/contents/x/y?ref=dev','https://api.github.com/repos/o/r/contents/?ref=master'][n_nationkey % 2 + 1] as url from nation")
def repository_listings(spark, sf_dir):
    said = F.array(F.lit("https://github.com/o/r/tree/dev/x/y"), F.lit("https://github.com/o/r"))[F.col("n_nationkey") % 2]
    return table(spark, sf_dir, "nation").select("n_nationkey", text.browse_listing(said).alias("url"))


@query("select n_nationkey, 'doc' || n_nationkey || '_minified.json' as name from nation")
def minified_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", listings.minified_name(F.concat(F.lit("doc"), F.col("n_nationkey").cast("string"), F.lit(".json"))).alias("name"))


@query("select n_nationkey from nation where n_nationkey < 12")
def fresh_results(spark, sf_dir):
    now = F.to_timestamp(F.lit("2025-01-01 12:00:00"))
    kept = table(spark, sf_dir, "nation").select("n_nationkey", (now - F.make_interval(secs=F.col("n_nationkey") * 300 + 1.0)).alias("written_at"))
    return location.still_fresh(kept, now).select("n_nationkey")


@query(f"select n_nationkey as project, room, round(cos(2*pi()*i/6), 8) as x, round(sin(2*pi()*i/6), 8) as y, round(greatest(44, 7*(n_nationkey + i + 0.5e0)), 6) as size from nation, {ROOM_SQL} r(i,room)")
def rooms_on_a_circle(spark, sf_dir):
    rooms = projects(spark, sf_dir).withColumn("net", F.col("project") + F.col("ord") + F.lit(0.5))
    return drawing.on_circle(rooms).select("project", "room", *[F.round(c, k).alias(c) for c, k in (("x", 8), ("y", 8), ("size", 6))])


@query("""with l as (select p_partkey, p_size*1.0e0 as x0, (p_partkey % 7)*0.5e0 as y0, (p_partkey % 13)*1.0e0 as x1, (p_size % 5)*0.5e0 as y1 from part),
  c as (select *, case when (x0+y0) - 2*floor((x0+y0)/2) > 1 then 0.15e0 else -0.15e0 end as s from l), m as (select *, (x0+x1)/2 - (y1-y0)*s as cx, (y0+y1)/2 + (x1-x0)*s as cy from c),
  p as (select *, unnest(range(30)) as i, unnest(range(30))/29.0e0 as t from m)
  select p_partkey, cast(i as integer) as i, round((1-t)*(1-t)*x0 + 2*(1-t)*t*cx + t*t*x1, 6) as x, round((1-t)*(1-t)*y0 + 2*(1-t)*t*cy + t*t*y1, 6) as y from p where x0 <> x1 or y0 <> y1 or i = 0""")
def linking_curves(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    points = drawing.curves(table(spark, sf_dir, "part"), ["p_partkey"], size * F.lit(1.0), k % 7 * F.lit(0.5), k % 13 * F.lit(1.0), size % 5 * F.lit(0.5))
    return points.select("p_partkey", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def rooms_by_springs(spark, sf_dir):
    """Rooms packed in the order of their heights among springs. SQL has no such placement; tests hold small cases."""
    rooms = projects(spark, sf_dir).withColumn("area", F.lit(12.0))
    edges = project_edges(spark, sf_dir).withColumn("score", F.when(F.col("room1") == "Dining", 3).otherwise(1))
    places = drawing.by_springs(rooms, edges)
    return rules.packed(drawing.by_height(rooms, places), 12.0, 6.0).join(places.withColumnsRenamed({"x": "drawn_x", "y": "drawn_y"}), ["project", "room"])


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as price, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as bundle, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '.000000Z', 'Z') as export, strftime(ts, '%Y%m%d_%H%M%S') as file from events")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[text.stamp(F.col("ts"), k).alias(k) for k in text.STAMPS])


@query("select s_nationkey, string_agg(60*m, ',' order by m) as ranges from (select s_nationkey, s_suppkey % 17 + 1 as m from supplier) group by 1")
def request_ranges(spark, sf_dir):
    minutes = F.collect_list(F.col("s_suppkey") % 17 + 1)
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(text.requested_ranges(minutes).alias("ranges"))
