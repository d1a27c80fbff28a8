"""Queries over the shared tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraline.functions import geo, payoff, rent, text
from terraline.operators import asof, cells, clicks, density, graph, jsondoc, keyed, location, rings, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ANCHOR = (20.05, 100.05)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """The tables have no coordinates: they follow from the key."""
    k = F.col(key)
    return table(spark, sf_dir, name).withColumns({"id": k, "lat": 20.0 + (k * 37 % 1000) / 10000.0, "lon": 100.0 + (k * 91 % 1000) / 10000.0})


POINTS = "(select *, c_custkey as id, 20.0e0 + (c_custkey*37 % 1000)/10000.0e0 as lat, 100.0e0 + (c_custkey*91 % 1000)/10000.0e0 as lon from customer)"


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin((radians({lat2})-radians({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2))"
    return f"(12742.0e0*atan2(sqrt({h}), sqrt(1-{h})))"


D = km("20.05e0", "100.05e0", "lat", "lon")


def events(spark, sf_dir, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("""select v.event_id, round(p.value, 6) as price from (select * from events where event_type='view') v
  asof join (select * from events where event_type='purchase') p on v.user_id = p.user_id and v.ts >= p.ts""")
def asof_last_value(spark, sf_dir):
    found = asof.asof(events(spark, sf_dir, "view").select("event_id", "user_id", "ts"), events(spark, sf_dir, "purchase"), "user_id", "ts", "value")
    return found.where("asof_value is not null").select("event_id", F.round("asof_value", 6).alias("price"))


@query("""with v as (select * from events where event_type='view'), p as (select * from events where event_type='purchase')
  select v.event_id, round(coalesce((select max_by(value, ts) from p where p.user_id=v.user_id and p.ts<=v.ts), (select min_by(value, ts) from p where p.user_id=v.user_id)), 6) as price from v""")
def asof_with_earliest_fallback(spark, sf_dir):
    found = asof.asof(events(spark, sf_dir, "view").select("event_id", "user_id", "ts"), events(spark, sf_dir, "purchase"), "user_id", "ts", "value", earliest=True)
    return found.select("event_id", F.round("asof_value", 6).alias("price"))


LEVEL_OF = {"purchase": "1m", "click": "5m", "signup": "15m", "error": "60m"}


@query("""with r as (select event_id, user_id, ts from events where event_type='view'),
  b as (select user_id, ts, value, case event_type when 'purchase' then 0 when 'click' then 1 when 'signup' then 2 else 3 end as lvl from events where event_type<>'view'),
  w as (select * from (values (0,2700,60),(1,7200,3600),(2,21600,7200),(3,172800,86400)) t(lvl,a,z)),
  m as (select r.event_id, b.lvl, coalesce(max_by(b.value, b.ts) filter (b.ts<=r.ts), min_by(b.value, b.ts)) as price
    from r join b on r.user_id=b.user_id join w on w.lvl=b.lvl and b.ts >= r.ts - to_seconds(w.a) and b.ts < r.ts + to_seconds(w.z) group by 1,2),
  f as (select event_id, min_by(price, lvl) as price, min(lvl) as lvl from m group by 1)
  select r.event_id, round(f.price, 6) as price, ['1m','5m','15m','60m'][f.lvl+1] as level from r left join f on r.event_id=f.event_id""")
def interval_cascade(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for kv in LEVEL_OF.items() for x in kv])
    bars = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("ticker"), kind[F.col("event_type")].alias("interval"), "ts", F.col("value").alias("close"))
    asked = events(spark, sf_dir, "view").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("ticker"), "ts")
    return asof.cascade(asked, bars).select(F.col("request_id").alias("event_id"), F.round("price", 6).alias("price"), "level")


@query("""with v as (select event_id, user_id, date_trunc('minute', ts) as m from events), p as (select user_id, date_trunc('minute', ts) as m, max_by(value, ts) as price from events where event_type='purchase' group by 1,2)
  select v.event_id, round(p.price, 6) as price, case when p.price is null then 'no bar' else 'ok' end as status from v left join p on v.user_id=p.user_id and v.m=p.m""")
def strict_minute_close(spark, sf_dir):
    bars = events(spark, sf_dir, "purchase").select("user_id", "ts", F.col("value").alias("close"))
    return asof.exact_minute(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), bars, "user_id", "event_id").select("event_id", F.round("price", 6).alias("price"), "status")


RAW = "lpad(cast(1 + o_orderkey % 31 as string), 2, '0') || '/' || cast(1 + o_orderkey % 12 as string) || '/2024 ' || cast(o_orderkey % 24 as string) || ':05:' || lpad(cast(o_orderkey % 60 as string), 2, '0') || ',ab' || cast(o_orderkey % 7 as string) || '.c'"


@query(f"""with r as (select o_orderkey, {RAW.replace('string', 'varchar')} as raw from orders),
  p as (select o_orderkey, regexp_extract(raw, '^(\\d+)/(\\d+)/(\\d+) (\\d+):(\\d+):(\\d+),(.*)$', ['d','m','y','h','mi','s','t']) as x from r),
  t as (select o_orderkey, x, try_strptime(x.y||'-'||lpad(x.m,2,'0')||'-'||x.d||' '||lpad(x.h,2,'0')||':'||x.mi||':'||x.s, '%Y-%m-%d %H:%M:%S') as l from p)
  select o_orderkey, cast(epoch(l) as bigint) - 25200 as epoch_utc, case when l is null then null else upper(x.t) end as ticker,
    case when l is null then null else x.d||'/'||lpad(x.m,2,'0')||'/'||x.y||','||lpad(x.h,2,'0')||':'||x.mi||':'||x.s||','||upper(x.t) end as stamp, case when l is null then 'invalid' else 'ok' end as status from t""")
def request_parse_bangkok(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(RAW).alias("raw"))
    return text.parse_requests(asked).select("o_orderkey", F.unix_timestamp("ts_utc").alias("epoch_utc"), "ticker", "stamp", "status")


@query(f"select id, round({D}*1000, 4) as metres from {POINTS}")
def haversine_to_anchor(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(geo.haversine_m(F.lit(ANCHOR[0]), F.lit(ANCHOR[1]), F.col("lat"), F.col("lon")), 4).alias("metres"))


SAMPLES = "(select p_retailprice as rent, 20.0e0 + (p_partkey*37 % 1000)/10000.0e0 as lat, 100.0e0 + (p_partkey*91 % 1000)/10000.0e0 as lon from part)"
FIT = f"(select count(*) as n, exp(regr_intercept(ln(rent), {D})) as r0, -regr_slope(ln(rent), {D}) as lam, regr_r2(ln(rent), {D}) as r2, max({D}) as d_far from {SAMPLES} where rent > 0)"


def samples(spark, sf_dir):
    return points(spark, sf_dir, "part", "p_partkey").select("lat", "lon", F.col("p_retailprice").alias("rent"))


@query(f"select n, round(r0, 6) as r0, round(lam, 8) as lam, round(r2, 8) as r2, 'fitted' as status from {FIT}")
def rent_fit_ols(spark, sf_dir):
    return rings.fit_rents(samples(spark, sf_dir), ANCHOR).select("n", F.round("r0", 6).alias("r0"), F.round("lam", 8).alias("lam"), F.round("r2", 8).alias("r2"), "status")


MODEL = f"(select *, greatest(5.0e0, 1.05e0*d_far) as d_max from {FIT})"


@query(f"select i, round(d_max*i/79, 6) as d_km, round(r0*exp(-lam*(d_max*i/79)), 4) as rent from {MODEL}, (select cast(range as integer) as i from range(80))")
def rent_curve(spark, sf_dir):
    return rings.curve(rings.model(rings.fit_rents(samples(spark, sf_dir), ANCHOR))).select("i", F.round("d_km", 6).alias("d_km"), F.round("rent", 4).alias("rent"))


@query(f"select lam < 0 as inverted, round(ln(2.0e0)/abs(lam), 6) as half_dist_km, round(d_max, 6) as d_max_km from {MODEL}")
def rent_half_distance(spark, sf_dir):
    return rings.model(rings.fit_rents(samples(spark, sf_dir), ANCHOR)).select("inverted", F.round("half_dist_km", 6).alias("half_dist_km"), F.round("d_max_km", 6).alias("d_max_km"))


@query(f"""select cast(k as integer) as ring, round(r0*exp(-lam*((k-0.5e0)*d_max/6)), 2) as mid_rent, round(pi()*(pow(k*d_max/6,2)-pow((k-1)*d_max/6,2)), 6) as area_km2 from {MODEL}, (select range as k from range(1,7))""")
def rent_rings(spark, sf_dir):
    shapes = rings.ring_shapes(rings.model(rings.fit_rents(samples(spark, sf_dir), ANCHOR)), ANCHOR)
    return shapes.select("ring", "mid_rent", F.round("area_km2", 6).alias("area_km2"))


RAMP_SQL = "[" + ",".join(f"'{c}'" for c in rent.RAMP) + "]"


@query(f"""with r as (select *, k, k*d_max/6 as outer_km, (k-1)*d_max/6 as inner_km, exp(-lam*((k-0.5e0)*d_max/6)) as mid, exp(-lam*0.5e0*d_max/6) as a, exp(-lam*5.5e0*d_max/6) as b from {MODEL}, (select range as k from range(1,7)))
  select cast(k as integer) as ring, {RAMP_SQL}[cast(round(6*(mid - least(a, b))/(greatest(a, b) - least(a, b))) as integer) + 1] as colour, 73 as n_outer, round(100.05e0 + outer_km/(111.320e0*cos(radians(20.05e0))), 8) as outer_east, round(20.05e0 + outer_km/110.574e0, 8) as outer_top,
    case when k > 1 then round(20.05e0 - inner_km/110.574e0, 8) end as inner_quarter, case when k > 1 then round(20.05e0 + inner_km/110.574e0, 8) end as inner_three_quarters from r""")
def rent_ring_outlines(spark, sf_dir):
    """Colours and outlines; the hole runs the other way round, so its first quarter ends at the bottom."""
    shapes = rings.ring_shapes(rings.model(rings.fit_rents(samples(spark, sf_dir), ANCHOR)), ANCHOR)
    at = lambda c, i, f, name: F.round(F.col(c)[i][f], 8).alias(name)
    return shapes.select("ring", "colour", F.size("outer").alias("n_outer"), at("outer", 0, "lon", "outer_east"), at("outer", 18, "lat", "outer_top"), at("inner", 18, "lat", "inner_quarter"), at("inner", 54, "lat", "inner_three_quarters"))


STEP = 1.0
RING = f"case when floor({D}/1.0e0) < 6 then cast(floor({D}/1.0e0) as integer) when {D} <= 6.0e0 + 1e-9 then 5 end"


@query(f"select {RING} as ring, count(*) as n, round(avg(c_acctbal), 6) as mean_value, max(c_acctbal) as max_value from {POINTS} group by 1")
def ring_counts(spark, sf_dir):
    return rings.ring_counts(rings.with_distance(points(spark, sf_dir), ANCHOR), STEP, value="c_acctbal").select("ring", "n", F.round("mean_value", 6).alias("mean_value"), "max_value")


CLOSE = "((c_custkey % 97)/97.0e0)"


@query(f"""with p as (select {RING} as ring, {CLOSE} as c, c_custkey, {D} as d from {POINTS}), s as (select {RING} as ring, count(*) as n from {SAMPLES} group by 1),
  g as (select ring, string_agg('#'||rk, ', ' order by rk) as golden from (select ring, row_number() over (order by c desc, c_custkey) as rk from p) where rk <= 10 group by 1),
  a as (select ring, count(*) as n, avg(c) as m, max(c) as x from p group by 1),
  k as (select cast(range as integer) as ring from range(6) union all select null)
  select coalesce(k.ring+1, 0) as ring, round(pi()*(2*k.ring+1), 6) as area_km2, round(100*exp(-0.2e0*(k.ring+0.5e0)), 2) as mid_rent, coalesce(a.n,0) as n_points, round(100.0e0*coalesce(a.n,0)/(select count(*) from p), 6) as percent,
    round(a.m, 6) as mean_value, coalesce(g.golden, '') as golden, round(a.m - least(1, greatest(0, round(100*exp(-0.2e0*(k.ring+0.5e0)),2)/100)), 6) as value_gap, coalesce(s.n,0) as n_samples
  from k left join a on a.ring is not distinct from k.ring left join g on g.ring is not distinct from k.ring left join s on s.ring is not distinct from k.ring where k.ring is not null or a.n > 0""")
def ring_report(spark, sf_dir):
    p = rings.with_distance(points(spark, sf_dir), ANCHOR).select("id", "d_km", ((F.col("c_custkey") % 97) / 97.0).alias("closeness"))
    top = p.orderBy(F.desc("closeness"), "id").limit(10)
    from pyspark.sql import Window

    golden = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("closeness"), "id"))).select("d_km", "rank")
    out = rings.ring_report(p, golden, rings.with_distance(samples(spark, sf_dir), ANCHOR), 100.0, 0.2, 6.0)
    return out.select("ring", F.round("area_km2", 6).alias("area_km2"), "mid_rent", "n_points", F.round("percent", 6).alias("percent"), F.round("mean_value", 6).alias("mean_value"), "golden", F.round("value_gap", 6).alias("value_gap"), "n_samples")


@query(f"select round(greatest(0.3e0, max({D})), 6) as d_max_km from (select unnest([lat-0.01e0, lat-0.01e0, lat+0.01e0, lat+0.01e0]) as lat, unnest([lon-0.01e0, lon+0.01e0, lon-0.01e0, lon+0.01e0]) as lon from {POINTS})")
def dmax_bbox(spark, sf_dir):
    areas = points(spark, sf_dir).select(squares(F.col("lat"), F.col("lon"), 0.01).alias("rings"))
    return location.d_max_km(areas, ANCHOR).select(F.round("d_max_km", 6).alias("d_max_km"))


def squares(lat, lon, half: float):
    """The rings of a square around a place."""
    corner = lambda a, b: F.struct((lon + b).alias("lon"), (lat + a).alias("lat"))
    return F.array(F.array(*[corner(a, b) for a, b in ((-half, -half), (-half, half), (half, half), (half, -half), (-half, -half))]))


EDGES = "(select l_partkey % 200 as src, (l_partkey % 200 + 1 + l_suppkey % 7) % 200 as dst, 1 + (l_partkey*13 + l_suppkey*7) % 50 + l_quantity as length from lineitem)"
PAIRS = f"(select least(src,dst) as a, greatest(src,dst) as b, min(length) as length from {EDGES} where src<>dst group by 1,2)"


def street_edges(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select((p % 200).alias("src"), ((p % 200 + 1 + s % 7) % 200).alias("dst"), (1 + (p * 13 + s * 7) % 50 + F.col("l_quantity")).alias("length"))


@query(f"select * from {PAIRS}")
def parallel_edge_min(spark, sf_dir):
    return graph.collapsed(street_edges(spark, sf_dir))


@query(f"select node, count(*) as degree from (select src as node from {EDGES} union all select dst from {EDGES}) group by 1")
def node_degree(spark, sf_dir):
    return graph.degrees(street_edges(spark, sf_dir))


PARTS = "(select c_custkey as src, case when c_custkey % 5 = 0 then c_custkey else c_custkey - 1 end as dst from customer)"


@query("select node from (select unnest([c_custkey, case when c_custkey % 5 = 0 then c_custkey else c_custkey-1 end]) as node, c_custkey // 5 as part from customer) where part = (select part from (select c_custkey // 5 as part, count(*) as n from customer group by 1) order by n desc, part limit 1) group by 1")
def largest_component(spark, sf_dir):
    k = F.col("c_custkey")
    return graph.largest_component(table(spark, sf_dir, "customer").select(k.alias("src"), F.when(k % 5 == 0, k).otherwise(k - 1).alias("dst"), F.lit(1.0).alias("length")))


@query(f"""with recursive e as (select a as s, b as t, length as w from {PAIRS} union all select b, a, length from {PAIRS}),
  p(src, dst, d) using key (src, dst) as (
    select s, s, 0.0e0 from (select distinct s from e)
    union
    select n.src, n.dst, n.d from (select p.src, e.t as dst, min(p.d + e.w) as d from p join e on p.dst = e.s group by 1, 2) n left join recurring.p r on r.src = n.src and r.dst = n.dst where r.d is null or n.d < r.d)
  select dst as node, round((count(*)-1)/sum(d), 8) as closeness from p group by 1""")
def closeness_exact(spark, sf_dir):
    return graph.closeness(street_edges(spark, sf_dir)).select("node", F.round("closeness", 8).alias("closeness"))


#: Shortest paths of the street graph: distances p, steps of shortest paths g by source, path counts c.
PATHS = f"""e as (select a as s, b as t, length as w from {PAIRS} union all select b, a, length from {PAIRS}),
  p(src, dst, d) using key (src, dst) as (
    select s, s, 0.0e0 from (select distinct s from e)
    union
    select n.src, n.dst, n.d from (select p.src, e.t as dst, min(p.d + e.w) as d from p join e on p.dst = e.s group by 1, 2) n left join recurring.p r on r.src = n.src and r.dst = n.dst where r.d is null or n.d < r.d),
  g as (select x.src as s, e.s as u, e.t as v from p x join e on x.dst = e.s join p y on y.src = x.src and y.dst = e.t where x.d + e.w = y.d),
  h(s, v, k, c) as (select s, s, 0, 1.0e0 from (select distinct s from e) union all select h.s, g.v, h.k + 1, sum(h.c) from h join g on g.s = h.s and g.u = h.v group by 1, 2, 3),
  c as (select s, v, sum(c) as c from h group by 1, 2),
  bet as (select least(g.u, g.v) as a, greatest(g.u, g.v) as b, sum(su.c * vt.c / st.c) / ((select count(distinct s) from e) * ((select count(distinct s) from e) - 1)) as betweenness
    from g join c su on su.s = g.s and su.v = g.u join p sv on sv.src = g.s and sv.dst = g.v join p dt on dt.src = g.v join p sd on sd.src = g.s and sd.dst = dt.dst and sv.d + dt.d = sd.d
    join c vt on vt.s = g.v and vt.v = dt.dst join c st on st.s = g.s and st.v = dt.dst group by 1, 2)"""


@query(f"with recursive {PATHS} select x.a, x.b, round(coalesce(bet.betweenness, 0), 10) as betweenness from {PAIRS} x left join bet on bet.a = x.a and bet.b = x.b")
def edge_betweenness(spark, sf_dir):
    return graph.edge_betweenness(street_edges(spark, sf_dir)).select("a", "b", F.round("betweenness", 10).alias("betweenness"))


@query(f"""with recursive {PATHS},
  k as (select dst as node, (count(*)-1)/sum(d) as closeness from p group by 1),
  q as (select src, dst, coalesce(betweenness, 0) / (select max(betweenness) from bet) as x from {EDGES} left join bet on a = least(src, dst) and b = greatest(src, dst)),
  m as (select node, avg(x) as quiet from (select src as node, x from q union all select dst, x from q where src <> dst) group by 1),
  n as (select node, count(*) as degree from (select src as node from {EDGES} union all select dst from {EDGES}) group by 1),
  s as (select k.node, closeness, degree, quiet, 0.5e0*closeness/(select max(closeness) from k) + 0.3e0*degree/(select max(degree) from n) + 0.2e0*(1-quiet) as score from k join m on k.node=m.node join n on k.node=n.node)
  select cast(row_number() over (order by score desc, node) as integer) as rank, node, round(score, 8) as score, round(closeness, 8) as closeness, round(quiet, 8) as mean_betweenness, degree from s order by score desc, node limit 10""")
def golden_topk(spark, sf_dir):
    e = street_edges(spark, sf_dir)
    return graph.golden_spots(e, graph.closeness(e), graph.edge_betweenness(e)).select("rank", "node", *[F.round(c, 8).alias(c) for c in ("score", "closeness", "mean_betweenness")], "degree")


CATS = "case p_size % 6 when 0 then ['commercial.supermarket'] when 1 then ['catering.cafe','catering'] when 2 then ['office'] when 3 then ['accommodation.hotel','commercial'] when 4 then ['healthcare'] else [] end"


@query(f"""with p as (select p_partkey, cast(substr(p_brand, 7) as integer) as candidate_id, {CATS} as c from part),
  w as (select p_partkey, candidate_id, coalesce(list_max(list_transform(c, lambda x: case x when 'commercial.supermarket' then 1.0e0 when 'catering.cafe' then 0.55e0 when 'office' then 0.45e0 when 'accommodation.hotel' then 0.85e0 when 'commercial' then 0.6e0 when 'healthcare' then 0.4e0 else 0e0 end)), 0e0) as w,
    list_distinct(list_transform(list_filter(c, lambda x: x like 'commercial%' or x like 'catering%' or x like 'accommodation%'), lambda x: split_part(x, '.', 1))) as t from p)
  select candidate_id, round(least(1, sum(w)/15), 6) as economic_activity, round(least(1, sum((len(t)>0)::int)*1.3e0/count(*)), 6) as commercial_density, round(least(1, len(list_distinct(flatten(list(t))))/6.0e0), 6) as land_use, count(*) as poi_count, 1.0e0 as data_coverage from w group by 1""")
def poi_evidence(spark, sf_dir):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = F.col("p_size") % 6
    cats = F.when(r == 0, a("commercial.supermarket")).when(r == 1, a("catering.cafe", "catering")).when(r == 2, a("office")).when(r == 3, a("accommodation.hotel", "commercial")).when(r == 4, a("healthcare")).otherwise(a())
    places = table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 9).cast("int").alias("candidate_id"), cats.alias("categories"))
    return density.poi_evidence(places).select("candidate_id", *[F.round(c, 6).alias(c) for c in ("economic_activity", "commercial_density", "land_use")], "poi_count", "data_coverage")


CELL = 0.15 / 111.0


def nodes(spark, sf_dir):
    return points(spark, sf_dir).select("id", "lat", "lon", (F.col("c_acctbal") / 10000).alias("closeness"))


@query(f"select id, round(closeness, 8) as closeness from (select id, c_acctbal/10000 as closeness, row_number() over (partition by cast(trunc(lat/{CELL!r}e0) as bigint), cast(trunc(lon/{CELL!r}e0) as bigint) order by c_acctbal desc, id) as rk from {POINTS}) where rk = 1 order by closeness desc, id limit 600")
def cell_thinning(spark, sf_dir):
    return density.thinned(nodes(spark, sf_dir)).select("id", F.round("closeness", 8).alias("closeness"))


@query(f"select a.id, count_if({km('a.lat','a.lon','b.lat','b.lon')} <= 0.5e0) as n_0, count_if({km('a.lat','a.lon','b.lat','b.lon')} <= 1.0e0) as n_1, count_if({km('a.lat','a.lon','b.lat','b.lon')} <= 2.0e0) as n_2 from {POINTS} a, {POINTS} b group by 1")
def radius_density(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return density.densities(n, n)


@query("""with r as (select c_custkey as id, (row_number() over (partition by c_nationkey order by c_acctbal, c_custkey)-1)/greatest(count(*) over (partition by c_nationkey)-1,1)::double as a, (row_number() over (partition by c_nationkey order by c_mktsegment, c_custkey)-1)/greatest(count(*) over (partition by c_nationkey)-1,1)::double as b, count(*) over (partition by c_nationkey) as n from customer)
  select id, round(case when n=1 then 1.0e0 else 1-(greatest(a,b)-least(a,b)) end, 6) as stability from r""")
def ordinal_percentile_stability(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    a = density.ordinal_percentile(c, "c_acctbal", "id", "a", ("c_nationkey",))
    b = density.ordinal_percentile(a, "c_mktsegment", "id", "b", ("c_nationkey",))
    return b.select("id", F.round(density.stability(["a", "b"]), 6).alias("stability"))


def suppressed_sql(rows: str, spacing: str = "0.3e0", most: int = 12) -> str:
    """CTEs (after "with recursive") that keep rows (id, lat, lon, score) greedily; the kept ones are ``kept``."""
    return f"""o as (select id, lat, lon, score, row_number() over (order by score desc, id) as rk from ({rows})),
  walk(rk, kept) as (select 0::bigint, []::struct(id bigint, lat double, lon double)[]
    union all select w.rk + 1, case when len(w.kept) < {most} and len(list_filter(w.kept, lambda k: {km("o.lat", "o.lon", "k.lat", "k.lon")} < {spacing})) = 0 then list_append(w.kept, {{'id': o.id, 'lat': o.lat, 'lon': o.lon}}) else w.kept end from walk w join o on o.rk = w.rk + 1),
  kept as (select unnest(kept).id as id from (select kept from walk order by rk desc limit 1))"""


THIN = f"select id, lat, lon, closeness as score from (select id, lat, lon, c_acctbal/10000 as closeness, row_number() over (partition by cast(trunc(lat/{CELL!r}e0) as bigint), cast(trunc(lon/{CELL!r}e0) as bigint) order by c_acctbal desc, id) as rk from {POINTS}) where rk = 1 order by closeness desc, id limit 600"


@query(f"with recursive {suppressed_sql(THIN)} select o.id, round(o.score, 6) as score from o join kept on o.id = kept.id")
def nms_candidates(spark, sf_dir):
    thin = density.thinned(nodes(spark, sf_dir)).select("id", "lat", "lon", F.col("closeness").alias("score"), F.lit(0).alias("pool"))
    return density.suppressed(thin).select("id", F.round("score", 6).alias("score"))


SCORE = "((c_custkey%11)/10.0e0*0.4e0 + (c_custkey%7)/6.0e0*0.35e0 + (c_custkey%5)/4.0e0*0.25e0)"


def scored(spark, sf_dir):
    k = F.col("c_custkey")
    parts = {"accessibility": (k % 11) / 10.0, "economic_activity": (k % 7) / 6.0, "network_centrality": (k % 5) / 4.0}
    out = points(spark, sf_dir).withColumns(parts)
    return out.withColumns({"cbd_score": density.cbd_score({"accessibility": 0.4, "economic_activity": 0.35, "network_centrality": 0.25}), "stability_score": (k % 10) / 10.0, "data_coverage": (k % 3 > 0).cast("double")})


@query(f"select id, round({SCORE}, 6) as cbd_score, case when c_custkey%3=0 then 'LOW' when round({SCORE},9) >= 0.6e0 and c_custkey%10 >= 7 then 'HIGH' when round({SCORE},9) >= 0.4e0 and c_custkey%10 >= 4 then 'MEDIUM' else 'LOW' end as confidence from {POINTS}")
def cbd_score_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("cbd_score", 6).alias("cbd_score"), density.confidence(F.round("cbd_score", 9), F.col("stability_score"), F.col("data_coverage")).alias("confidence"))


@query(f"select id, round(0.25e0*greatest(0, 1-{D}/1.5e0), 6) as future_boost, round(least(1, {SCORE} + 0.25e0*greatest(0, 1-{D}/1.5e0)), 6) as cbd_score from {POINTS}")
def future_boost(spark, sf_dir):
    boost = density.future_boost(F.col("d_km"))
    return rings.with_distance(scored(spark, sf_dir), ANCHOR).select("id", F.round(boost, 6).alias("future_boost"), F.round(F.least(F.lit(1.0), F.col("cbd_score") + boost), 6).alias("cbd_score"))


def scenarios(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return payoff.with_defaults(p.select("p_partkey", (5.0 + F.col("p_size") % 7).alias("x0_1"), (8.0 + F.col("p_size") % 5).alias("x0_2"), (F.col("p_size") * 3.0).alias("b1")))


GRID = "(select p_partkey, cast(range as integer) as i, 3.0e0 + range*(14.0e0/100) as x, 5.0e0+p_size%7 as a, 8.0e0+p_size%5 as z, p_size*3.0e0 as b1 from part, range(101))"
Y1, Y8, Y9 = "(1500.0e0*ln(x/a) + b1)", "(greatest(0, x-a)*100 - 260.0e0)", "(greatest(0, z-x)*100 - 260.0e0)"
Y2 = "(case when 2 - x/z > 0 then 1500.0e0*ln(case when 2 - x/z > 0 then 2 - x/z else 1 end) end)"


@query(f"select p_partkey, i, round(x, 6) as x, round({Y1}, 6) as y1_d2, round({Y2}, 6) as y2_d2, round({Y2}*(case when x<z then 1.0e0 else 0.2e0 end), 6) as y4, round({Y8}, 6) as y8, round({Y9}, 6) as y9, round((x-7)*100, 6) as y10, round((10-x)*100, 6) as y11 from {GRID}")
def payoff_grid(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("x", "y1_d2", "y2_d2", "y4", "y8", "y9", "y10", "y11")]
    return payoff.by_settings(scenarios(spark, sf_dir), "p_partkey", lambda s: payoff.series(payoff.grid(s)).select("p_partkey", "i", *rounded))


@query(f"select p_partkey, i, round({Y1}+{Y8}+{Y9}, 6) as y3_d2, round({Y1}+{Y8}+{Y9} - 1500.0e0*ln(x/7.0e0), 6) as overlay from {GRID}")
def payoff_net(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("y3_d2", "overlay")]
    return payoff.by_settings(scenarios(spark, sf_dir), "p_partkey", lambda s: payoff.series(payoff.grid(s)).select("p_partkey", "i", *rounded))


@query(f"""with g as (select p_partkey, i, x, {Y1}+{Y8}+{Y9} as y from {GRID}), p as (select p_partkey, i, x as b, y as v, lag(x) over w as a, lag(y) over w as u from g window w as (partition by p_partkey order by i))
  select p_partkey, i as place, round(case when u=0 then a when v=0 then b else a+(b-a)*(-u/(v-u)) end, 6) as root from p where u is not null and v is not null and (u=0 or v=0 or u*v<0)""")
def zero_crossings(spark, sf_dir):
    found = payoff.by_settings(scenarios(spark, sf_dir), "p_partkey", lambda s: payoff.zero_crossings(payoff.series(payoff.grid(s)), "p_partkey", "i", "x", "y3_d2"))
    return found.select("p_partkey", "place", F.round("root", 6).alias("root"))


@query("""with e as (select event_id, user_id, ts, event_type in ('view','click') as on_, value as b1, 1000.0e0 as c1, 5.0e0+event_id%7 as a, 8.0e0+event_id%5 as z from events), t as (select *, on_ and not coalesce(lag(on_) over (partition by user_id order by ts), false) as turned from e),
  s as (select *, last_value(case when turned then b1 end ignore nulls) over (partition by user_id order by ts rows unbounded preceding) as base from t)
  select event_id, round(case when on_ then base + 500.0e0*ln(z/a) else b1 end, 6) as b1_new from s""")
def auto_rollover(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").isin("view", "click").alias("on"), F.col("value").alias("b1"), F.lit(0.0).alias("b2"), F.lit(1500.0).alias("refConst"), F.lit(1000.0).alias("constant1"), F.lit(1000.0).alias("constant2"), (5.0 + k % 7).alias("x0_1"), (8.0 + k % 5).alias("x0_2"))
    return payoff.rollover(e, "user_id", "ts", "on").select("event_id", F.round("b1_new", 6).alias("b1_new"))


@query("select p_partkey, round(5.0e0+p_size%7 + 2.6e0, 6) as be_call, round(8.0e0+p_size%5 - 2.6e0, 6) as be_put from part")
def break_even(spark, sf_dir):
    return payoff.break_evens(scenarios(spark, sf_dir)).select("p_partkey", F.round("be_call", 6).alias("be_call"), F.round("be_put", 6).alias("be_put"))


def coupons(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_mktsegment").alias("status"), F.round("c_acctbal", 2).alias("value"))


NEW = "(select cast(c_custkey*3 as varchar) as code, 'vip' as status, 1.5e0 as value from customer)"
OLD = "(select cast(c_custkey as varchar) as code, c_mktsegment as status, round(c_acctbal, 2) as value from customer)"


def new_coupons(spark, sf_dir):
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).cast("string").alias("code"), F.lit("vip").alias("status"), F.lit(1.5).alias("value"))


@query(f"select coalesce(n.code, o.code) as code, coalesce(n.status, o.status) as status, coalesce(n.value, o.value) as value from {OLD} o full join {NEW} n on o.code=n.code")
def coupon_upsert(spark, sf_dir):
    return keyed.upsert(coupons(spark, sf_dir), new_coupons(spark, sf_dir), "code")


@query(f"select * from {OLD} union all select * from {NEW} n where n.code not in (select code from {OLD})")
def coupon_insert_absent(spark, sf_dir):
    return keyed.insert_absent(coupons(spark, sf_dir), new_coupons(spark, sf_dir), "code")[0]


@query(f"select * from {OLD} o where o.code not in (select code from {NEW})")
def coupon_delete(spark, sf_dir):
    return keyed.delete(coupons(spark, sf_dir), new_coupons(spark, sf_dir), "code")


@query("select event_id, 'u'||user_id as code, 'active' as status, cast(json_extract(props, '$.k') as varchar) as value from events")
def coupon_scan(spark, sf_dir):
    text_ = F.concat(F.lit('{"u'), F.col("user_id").cast("string"), F.lit('": {"status": "active", "value": '), F.get_json_object("props", "$.k"), F.lit('}, "odd": 1}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(keyed.json_map(text_, ("status", "value"))).alias("r"))
    return rows.select("event_id", "r.code", "r.status", "r.value")


@query("""select event_id, '{"a":'||json_extract(props, '$.k')||',"b":[{"c":3}],"t":"ก"}' as minified from events""")
def json_prune_minify(spark, sf_dir):
    doc = F.concat(F.lit('{"a": '), F.get_json_object("props", "$.k"), F.lit(', "designer": {"x": 1}, "b": [ {"expect": 2, "c": 3} ], "t": "ก"}'))
    return table(spark, sf_dir, "events").select("event_id", jsondoc.prune_minify(doc).alias("minified"))


DISCS = "(select c_custkey % 40 as id, 20.0e0 + (c_custkey % 40)*0.0005e0 as lat, 100.0e0 + (c_custkey % 40)*0.0003e0 as lon, max(0.5e0 + (c_custkey % 3)*0.2e0) + 1.5e0 as radius_km from customer group by 1, 2, 3)"
DISC_CELLS = f"""(select id, cy, cx from (select d.*, y.range as cy, x.range as cx from {DISCS} d, range(19950, 20080) y, range(99950, 100060) x) where {km('lat', 'lon', '((cy+0.5e0)*0.001e0)', '((cx+0.5e0)*0.001e0)')} <= radius_km)"""


def discs(spark, sf_dir):
    k = F.col("c_custkey") % 40
    return table(spark, sf_dir, "customer").groupBy(k.alias("id")).agg((F.max(0.5 + (F.col("c_custkey") % 3) * 0.2) + 1.5).alias("radius_km")).select("id", (20.0 + F.col("id") * 0.0005).alias("lat"), (100.0 + F.col("id") * 0.0003).alias("lon"), "radius_km")


@query(f"select cy, cx from {DISC_CELLS} group by 1, 2 having count(distinct id) = 40")
def cell_intersection(spark, sf_dir):
    return cells.intersection(cells.disc_cells(discs(spark, sf_dir)), 40)


@query(f"select count(*) as n_cells, round(sum(110.574e0*111.320e0*1e-6*cos(radians((cy+0.5e0)*0.001e0))), 4) as area_km2 from (select distinct cy, cx from {DISC_CELLS})")
def cell_union_area(spark, sf_dir):
    return cells.area_km2(cells.union(cells.disc_cells(discs(spark, sf_dir)))).select("n_cells", F.round("area_km2", 4).alias("area_km2"))


@query(f"""with recursive e as (select event_id, user_id, ts, 20.0e0 + event_id % 3 * 0.00004e0 as lat, 100.0e0 + event_id % 5 * 0.00004e0 as lon, row_number() over (partition by user_id order by ts) as rk from events),
  kept as (select * from e where rk = 1
    union all select unnest(x) from (select min_by({{'event_id': e.event_id, 'user_id': e.user_id, 'ts': e.ts, 'lat': e.lat, 'lon': e.lon, 'rk': e.rk}}, e.rk) as x from kept k join e on e.user_id = k.user_id and e.rk > k.rk and epoch_us(e.ts) - epoch_us(k.ts) >= 500000 and 1000*{km("k.lat", "k.lon", "e.lat", "e.lon")} >= 10.0e0 group by k.user_id, k.rk))
  select event_id, user_id from kept""")
def debounce(spark, sf_dir):
    e = F.col("event_id")
    return clicks.debounce(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (20.0 + e % 3 * 0.00004).alias("lat"), (100.0 + e % 5 * 0.00004).alias("lon"))).select("event_id", "user_id")


ROOMS = ("Kitchen", "Dining", "Living Area", "Bedroom", "Bathroom", "Closet")


def projects(spark, sf_dir):
    rooms = F.posexplode(F.array(*map(F.lit, ROOMS)))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), rooms.alias("ord", "room"))


def project_edges(spark, sf_dir):
    p = rules.rule_pairs(projects(spark, sf_dir))
    return p.where((F.col("project") + F.col("i") * 3 + F.col("j")) % 3 > 0).select("project", F.col("room2").alias("room1"), F.col("room1").alias("room2"))


RULE_SQL = "(values " + ",".join(f"('{a}','{b}',{c},{w})" for a, b, c, w in rules.RULES) + ") r(a,b,c,w)"
ROOM_SQL = "(values " + ",".join(f"({i},'{r}')" for i, r in enumerate(ROOMS)) + ")"
PAIR_SQL = f"""(select n_nationkey as project, x.i as i, y.i as j, x.room as room1, y.room as room2, coalesce(r.c,0) as c, coalesce(r.w,0) as w, (n_nationkey + x.i*3 + y.i) % 3 > 0 as present
  from nation, {ROOM_SQL} x(i,room) join {ROOM_SQL} y(i,room) on x.i<y.i left join {RULE_SQL} on (r.a=x.room and r.b=y.room) or (r.a=y.room and r.b=x.room))"""


@query(f"""select project, cast(sum(case when present then c*w else 0 end - case when c=1 and w=3 and not present then w else 0 end) as bigint) as score, cast(sum(greatest(c*w,0)) as bigint) as s_max, round(least(100, greatest(0, 100.0e0*sum(case when present then c*w else 0 end - case when c=1 and w=3 and not present then w else 0 end)/sum(greatest(c*w,0)))), 6) as quality, count_if(present) as n_edges, count_if((c=1 and w=3 and not present) or (c=-1 and w=3 and present)) as n_violations from {PAIR_SQL} group by 1""")
def rule_matrix_score(spark, sf_dir):
    found = rules.graph_scores(rules.rule_pairs(projects(spark, sf_dir)), project_edges(spark, sf_dir))
    return found.withColumn("quality", F.round("quality", 6))


@query(f"select project, room1, room2, case when c=1 then 'missing' else 'present' end as violation from {PAIR_SQL} where (c=1 and w=3 and not present) or (c=-1 and w=3 and present)")
def rule_violations(spark, sf_dir):
    return rules.violations(rules.rule_pairs(projects(spark, sf_dir)), project_edges(spark, sf_dir))


def rects(spark, sf_dir):
    return rules.packed(projects(spark, sf_dir).withColumn("area", 6.0 + (F.col("project") + F.col("ord") * 5) % 9), 12.0, 9.0)


PACK_SQL = f"""with recursive a as (select n_nationkey as project, i, room, 6.0e0 + (n_nationkey + i * 5) % 9 as area from nation, {ROOM_SQL} r(i, room)),
  u as (select project, list_concat([0.0e0], list(upto order by i)) as upto, list(room order by i) as rooms from (select *, sum(area) over (partition by project order by i) as upto from a) group by 1),
  t(project, lo, hi, x, y, w, h) as (select project, 0::bigint, 6::bigint, 0.0e0, 0.0e0, 12.0e0, 9.0e0 from u
    union all select project, case side when 0 then lo else cut end, case side when 0 then cut else hi end, case when side = 1 and w >= h then x + w * p else x end, case when side = 1 and w < h then y + h * p else y end,
      case when w >= h then (case side when 0 then w * p else w - w * p end) else w end, case when w >= h then h else (case side when 0 then h * p else h - h * p end) end
    from (select *, (upto[cut + 1] - upto[lo + 1]) / (upto[hi + 1] - upto[lo + 1]) as p from (select t.*, u.upto, list_min(list_transform(range(lo + 1, hi), lambda k: {{'d': abs(u.upto[k + 1] - u.upto[lo + 1] - (u.upto[hi + 1] - u.upto[lo + 1]) / 2), 'k': k}})).k as cut from t join u on u.project = t.project where hi - lo > 1)), (values (0), (1)) s(side))"""


@query(f"{PACK_SQL} select t.project, rooms[lo + 1] as room, round(x, 3) as x, round(y, 3) as y, round(w, 3) as w, round(h, 3) as h from t join u on u.project = t.project where hi - lo = 1")
def treemap_pack(spark, sf_dir):
    return rects(spark, sf_dir).select("project", "room", *[F.round(c, 3).alias(c) for c in ("x", "y", "w", "h")])


#: The first 40 attempts of each sample: all of them are disconnected with a chance of less than one in 10**9.
DRAWN = f"""p as (select *, 1 / (1 + exp(greatest(-50, least(50, -c * w / 0.7e0)))) as chance from {PAIR_SQL}),
  d as (select p.project, s.range as sample, t.range as attempt, p.i, p.j, p.c, p.w, ('0x' || substr(md5('1:' || p.project || ':' || s.range || ':' || t.range || ':' || p.i || ':' || p.j), 1, 8))::bigint / 4294967296.0e0 < chance as present from p, range(100) s, range(40) t),
  m as (select project, sample, attempt, list(mask order by room) as masks from (select project, sample, attempt, room, bit_or(1 << other) as mask from (select project, sample, attempt, i as room, j as other from d where present union all select project, sample, attempt, j, i from d where present union all select project, sample, attempt, r.range, r.range from (select distinct project, sample, attempt from d), range(6) r) group by all) group by all),
  r0 as (select *, 1::bigint as reach from m),
  {", ".join(f"r{k} as (select * replace (list_reduce(list_transform(list_filter(range(6), lambda i: (reach >> i) & 1 = 1), lambda i: masks[i + 1]), lambda a, b: a | b) as reach) from r{k - 1})" for k in range(1, 6))},
  f as (select project, sample, min(attempt) as attempt from r5 where reach = 63 group by all),
  z as (select project, sample, cast(sum(case when present then c*w else 0 end - case when c=1 and w=3 and not present then w else 0 end) as bigint) as score, count_if(present) as n_edges, count_if((c=1 and w=3 and not present) or (c=-1 and w=3 and present)) as n_violations from d join f using (project, sample, attempt) group by all)"""


@query(f"with {DRAWN} select project, cast(rank as integer) as rank, cast(sample as integer) as sample, score, n_edges, n_violations from (select *, row_number() over (partition by project order by score desc, sample) as rank from z) where rank <= 5")
def graph_sampling(spark, sf_dir):
    pairs = rules.rule_pairs(projects(spark, sf_dir))
    return rules.best_graphs(pairs, rules.sampled_graphs(pairs), top=5).select("project", "rank", "sample", "score", "n_edges", "n_violations")


@query("""select project, id, room, warning from (select n_nationkey as project, 'f'||n_nationkey as id, 'Kitchen' as room, case when 0.5e0*(n_nationkey%5) + 2.0e0 > 3.01e0 then 'beyond its room' end as warning from nation
  union all select n_nationkey, 'o'||n_nationkey, 'Kitchen', case when n_nationkey%2=0 and 0.5e0+0.1e0*(n_nationkey%6) < 0.8e0 then 'narrow door' when n_nationkey%2=1 and 0.5e0+0.1e0*(n_nationkey%6) < 0.6e0 then 'narrow window' end from nation) where warning is not null""")
def furniture_checks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    one = lambda kind: [k.alias("project"), F.concat(F.lit(kind), k.cast("string")).alias("id"), F.lit("Kitchen").alias("room")]
    f = n.select(*one("f"), (k % 5 * 0.5).alias("x_m"), F.lit(0.0).alias("y_m"), F.lit(2.0).alias("w_m"), F.lit(1.0).alias("d_m"))
    o = n.select(*one("o"), F.when(k % 2 == 0, "door").otherwise("window").alias("type"), (0.5 + k % 6 * 0.1).alias("width_m"))
    room = n.select(k.alias("project"), F.lit("Kitchen").alias("room"), F.lit(3.0).alias("w"), F.lit(4.0).alias("h"))
    return rules.furniture_warnings(f, o, room)


@query("select s_suppkey, unnest(['LineString','Polygon']) as kind, unnest([2, 4]) as n_points, unnest([100.0e0 + s_suppkey%10, 1.0e0]) as first_lon from supplier")
def kml_parse(spark, sf_dir):
    doc = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><LineString><coordinates>'), (100 + F.col("s_suppkey") % 10).cast("string"), F.lit(",20,0 bad 101,21</coordinates></LineString></Placemark><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>"))
    shapes = text.kml_shapes(table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("value")))
    return shapes.select("s_suppkey", "kind", F.size("points").alias("n_points"), F.col("points")[0]["lon"].alias("first_lon"))
