"""Hand-derived numbers for the operators outside the training-data subpackage."""

import json
import math

import pytest
from pyspark.sql import functions as F

from terraline.functions import geo, payoff, rent, text
from terraline.operators import asof, cells, clicks, density, graph, jsondoc, keyed, rings, rules
from terraline.sources import configs, tables


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_haversine(spark):
    r = one(spark, a=geo.haversine_m(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), b=geo.haversine_m(*map(F.lit, (20.219443, 100.40363, 20.23, 100.41))), c=geo.haversine_m(*map(F.lit, (20.23, 100.41, 20.219443, 100.40363))))
    assert r.a == pytest.approx(111194.9266, abs=1e-3) and r.b == pytest.approx(1348.9818, abs=1e-3) and r.c == pytest.approx(r.b)


def test_requests(spark):
    raw = ["27/10/2025 20:38:59 APLS", "27-10-2025,20:38:59,brk.b", "31/02/2025 20:38:59 A", "27/10/2025 20:38 A", None]
    out = text.parse_requests(spark.createDataFrame([(r,) for r in raw], "raw string")).select(F.unix_timestamp("ts_utc").alias("t"), "ticker", "stamp", "status").collect()
    assert [r.status for r in out] == ["ok", "ok", "invalid", "invalid", "invalid"]
    assert out[0].t == 1761572339 and out[1].ticker == "BRK.B" and out[0].stamp == "27/10/2025,20:38:59,APLS"


def test_fit_recovers_a_noiseless_model(spark):
    pts = [(20.0, 100.0 + k / 100) for k in range(1, 8)]
    s = rings.with_distance(spark.createDataFrame(pts, "lat double, lon double"), (20.0, 100.0)).withColumn("rent", 100 * F.exp(-0.3 * F.col("d_km")))
    m = rings.fit_rents(s, (20.0, 100.0)).first()
    assert m.r0 == pytest.approx(100) and m.lam == pytest.approx(0.3) and m.r2 == pytest.approx(1)
    few = rings.fit_rents(spark.createDataFrame([(20.0, 100.1, 5.0), (20.0, 100.1, 6.0), (20.0, 100.2, -1.0), (20.0, 100.3, float("nan"))], "lat double, lon double, rent double"), (20.0, 100.0)).first()
    assert few.n == 2 and few.status == "too few" and few.r0 is None


def test_index_model(spark):
    empty = rings.fit_rents(spark.createDataFrame([], "lat double, lon double, rent double"), (20.0, 100.0))
    m = rings.model(empty, 5.0)
    r = m.first()
    assert r.is_index and r.lam == pytest.approx(math.log(4) / 5) and r.half_dist_km == pytest.approx(2.5)
    shapes = rings.ring_shapes(m, (20.0, 100.0)).orderBy("ring").collect()
    assert [s.mid_rent for s in shapes] == [89.09, 70.71, 56.12, 44.54, 35.36, 28.06]
    assert [round(s.area_km2, 4) for s in shapes] == [2.1817, 6.545, 10.9083, 15.2716, 19.635, 23.9983]
    assert len(shapes[0].outer) == 73 and shapes[0].inner is None
    assert rings.curve(m).where("i = 79").first().rent == pytest.approx(25)


def test_ring_edges(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (6.0,), (6.0 + 1e-12,), (6.1,)], "d double")
    assert [r[0] for r in d.select(rent.ring_index(F.col("d"), F.lit(1.0))).collect()] == [0, 1, 5, 5, None]


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, "a", 1)], "id int, k string, ts long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0)], "k string, ts long, v double")
    got = {r.id: r.asof_value for r in asof.asof(left, right, "k", "ts", "v").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: None}
    assert {r.id: r.asof_value for r in asof.asof(left, right, "k", "ts", "v", earliest=True).collect()}[4] == 1.0


def test_payoff_defaults_and_roots(spark):
    points = payoff.series(payoff.grid(payoff.with_defaults(spark.range(1))))
    at10 = points.where("i = 50").first()
    assert at10.y1_d2 == pytest.approx(535.0124, abs=1e-4) and at10.y1_d1 == pytest.approx(107.0025, abs=1e-4)
    assert (at10.y8, at10.y9) == (pytest.approx(40), pytest.approx(-260)) and at10.y3_d2 == pytest.approx(315.0124, abs=1e-4)
    assert payoff.zero_crossings(points, "id", "i", "x", "y3_d2").first().root == pytest.approx(8.106076, abs=1e-6)
    assert payoff.series(payoff.grid(payoff.with_defaults(spark.range(1))), active=()).where("y3_d1 <> 0").count() == 0
    exact = spark.createDataFrame([(1, 0, 0.0, -1.0), (1, 1, 1.0, 0.0), (1, 2, 2.0, 1.0), (1, 3, 3.0, None)], "k int, i int, x double, y double")
    assert [r.root for r in payoff.zero_crossings(exact, "k", "i", "x", "y").collect()] == [1.0, 1.0]


def test_rollover(spark):
    e = spark.createDataFrame([(1, 1, False, 3.0, 3.0), (1, 2, True, 0.0, 0.0), (1, 3, True, 9.0, 9.0)], "k int, t int, on boolean, b1 double, b2 double").withColumns({"refConst": F.lit(1500.0), "constant1": F.lit(1000.0), "constant2": F.lit(1000.0), "x0_1": F.lit(7.0), "x0_2": F.lit(10.0)})
    r = payoff.rollover(e, "k", "t", "on").orderBy("t").collect()
    assert r[0].b1_new == 3 and r[1].b1_new == pytest.approx(178.3375, abs=1e-4) and r[2].b2_new == pytest.approx(-178.3375, abs=1e-4)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 5.0), (2, 3, None), (3, 3, 1.0), (7, 8, 1.0)], "src int, dst int, length double")
    close = {r.node: r.closeness for r in graph.closeness(e).collect()}
    assert close == {1: pytest.approx(2 / 3), 2: 1.0, 3: pytest.approx(2 / 3), 7: 0.0, 8: 0.0}
    between = {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(e.where("src < 7")).collect()}
    assert between == {(1, 2): pytest.approx(2 / 3), (2, 3): pytest.approx(2 / 3)}
    assert {r.node: r.degree for r in graph.degrees(e).collect()}[3] == 3
    d = graph.distances(graph.collapsed(e), spark.createDataFrame([(1,)], "node int"))
    assert {r.node: r.d for r in d.collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in graph.connected_components(path).collect()} == {0}


def test_density_and_suppression(spark):
    p = spark.createDataFrame([(1, 20.0, 100.0, 1.0), (2, 20.0026, 100.0, 0.9), (3, 20.01, 100.0, 0.9), (4, -20.0, 100.0, 0.1)], "id int, lat double, lon double, score double").withColumn("pool", F.lit(0))
    assert [r.n_0 for r in density.densities(p, p).orderBy("id").collect()] == [2, 2, 1, 1]
    assert [r.id for r in density.suppressed(p).collect()] == [1, 3, 4]
    ranks = density.ordinal_percentile(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, v int"), "v", "id", "p").orderBy("id").collect()
    assert [r.p for r in ranks] == [0.0, 0.5, 1.0]
    places = spark.createDataFrame([(1, ["commercial.supermarket"]), (1, ["catering.restaurant"]), (1, ["office"]), (2, None)], "candidate_id int, categories array<string>")
    got = {r.candidate_id: r for r in density.poi_evidence(places).collect()}
    assert got[1].commercial_density == pytest.approx(0.866667, abs=1e-6) and got[1].economic_activity == pytest.approx(2.15 / 15) and got[2].data_coverage == 0


def test_keyed(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "code string, v int")
    n = spark.createDataFrame([("b", None), ("c", 3)], "code string, v int")
    assert sorted(map(tuple, keyed.upsert(t, n, "code").collect()), key=str) == [("a", 1), ("b", None), ("c", 3)]
    kept, refused = keyed.insert_absent(t, n, "code")
    assert kept.count() == 3 and [r.code for r in refused.collect()] == ["b"]
    r = one(spark, a=keyed.json_map(F.lit('{"x": {"status": "s"}, "y": 1}'), ("status",)), b=keyed.json_map(F.lit('[{"x": 1}]'), ("status",)))
    assert [(x.code, x.status) for x in r.a] == [("x", "s")] and r.b is None
    assert [x.code for x in keyed.repdigits(spark, 5, "vip", "t").collect()][0] == "11111"


def test_json(spark):
    docs = ['{"a":1,"designer":{},"b":[{"expect":2,"c":3}]}', "{bad", None, '{"z": "ก", "a": {"restore": {"a": 1}}}']
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(jsondoc.prune_minify(F.col("d"))).collect()]
    assert got == ['{"a":1,"b":[{"c":3}]}', None, None, '{"z":"ก","a":{}}']


def test_cells(spark):
    square = [(0.0, 0.0), (0.02, 0.0), (0.02, 0.02), (0.0, 0.02), (0.0, 0.0)]
    p = spark.createDataFrame([(1, [[{"lon": x, "lat": y} for x, y in square]])], "id int, rings array<array<struct<lon: double, lat: double>>>")
    got = cells.polygon_cells(p)
    assert got.count() == 400
    assert cells.intersection(got, 1).count() == 0 and cells.union(got.union(got)).count() == 400


def test_clicks(spark):
    rows = [(1, 0.0, 20.0), (1, 0.2, 21.0), (1, 1.0, 20.0), (1, 2.0, 20.1), (2, 0.1, 20.0)]
    df = spark.createDataFrame(rows, "user_id int, t double, lat double").select("user_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "lat", F.lit(100.0).alias("lon"))
    assert sorted((r.user_id, r.lat) for r in clicks.debounce(df).collect()) == [(1, 20.0), (1, 20.1), (2, 20.0)]


def test_rules(spark):
    rooms = spark.createDataFrame([(1, i, r) for i, r in enumerate(["Kitchen", "Dining", "Living Area", "Bedroom", "Bathroom", "Closet"])], "project int, ord int, room string")
    pairs = rules.rule_pairs(rooms)
    none = spark.createDataFrame([], "project int, room1 string, room2 string")
    s = rules.graph_scores(pairs, none).first()
    assert (s.s_max, s.score) == (18, -12)
    rects = rules.packed(rooms.withColumn("area", F.lit(10.0)), 10.0, 6.0).toPandas()
    assert (rects.w * rects.h).sum() == pytest.approx(60)
    g = rules.sampled_graphs(pairs, 5)
    assert g.select("sample").distinct().count() == 5
    assert g.exceptAll(rules.sampled_graphs(pairs, 5)).count() == 0


def test_configs(spark):
    c = spark.createDataFrame([('{"version": "1.2.0", "params": {"callContracts": 2.5, "delta1": "x", "x1Range": [1, 2]}}',)], "value string")
    r = configs.payoff_scenarios(c).first()
    assert r.callContracts == 2 and r.delta1 == 0.2 and (r.lo, r.hi) == (1, 2) and r.known_version
    assert "api_key" not in configs.app_config(spark, spark.createDataFrame([(0, 1.0, 2.0, True)], "idx int, lat double, lng double, active boolean"), {"api_key": "k", "travel_mode": "drive"}).first().value
    b = configs.bundle("{}", b"", "2025-01-01T00:00:00Z")
    assert configs.bundle_status(b)[0] == "ok" and configs.bundle_status(b"no")[0] == "refused"


def test_isochrones(spark):
    fc = {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}, "properties": {"value": 600, "original_index": 3}}]}
    r = tables.isochrones(spark.createDataFrame([(json.dumps(fc),)], "value string")).first()
    assert r.orig_idx == 3 and r.minutes == 10 and r.rings[0][1].lat == 4


def test_locators(spark):
    said = ["https://github.com/o/r/blob/main/a/b.json", "o/r/x@dev", "o/r/x.json", "https://github.com/o/r"]
    got = [r[0].kind for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.locator(F.col("s"))).collect()]
    assert got == ["raw", "api", "raw", "browse"]


def test_graph_sampling_draws_all(spark, monkeypatch):
    """The query draws a hundred graphs a project and keeps the five best."""
    from terraline.operators import rules
    from terraline.plans import catalogue

    drawn, draw = [], rules.sampled_graphs
    monkeypatch.setattr(rules, "sampled_graphs", lambda *a, **k: drawn.append(draw(*a, **k)) or drawn[-1])
    ranks = {r["rank"] for r in catalogue.graph_sampling(spark, "/root/testdata/sf0.001").select("rank").distinct().collect()}
    assert ranks == {1, 2, 3, 4, 5} and drawn[0].select("sample").distinct().count() == 100


def test_equal_settings_once(spark, monkeypatch):
    """Scenarios with equal settings, nulls too, are worked once; the rows are those of all scenarios worked by themselves."""
    many = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 4 * 1.5).alias("x0_1"), (F.col("id") % 2 == 0).alias("showY1"))
    s = payoff.preset(payoff.with_defaults(many), "none").withColumns({"showY1": F.col("k") % 2 == 0, "showY8": F.lit(True)})
    worked = []

    def work(some):
        worked.append(some.count())
        return payoff.tab_series(payoff.series(payoff.grid(some, 4)), "k", "delta2")

    once = sorted(map(tuple, payoff.by_settings(s, "k", work).collect()), key=str)
    monkeypatch.setattr(payoff, "MAX_SETTINGS", 3)
    each = sorted(map(tuple, payoff.by_settings(s, "k", work).collect()), key=str)
    assert once == each and len(once) == 40 * 5 + 20 * 5 and worked == [4, 40]
