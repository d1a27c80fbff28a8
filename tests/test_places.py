"""Graphs by arrays and by joins, places at every latitude, kept files and streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terraline.functions import geo, text
from terraline.operators import cells, clicks, density, graph, keyed, location, network, rules
from terraline.sources import configs, listings, tables


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def streets(spark):
    """Two components, parallel edges, a loop, a missing length and many equal paths."""
    rng = random.Random(1)
    rows = [(i, (i + rng.choice([1, 3])) % 14, float(rng.choice([1, 2]))) for i in range(14) for _ in range(2)]
    rows += [(0, 1, None), (5, 5, 1.0), (20, 21, 1.0), (21, 22, 2.0), (30, 30, 1.0)]
    return spark.createDataFrame(rows, "src long, dst long, length double")


def paths_of(rows):
    """Distances and numbers of shortest paths between all nodes, by Bellman's relaxation and counting."""
    best = {}
    for a, b, w in rows:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = min(best.get(key, 9e9), 1.0 if w is None else w)
    nodes = sorted({n for e in best for n in e})
    step = {n: {} for n in nodes}
    for (a, b), w in best.items():
        step[a][b] = step[b][a] = w
    d = {s: {s: 0.0} for s in nodes}
    for s in nodes:
        for _ in nodes:
            for a in list(d[s]):
                for b, w in step[a].items():
                    if d[s][a] + w < d[s].get(b, 9e9):
                        d[s][b] = d[s][a] + w
    count = {s: {s: 1} for s in nodes}
    for s in nodes:
        for b in sorted(d[s], key=d[s].get)[1:]:
            count[s][b] = sum(count[s][a] for a, w in step[b].items() if d[s][a] + w == d[s][b])
    return best, nodes, d, count


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_centralities(streets, monkeypatch, most):
    """As arrays and, with a limit of 0, by joins alone."""
    monkeypatch.setattr(graph, "MAX_BROADCAST_PAIRS", most)
    best, nodes, d, count = paths_of([tuple(r) for r in streets.collect()])
    main = max(({*d[s]} for s in nodes), key=len)
    close = {r.node: r.closeness for r in graph.closeness(streets).collect()}
    assert close == {n: pytest.approx((len(main) - 1) / sum(d[n].values())) if n in main else 0.0 for n in [*nodes, 30]}
    want = {}
    for e, w in best.items():
        want[e] = 0.0
        for s in nodes:
            for t in d[s]:
                for a, b in (e, e[::-1]):
                    if s != t and a in d[s] and d[s][a] + w + d[b].get(t, 9e9) == d[s][t]:
                        want[e] += count[s][a] * count[b][t] / count[s][t]
    n = len(nodes)
    got = {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(streets).collect()}
    assert got == {e: pytest.approx(x / (n * (n - 1))) for e, x in want.items()}


def test_sampled_centralities_do_not_depend_on_the_form(streets, monkeypatch):
    found = []
    for most in (2_000_000, 0):
        monkeypatch.setattr(graph, "MAX_BROADCAST_PAIRS", most)
        close = {r.node: (round(r.closeness, 9), r.method) for r in graph.closeness(streets, exact_up_to=5, pivots=4).collect()}
        between = {(r.a, r.b): round(r.betweenness, 9) for r in graph.edge_betweenness(streets, exact_up_to=5, k=6).collect()}
        found.append((close, between))
    assert found[0] == found[1] and found[0][0][0][1] == "4 pivots"


def test_golden_spots(spark):
    """By hand: betweenness over its most, over a node's edges, parallel ones each."""
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 2, 3.0), (2, 3, 1.0)], "src long, dst long, length double")
    got = {r.node: r for r in graph.golden_spots(edges, graph.closeness(edges), graph.edge_betweenness(edges)).collect()}
    assert got[2].rank == 1 and got[2].degree == 3 and got[2].mean_betweenness == pytest.approx(1.0)
    assert got[2].score == pytest.approx(0.5 + 0.3) and got[3].score == pytest.approx(0.5 * (2 / 3) / 1 + 0.3 / 3)
    quiet = graph.golden_spots(edges, graph.closeness(edges), graph.edge_betweenness(edges), zero_betweenness=True).first()
    assert quiet.score == pytest.approx(1.0)


def test_hop_closeness_and_empty_graphs(spark, streets):
    path = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    got = {r.node: r.closeness for r in graph.hop_closeness(path).collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.5), 3: pytest.approx(2 / 3)}
    none = streets.limit(0)
    assert graph.closeness(none).count() == 0 and graph.edge_betweenness(none).count() == 0
    found = network.layers(spark.createDataFrame([], "id long, lat double, lon double"), none)
    assert found.golden.count() == 0 and found.stats.first().status == "too few nodes"


@pytest.mark.parametrize("lat, lon", [(0.0, 0.0), (75.0, 10.0), (-75.0, 179.99), (89.99, 30.0), (60.0, -180.0)])
def test_densities_at_any_latitude(spark, lat, lon):
    rng = random.Random(lat)
    rows = [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.04, 0.04))), (lon + rng.uniform(-0.2, 0.2) + 180) % 360 - 180) for i in range(60)]
    rows += [(100, rows[0][1], rows[0][2])]
    p = spark.createDataFrame(rows, "id long, lat double, lon double")
    want = {a[0]: tuple(sum(km(a[1:], b[1:]) <= r for b in rows) for r in (0.5, 1.0, 2.0)) for a in rows}
    assert {r.id: (r.n_0, r.n_1, r.n_2) for r in density.densities(p, p).collect()} == want


@pytest.mark.parametrize("lat", [10.0, 75.0, -82.0])
def test_disc_cells_at_any_latitude(spark, lat):
    got = {(r.cy, r.cx) for r in cells.disc_cells(spark.createDataFrame([(1, lat, 179.9, 3.0)], "id int, lat double, lon double, radius_km double"), 0.01).collect()}
    want = set()
    for cy in range(round(lat * 100) - 10, round(lat * 100) + 10):
        for cx in range(-18000, 18000):
            if abs((cx + 0.5) * 0.01) > 175 and km((lat, 179.9), ((cy + 0.5) * 0.01, (cx + 0.5) * 0.01)) <= 3:
                want.add((cy, cx))
    assert got == want


def test_packing(spark):
    rooms = spark.createDataFrame([(1, i, f"r{i}", a) for i, a in enumerate([5.0, 1.0, 4.0, 2.0])] + [(2, i, f"r{i}", 0.0) for i in range(4)] + [(3, 0, "one", 7.0)], "project int, ord int, room string, area double")
    got = rules.packed(rooms, 6.0, 4.0).toPandas()
    for p, part in got.groupby("project"):
        assert (part.w * part.h).sum() == pytest.approx(24)
    one = got[got.project == 1].set_index("room")
    assert one.w["r0"] * one.h["r0"] == pytest.approx(10) and (one.x["r0"], one.y["r0"]) == (0, 0)
    assert set((got[got.project == 2].w * got[got.project == 2].h).round(6)) == {6.0}


def test_best_graphs_are_the_best_of_all_draws(spark):
    """Scores of every draw in plain Python."""
    rooms = spark.createDataFrame([(1, i, r) for i, r in enumerate(["Kitchen", "Dining", "Bedroom", "Bathroom"])] + [(2, 0, "Attic")], "project int, ord int, room string")
    pairs = rules.rule_pairs(rooms)
    graphs = rules.sampled_graphs(pairs, 20)
    drawn: dict = {}
    for r in graphs.collect():
        drawn.setdefault(r["sample"], set()).add(frozenset((r.room1, r.room2)))
    score = {}
    for s, edges in drawn.items():
        assert rules._connected(["Kitchen", "Dining", "Bedroom", "Bathroom"], [tuple(e) for e in edges])
        score[s] = sum((r.c * r.w if {r.room1, r.room2} in edges else -r.w * (r.c == 1 and r.w == 3)) for r in pairs.collect())
    best = sorted(score, key=lambda s: (-score[s], s))[:3]
    assert [(r["sample"], r.score) for r in rules.best_graphs(pairs, graphs, 3).orderBy("rank").collect()] == [(s, score[s]) for s in best]
    chain = rules.sampled_graphs(pairs.withColumns({"c": F.lit(-1), "w": F.lit(60)}), 1).collect()
    assert [(r.room1, r.room2) for r in chain] == [("Kitchen", "Dining"), ("Dining", "Bedroom"), ("Bedroom", "Bathroom")]


def test_inserts_of_one_key(spark):
    t = spark.createDataFrame([("a", 1)], "code string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 3), ("a", 2), ("c", None)], "code string, v int")
    kept, refused = keyed.insert_absent(t, new, "code", order="v")
    assert sorted(map(tuple, kept.collect()), key=str) == [("a", 1), ("b", 3), ("c", None)]
    assert sorted(map(tuple, refused.collect())) == [("a", 2), ("b", 5)]


def test_bundles(monkeypatch):
    good = configs.bundle("{}", b"x" * 100, "2025-01-01T00:00:00Z")
    assert configs.bundle_status(good) == ("ok", [])
    monkeypatch.setattr(configs, "MAX_CACHE_BYTES", 50)
    status, reasons = configs.bundle_status(good)
    assert status == "config only" and len(reasons) == 2  # too large, and so another checksum


def test_files(spark, tmp_path):
    g = spark.createDataFrame([("k1", 1), ("k2", 2)], "cache_key string, x int")
    g.write.partitionBy("cache_key").parquet(f"{tmp_path}/given")
    done = listings.copy_graphs(spark, f"{tmp_path}/given", f"{tmp_path}/kept", g.where("cache_key = 'k1'").select("cache_key"))
    assert {(r.cache_key, r.action) for r in done.collect()} == {("k1", "skipped"), ("k2", "imported")}
    assert [r.x for r in spark.read.parquet(f"{tmp_path}/kept").collect()] == [2]
    listings.write_csv(g, f"{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfcache_key,x\n")
    names = spark.createDataFrame([("osm_graph_a.parquet",), ("../osm_graph_a.parquet",), ("x.parquet",)], "name string")
    assert [r.valid for r in listings.valid_members(names).collect()] == [True, False, False]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.JSON").write_text('{"ก":\n1}', encoding="utf-8")
    (tmp_path / "texts" / "b.txt").write_text("no")
    (tmp_path / "texts" / "c.zip").write_bytes(b"zip")
    assert [(r.name, r.value, r.preview) for r in listings.preview(listings.documents(spark, f"{tmp_path}/texts"), most=3).collect()] == [("a.JSON", '{"ก":\n1}', '{"ก')]
    assert [(r.name, r.length, bytes(r.content)) for r in listings.archives(spark, f"{tmp_path}/texts").collect()] == [("c.zip", 3, b"zip")]
    tables.save_graph(g, g, str(tmp_path), "k")
    assert tables.load_graph(spark, str(tmp_path), "k")[1].count() == 2
    b = spark.createDataFrame([("A", "1m", "2025-01-01 00:00:00", 1.0), ("A", "1m", "2025-01-01 00:01:00", 2.0), ("B", "1m", "2025-01-01 00:00:00", 3.0)], "ticker string, interval string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    b.write.partitionBy("ticker", "interval").parquet(f"{tmp_path}/bars")
    assert [r.close for r in tables.bars(spark, f"{tmp_path}/bars", "A", "1m", "2025-01-01 00:00:00", "2025-01-01 00:01:00").collect()] == [1.0]


def test_shapes_of_map_files(spark):
    doc = '<kml xmlns="http://www.opengis.net/kml/2.2"><LineString><coordinates>1,2 3,4,5 x</coordinates></LineString><LineString><coordinates>1,2</coordinates></LineString><Polygon><outerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2</coordinates></LinearRing></outerBoundaryIs></Polygon></kml>'
    got = text.kml_shapes(spark.createDataFrame([(7, doc)], "id int, value string")).collect()
    assert [(r.id, r.kind, len(r.points)) for r in got] == [(7, "LineString", 2)]


def test_no_anchor_no_model(spark):
    none = spark.createDataFrame([], "idx int, lat double, lng double, active boolean")
    samples = spark.createDataFrame([(20.0, 100.0, 5.0)], "lat double, lon double, rent double")
    found = location.rent_model(none, samples)
    assert found.model.count() == 0 and found.curve.count() == 0 and found.shapes.count() == 0
    assert location.rent_model(location.reset_markers(spark), samples).model.first().is_index
