"""Exact overlay of polygons against areas known by hand and by a count of crossings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraline.operators import overlay

KIND = "id long, rings array<array<struct<lon:double,lat:double>>>"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


L_SHAPE = ring((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
HOLE = [box(0, 0, 3, 3), box(1, 1, 2, 2)]


def measure(spark, rows, pick, tile=0.7, **more):
    pieces = overlay.coverage(spark.createDataFrame(rows, KIND), tile_deg=tile, **more)
    return overlay.measured(pick(pieces)).first()


@pytest.mark.parametrize("tile", [0.37, 0.7, 10.0])
def test_known_shapes(spark, tile):
    one = lambda rows, pick=overlay.union: measure(spark, rows, pick, tile)
    m = one([(1, [box(0, 0, 1, 1)]), (2, [box(0.5, 0.5, 1.5, 1.5)])])
    assert (m.area_deg2, m.lat, m.lon, m.south, m.east) == pytest.approx((1.75, 0.75, 0.75, 0.0, 1.5), abs=1e-9)
    m = one([(1, [box(0, 0, 1, 1)]), (2, [box(0.5, 0.5, 1.5, 1.5)])], lambda p: overlay.intersection(p, 2))
    assert (m.area_deg2, m.lat, m.lon) == pytest.approx((0.25, 0.75, 0.75), abs=1e-9)
    m = one([(1, [L_SHAPE])])
    assert (m.area_deg2, m.lat, m.lon) == pytest.approx((3, 2.5 / 3, 2.5 / 3), abs=1e-9)
    m = one([(1, HOLE)])
    assert (m.area_deg2, m.lat, m.lon) == pytest.approx((8, 1.5, 1.5), abs=1e-9)
    m = one([(1, HOLE), (2, [box(1, 1, 2, 2)])])  # the hole is filled, along touching edges
    assert m.area_deg2 == pytest.approx(9, abs=1e-9)
    m = one([(1, [box(0, 0, 1, 1)]), (2, [box(1, 0, 2, 1)])], lambda p: overlay.intersection(p, 2))
    assert m.area_deg2 is None and m.area_km2 is None
    m = one([(1, [ring((0, 0), (2, 2), (2, 0), (0, 2))])])  # a bow
    assert m.area_deg2 == pytest.approx(2, abs=1e-9)
    m = one([(1, [ring((0, 0), (4, 0), (2, 4))]), (2, [ring((0, 3), (2, -1), (4, 3))])], lambda p: overlay.intersection(p, 2))
    assert (m.area_deg2, m.lat, m.lon) == pytest.approx((5.25, 1.5, 2), abs=1e-9)


def test_odd_rows_and_copies(spark):
    rows = [(1, [box(0, 0, 1, 1)])] * 5 + [(2, None), (3, []), (4, [ring((0, 0), (1, 1))]), (5, [ring((0, 0), (float("nan"), 1), (2, 2))]), (None, [box(0, 0, 1, 2)])]
    pieces = overlay.coverage(spark.createDataFrame(rows, KIND))
    by_n = {r.n: r.a for r in pieces.groupBy("n").agg(F.sum((F.col("right0") - F.col("left0")) * (F.col("y1") - F.col("y0"))).alias("a")).collect()}
    assert by_n == {1: pytest.approx(1), 2: pytest.approx(1)}
    assert overlay.coverage(spark.createDataFrame([], KIND)).count() == 0


def even_odd(rings, x, y):
    inside = False
    for r in rings:
        pts = [(p["lon"], p["lat"]) for p in r]
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


@pytest.mark.parametrize("edges", [512, 8])
def test_any_place_lies_in_as_many_ids_as_brute_force_says(spark, monkeypatch, edges):
    """Random stars, polygons of one id that overlap, tiles that are split, at random places."""
    monkeypatch.setattr(overlay, "MAX_EDGES", edges)
    rng = random.Random(edges)

    def star(x, y):
        turns = sorted(rng.uniform(0, 2 * np.pi) for _ in range(rng.randint(3, 9)))
        return ring(*[(x + rng.uniform(0.1, 1) * np.cos(t), y + rng.uniform(0.1, 1) * np.sin(t)) for t in turns])

    rows = [(i % 7, [star(rng.uniform(-1, 2), rng.uniform(-1, 2))]) for i in range(24)]
    pieces = overlay.coverage(spark.createDataFrame(rows, KIND), tile_deg=1.0).toPandas()
    for _ in range(400):
        x, y = rng.uniform(-2, 3), rng.uniform(-2, 3)
        want = len({i for i, rings in rows if even_odd(rings, x, y)})
        at = pieces[(pieces.y0 <= y) & (y < pieces.y1)]
        t = (y - at.y0) / (at.y1 - at.y0)
        got = at[(at.left0 + t * (at.left1 - at.left0) <= x) & (x < at.right0 + t * (at.right1 - at.right0))]
        assert got.n.sum() == want and len(got) <= 1


def test_pieces_can_be_overlaid_again(spark):
    """An intersection of unions: each owner's union first, then what both have."""
    rows = [(1, 1, [box(0, 0, 1, 1)]), (1, 2, [box(1, 0, 2, 1)]), (2, 3, [box(0.5, 0.25, 1.5, 0.75)]), (2, 4, [box(0.5, 0.25, 1, 2)])]
    parts = spark.createDataFrame(rows, "owner long, " + KIND)
    united = overlay.union(overlay.coverage(parts, by="owner", tile_deg=0.3))
    m = {r.owner: r.area_deg2 for r in overlay.measured(united, "owner").collect()}
    assert m == {1: pytest.approx(2), 2: pytest.approx(0.5 + 0.5 * 1.25)}
    again = overlay.coverage(united.select(F.col("owner").alias("id"), overlay.rings_of(united).alias("rings")))
    assert overlay.measured(overlay.intersection(again, 2)).first().area_deg2 == pytest.approx(0.5 + 0.5 * 0.25, abs=1e-9)


def test_equal_polygons_of_many_ids(spark, monkeypatch):
    """Ids with the same polygons are counted by their number, and a task never sees their copies."""
    rows, seen, work = [(i, [box(0, 0, 2, 2)]) for i in range(300)] + [(i, [box(1, 1, 3, 3)]) for i in range(300, 500)], [], overlay._classes
    rows += [(0, [box(1, 1, 3, 3)]), (0, [box(0, 0, 2, 2)]), (None, [box(0, 0, 2, 2)])]
    monkeypatch.setattr(overlay, "_classes", lambda *a: seen.append(work(*a)) or seen[-1])
    pieces = overlay.coverage(spark.createDataFrame(rows, KIND), tile_deg=0.7)
    area = lambda p: round(overlay.measured(p).first().area_deg2, 9)
    assert {n: area(pieces.where(F.col("n") == n)) for n in (201, 301, 501)} == {201: 3.0, 301: 3.0, 501: 1.0}
    assert area(overlay.union(pieces)) == 7.0 and seen[0].count() == 4
