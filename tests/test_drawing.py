"""Rooms drawn on a circle and by springs, curves between them, and small functions beside them."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terraline.functions import text
from terraline.operators import candidates, cells, drawing, keyed, location

ROOMS = "project long, ord int, room string, net double"


def test_circle(spark):
    rooms = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 10.0), (1, 2, "c", 1.0), (1, 3, "d", 1.0), (2, 0, "a", None)], ROOMS)
    got = {(r.project, r.room): (r.x, r.y, r.size) for r in drawing.on_circle(rooms).collect()}
    want = {(1, "a"): (1, 0, 44), (1, "b"): (0, 1, 70), (1, "c"): (-1, 0, 44), (1, "d"): (0, -1, 44), (2, "a"): (1, 0, 44)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_curve(spark):
    """From (0, 0) to (4, 0) the control point is 0.6 below the line, so the middle is 0.3 below; from (1.5, 0) it is above."""
    ends = [(0.0, 0.0, 4.0, 0.0), (1.5, 0.0, 5.5, 0.0), (2.0, 3.0, 2.0, 3.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, a double, b double, c double, d double")
    got = [r.p for r in df.select("i", drawing.curve(*map(F.col, "abcd"), points=5).alias("p")).orderBy("i").collect()]
    assert [(p.x, round(p.y, 12)) for p in got[0]] == [(0, 0), (1, -0.225), (2, -0.3), (3, -0.225), (4, 0)]
    assert [round(p.y, 12) for p in got[1]] == [0, 0.225, 0.3, 0.225, 0]
    assert got[2] == [(2.0, 3.0)] and got[3] is None


def test_springs(spark):
    """Two rooms end opposite each other; strongly linked rooms come nearer than weakly linked ones; nobody's places depend
    on the order of the rows, and other plans play no part."""
    rooms = [(1, 0, "a", 1.0), (1, 1, "b", 1.0), (2, 0, "alone", 1.0), *[(3, i, c, 1.0) for i, c in enumerate("abcd")]]
    edges = [(1, "a", "b", 3), (1, "a", "gone", 3), (1, "a", "a", 3), (3, "a", "b", 3), (3, "c", "d", -1), (3, "b", "c", 2), (9, "a", "b", 1)]
    kinds = "project long, room1 string, room2 string, score int"
    run = lambda r, e: {(x.project, x.room): (x.x, x.y) for x in drawing.by_springs(spark.createDataFrame(r, ROOMS), spark.createDataFrame(e, kinds)).collect()}
    got = run(rooms, edges)
    assert len(got) == 7 and got == run(rooms[::-1], edges[::-1])
    assert got[1, "a"] == pytest.approx([-v for v in got[1, "b"]]) and max(map(abs, got[1, "a"])) == pytest.approx(1)
    assert got[2, "alone"] == (0, 0)
    gap = lambda a, b: math.dist(got[3, a], got[3, b])
    assert gap("a", "b") < gap("c", "d") and max(abs(v) for k in "abcd" for v in got[3, k]) == pytest.approx(1)
    assert run(rooms, edges[:0] + [(7, "x", "y", 1)]).keys() == got.keys()


def test_order_by_height(spark):
    rooms = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 2, "c", 3.0)], ROOMS)
    places = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9), (1, "c", 0.1)], "project long, room string, y double")
    got = drawing.by_height(rooms, places)
    assert got.columns == rooms.columns and sorted(tuple(r)[1:3] for r in got.collect()) == [(0, "b"), (1, "a"), (2, "c")]


def test_stamps_and_ranges(spark):
    df = spark.createDataFrame([(1, datetime(2024, 3, 1, 4, 5, 6), [15, None, 5]), (2, None, None), (3, datetime(2024, 3, 1, 4, 5, 6, 70), [])], "i int, t timestamp, m array<int>")
    got = df.select("i", *[text.stamp(F.col("t"), k).alias(k) for k in text.STAMPS], text.requested_ranges(F.col("m")).alias("r")).orderBy("i").collect()
    assert tuple(got[0])[1:] == ("2024-03-01 04:05:06", "2024-03-01T04:05:06Z", "2024-03-01T04:05:06Z", "20240301_040506", "300,900")
    assert tuple(got[1])[1:] == (None,) * 5 and got[2].export == "2024-03-01T04:05:06.000070Z" and got[2].r == ""


def test_changes_said_twice(spark):
    table = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "code string, v int, at int")
    changes = spark.createDataFrame([("a", 9, 1), ("a", 8, 2), ("c", 5, None), ("c", 4, 7), ("c", 4, 7)], table.schema)
    assert sorted(map(tuple, keyed.upsert(table, changes, "code", order="at").collect())) == [("a", 8, 2), ("b", 2, 0), ("c", 4, 7)]
    assert sorted(map(tuple, keyed.upsert(table, changes, "code").collect())) == [("a", 9, 1), ("b", 2, 0), ("c", 5, None)]


def test_centroid_across_the_date_line(spark):
    lon = lambda rows: cells.area_km2(spark.createDataFrame(rows, "cy long, cx long")).first().lon
    assert lon([(0, 179_999), (0, -180_000)]) in (pytest.approx(180), pytest.approx(-180))
    assert lon([(0, 179_998), (0, 179_999), (0, -180_000)]) == pytest.approx(179.9995)
    assert lon([(0, -2), (0, 1)]) == pytest.approx(0)


def test_nearest_places_only(spark):
    """All places in one spot, three of them nearer: the cap takes these and then by categories."""
    asked = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "id long, lat double, lon double")
    held = spark.createDataFrame([(0.001, 0.0, f"far {i:03}") for i in range(300)] + [(0.0, 0.0, f"near {i}") for i in range(3)], "lat double, lon double, categories string")
    got = candidates.places_near(asked, held, 0.5, 100).collect()
    assert {r.candidate_id for r in got} == {1} and sorted(r.categories for r in got) == [f"far {i:03}" for i in range(97)] + ["near 0", "near 1", "near 2"]


def test_areas_of_all_markers(spark):
    parts = [spark.createDataFrame([(i, 5.0)], "orig_idx int, minutes double") for i in range(3)]
    assert sorted(r.orig_idx for r in location.travel_areas(parts).collect()) == [0, 1, 2]


def test_places_of_copies(spark):
    """Candidates and places that share their positions are counted by these, and the cap ends inside a group of equal places."""
    n = 40_000
    asked = spark.range(n).select("id", F.lit(20.0).alias("lat"), F.lit(100.0).alias("lon"))
    held = spark.range(n).select(F.lit(20.001).alias("lat"), F.lit(100.0).alias("lon"), F.array(F.when(F.col("id") < 3, "b").otherwise("c")).alias("categories"))
    held = held.union(held.limit(1).select(F.lit(20.0).alias("lat"), "lon", F.array(F.lit("a")).alias("categories")))
    for most, n_of in ((5, 5), (10**6, n + 1)):
        got = candidates.places_counted(asked, held, 0.5, most).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("n"), F.round(F.min("farthest_km"), 6).alias("far")).first()
        assert (got.rows, got.least, got.n, got.far) == (n, n_of, n_of, 0.111195)
    few = candidates.places_near(asked.limit(2), held, 0.5, 5)
    assert sorted((r.candidate_id, *r.categories, round(r.d_km, 3)) for r in few.collect()) == sorted((i, *x) for i in (0, 1) for x in [("a", 0.0)] + [("b", 0.111)] * 3 + [("c", 0.111)])


def test_curves_as_rows(spark):
    """The rows of ``curves`` are the points of ``curve``, over more tasks than the links had."""
    ends = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 1.0), (2, 1.5, 0.0, 1.5, 0.0), (3, None, 0.0, 1.0, 0.0), (4, 1.5, 0.25, -2.0, 0.0)], "k long, a double, b double, c double, d double").coalesce(1)
    at = [F.col(c) for c in "abcd"]
    rows = drawing.curves(ends, ["k"], *at, points=7)
    want = ends.select("k", F.posexplode(drawing.curve(*at, points=7)).alias("i", "p")).select("k", "i", "p.x", "p.y")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) and rows.count() == 15
    assert rows.rdd.getNumPartitions() > 1
