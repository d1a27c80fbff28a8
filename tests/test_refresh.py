"""Kept layers: what is computed again, what fails, what a centre's choice and time change."""

import time

import pytest
from pyspark.sql import functions as F

from terraline.operators import analysis
from terraline.operators.refresh import Layer, Store, content_key, refresh


def statuses(found):
    return {r.layer: r.status for r in found.statuses.collect()}


def test_only_what_has_changed(spark, tmp_path):
    calls = []

    def adding(n):
        def make(*tables):
            calls.append(n)
            return tables[0].withColumn("x", F.col("x") + n)

        return make

    layers = [Layer("a", ("left",), adding(1)), Layer("b", ("right",), adding(2)), Layer("c", ("a", "b"), adding(3))]
    table = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    kept = Store(spark, f"file://{tmp_path}/kept", seconds=100)
    first = refresh(layers, {"left": table(1, 2), "right": table(3)}, kept)
    assert statuses(first) == dict.fromkeys("abc", "computed") and calls == [1, 2, 3]
    assert sorted(r.x for r in first.tables["c"].collect()) == [5, 6] and {r.layer: r.rows for r in first.statuses.collect()} == {"a": 2, "b": 1, "c": 2}
    again = refresh(layers, {"left": table(2, 1), "right": table(3)}, kept)
    assert statuses(again) == dict.fromkeys("abc", "kept") and calls == [1, 2, 3]
    assert statuses(refresh(layers, {"left": table(1, 2), "right": table(4)}, kept)) == {"a": "kept", "b": "computed", "c": "computed"}
    assert statuses(refresh(layers, {"left": table(1, 2), "right": table(3)}, kept)) == dict.fromkeys("abc", "kept")
    other = [*layers[:2], Layer("c", ("a", "b"), adding(4), "four")]
    assert statuses(refresh(other, {"left": table(1, 2), "right": table(3)}, kept)) == {"a": "kept", "b": "kept", "c": "computed"}
    late = time.time() + 200
    assert kept.expire(time.time()) == 0 and statuses(refresh(layers[:1], {"left": table(1, 2)}, kept, now=late)) == {"a": "computed"}
    assert kept.expire(late) == 6 and kept.expire(late) == 0


def test_a_failure_is_a_status(spark, tmp_path):
    def broken(t):
        return t.select(F.raise_error(F.lit("no answer from there")).alias("x"))

    layers = [Layer("a", ("t",), broken), Layer("b", ("a",), lambda t: t), Layer("c", ("t",), lambda t: t), Layer("d", ("missing", "c"), lambda *t: t[0])]
    found = refresh(layers, {"t": spark.range(3).toDF("x")}, Store(spark, f"file://{tmp_path}/kept"))
    assert statuses(found) == {"a": "failed", "b": "waiting", "c": "computed", "d": "waiting"} and set(found.tables) == {"c"}
    told = {r.layer: r.error for r in found.statuses.collect()}
    assert told["a"] and "without a" in told["b"] and told["c"] is None


def test_keys_tell_rows_and_schemas(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n long, s string")
    same = [a.orderBy(F.desc("n")), a.select("s", "n"), a.repartition(3)]
    other = [a.distinct(), a.where("n = 1"), a.withColumn("n", F.col("n").cast("int")), a.fillna(""), a.limit(0)]
    assert {content_key(t) for t in same} == {content_key(a)} and content_key(a) not in {content_key(t) for t in other}


def test_the_analysis_from_markers_to_the_rent_model(spark, tmp_path):
    """A failed marker leaves no zone, so the network's top node is the anchor; with centres the primary one is."""
    markers = spark.createDataFrame([(0, 20.0, 100.0, True), (1, 20.01, 100.01, True)], "idx int, lat double, lng double, active boolean")
    body = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[99.9,19.9],[100.1,19.9],[100.1,20.1],[99.9,20.1],[99.9,19.9]]]},"properties":{"value":600}}]}'
    answer = lambda code: spark.createDataFrame([(0, 200, body), (1, code, body)], "orig_idx int, code int, body string")
    nodes = spark.createDataFrame([(i, 20.0 + 0.004 * (i % 6), 100.0 + 0.004 * (i // 6)) for i in range(36)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(i, j, 1.0 + (i * 7 + j) % 3) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j != i + 1 or j % 6)], "src long, dst long, length double")
    samples = spark.createDataFrame([(20.0, 100.0, 50.0), (20.05, 100.0, 30.0), (20.1, 100.0, 20.0)], "lat double, lon double, rent double")
    places = spark.createDataFrame([(20.008, 100.008, ["commercial.supermarket"]), (20.012, 100.008, ["catering.cafe"])], "lat double, lon double, categories array<string>")
    given = {"markers": markers, "answers": answer(200), "nodes": nodes, "edges": edges, "samples": samples, "places": places}
    kept = Store(spark, f"file://{tmp_path}/kept")
    found = refresh(analysis.analysis(), given, kept)
    assert set(statuses(found).values()) == {"computed"}
    zone, model = found.tables["intersection"].first(), found.tables["rent"].first()
    assert (zone.area_deg2, zone.lat, zone.lon) == pytest.approx((0.04, 20.0, 100.0)) and (model.lat, model.lon) == pytest.approx((20.0, 100.0))
    lost = refresh(analysis.analysis(), given | {"answers": answer(403)}, kept)
    assert statuses(lost) == {"isochrone": "computed", "intersection": "computed", "closeness": "kept", "betweenness": "kept", "top": "kept", "rent": "computed", "rent_nodes": "computed"}
    assert {(r.orig_idx, r.status, r.rings is None) for r in lost.tables["isochrone"].collect()} == {(0, "ok", False), (1, "no access", True)}
    top, model = lost.tables["top"].first(), lost.tables["rent"].first()
    assert lost.tables["intersection"].count() == 0 and (model.lat, model.lon) == pytest.approx((top.lat, top.lon))
    centred = refresh(analysis.analysis(by_centre=True), given, kept)
    assert statuses(centred)["centres"] == "computed" and statuses(centred)["closeness"] == "kept"
    primary, model = centred.tables["centres"].where("role = 'primary'").first(), centred.tables["rent"].first()
    assert (model.lat, model.lon) == pytest.approx((primary.lat, primary.lon))
    moved = refresh(analysis.analysis(by_centre=True), given | {"places": places.where("lat > 20.01")}, kept)
    assert {k for k, v in statuses(moved).items() if v == "computed"} == {"centres", "rent", "rent_nodes"}
