"""Graphs cut to areas and kept by their bounds."""

import random

from terraline.operators import network
from terraline.sources import tables

RINGS = "rings array<array<struct<lon double, lat double>>>"


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_nodes_and_edges_of_two_areas(spark):
    """Two squares that overlap, one with a hole, against plain comparisons; nodes without a place and edges that leave go."""
    rng = random.Random(5)
    nodes = [(i, rng.random() * 0.2, rng.random() * 0.2) for i in range(400)] + [(400, None, 0.1), (401, 0.1, None)]
    edges = [(rng.randrange(402), rng.randrange(402), i) for i in range(900)] + [(None, 1, 900), (1, None, 901)]
    areas = spark.createDataFrame([([square(0.0, 0.0, 0.1), square(0.03, 0.03, 0.03)],), ([square(0.08, 0.08, 0.1)],), ([],)], RINGS)
    within = lambda a, y, x, s: a <= x < a + s and a <= y < a + s
    want = {i for i, y, x in nodes if None not in (y, x) and ((within(0.0, y, x, 0.1) and not within(0.03, y, x, 0.03)) or within(0.08, y, x, 0.1))}
    n, e = network.in_area(spark.createDataFrame(nodes, "id long, lat double, lon double"), spark.createDataFrame(edges, "src long, dst long, key long"), areas)
    assert [r.id for r in n.orderBy("id").collect()] == sorted(want) and 50 < len(want) < 350
    assert e.columns == ["src", "dst", "key"] and {tuple(r) for r in e.collect()} == {x for x in edges if x[0] in want and x[1] in want}


def test_kept_by_bounds(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.01, 0.01), (2, 0.02, 0.02), (3, 0.5, 0.5)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    areas = spark.createDataFrame([([square(0.0, 0.0, 0.1)],)], RINGS)
    n, e, kept = network.graph_of_area(spark, str(tmp_path), areas, network.NETWORK_OF["bicycle"], nodes, edges)
    assert (n.count(), e.count(), kept) == (2, 1, False)
    n, e, kept = network.graph_of_area(spark, str(tmp_path), areas, "bike", nodes.limit(0), edges.limit(0))
    assert (n.count(), e.count(), kept) == (2, 1, True)
    other = network.graph_of_area(spark, str(tmp_path), areas, network.NETWORK_OF["walk"], nodes.limit(0), edges)
    assert (other[0].count(), other[1].count(), other[2]) == (0, 0, False)
    assert len(list(tmp_path.iterdir())) == 2 and tables.load_graph(spark, str(tmp_path), sorted(p.name for p in tmp_path.iterdir())[0])
