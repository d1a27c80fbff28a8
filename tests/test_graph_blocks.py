"""Shortest paths by blocks against the arrays of the whole graph."""

import random

import pytest
from pyspark.sql import functions as F

from terraline.operators import graph, graph_blocks


def grid(n, length):
    at = lambda x, y: x * n + y
    return [(at(x, y), at(x + dx, y + dy), length()) for x in range(n) for y in range(n) for dx, dy in ((0, 1), (1, 0)) if x + dx < n and y + dy < n]


def graphs():
    rng = random.Random(1)
    ties = grid(14, lambda: 1.0)
    metres = grid(14, lambda: rng.uniform(3, 9000)) + [(3, 150, None), (7, 7, 1.0), (20, 21, 2.0), (21, 20, 1.5)]
    apart = grid(6, lambda: 1.0) + [(1000 + a, 1000 + b, 0.1) for a, b, _ in grid(9, lambda: 1.0)] + [(5000, 5001, 1.0)]
    hub = [(0, i, float(i % 5 + 1)) for i in range(1, 150)] + [(i, i + 1, 2.0) for i in range(1, 149)]
    return {"ties": ties, "metres": metres, "apart": apart, "hub": hub}


@pytest.mark.parametrize("name", ["ties", "metres", "apart", "hub"])
def test_blocks_give_what_arrays_give(spark, monkeypatch, name):
    edges = spark.createDataFrame(graphs()[name], "src long, dst long, length double")
    said = lambda df, *keys: {tuple(r[k] for k in keys): r[-1] for r in df.collect()}
    forms = lambda: (said(graph.closeness(edges, exact_up_to=50, pivots=11).select("node", "closeness"), "node"), said(graph.edge_betweenness(edges, exact_up_to=50, k=9), "a", "b"))
    known = forms()
    monkeypatch.setattr(graph_blocks, "BLOCK_NODES", 30)
    monkeypatch.setattr(graph_blocks, "ROUNDS", 3)
    monkeypatch.setattr(graph, "_compact", lambda *a, **k: None)
    for a, b in zip(known, forms()):
        assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], rel=1e-9, abs=1e-12) for k in a)


def test_blocks_are_bounded_and_whole(spark):
    pairs = spark.createDataFrame(grid(40, lambda: 1.0), "a long, b long, length double")
    block = graph_blocks.blocks_of(pairs, 100)
    assert block.count() == block.select("node").distinct().count() == 1600
    most, many = block.groupBy("block").count().agg(F.max("count"), F.count("*")).first()
    assert most <= 200 and many <= 64


def test_an_overlay_that_is_too_large_is_left_to_joins(spark, monkeypatch):
    """The same again, with joins along the overlay and, for nodes that are names, along the graph."""
    rows = grid(5, lambda: 1.0) + [(100, 101, 2.0), (101, 102, 1.0), (100, 102, 3.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, length double")
    known = {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(edges).collect()}
    close = {r.node: r.closeness for r in graph.closeness(edges).collect()}
    monkeypatch.setattr(graph, "MAX_BROADCAST_PAIRS", 3)
    monkeypatch.setattr(graph_blocks, "BLOCK_NODES", 6)
    monkeypatch.setattr(graph_blocks, "ROUNDS", 2)
    assert {(r.a, r.b): pytest.approx(r.betweenness) for r in graph.edge_betweenness(edges).collect()} == known
    assert {r.node: pytest.approx(r.closeness) for r in graph.closeness(edges).collect()} == close
    name = lambda c: F.format_string("n%03d", c)
    named = graph.edge_betweenness(edges.select(name("src").alias("src"), name("dst").alias("dst"), "length")).collect()
    assert {(int(r.a[1:]), int(r.b[1:])): pytest.approx(r.betweenness) for r in named} == known
