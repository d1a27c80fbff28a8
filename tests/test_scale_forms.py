"""Operators whose rows spread over tasks however large a group is, against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from terraline.operators import asof, density, graph, hops


@pytest.mark.parametrize("width", [1, 50, 100_000])
def test_asof_in_slices_of_any_width(spark, width):
    """One key with most rows, values that are null, times that are equal on both sides or missing."""
    rng = random.Random(width)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    right = {(key(), t): rng.choice([None, float(t)]) for t in rng.sample(range(3000), 300)}
    left = [(i, key(), rng.choice([None, rng.randint(-50, 3100)])) for i in range(400)]
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c))
    l = spark.createDataFrame(left, "id int, k string, t int").withColumn("ts", at("t"))  # noqa: E741
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()] + [("hot", None, -1.0)], "k string, t int, v double").withColumn("ts", at("t"))
    for earliest in (False, True):
        got = {x.id: x.asof_value for x in asof.asof(l, r, "k", "ts", "v", earliest, slice_seconds=width).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            mine = sorted((u, v) for (q, u), v in right.items() if q == k and k is not None)
            upto = [v for u, v in mine if t is not None and u <= t]
            if k is not None and (t is not None or not earliest):
                assert got[i] == (upto[-1] if upto else mine[0][1] if earliest and mine else None), (i, k, t)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_percentiles_by_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice(["hot", "hot", "hot", "x", None]), rng.choice([None, *range(6)])) for i in range(300)] + [(1000, "lone", 5)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r.id: r.p for r in density.ordinal_percentile(df, "v", "id", "p", ("g",), ranges).collect()}
    for g in {g for _, g, _ in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in mine] == ([1.0] if len(mine) == 1 else [k / (len(mine) - 1) for k in range(len(mine))])
    alone = {r.id: r.p for r in density.ordinal_percentile(df.where("id < 50"), "v", "id", "p", ranges=ranges).collect()}
    assert sorted(alone.values()) == [k / 49 for k in range(50)]
    assert density.ordinal_percentile(df.limit(0), "v", "id", "p").count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_hops_from_every_node(spark, monkeypatch, most):
    """Arrays and joins, more than one word of sources, loops, parallel edges and a part that few reach."""
    rng = random.Random(4)
    n = 150 if most else 90
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)] + [(3, 3), (1, 2), (1, 2), (500, 501)]
    monkeypatch.setattr(hops, "TOGETHER", 1024)
    edges = spark.createDataFrame(rows, "src long, dst long")
    got = {r.node: (r.r, r.s) for r in hops.reached(edges, most).collect()}
    out = {}
    for a, b in set(rows):
        if a != b:
            out.setdefault(a, []).append(b)
    want = {}
    for s in {x for r in rows for x in r}:
        far, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in out.get(v, ()):
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
        for v, d in far.items():
            if d:
                r, t = want.get(v, (0, 0))
                want[v] = (r + 1, t + d)
    assert got == want
    close = {r.node: r.closeness for r in graph.hop_closeness(edges).collect()}
    every = {x for r in rows for x in r}
    assert close == {v: pytest.approx(want[v][0] / want[v][1] * want[v][0] / (len(every) - 1) if v in want else 0.0) for v in every}
