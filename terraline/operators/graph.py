"""Graph operators over edge DataFrames (largest component, degrees, edge collapse, centralities)."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terraline.operators import graph_blocks, hops
from terraline.operators.graph_joins import SAME, backward, both_ways, distances_along, forward
from terraline.session import discard, fits, written


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) for every end of an edge; ``component`` is the smallest node that can be reached.

    Alternating star contraction: every node hands its larger neighbours to its smallest one (large star), then every
    node links its smaller neighbours to the smallest (small star), until all edges are stars around the smallest node
    of their component. The rounds grow with the logarithm of the longest path; each ends in a written table, and only
    a count and a sum come to the driver. Edges with a null end count as none.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    now, seen = written(pairs.select("u", "v").distinct(), "components"), None
    while True:
        mark = now.where("u > v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.where("u > v").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")
        smallest = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(smallest, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = now, written(small.where("u > v").distinct(), "components")
        discard(before)
    lone = pairs.where("u = v").select("u", "v").distinct()
    stars = now.where("u > v")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v")).union(lone).groupBy("node").agg(F.min("component").alias("component"))


#: Pairs of nodes that may be broadcast for shortest paths, as arrays of 24 bytes a pair and direction (under 100 MB).
#: Larger graphs stay tables, and the same results come from blocks and the overlay between them, by arrays if the overlay
#: is small enough and else by joins along it; no graph is refused.
MAX_BROADCAST_PAIRS = 2_000_000


def collapsed(edges: DataFrame) -> DataFrame:
    """(a, b, length) with a < b: parallel edges become the shortest one, a missing length is 1, self-loops go."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.coalesce("length", F.lit(1.0))).alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): in plus out on the directed multigraph, a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def largest_component(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node) of the largest connected component, ties to the one with the smallest node."""
    parts = written(connected_components(edges, a, b), "parts")
    top = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(top.select("component")), "component").select("node")


def distances(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, d): shortest lengths from each source, along pairs (a, b, length) both ways."""
    return distances_along(both_ways(pairs), sources)


class Compact:
    """A graph as arrays: ``ids`` in order, and the neighbours and lengths of node i from starts[i] to starts[i + 1]."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, length: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.ids, self.to, self.length = ids, dst[order], length[order]
        self.starts = np.searchsorted(src[order], np.arange(len(ids) + 1))

    def neighbours(self, v: int):
        a, b = self.starts[v], self.starts[v + 1]
        return zip(self.to[a:b].tolist(), self.length[a:b].tolist())

    def largest_component(self) -> np.ndarray:
        """Its nodes; of equal ones the one with the smallest node."""
        label, src = np.arange(len(self.ids)), np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        while True:
            least = label.copy()
            np.minimum.at(least, src, label[self.to])
            np.minimum.at(least, self.to, label[src])
            least = least[least]
            if (least == label).all():
                return np.flatnonzero(label == np.argmax(np.bincount(label))) if len(label) else label
            label = least

    def shortest(self, source: int):
        """(distance by node, nodes by distance, path counts, predecessors) from a source."""
        dist, paths, before, order = {}, {source: 1.0}, {source: []}, []
        queue, near = [(0.0, source)], {source: 0.0}
        while queue:
            d, v = heappop(queue)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for w, length in self.neighbours(v):
                new = d + length
                slack = SAME * max(1.0, new)
                if w not in dist and (w not in near or new < near[w] - slack):
                    near[w], paths[w], before[w] = new, paths[v], [v]
                    heappush(queue, (new, w))
                elif w not in dist and new <= near[w] + slack:
                    paths[w] += paths[v]
                    before[w].append(v)
        return dist, order, paths, before


def _compact(pairs: DataFrame, one_way: bool = False) -> Compact | None:
    """The graph of pairs (a, b, length) as arrays, after a check of its size; None if it is too large."""
    if not fits(pairs, MAX_BROADCAST_PAIRS):
        return None
    found = pairs.select("a", "b", "length").toPandas()
    ids, ends = np.unique(np.r_[found.a.to_numpy(), found.b.to_numpy()], return_inverse=True)
    a, b, length = ends[: len(found)], ends[len(found) :], found.length.to_numpy(float)
    return Compact(ids, a, b, length) if one_way else Compact(ids, np.r_[a, b], np.r_[b, a], np.r_[length, length])


def _numbered(pairs: DataFrame) -> bool:
    """Whether nodes are whole numbers, as blocks need them."""
    return isinstance(pairs.schema["a"].dataType, T.IntegralType)


def _tasks(spark, n: int) -> DataFrame:
    """(i) from 0 to n - 1, spread over tasks."""
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("i"))


def closeness(edges: DataFrame, exact_up_to: int = 3000, pivots: int = 600, seed: int = 42) -> DataFrame:
    """(node, closeness, method) over the largest component, 0 elsewhere: (N - 1) over the sum of distances; above
    ``exact_up_to`` nodes, k over the sum of distances to k pivots, the first by the hash of seed and node. The edges are
    read once. Sources are spread over tasks, each of which sends sums, not distances."""
    spark = edges.sparkSession
    ends = written(edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.coalesce("length", F.lit(1.0))).alias("length")), "pairs")
    pairs, all_nodes = ends.where("a <> b"), nodes_of(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    order, graph = F.xxhash64(F.lit(seed), "node"), _compact(pairs)
    if graph is None:
        main = written(largest_component(pairs, "a", "b"), "main")
        n = main.count()
        sources = main if n <= exact_up_to else main.orderBy(order, "node").limit(pivots)
        if _numbered(pairs):
            sums = graph_blocks.distance_sums(graph_blocks.cut(pairs, sources, MAX_BROADCAST_PAIRS))
        else:
            sums = distances(pairs, sources).groupBy("node").agg(F.sum("d").alias("s"))
        sums = sums.join(main, "node", "left_semi")
    else:
        inside = graph.largest_component()
        n, at = len(inside), inside.tolist()
        if n > exact_up_to:
            ranked = all_nodes.orderBy(order, "node").toPandas().node.to_numpy()
            at = np.searchsorted(graph.ids, ranked[np.isin(ranked, graph.ids[inside])][:pivots]).tolist()
        known = spark.sparkContext.broadcast(graph)
        chosen = spark.sparkContext.broadcast(at)
        kind = pairs.schema["a"].dataType

        def run(batches):
            total = np.zeros(len(known.value.ids))
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    dist = known.value.shortest(chosen.value[i])[0]
                    total[np.fromiter(dist, int, len(dist))] += np.fromiter(dist.values(), float, len(dist))
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known.value.ids[met], to_arrow_type(kind)), pa.array(total[met])], ["node", "d"])

        parts = _tasks(spark, len(at)).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("d", T.DoubleType())]))
        sums = parts.groupBy("node").agg(F.sum("d").alias("s"))
    method, k = ("exact", n - 1) if n <= exact_up_to else (f"{pivots} pivots", min(n, pivots))
    return all_nodes.join(sums, "node", "left").select("node", F.when(F.col("s") > 0, F.lit(float(k)) / F.col("s")).otherwise(0.0).alias("closeness"), F.lit(method).alias("method"))


def hop_closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness) by hops along the directed edges into a node, over the whole graph: (r - 1) over the sum of
    hops from the r nodes that reach it, times (r - 1) / (N - 1)."""
    nodes = written(nodes_of(edges), "nodes")
    far = hops.reached(edges, MAX_BROADCAST_PAIRS).withColumnRenamed("node", "_node")
    r = F.col("r").cast("double")
    return nodes.join(far, nodes.node == F.col("_node"), "left").select("node", F.when(F.col("s") > 0, r / F.col("s") * r / F.lit(float(max(1, nodes.count() - 1)))).otherwise(0.0).alias("closeness"))


def _dependencies(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(a, b, x): the edges' shares of shortest paths from all ``sources``, by joins alone; for nodes that are no numbers."""
    _, steps = forward(pairs.withColumn("paths", F.lit(1.0)), sources)
    shares, _ = backward(steps)
    return shares.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "x")


def edge_betweenness(edges: DataFrame, exact_up_to: int = 2000, k: int = 400, seed: int = 42) -> DataFrame:
    """(a, b, betweenness) by Brandes' sums from every source, or above ``exact_up_to`` nodes from the first k by the
    hash of seed and node, scaled up; normalised by n * (n - 1) / 2 pairs."""
    spark = edges.sparkSession
    pairs = written(collapsed(edges), "pairs")
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    n = nodes.count()
    used = nodes if n <= exact_up_to else nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(k)
    m = n if n <= exact_up_to else min(n, k)
    graph = _compact(pairs)
    if graph is None:
        used = written(used, "sources")
        shares = graph_blocks.edge_shares(graph_blocks.cut(pairs, used, MAX_BROADCAST_PAIRS)) if _numbered(pairs) else _dependencies(pairs, used)
        sums = shares.groupBy("a", "b").agg(F.sum("x").alias("x"))
    else:
        known = spark.sparkContext.broadcast(graph)
        at = np.searchsorted(graph.ids, np.sort(used.toPandas().node.to_numpy())).tolist() if n else []
        chosen = spark.sparkContext.broadcast(at)
        kind = pairs.schema["a"].dataType

        def run(batches):
            total: dict = {}
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    _, order, paths, before = known.value.shortest(chosen.value[i])
                    share = dict.fromkeys(order, 0.0)
                    for w in reversed(order):
                        for v in before[w]:
                            c = paths[v] / paths[w] * (1 + share[w])
                            share[v] += c
                            e = (v, w) if v < w else (w, v)
                            total[e] = total.get(e, 0.0) + c
            ends = [pa.array(known.value.ids[[e[j] for e in total]] if total else [], to_arrow_type(kind)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(list(total.values()), pa.float64())], ["a", "b", "x"])

        parts = _tasks(spark, len(at)).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("x", T.DoubleType())]))
        sums = parts.groupBy("a", "b").agg(F.sum("x").alias("x"))
    scale = (n / m) / (n * (n - 1)) if n > 1 else 0.0
    return pairs.join(sums, ["a", "b"], "left").select("a", "b", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))


#: The weights of closeness, degree and quiet roads.
GOLDEN_WEIGHTS = (0.5, 0.3, 0.2)


def adjacent_betweenness(edges: DataFrame, between: DataFrame) -> DataFrame:
    """(node, mean_betweenness): the mean over a node's edges, parallel ones each, of betweenness over its most; a
    self-loop counts once and has none."""
    most = between.agg(F.max("betweenness").alias("_most"))
    each = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).join(between, ["a", "b"], "left").join(F.broadcast(most))
    x = F.when(F.col("_most") > 0, F.coalesce("betweenness", F.lit(0.0)) / F.col("_most")).otherwise(F.coalesce("betweenness", F.lit(0.0))).alias("x")
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    return each.select(F.explode(ends).alias("node"), x).groupBy("node").agg(F.avg("x").alias("mean_betweenness"))


def golden_spots(edges: DataFrame, close: DataFrame, between: DataFrame, top: int = 10, zero_betweenness: bool = False) -> DataFrame:
    """(rank, node, score, closeness, degree, mean_betweenness): half the closeness over its most, 0.3 the degree over
    its most, 0.2 one minus the mean betweenness of the node's edges; ties to the smaller node."""
    quiet = adjacent_betweenness(edges, between.withColumn("betweenness", F.lit(0.0)) if zero_betweenness else between)
    joined = written(close.select("node", "closeness").join(degrees(edges), "node", "left").join(quiet, "node", "left").fillna(0, ["degree", "mean_betweenness"]), "spots")
    most_close, most_degree = joined.agg(F.max("closeness"), F.max("degree")).first()
    over = lambda c, most: F.col(c) / F.lit(float(most or 1) or 1.0)
    w = GOLDEN_WEIGHTS
    score = w[0] * over("closeness", most_close) + w[1] * over("degree", most_degree) + w[2] * (1 - F.col("mean_betweenness"))
    best = joined.withColumn("score", score).orderBy(F.desc("score"), "node").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "node"))).select("rank", "node", "score", "closeness", "degree", "mean_betweenness")
