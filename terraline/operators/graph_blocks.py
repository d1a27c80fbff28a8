"""Shortest paths on graphs that are too large to broadcast: by blocks, between which only border distances are exchanged.

Nodes are dealt into blocks of bounded size. The terminals of a block are its nodes with an edge into another block and the
sources that lie in it. In a block, nodes that are none are taken out one by one, which leaves the shortest ways between
terminals that meet no third one, with how many there are of them; these shortcuts and the edges between blocks make up
the overlay, whose nodes are the terminals alone. Every shortest path from a source is a chain of overlay edges and an end inside of a block, in one way only, so

- distances and path counts at terminals come from the overlay,
- those at all other nodes from their block and its terminals,
- and dependencies (Brandes) go back the same way: a block tells what its inner nodes add at each terminal, the overlay
  adds that up towards the source, and the block shares it out to its edges.

That is a pass over the blocks for each of these steps and no round for each hop. A block works on all sources at once, as
rows of a matrix. The overlay is broadcast as arrays where it is small enough; beyond that it stays a table, along which
joins go in as many rounds as a path has overlay edges, which are at most two for each block that it crosses.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terraline.operators.graph_joins import SAME, backward, both_ways, distances_along, forward
from terraline.session import discard, fits, written

#: Nodes of a block, about: it is a task's work, and its terminals are about four times its root.
BLOCK_NODES = 2_000
#: Rows of sources that a block works on at once.
ROWS = 32
#: Merging stops after so many rounds, or when one merges less than this share of the clusters.
ROUNDS, LEAST_MERGED = 40, 0.05


def blocks_of(pairs: DataFrame, limit: int = BLOCK_NODES, seed: int = 7) -> DataFrame:
    """(node, block) of pairs (a, b): neighbouring clusters are merged while they have at most ``limit`` nodes together,
    tails into a head next to them by a coin a round, all that ask for the head if they fit and one of them otherwise;
    each round only counts and picks by key. Clusters that stay small share blocks by a hash."""
    label = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")), "labels")
    size = written(label.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    edges = written(pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).cast("long").alias("n")), "contracted")
    many = size.count()
    for number in range(ROUNDS):
        coin = lambda c: F.xxhash64(F.lit(seed + number), c)
        ways = edges.select(F.explode(F.array(F.struct(F.col("u").alias("tail"), F.col("v").alias("head"), "n"), F.struct(F.col("v").alias("tail"), F.col("u").alias("head"), "n"))).alias("e")).select("e.*")
        ways = ways.where((coin("tail") % 2 == 0) & (coin("head") % 2 != 0))
        of = lambda name: size.select(F.col("cluster").alias(name), F.col("size").alias(f"{name}_size"))
        asked = ways.join(of("tail"), "tail").join(of("head"), "head").where(F.col("tail_size") + F.col("head_size") <= limit)
        asked = asked.groupBy("tail").agg(F.max_by(F.struct("head", "head_size", "tail_size"), F.struct("n", coin("head"))).alias("w")).select("tail", "w.*")
        taken = asked.groupBy("head").agg((F.sum("tail_size") + F.first("head_size") <= limit).alias("all"), F.min_by("tail", coin("tail")).alias("one"))
        moves = written(asked.join(taken, "head").where(F.col("all") | (F.col("tail") == F.col("one"))).select(F.col("tail").alias("cluster"), F.col("head").alias("to")), "moves")
        merged = moves.count()
        if merged:
            moved = lambda df, c: df.join(moves.withColumnsRenamed({"cluster": c, "to": "_to"}), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
            new = (
                written(moved(label, "cluster"), "labels"),
                written(moved(size, "cluster").groupBy("cluster").agg(F.sum("size").alias("size")), "sizes"),
                written(moved(moved(edges, "u"), "v").where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("n").alias("n")), "contracted"),
            )
            discard(label, size, edges, moves)
            label, size, edges = new
        if merged < LEAST_MERGED * many:
            break
        many -= merged
    small = F.col("size") * 4 < limit
    rest = size.where(small).agg(F.sum("size")).first()[0] or 0
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-rest // limit)))).cast("string"))
    named = size.select("cluster", F.when(small, shared).otherwise(F.concat(F.lit("c"), F.col("cluster").cast("string"))).alias("block"))
    return label.join(named, "cluster").select("node", "block")


class Block:
    """Edges of a block both ways, by the node they lead to."""

    def __init__(self, a: np.ndarray, b: np.ndarray, length: np.ndarray):
        src, dst, both = np.r_[a, b], np.r_[b, a], np.r_[length, length]
        order = np.argsort(dst, kind="stable")
        self.order, self.src, self.dst, self.length = order, src[order], dst[order], both[order]
        self.heads, self.starts = np.unique(self.dst, return_index=True)

    def nearest(self, dist: np.ndarray) -> np.ndarray:
        """Lowers distances (sources x nodes) until no edge makes one shorter."""
        rows = np.arange(len(dist)) if len(self.src) else np.zeros(0, int)
        while len(rows):
            here = dist[rows]
            new = np.minimum(np.minimum.reduceat(here[:, self.src] + self.length, self.starts, axis=1), here[:, self.heads])
            changed = (new < here[:, self.heads]).any(axis=1)
            here[:, self.heads] = new
            dist[rows] = here
            rows = rows[changed]
        return dist

    def tight(self, dist: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(sources x edges) whether an edge from ``before`` to ``after`` ends a shortest path."""
        x, y = dist[:, before], dist[:, after]
        with np.errstate(invalid="ignore"):
            return (np.abs(x + self.length - y) <= SAME * np.maximum(1.0, y)) & (x < y)

    def settled(self, values: np.ndarray, fixed: np.ndarray, along) -> np.ndarray:
        """Sums along edges into each node that is not ``fixed``, repeated until they stay as they are."""
        while len(self.src):
            got = np.add.reduceat(along(values), self.starts, axis=1)
            old = values[:, self.heads]
            new = np.where(fixed[:, self.heads], old, got)
            if np.array_equal(new, old, equal_nan=True):
                break
            values[:, self.heads] = new
        return values

    def counts(self, dist: np.ndarray, paths: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Numbers of shortest paths, from those that are ``fixed``."""
        on = self.tight(dist, self.src, self.dst)
        return self.settled(paths, fixed, lambda p: np.where(on, p[:, self.src], 0.0))

    def shares(self, dist: np.ndarray, paths: np.ndarray, beyond: np.ndarray, fixed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dependencies by node, shares by edge), backwards along shortest paths that go on to a node in ``ends``; an edge
        in the arrays leads from ``dst``, the nearer one, to ``src``."""
        on = self.tight(dist, self.dst, self.src) & ends[self.src]
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(on, paths[:, self.dst] / paths[:, self.src], 0.0)
        share = lambda g: part * (1 + g[:, self.src])
        beyond = self.settled(beyond, fixed, share)
        return beyond, share(beyond)


class Overlay:
    """The overlay as arrays: neighbours of each terminal with length, number of paths and the edge's number."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, paths: np.ndarray):
        src, dst = np.r_[a, b], np.r_[b, a]
        order = np.argsort(src, kind="stable")
        self.ids, self.to, self.edge = ids, dst[order], np.r_[np.arange(len(a)), np.arange(len(a))][order]
        self.length, self.paths = np.r_[length, length][order], np.r_[paths, paths][order]
        self.starts = np.searchsorted(src[order], np.arange(len(ids) + 1))

    def shortest(self, source: int):
        """(distance by node, nodes by distance, path counts, [(predecessor, paths between, edge)] by node)."""
        dist, paths, before, order = {}, {source: 1.0}, {source: []}, []
        queue, near = [(0.0, source)], {source: 0.0}
        while queue:
            d, v = heappop(queue)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            i, j = self.starts[v], self.starts[v + 1]
            for w, length, n, e in zip(self.to[i:j].tolist(), self.length[i:j].tolist(), self.paths[i:j].tolist(), self.edge[i:j].tolist()):
                if w in dist:
                    continue
                new = d + length
                slack = SAME * max(1.0, new)
                if w not in near or new < near[w] - slack:
                    near[w], paths[w], before[w] = new, paths[v] * n, [(v, n, e)]
                    heappush(queue, (new, w))
                elif new <= near[w] + slack:
                    paths[w] += paths[v] * n
                    before[w].append((v, n, e))
        return dist, order, paths, before


@dataclass(frozen=True)
class Cut:
    """A graph in blocks, made for ``sources`` (node). ``inner``: (block, a, b, length) edges within blocks; ``terminals``:
    (node, block); ``overlay``: (a, b, length, paths, between), the last for edges from block to block. If the overlay is
    small enough, ``arrays`` and, by the places of its edges, ``between`` are broadcasts, and ``places`` are the sources'."""

    inner: DataFrame
    terminals: DataFrame
    overlay: DataFrame
    sources: DataFrame
    kind: T.DataType
    arrays: object = None
    between: object = None
    places: tuple[int, ...] = ()


def _local(table: pa.Table, ids: np.ndarray) -> Block:
    place = lambda c: np.searchsorted(ids, table.column(c).to_numpy())
    return Block(place("a"), place("b"), table.column("length").to_numpy())


def _ids(inner: pa.Table, terminals: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([inner.column("a").to_numpy(), inner.column("b").to_numpy(), terminals]))


def _eliminated(near: list[dict[int, tuple[float, float]]], keep: np.ndarray) -> None:
    """Takes all nodes but ``keep`` out of a graph (by node: neighbours with length and number of paths), the one with the
    fewest neighbours first; the ways through a node become edges between its neighbours."""
    queue = [(len(near[v]), v) for v in range(len(near)) if not keep[v]]
    heapify(queue)
    gone = np.zeros(len(near), bool)
    while queue:
        degree, v = heappop(queue)
        if gone[v]:
            continue
        if degree != len(near[v]):
            heappush(queue, (len(near[v]), v))
            continue
        gone[v] = True
        around = list(near[v].items())
        near[v] = {}
        for a, _ in around:
            del near[a][v]
        for i, (a, (la, pa_)) in enumerate(around):
            of = near[a]
            for b, (lb, pb) in around[i + 1 :]:
                new, n = la + lb, pa_ * pb
                old = of.get(b)
                if old is not None:
                    slack = SAME * max(1.0, new)
                    if new > old[0] + slack:
                        continue
                    if new >= old[0] - slack:
                        new, n = old[0], old[1] + n
                of[b] = near[b][a] = (new, n)


def _shortcuts(kind: pa.DataType):
    """A block's edges and terminals to its shortcuts (a, b, length, paths): ways between terminals that meet no third one
    and that no way through others beats."""

    def run(inner: pa.Table, terminals: pa.Table) -> pa.Table:
        own = np.sort(terminals.column("node").to_numpy()) if len(terminals) else np.zeros(0, np.int64)
        a = b = length = paths = np.zeros(0)
        if len(own) > 1 and len(inner):
            ids = _ids(inner, own)
            at = np.searchsorted(ids, own)
            near: list[dict[int, tuple[float, float]]] = [{} for _ in ids]
            ends = [np.searchsorted(ids, inner.column(c).to_numpy()).tolist() for c in ("a", "b")]
            for x, y, far in zip(*ends, inner.column("length").to_pylist()):
                near[x][y] = near[y][x] = (far, 1.0)
            keep = np.zeros(len(ids), bool)
            keep[at] = True
            _eliminated(near, keep)
            place = {v: k for k, v in enumerate(at.tolist())}
            rows = [(place[v], place[w], *e) for v in at.tolist() for w, e in near[v].items() if v < w]
            a, b, length, paths = (np.array(c) for c in zip(*rows)) if rows else (a, b, length, paths)
            a, b = a.astype(int), b.astype(int)
            best = np.full((len(own), len(own)), np.inf)
            best[a, b] = best[b, a] = length
            for k in range(len(own)):
                np.minimum(best, best[:, k, None] + best[k], out=best)
            use = length <= best[a, b] + SAME * np.maximum(1.0, length) if len(a) else np.zeros(0, bool)
            a, b, length, paths = own[a[use]], own[b[use]], length[use], paths[use]
        return pa.table({"a": pa.array(a.astype(own.dtype), kind), "b": pa.array(b.astype(own.dtype), kind), "length": pa.array(length, pa.float64()), "paths": pa.array(paths, pa.float64())})

    return run


def cut(pairs: DataFrame, sources: DataFrame, max_pairs: int, limit: int | None = None) -> Cut:
    """The graph of pairs (a, b, length), a < b whole numbers, in blocks, with ``sources`` (node) among the terminals; the
    driver holds the overlay if it has at most ``max_pairs`` edges."""
    spark, kind = pairs.sparkSession, pairs.schema["a"].dataType
    arrow = to_arrow_type(kind)
    block = written(blocks_of(pairs, limit or BLOCK_NODES), "blocks")
    of = lambda c: block.select(F.col("node").alias(c), F.col("block").alias(f"{c}_block"))
    ends = written(pairs.join(of("a"), "a").join(of("b"), "b"), "edges-of-blocks")
    inner = ends.where("a_block = b_block").select(F.col("a_block").alias("block"), "a", "b", "length")
    cross = ends.where("a_block <> b_block").select("a", "b", "length", F.lit(1.0).alias("paths"), F.lit(True).alias("between"))
    borders = cross.select(F.explode(F.array("a", "b")).alias("node")).unionByName(sources.select("node")).distinct()
    terminals = written(borders.join(block, "node").select("node", "block"), "terminals")
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("length", T.DoubleType()), T.StructField("paths", T.DoubleType())])
    short = inner.groupBy("block").cogroup(terminals.groupBy("block")).applyInArrow(_shortcuts(arrow), schema)
    overlay = written(cross.unionByName(short.withColumn("between", F.lit(False))), "overlay")
    if not fits(overlay, max_pairs):
        return Cut(inner, terminals, overlay, sources, kind)
    edges = overlay.toPandas()
    known = sources.select("node").toPandas().node.to_numpy()
    ids = np.unique(np.concatenate([edges.a.to_numpy(), edges.b.to_numpy(), known]))
    place = lambda c: np.searchsorted(ids, edges[c].to_numpy())
    arrays = Overlay(ids, place("a"), place("b"), edges.length.to_numpy(float), edges.paths.to_numpy(float))
    share = spark.sparkContext.broadcast
    return Cut(inner, terminals, overlay, sources, kind, share(arrays), share(edges.between.to_numpy()), tuple(np.searchsorted(ids, np.sort(known)).tolist()))


def _tasks(spark, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("i"))


def terminal_values(graph: Cut) -> DataFrame:
    """(source, node, d, paths) at the terminals that each source reaches, by arrays."""
    spark = graph.terminals.sparkSession
    kind, overlay, sources = to_arrow_type(graph.kind), graph.arrays, spark.sparkContext.broadcast(graph.places)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                source, ids = sources.value[i], overlay.value.ids
                dist, order, paths, _ = overlay.value.shortest(source)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), ids[source]), kind), pa.array(ids[order], kind), pa.array([dist[v] for v in order], pa.float64()), pa.array([paths[v] for v in order], pa.float64())], ["source", "node", "d", "paths"])

    schema = T.StructType([T.StructField("source", graph.kind), T.StructField("node", graph.kind), T.StructField("d", T.DoubleType()), T.StructField("paths", T.DoubleType())])
    return _tasks(spark, len(graph.places)).mapInArrow(run, schema)


def in_blocks(graph: Cut, values: DataFrame) -> DataFrame:
    """Values at terminals with their ``block``."""
    return values.join(graph.terminals, "node").select("block", *values.columns)


def _known(values: pa.Table, ids: np.ndarray, *columns: str):
    """(sources, terminals' places, matrices sources x nodes of ``columns``, with infinity and zeros elsewhere)."""
    sources, row = np.unique(values.column("source").to_numpy(), return_inverse=True)
    at = np.searchsorted(ids, values.column("node").to_numpy())
    out = []
    for c in columns:
        matrix = np.full((len(sources), len(ids)), np.inf if c == "d" else 0.0)
        matrix[row, at] = values.column(c).to_numpy()
        out.append(matrix)
    return sources, np.unique(at), out


def distance_sums(graph: Cut) -> DataFrame:
    """(node, s): each node's sum of distances from the sources that reach it; nodes that none reaches are left out."""
    kind = to_arrow_type(graph.kind)

    def run(inner: pa.Table, values: pa.Table) -> pa.Table:
        total, ids = np.zeros(0), np.zeros(0, np.int64)
        if len(values):
            ids = _ids(inner, values.column("node").to_numpy())
            block, total, met = _local(inner, ids), np.zeros(len(ids)), np.zeros(len(ids), bool)
            _, _, (dist,) = _known(values, ids, "d")
            for i in range(0, len(dist), ROWS):
                d = block.nearest(dist[i : i + ROWS])
                met |= np.isfinite(d).any(axis=0)
                total += np.where(np.isfinite(d), d, 0.0).sum(axis=0)
            ids, total = ids[met], total[met]
        return pa.table({"node": pa.array(ids, kind), "s": pa.array(total, pa.float64())})

    schema = T.StructType([T.StructField("node", graph.kind), T.StructField("s", T.DoubleType())])
    values = terminal_values(graph).drop("paths") if graph.arrays else distances_along(both_ways(graph.overlay), graph.sources)
    return graph.inner.groupBy("block").cogroup(in_blocks(graph, values).groupBy("block")).applyInArrow(run, schema)


def edge_shares(graph: Cut) -> DataFrame:
    """(a, b, x): the edges' shares of the shortest paths from the sources to all nodes, in parts that are to be added."""
    spark, kind = graph.terminals.sparkSession, to_arrow_type(graph.kind)
    at_ends, steps = (terminal_values(graph), None) if graph.arrays else forward(graph.overlay, graph.sources)
    values = written(in_blocks(graph, at_ends), "terminal-values")
    node, double = (lambda n: T.StructField(n, graph.kind)), (lambda n: T.StructField(n, T.DoubleType()))

    def sweep(inner, values, extra, use):
        """Calls ``use`` with a block and the matrices of some of the sources at a time."""
        ids = _ids(inner, values.column("node").to_numpy())
        block = _local(inner, ids)
        sources, at, (dist, paths, *more) = _known(values, ids, "d", "paths", *extra)
        ends = np.zeros(len(ids), bool)
        ends[at] = True
        for i in range(0, len(sources), ROWS):
            d, fixed = block.nearest(dist[i : i + ROWS]), np.repeat(ends[None], len(dist[i : i + ROWS]), axis=0)
            p = block.counts(d, paths[i : i + ROWS], fixed)
            use(block, ids, sources[i : i + ROWS], at, ends, fixed, d, p, *[m[i : i + ROWS] for m in more])

    def added(inner: pa.Table, values: pa.Table) -> pa.Table:
        """What a block's inner nodes add at its terminals, for each source: (source, node, x)."""
        out = {"source": [], "node": [], "x": []}

        def use(block, ids, sources, at, ends, fixed, d, p):
            beyond, _ = block.shares(d, p, np.zeros(d.shape), np.zeros(d.shape, bool), ~ends)
            r, t = np.nonzero(np.isfinite(d[:, at]))
            out["source"].append(sources[r])
            out["node"].append(ids[at[t]])
            out["x"].append(beyond[r, at[t]])

        if len(values):
            sweep(inner, values, (), use)
        joined = lambda c, k: pa.array(np.concatenate(out[c]) if out[c] else [], k)
        return pa.table({"source": joined("source", kind), "node": joined("node", kind), "x": joined("x", pa.float64())})

    adds = graph.inner.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(added, T.StructType([node("source"), node("node"), double("x")]))
    overlay, between = graph.arrays, graph.between

    def back(table: pa.Table) -> pa.Table:
        """A source's dependencies at all terminals (b is null) and its shares of the edges between blocks."""
        graph, ids = overlay.value, overlay.value.ids
        source = table.column("source")[0].as_py()
        _, order, paths, before = graph.shortest(int(np.searchsorted(ids, source)))
        beyond = dict(zip(np.searchsorted(ids, table.column("node").to_numpy()).tolist(), table.column("x").to_pylist()))
        a, b, x = [], [], []
        for w in reversed(order):
            here = 1 + beyond.get(w, 0.0)
            for v, n, e in before[w]:
                c = paths[v] * n / paths[w] * here
                beyond[v] = beyond.get(v, 0.0) + c
                if between.value[e]:
                    a.append(v)
                    b.append(w)
                    x.append(c)
        pairs = np.sort(np.array([a, b], int).reshape(2, -1), axis=0)
        nodes = pa.array(ids[order], kind)
        return pa.table({
            "source": pa.array(np.full(len(order) + len(x), source), kind),
            "a": pa.concat_arrays([nodes, pa.array(ids[pairs[0]], kind)]),
            "b": pa.concat_arrays([pa.nulls(len(order), kind), pa.array(ids[pairs[1]], kind)]),
            "x": pa.array([*(beyond.get(v, 0.0) for v in order), *x], pa.float64()),
        })

    if graph.arrays:
        flows = written(adds.groupBy("source").applyInArrow(back, T.StructType([node("source"), node("a"), node("b"), double("x")])), "flows")
        at_terminals, crossing = flows.where("b is null").select("source", F.col("a").alias("node"), "x"), flows.where("b is not null").select("a", "b", "x")
    else:
        shares, at_terminals = backward(steps, written(adds, "adds"))
        crossing = shares.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "x").join(graph.overlay.where("between").select("a", "b"), ["a", "b"], "left_semi")

    def shared(inner: pa.Table, values: pa.Table) -> pa.Table:
        """A block's edges with their shares, over all sources."""
        total = np.zeros(2 * len(inner))
        if len(values):

            def use(block, ids, sources, at, ends, fixed, d, p, beyond):
                _, share = block.shares(d, p, beyond, fixed, np.ones(len(ids), bool))
                total[block.order] += share.sum(axis=0)

            sweep(inner, values, ("x",), use)
        half = len(inner)
        return pa.table({"a": inner.column("a"), "b": inner.column("b"), "x": pa.array(total[:half] + total[half:], pa.float64())}).cast(pa.schema([("a", kind), ("b", kind), ("x", pa.float64())]))

    whole = values.join(at_terminals, ["source", "node"])
    within = graph.inner.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(shared, T.StructType([node("a"), node("b"), double("x")]))
    return within.unionByName(crossing)
