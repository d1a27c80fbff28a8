"""Shortest paths by joins alone, a round for each edge of the longest one: for graphs of any size with few edges on a path,
such as the overlay of a graph in blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraline.session import discard, written

#: Paths whose lengths differ by no more than this share of them (of 1, if that is more) are equally long.
SAME = 1e-12


def both_ways(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, ...) as (src, dst, ...) in both directions."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), *rest), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), *rest))).alias("e")).select("e.*")


def distances_along(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, d) along edges (src, dst, length), relaxed by joins until nothing gets shorter."""
    edges = written(edges.select("src", "dst", "length"), "edges")
    best = written(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("d")), "distances")
    front = best
    while front.limit(1).count():
        reached = front.join(edges, front.node == edges.src).select("source", F.col("dst").alias("node"), (F.col("d") + F.col("length")).alias("d"))
        shorter = reached.groupBy("source", "node").agg(F.min("d").alias("d")).join(best.withColumnRenamed("d", "old"), ["source", "node"], "left").where("old is null or d < old").select("source", "node", "d")
        new = written(shorter, "distances")
        lower = written(best.unionByName(new).groupBy("source", "node").agg(F.min("d").alias("d")), "distances")
        discard(*({front, best}))
        front, best = new, lower
    discard(front, edges)
    return best


def forward(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, node, d, paths), and the edges that end shortest paths as (source, src, dst, level, part): ``level`` is the
    most edges of a shortest path to dst, ``part`` the share of dst's paths that come along the edge. edges: (a, b, length,
    paths), where ``paths`` of one length are what an edge stands for."""
    d = distances_along(both_ways(edges), sources)
    ways = both_ways(edges.select("a", "b", "length", "paths"))
    u, v = d.select("source", F.col("node").alias("src"), F.col("d").alias("du")), d.select(F.col("source").alias("_s"), F.col("node").alias("_n"), F.col("d").alias("dv"))
    tight = (F.abs(F.col("du") + F.col("length") - F.col("dv")) <= SAME * F.greatest(F.lit(1.0), "dv")) & (F.col("du") < F.col("dv"))
    steps = written(u.join(ways, "src").join(v, (F.col("source") == F.col("_s")) & (F.col("dst") == F.col("_n"))).where(tight).select("source", "src", "dst", "paths"), "steps")
    level = d.select("source", "node", F.lit(0).alias("level"))
    moved, met = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("level")), "front"), []
    while moved.limit(1).count():
        met.append(moved)
        moved = written(moved.join(steps, (moved.source == steps.source) & (moved.node == steps.src)).select(steps.source, F.col("dst").alias("node"), (F.col("level") + 1).alias("level")).distinct(), "front")
    level = written(reduce(DataFrame.unionByName, met, level).groupBy("source", "node").agg(F.max("level").alias("level")), "levels")
    discard(moved, *met)
    far = level.agg(F.max("level")).first()[0] or 0
    dealt = written(steps.join(level.withColumnRenamed("node", "dst"), ["source", "dst"]), "steps")
    discard(steps)
    counts = [written(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("n")), "paths")]
    for at in range(1, far + 1):
        known = reduce(DataFrame.unionByName, counts).withColumnRenamed("node", "src")
        counts.append(written(dealt.where(F.col("level") == at).join(known, ["source", "src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("n") * F.col("paths")).alias("n")), "paths"))
    paths = written(reduce(DataFrame.unionByName, counts), "paths")
    discard(*counts)
    ratio = dealt.join(paths.select("source", F.col("node").alias("src"), F.col("n").alias("n_src")), ["source", "src"]).join(paths.select("source", F.col("node").alias("dst"), F.col("n").alias("n_dst")), ["source", "dst"])
    part = written(ratio.select("source", "src", "dst", "level", (F.col("n_src") * F.col("paths") / F.col("n_dst")).alias("part")), "steps")
    discard(dealt)
    return d.join(paths, ["source", "node"]).select("source", "node", "d", F.col("n").alias("paths")), part


def backward(steps: DataFrame, adds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, src, dst, x), the edges' shares of the shortest paths to all nodes, and (source, node, x), what goes on
    beyond each node. ``adds`` (source, node, x): targets beyond a node that the edges don't reach."""
    far = steps.agg(F.max("level")).first()[0] or 0
    done = []
    extra = [] if adds is None else [adds.select("source", "node", "x")]
    beyond = lambda: reduce(DataFrame.unionByName, [s.select("source", F.col("src").alias("node"), "x") for s in done] + extra)
    for at in range(far, 0, -1):
        here = steps.where(F.col("level") == at)
        if done or extra:
            here = here.join(beyond().groupBy("source", F.col("node").alias("dst")).agg(F.sum("x").alias("below")), ["source", "dst"], "left")
        else:
            here = here.withColumn("below", F.lit(0.0))
        done.append(written(here.select("source", "src", "dst", (F.col("part") * (1 + F.coalesce("below", F.lit(0.0)))).alias("x")), "shares"))
    if not done:
        shares = steps.select("source", "src", "dst", F.lit(0.0).alias("x")).limit(0)
        return shares, (extra[0] if extra else shares.select("source", F.col("src").alias("node"), "x"))
    return reduce(DataFrame.unionByName, done), beyond().groupBy("source", "node").agg(F.sum("x").alias("x"))
