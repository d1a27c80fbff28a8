"""Distances in hops from every node, 64 sources to a word of bits, and no row for a pair of nodes.

A search from 64 sources at once keeps a word a node: bit k is set once source k has reached it. A step sends each word's new
bits along the edges and ors them together where they meet; how many bits are new says how many sources reach the node in
that many hops, which is all that closeness sums. Graphs that are small enough are broadcast as arrays and searches are
dealt to tasks; beyond that, words are rows and a step is a join and an aggregate, with ``TOGETHER`` searches side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from terraline.session import discard, fits, written

#: Searches of 64 sources that joins follow at once.
TOGETHER = 64


def _by_arrays(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    found = edges.toPandas()
    ids, ends = np.unique(np.r_[found.src.to_numpy(), found.dst.to_numpy()], return_inverse=True)
    src, dst = ends[: len(found)], ends[len(found) :]
    order = np.argsort(dst, kind="stable")
    heads, starts = np.unique(dst[order], return_index=True)
    known = spark.sparkContext.broadcast((ids, src[order], heads, starts))
    searches = -(-len(ids) // 64)
    tasks = spark.range(0, searches, 1, max(1, min(searches, 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        ids, src, heads, starts = known.value
        reached, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            for search in batch.column(0).to_pylist():
                own = np.arange(64 * search, min(64 * (search + 1), len(ids)))
                seen = np.zeros(len(ids), np.uint64)
                seen[own] = np.uint64(1) << (own - 64 * search).astype(np.uint64)
                new, hops = seen.copy(), 0
                while True:
                    hops += 1
                    met = np.bitwise_or.reduceat(new[src], starts) & ~seen[heads]
                    if not met.any():
                        break
                    new = np.zeros(len(ids), np.uint64)
                    new[heads] = met
                    seen |= new
                    n = np.bitwise_count(met).astype(np.int64)
                    reached[heads] += n
                    total[heads] += hops * n
        at = np.flatnonzero(reached)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at], to_arrow_type(kind)), pa.array(reached[at]), pa.array(total[at])], ["node", "r", "s"])

    schema = T.StructType([T.StructField("node", kind), T.StructField("r", T.LongType()), T.StructField("s", T.LongType())])
    return tasks.mapInArrow(run, schema) if len(found) else spark.createDataFrame([], schema)


def _by_joins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by joins. Sources are numbered within pieces of the ids, so no window holds all of them."""
    edges = written(edges, "hop-edges")
    pieces = F.pmod(F.xxhash64("node"), F.lit(1024))
    numbered = nodes.withColumn("_piece", pieces).withColumn("_n", F.row_number().over(Window.partitionBy("_piece").orderBy("node")) - 1)
    searches = written(numbered.select("node", "_piece", F.floor(F.col("_n") / 64).alias("word"), F.expr("shiftleft(1L, cast(_n % 64 as int))").alias("bits")), "hop-sources")
    groups = searches.agg(F.max("word")).first()[0]
    parts = []
    # A group is a word's number in some of the pieces: at most TOGETHER searches.
    for word in range(0 if groups is None else groups + 1):
        for piece in range(0, 1024, TOGETHER):
            begin = searches.where((F.col("word") == word) & (F.col("_piece") >= piece) & (F.col("_piece") < piece + TOGETHER)).select("node", F.col("_piece").alias("search"), "bits")
            seen = written(begin, "hop-seen")
            new, hops = seen, 0
            while new.limit(1).count():
                hops += 1
                met = new.join(edges, new.node == edges.src).groupBy(F.col("dst").alias("node"), "search").agg(F.bit_or("bits").alias("bits"))
                fresh = met.join(seen.withColumnRenamed("bits", "_seen"), ["node", "search"], "left").select("node", "search", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")
                step = written(fresh, "hop-new")
                parts.append(step.groupBy("node").agg(F.sum(F.bit_count("bits").cast("long")).alias("r")).withColumn("s", F.col("r") * hops))
                wider = written(seen.unionByName(step).groupBy("node", "search").agg(F.bit_or("bits").alias("bits")), "hop-seen")
                parts[-1] = written(parts[-1], "hop-sums")
                discard(*{new, seen})
                new, seen = step, wider
            discard(*{new, seen})
    if not parts:
        return nodes.select("node", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("s")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reached(edges: DataFrame, max_edges: int) -> DataFrame:
    """(node, r, s): how many other nodes reach a node along the directed edges (src, dst), and the sum of their hops, for
    nodes that any reaches. Graphs with at most ``max_edges`` different edges are broadcast."""
    along = written(edges.where("src <> dst").select("src", "dst").distinct(), "hop-edges")
    nodes = along.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = _by_arrays(along, nodes) if fits(along, max_edges) else _by_joins(along, nodes)
    return found.groupBy("node").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
