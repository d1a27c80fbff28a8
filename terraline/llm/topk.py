"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; a segment keeps its mean and its deviation. For two segments of length L the squared
distance is at least L * ((mean - mean')**2 + (dev - dev')**2); with the squared norms that bounds the inner product
from above by the sum of L * (mean * mean' + dev * dev'). Levels go from few segments to many, each sees the survivors
of the one before, and what survives the finest is computed exactly. Sums of whole numbers below 2**53 are exact.

Queries are dealt into blocks and rows into chunks, both of bounded size, by their ids; each pair of a block and a chunk
is a group of rows, the block's queries first, so a task holds one block while a chunk's rows stream by, and only the
best k of each query leave it. Nothing passes through the driver but two counts. The queries of a block that are rows of
the searched vectors are candidates of each other, so each query begins with a score that its k-th best can't be below.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length
than a query's are none of its candidates; rows that repeat a query's id are one query (the smallest vector of them)
and none of its candidates; rows that repeat another id are candidates each. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraline.session import written

#: Queries in a block, which a task holds at once, and rows in a chunk, which meet a block in one task.
BLOCK, CHUNK = 4096, 200_000
#: Tasks of a search at most; more groups than these share tasks.
MAX_TASKS = 10_000
#: Segments at each level, coarse to fine.
LEVELS = (1, 4, 16)


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as array<double>; null where the vector takes no part."""
    clean = embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(clean, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment: dot products of them bound inner products."""
    parts = np.array_split(vectors, min(segments, vectors.shape[1]), axis=1)
    return np.hstack([np.c_[p.mean(axis=1), p.std(axis=1)] * np.sqrt(p.shape[1]) for p in parts])


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)


class Block:
    """Queries of one length, their features at every level and what their k-th best score is at least."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, rows: np.ndarray):
        """``rows``: which of the queries are rows of the searched vectors; only their scores are a floor."""
        self.ids, self.vectors, self.k = ids, vectors, k
        self.features = [segment_features(vectors, s) for s in LEVELS]
        self.floor = np.full(len(ids), -np.inf)
        for at in range(0, len(ids), 512):
            part = vectors[at : at + 512] @ vectors.T
            part[(ids[at : at + 512, None] == ids[None, :]) | ~rows] = -np.inf
            self.floor[at : at + 512] = _kth_best(part, k)

    def search(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray):
        """Pairs (query index, row index, score) of rows that may be among the best k."""
        norms = np.linalg.norm(self.vectors, axis=1), np.linalg.norm(vectors, axis=1)
        slack = 1e-9 * norms[0][:, None] * norms[1][None, :] + 1e-6  # rounding of the bounds
        alive = self.features[0] @ segment_features(vectors, LEVELS[0]).T + slack >= floor[:, None]
        alive &= self.ids[:, None] != ids[None, :]
        q, r = np.nonzero(alive)
        for level, segments in enumerate(LEVELS[1:], 1):
            rows, near = segment_features(vectors, segments), np.zeros(len(q), bool)
            for at in range(0, len(q), 200_000):
                a, b = q[at : at + 200_000], r[at : at + 200_000]
                near[at : at + 200_000] = np.einsum("ij,ij->i", self.features[level][a], rows[b]) + slack[a, b] >= floor[a]
            q, r = q[near], r[near]
        scores = np.empty(len(q))
        for at in range(0, len(q), 200_000):
            scores[at : at + 200_000] = np.einsum("ij,ij->i", self.vectors[q[at : at + 200_000]], vectors[r[at : at + 200_000]])
        fine = scores >= floor[q]
        return q[fine], r[fine], scores[fine]


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The best k of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < k], ids[place < k], scores[place < k]


def _vectors(column: pa.ListArray, rows: np.ndarray, n: int) -> np.ndarray:
    """Vectors of length ``n`` at ``rows``."""
    first, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return flat[first[rows][:, None] + np.arange(n)[None, :]]


class _Search:
    """The best k of a block's queries over the rows that have streamed by."""

    def __init__(self, k: int):
        self.k, self.asked, self.blocks = k, [], None

    def ask(self, ids: np.ndarray, column: pa.ListArray, known: np.ndarray) -> None:
        self.asked.append((ids, column, known))

    def begin(self) -> None:
        by_length: dict[int, list] = {}
        for ids, column, known in self.asked:
            lengths = np.diff(column.offsets.to_numpy())
            for n in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == n)
                by_length.setdefault(n, []).append((ids[at], _vectors(column, at, n), known[at]))
        self.blocks = {n: Block(*(np.concatenate(x) for x in list(zip(*parts))[:2]), self.k, np.concatenate([p[2] for p in parts])) for n, parts in by_length.items()}
        self.best, self.floors, self.asked = {}, {n: b.floor.copy() for n, b in self.blocks.items()}, []

    def rows(self, ids: np.ndarray, column: pa.ListArray) -> None:
        if self.blocks is None:
            self.begin()
        lengths = np.diff(column.offsets.to_numpy())
        for n, queries in self.blocks.items():
            whole = np.flatnonzero(lengths == n)
            for at in range(0, len(whole), 1024):
                some = whole[at : at + 1024]
                q, r, scores = queries.search(ids[some], _vectors(column, some, n), self.floors[n])
                found, held = (q, ids[some][r], scores), self.best.get(n)
                if held is not None:
                    found = tuple(map(np.concatenate, zip(held, found)))
                self.best[n] = q, _, s = _best(*found, self.k)
                kth = np.flatnonzero(np.bincount(q, minlength=len(queries.ids)) == self.k)
                if len(kth):
                    last = np.searchsorted(q, kth, side="right") - 1
                    self.floors[n][kth] = np.maximum(self.floors[n][kth], s[last])

    def result(self):
        for n, (q, ids, scores) in (self.best if self.blocks is not None else {}).items():
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(self.blocks[n].ids[q]), "vec_id": pa.array(ids), "score": pa.array(scores.astype(np.int64))})


def _searcher(k: int):
    def run(batches):
        at, search = None, None
        for batch in batches:
            groups, chunks, roles = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(groups):
                continue
            edges = np.flatnonzero((groups[1:] != groups[:-1]) | (chunks[1:] != chunks[:-1]) | (roles[1:] != roles[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(groups)]):
                if at != (groups[start], chunks[start]):
                    if search is not None:
                        yield from search.result()
                    at, search = (groups[start], chunks[start]), _Search(k)
                part = batch.slice(start, end - start)
                ids, column = part.column(3).to_numpy(zero_copy_only=False), pa.concat_arrays([part.column(4)])
                if roles[start] == 0:
                    search.ask(ids, column, part.column(5).to_numpy(zero_copy_only=False).astype(bool))
                else:
                    search.rows(ids, column)
        if search is not None:
            yield from search.result()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score). Both inputs: vec_id long, v array<double> of whole numbers."""
    rows = vectors.where("v is not null and vec_id is not null").select(F.col("vec_id").cast("long"), "v")
    asked = queries.where("v is not null and vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))
    found = rows.join(asked, ["vec_id", "v"], "left_semi").distinct().withColumn("known", F.lit(True))
    asked = written(asked.join(found, ["vec_id", "v"], "left").withColumn("known", F.coalesce("known", F.lit(False))), "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    chunks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // CHUNK))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = asked.select(deal(blocks, 1).alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("role"), "vec_id", "v", "known")
    passing = rows.select(every(blocks).alias("block"), deal(chunks, 2).alias("chunk"), F.lit(1).alias("role"), "vec_id", "v", F.lit(False).alias("known"))
    groups = held.union(passing).repartition(min(MAX_TASKS, blocks * chunks), "block", "chunk").sortWithinPartitions("block", "chunk", "role")
    best = groups.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
