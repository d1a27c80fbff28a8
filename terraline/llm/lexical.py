"""Ranked lexical search with a two-level quantised index.

A term's share of a document's score, without the term's weight, is s = (10**9 * tf) div (1000 * tf + 20 * m), where m
grows with the document's length; a query's score is the sum of weight * s over its terms. The index keeps segments of
documents, and a row for each segment and term that it holds, with two levels of arrays:

- level 1: the documents' places in the segment and one byte each, s in steps of ``STEP``, rounded up;
- level 2: the exact counts tf.

``STEP`` * sum of weight * byte is an upper bound of a score, and ``STEP`` * sum of weight * (byte - 1) a lower one. For
each segment and block of queries the bounds of all documents are added up term by term; every document whose upper bound
reaches the k-th best lower bound, or the k-th best exact score that the task has met before, is scored again from level 2
in 64-bit integers. A task sends k rows a query; the best k of all are the result, exactly.

Queries are dealt into blocks of about ``BLOCK`` by a hash. A term's index rows meet the blocks that ask for it, then rows
are shuffled by block and segment, so no row meets a whole term or a whole query; a copy of the index isn't needed
anywhere. A segment has at most ``SEGMENT_DOCS`` documents and ends with the text that reaches ``SEGMENT_BYTES``.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. Defined results: a
null text has no terms; a null id is an id like any other and sorts first among equal scores; documents that repeat an id
are documents each; rows that repeat an item_id are one query with the terms of all of them; a query without a term that
some document holds has no rows; an index without documents answers nothing.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraline.llm.exact_dedup import LOWER, UPPER
from terraline.llm.fill_middle import _slices
from terraline.session import fits, written

#: Size of a byte's step: 255 of them are the most that s can be.
STEP = 3922
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 16 << 20
#: Queries in a block, about.
BLOCK = 128
#: Different terms of all queries that may be broadcast to the index; more are joined by a shuffle.
MAX_BROADCAST_TERMS = 200_000

#: Bytes that are no part of a term as spaces, A-Z in lower case.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INSIDE = np.frombuffer(_PLAIN, np.uint8) != 32


def terms_of(text: Column) -> Column:
    """array<string> of a text's terms, with repeats."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")


@dataclass(frozen=True)
class LexicalIndex:
    """``rows``: (segment, term, n, places, bytes, counts), and for each segment one row without a term that holds its
    documents' ids and m. ``n_docs``: documents with a term; ``n_terms``: all terms with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts."""
    texts = column.fill_null("").cast(pa.large_binary())
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, n_terms) of slices of batches: the beginnings of terms, counted over all of a slice's bytes at once."""

    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch.column(0))
            many = total = 0
            for at, to in _slices(offsets):
                begins, ends = offsets[at:to] - offsets[at], offsets[at + 1 : to + 1] - offsets[at]
                inside = _INSIDE[data[offsets[at] : offsets[to]]]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                some = begins[begins < ends]
                first[some] = inside[some]
                each = np.add.reduceat(first, some, dtype=np.int64) if len(some) else np.zeros(0, np.int64)
                many, total = many + int((each > 0).sum()), total + int(each.sum())
            yield pa.RecordBatch.from_arrays([pa.array([many]), pa.array([total])], ["n_docs", "n_terms"])

    return docs.select(text).mapInArrow(run, "n_docs long, n_terms long")


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


_ROWS = "segment long, term string, n int, places binary, bytes binary, counts binary, ids array<{kind}>, m array<long>"


class _Segment:
    """Documents that are being gathered into a segment: the number of each different term, and by document and term in
    turn the term's number, the document's place and the count."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids, self.lengths, self.numbers = [], [], {}
        self.terms, self.held, self.counts = array("i"), array("i"), array("i")

    def add(self, doc_id, text: bytes) -> None:
        counter = Counter(text.translate(_PLAIN).split())
        numbers = self.numbers
        self.terms.extend([numbers.setdefault(t, len(numbers)) for t in counter])
        self.counts.extend(counter.values())
        self.held.append(len(counter))
        self.ids.append(doc_id)
        self.lengths.append(counter.total())
        self.size += len(text)

    def full(self) -> bool:
        return len(self.ids) == SEGMENT_DOCS or self.size >= SEGMENT_BYTES

    def rows(self, n_docs: int, n_terms: int, kind: pa.DataType) -> pa.RecordBatch:
        """The segment's head, then a row a term."""
        term, counts = np.frombuffer(self.terms, np.int32), np.frombuffer(self.counts, np.int32)
        places = np.repeat(np.arange(len(self.ids), dtype=np.int16), np.frombuffer(self.held, np.int32))
        order = np.argsort(term, kind="stable")
        places, counts = places[order], counts[order]
        m = 50 + 50 * np.array(self.lengths, np.int64) * n_docs // max(n_terms, 1)
        steps = (-(-shares(counts.astype(np.int64), m[places]) // STEP)).astype(np.uint8)
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.numbers)))] if len(term) else np.zeros(1, np.int64)

        def cells(values: np.ndarray) -> pa.Array:
            ends = (starts * values.itemsize).astype(np.int32)
            body = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
            return pa.concat_arrays([pa.nulls(1, pa.binary()), body])

        none, n = [None] * len(self.numbers), len(self.numbers)
        terms = pa.array([None, *self.numbers], pa.binary()).cast(pa.string())
        columns = [pa.array(np.full(n + 1, self.number)), terms, pa.array([len(self.ids), *np.diff(starts).tolist()], pa.int32()), cells(places), cells(steps), cells(counts), pa.array([self.ids, *none], pa.list_(kind)), pa.array([m.tolist(), *none], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["segment", "term", "n", "places", "bytes", "counts", "ids", "m"])


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Indexes every row of ``docs``; texts are read twice and don't move. The index is a written table."""
    total = lengths(docs, text).agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        segment = _Segment(TaskContext.get().partitionId() << 32)
        arrow = pa.int64()
        for batch in batches:
            arrow = batch.column(0).type
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for i, t in zip(some.column(0).to_pylist(), some.column(1).fill_null("").cast(pa.binary()).to_pylist()):
                    segment.add(i, t)
                    if segment.full():
                        yield segment.rows(n_docs, n_terms, arrow)
                        segment = _Segment(segment.number + 1)
        if segment.ids:
            yield segment.rows(n_docs, n_terms, arrow)

    rows = docs.select(doc_id, text).mapInArrow(run, _ROWS.format(kind=kind))
    return LexicalIndex(written(rows, "lexical-index"), n_docs, n_terms)


def weights(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """(term, w) of the terms of ``wanted`` (term) that some document holds."""
    df = index.rows.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    return df.select("term", F.floor(1000 * F.log((2.0 * F.lit(index.n_docs) + 2) / (2.0 * F.col("df") + 1))).alias("w"))


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id, ids that are null (``known`` is false) first."""
    return np.lexsort((ids, known, -scores))[:k]


class _Block:
    """The best of a block of queries over the segments that a task has met."""

    def __init__(self, block: int, n: int, k: int):
        self.block, self.k = block, k
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.known = [np.zeros(0, bool)] * n
        self.floor = np.zeros(n, np.int64)

    def add(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, rows: list) -> None:
        """A segment: rows of (w, queries, places, bytes, counts) for its terms."""
        n, size = len(self.scores), len(ids)
        upper, held = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
        for w, asked, places, steps, _ in rows:
            at = np.ix_(asked, places)
            upper[at] += w * steps
            held[at] += w
        lower = (upper - held) * STEP
        floor = self.floor
        if size > self.k:
            floor = np.maximum(floor, np.partition(lower, size - self.k, axis=1)[:, size - self.k])
        again = (upper > 0) & (upper * STEP >= floor[:, None])
        score = np.zeros((n, size), np.int64)
        for w, asked, places, _, counts in rows:
            at = np.ix_(asked, places)
            i, j = np.nonzero(again[at])
            score[asked[i], places[j]] += w * shares(counts[j], m[places[j]])
        for q in np.flatnonzero(again.any(axis=1)):
            at = np.flatnonzero(again[q] & (score[q] > 0))
            s, i, o = np.r_[self.scores[q], score[q, at]], np.r_[self.ids[q], ids[at]], np.r_[self.known[q], known[at]]
            best = _best(s, i, o, self.k)
            self.scores[q], self.ids[q], self.known[q] = s[best], i[best], o[best]
            if len(best) == self.k:
                self.floor[q] = s[best[-1]]

    def rows(self):
        queries = np.repeat(np.arange(len(self.scores)), [len(s) for s in self.scores])
        ids = pa.array(np.concatenate(self.ids), pa.int64(), mask=~np.concatenate(self.known))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(queries), self.block, np.int32)), pa.array(queries.astype(np.int32)), ids, pa.array(np.concatenate(self.scores))], ["block", "place", "doc_id", "score"])


def _scorer(sizes: dict[int, int], k: int):
    """Rows sorted by block and segment, a segment's head first, to each block's best."""

    def run(batches):
        best, key, head, rows = None, None, None, []
        for batch in batches:
            for block, segment, w, asked, places, steps, counts, ids, m in zip(*[batch.column(c).to_pylist() for c in ("block", "segment", "w", "asked", "places", "bytes", "counts", "ids", "m")]):
                if (block, segment) != key:
                    if rows:
                        best.add(*head, rows)
                    if best is None or best.block != block:
                        if best is not None:
                            yield best.rows()
                        best = _Block(block, sizes[block], k)
                    key, head, rows = (block, segment), None, []
                if ids is not None:
                    known = np.array([i is not None for i in ids])
                    head = np.array([i or 0 for i in ids], np.int64), known, np.array(m, np.int64)
                else:
                    rows.append((w, np.array(asked, np.int64), np.frombuffer(places, np.int16).astype(np.int64), np.frombuffer(steps, np.uint8).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.int64)))
        if rows:
            best.add(*head, rows)
        if best is not None:
            yield best.rows()

    return run


def search(index: LexicalIndex, queries: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``queries`` with a score above 0, equal scores
    by smaller id. Ids of documents are whole numbers."""
    spark = queries.sparkSession
    asked = queries.select(F.col(item_id).alias("item_id"), F.array_distinct(terms_of(F.col(text))).alias("terms"))
    blocks = max(1, -(-asked.select("item_id").distinct().count() // BLOCK))
    place = Window.partitionBy("block").orderBy("item_id")
    items = written(asked.select("item_id").distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("place", (F.row_number().over(place) - 1).cast("int")), "items")
    sizes = {r.block: r.n for r in items.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a number a block
    terms = asked.withColumnRenamed("item_id", "_item").join(items, F.col("_item").eqNullSafe(F.col("item_id"))).select("block", "place", F.explode("terms").alias("term"))
    terms = written(terms.groupBy("term", "block").agg(F.array_sort(F.collect_set("place")).alias("asked")), "asked-terms")
    few = fits(terms, MAX_BROADCAST_TERMS)
    small = F.broadcast if few else (lambda df: df)
    weighted = written(terms.join(weights(index, small(terms.select("term").distinct())), "term"), "weighted-terms")
    met = index.rows.join(small(weighted), "term").select("block", "segment", "term", "w", "asked", "places", "bytes", "counts", F.lit(None).cast(index.rows.schema["ids"].dataType).alias("ids"), F.lit(None).cast("array<long>").alias("m"))
    each = F.explode(F.array(*[F.lit(b) for b in sorted(sizes)]).cast("array<int>"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("w", "long"), ("asked", "array<int>"))}
    heads = index.rows.where("term is null").withColumns(nothing | {"block": each}).select(*met.columns)
    groups = met.unionByName(heads).repartition("block", "segment").sortWithinPartitions("block", "segment", F.col("term").asc_nulls_first())
    found = groups.mapInArrow(_scorer(sizes, k), "block int, place int, doc_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(items) if fits(items, MAX_BROADCAST_TERMS) else items, ["block", "place"]).select("item_id", "rank", "doc_id", "score")
