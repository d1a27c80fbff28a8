"""SimHash fingerprints and exact near-duplicate groups by covering locality-sensitive hashing.

A pair within ``radius`` bits must collide in some table: every bit position i has a vector phi(i) of radius + 1 bits,
and table v (each non-zero vector) keeps the bits with <phi(i), v> = 1. The phi of at most ``radius`` differing bits
cannot span the space, so some v is orthogonal to all of them and that table drops every differing bit.

Rows with one fingerprint are one before anything is compared. A bucket yields a spanning forest of its links, not its
pairs. A bucket of more than ``MAX_BUCKET`` fingerprints is covered again over the bits that its table drops, which
leaves at most 2**(half of these bits) fingerprints a bucket, so nothing is capped.

Defined results: a null text is empty; a text without words has fingerprint 0, which links like any other; documents
that share an id are rows of their own with one component; a null id can't be the smallest of a group that has another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraline.llm.bpe import _with
from terraline.operators.graph import connected_components
from terraline.session import fits, written

MAX_BUCKET = 20_000
#: More rows to leave out than this are found by a join instead of a broadcast.
MAX_BROADCAST_IDS = 100_000


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of ``size`` words, ASCII letters in lower case; of all words if fewer."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]


def majority(hashes: list[int]) -> int:
    """The bits set in over half of ``hashes``, as a signed 64-bit integer."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, out: str = "fp") -> DataFrame:
    """Adds the 64-bit fingerprint of ``text`` and leaves the text out. No shuffle."""
    kept = docs.drop(out) if out in docs.columns else docs
    rest = [f.name for f in kept.schema if f.name != text]
    schema = _with(T.StructType([f for f in kept.schema if f.name != text]), T.StructField(out, T.LongType()))

    def run(batches):
        for batch in batches:
            found = [majority(shingle_hashes(t or "", shingle)) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in rest] + [pa.array(found, pa.int64())], [*rest, out])

    return kept.mapInArrow(run, schema)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """A mask of ``positions`` for every non-zero vector; a set of at most ``radius`` positions misses one of them. Of
    some regular ways to deal vectors to positions, the one whose smallest mask is largest: a mask of few bits would
    have few large buckets."""
    n, half = 2 ** (radius + 1) - 1, 2**radius

    def masks(phi) -> list[int]:
        at = [(1 << p, phi(k)) for k, p in enumerate(positions)]
        return [sum(bit for bit, x in at if (x & v).bit_count() % 2) for v in range(1, n + 1)]

    steps = range(1, min(n, 64), 2)
    ways = [masks(lambda k, m=m: 1 + k * m % n) for m in steps] + [masks(lambda k, m=m: half + k * m % half) for m in steps]
    return max(ways, key=lambda w: min(x.bit_count() for x in w))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs, each within ``radius``, that connect what is connected in ``members`` (unsigned, distinct)."""
    left, links = np.arange(len(members)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(members[left] ^ members[x]) <= radius
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                queue += found.tolist()
                left = left[~near]
    return links


_LINKS = "a long, b long, tbl int, key long, fp long"


def _linker(masks: list[int], radius: int, again: bool):
    """Reads rows sorted by (tbl, key, fp); yields links (a, b), and where ``again`` the rows of the next level."""

    def deeper(table: int, rows: np.ndarray) -> pa.RecordBatch:
        mask = masks[table]
        free = [i for i in range(64) if not mask >> i & 1]
        out = [(table * len(masks) + k, rows & np.uint64(mask | more)) for k, more in enumerate(covering_masks(free, radius))]
        n = len(rows)
        return pa.RecordBatch.from_pydict(
            {"a": pa.nulls(n * len(out), pa.int64()), "b": pa.nulls(n * len(out), pa.int64()), "tbl": pa.array(np.repeat([t for t, _ in out], n), pa.int32()), "key": pa.array(np.concatenate([k for _, k in out]).view(np.int64)), "fp": pa.array(np.tile(rows, len(out)).view(np.int64))}
        )

    def pairs(a: list, b: list) -> pa.RecordBatch:
        a, b = np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "tbl": pa.nulls(len(a), pa.int32()), "key": pa.nulls(len(a), pa.int64()), "fp": pa.nulls(len(a), pa.int64())})

    def run(batches):
        held, at, large = np.array([], np.uint64), None, False  # the bucket that may go on, and whether part of it has gone deeper
        for batch in batches:
            tables, keys, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(rows):
                continue
            rows = rows.view(np.uint64)
            if at != (tables[0], keys[0]):
                if len(held):
                    yield from finish(at[0], held, large)
                held, large = held[:0], False
            tables, keys, rows = np.r_[np.full(len(held), tables[0]), tables], np.r_[np.full(len(held), keys[0]), keys], np.r_[held, rows]
            starts = np.flatnonzero(np.r_[True, (tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])])
            whole = [*zip(starts[:-1].tolist(), starts[1:].tolist())]
            if large and whole:
                yield from finish(tables[0], rows[: whole[0][1]], True)
                starts, whole, large = starts[1:], whole[1:], False
            two = starts[:-1][np.diff(starts) == 2]
            near = np.bitwise_count(rows[two] ^ rows[two + 1]) <= radius
            if near.any():
                yield pairs(rows[two][near], rows[two + 1][near])
            for start, end in whole:
                if end - start > 2:
                    yield from finish(tables[start], rows[start:end], False)
            held, at = rows[starts[-1] :], (tables[-1], keys[-1])
            if again and (large or len(held) > MAX_BUCKET):
                yield deeper(int(at[0]), held)
                held, large = held[:0], True
        if len(held):
            yield from finish(at[0], held, large)

    def finish(table, rows, large):
        if again and (large or len(rows) > MAX_BUCKET):
            yield deeper(int(table), rows)
        elif links := spanning_links(rows, radius):
            yield pairs([rows[x] for x, _ in links], [rows[y] for _, y in links])

    return run


def links(distinct: DataFrame, radius: int = 4, fp: str = "fp") -> DataFrame:
    """(a, b): links between different fingerprints that connect all that links within ``radius`` connect."""
    masks = covering_masks(list(range(64)), radius)
    rows = distinct.select(F.col(fp).alias("fp"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("tbl", "key")).select("tbl", "key", "fp")
    found = written(rows.repartition("tbl", "key").sortWithinPartitions("tbl", "key", "fp").mapInArrow(_linker(masks, radius, True), _LINKS), "simhash-links")
    more = found.where("fp is not null").select("tbl", "key", "fp").repartition("tbl", "key").sortWithinPartitions("tbl", "key", "fp").mapInArrow(_linker(masks, radius, False), _LINKS)
    return found.where("a is not null").select("a", "b").union(more.select("a", "b"))


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, fp, part, component_id) for every row: ``part`` names the group by its smallest
    fingerprint, ``component_id`` is the smallest id that links reach. Texts don't shuffle."""
    marked = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text")), "text", shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    parts = connected_components(links(classes.select("fp"), radius), "a", "b")
    grouped = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part"))
    smallest = grouped.groupBy("part").agg(F.min("first_id").alias("component_id"))
    of = grouped.join(smallest, "part").select("fp", "part", "component_id")
    return marked.join(of, "fp", "left").select("doc_id", *keep, "fp", "part", "component_id")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of texts that links of a shingle similarity of 0.8 or more join: the smallest
    id, then the smallest hash of the text; equal rows are one."""
    from terraline.llm.similar_sets import groups

    marked = docs.withColumn("_terraline_row", F.xxhash64(F.col(text)))
    of = written(groups(marked.select(F.col(doc_id).alias("doc_id"), F.col("_terraline_row").alias("_row"), F.col(text).alias("text")), shingle, radius), "groups")
    first = of.groupBy("part").agg(F.min(F.struct("doc_id", "_row")).alias("first"))
    gone = written(of.join(first, "part").where(~F.struct("doc_id", "_row").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("_terraline_id"), F.col("_row").alias("_terraline_gone")).distinct(), "near-copies")
    gone = F.broadcast(gone) if fits(gone, MAX_BROADCAST_IDS) else gone
    kept = marked.join(gone, F.col(doc_id).eqNullSafe(F.col("_terraline_id")) & F.col("_terraline_row").eqNullSafe(F.col("_terraline_gone")), "left_anti")
    twice = of.groupBy("doc_id", "_row").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([doc_id, "_terraline_row"]) if twice else kept).drop("_terraline_row")
