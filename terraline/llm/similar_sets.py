"""Links between all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Two sets this similar share a shingle among the first n - ceil(0.8 n) + 1 of each (n shingles in one fixed order), so
buckets by these shingles miss no pair. Any order is right; shingles that are frequent in a sample of texts come last,
which keeps what many texts share out of the buckets. A pair that shares s first shingles has at most
s + max(ceil(0.8 n) - 1, ceil(0.8 m) - 1) in common, and at most as many as its elements whose bit in a sketch the
other one has too, so most pairs that aren't similar go by these bounds; every link is verified by the
whole sets.

Groups are all that is wanted, so a pair is left out only where verified links join its ends already: first SimHash
links are verified, then, in two rounds, each set with the one of its buckets' leaders that it shares most with, then
what is left between groups. A bucket's leader is the set that has most neighbours over all its buckets: the copies of a
text may be less alike than 0.8 among themselves, but each is like the text that they were made from.

What is left are many pairs just below 0.8 in large families of copies. No row is made for a pair of them: a task links what
the bounds can't tell apart by a forest, and whole sets are compared within the components of these forests.

Shingles and sets are told by 64-bit hashes. A text without words has the empty set; empty sets are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraline.llm.simhash import links, majority, shingle_hashes
from terraline.operators.graph import connected_components
from terraline.session import discard, fits, written

#: Texts that the order of shingles is taken from, and shingles that it tells apart from rare ones.
SAMPLE, FREQUENT = 20_000, 100_000
#: More sets to verify than this meet their texts by a join instead of a broadcast.
MAX_BROADCAST_SETS = 100_000
#: Least bits of a set's sketch, and how many elements a bit stands for at most: fuller sketches would tell nothing.
BITS, LOAD = 1024, 1.25
#: A leader's pairs are verified so many to a group of rows.
AT_ONCE = 1_000
#: Elements of a block of sets that a task compares with another block, and sets that a task's forest holds at once.
ELEMENTS, AT_HAND = 1_000_000, 500_000


def _set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether |a & b| >= 0.8 |a | b| of two sorted sets, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def share_of(share: float, *columns: str) -> Column:
    """Whether a row is in a sample by the hash of ``columns``; a share however small stays above nothing."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**53)) < int(share * 2**53)


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that a sample of texts has most often."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))

    def run(batches):
        for batch in batches:
            found = [_set(shingle_hashes(text or "", shingle)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate([np.array([], np.uint64), *found]).view(np.int64))})

    counts = docs.where(share_of(share, "doc_id", "_row")).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c"))
    most = counts.where("c > 2").orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    hashes, times = most.h.to_numpy(np.int64).view(np.uint64), most.c.to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def _sketch(found: np.ndarray) -> bytes:
    """A bit for each element, in a power of two of bits that grows with the set."""
    size = BITS
    while size * LOAD < len(found):
        size *= 2
    bits = np.zeros(size, np.uint8)
    bits[found % np.uint64(size)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, the longer ones folded to the shortest one's bits."""
    size = min(map(len, sketches)) // 8
    return np.array([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, size), axis=0) for x in sketches])


def _firsts(found: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles of a set, in the common order, one of which every set similar to it has among its own."""
    often = np.zeros(len(found), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        often = np.where(hashes[at] == found, times[at], 0)
    n = len(found)
    return found[np.lexsort((found, often))][: n - -(-4 * n // 5) + 1]


def _sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, _row, fp, cls, n, firsts, sketch): fingerprint, hash, size, first shingles and sketch of each text's set."""
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps, classes, sizes, firsts, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text or "", shingle)
                found = _set(hashes)
                fps.append(majority(hashes)), sizes.append(len(found))
                classes.append(np.array(xxhash.xxh64_intdigest(found.tobytes()), np.uint64).view(np.int64).item())
                firsts.append(_firsts(found, *order.value).view(np.int64) if len(found) else np.array([], np.int64))
                sketches.append(_sketch(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "_row", "fp", "cls", "n", "firsts", "sketch"])

    return docs.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {kind}, _row long, fp long, cls long, n int, firsts array<long>, sketch binary")


def _whole(docs: DataFrame, asked: DataFrame, columns: str, shingle: int) -> DataFrame:
    """The rows of ``asked`` (``columns``, and _id and _first of a text) with the whole set (members). Other texts are not cut."""
    asked = written(asked, "asked")
    asked = F.broadcast(asked) if fits(asked, MAX_BROADCAST_SETS) else asked
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            known: dict[str, bytes] = {}  # rows of one text are next to each other
            found = []
            for text in batch.column(len(names)).to_pylist():
                if text not in known:
                    known = {text: _set(shingle_hashes(text or "", shingle)).tobytes()}
                found.append(known[text])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*names, "members"])

    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_first")))
    return texts.select(*names, "text").mapInArrow(run, f"{columns}, members binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar. Only texts of these sets are read whole; each set is shuffled once for
    every leader (a) that it is compared with, and a leader once for each ``AT_ONCE`` of its pairs."""
    pairs = written(pairs.where("a <> b").distinct(), "pairs")
    many = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {AT_ONCE}) as int)").alias("groups"))
    leaders = many.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), F.lit(0).alias("role"))
    members = pairs.join(many, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("grp"), F.lit(1).alias("role"))
    asked = leaders.union(members).join(classes.select("cls", F.col("first.doc_id").alias("_id"), F.col("first._row").alias("_first")), "cls")
    def run(batches):
        at, leader = None, None
        for batch in batches:
            left, right = [], []
            for a, grp, role, cls, members in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if role == 0:
                    at, leader = (a, grp), np.frombuffer(members, np.uint64)
                elif at == (a, grp) and similar(leader, np.frombuffer(members, np.uint64)):
                    left.append(a), right.append(cls)
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    whole = _whole(docs, asked, "a long, grp int, role int, cls long", shingle)
    return written(whole.repartition("a", "grp").sortWithinPartitions("a", "grp", "role").mapInArrow(run, "a long, b long").distinct(), "similar")


def _pairs_in(open_rows: DataFrame, leaders: int) -> DataFrame:
    """(a, b) that may be similar by the number of first shingles that they share: rows (key, cls, n, part, w) of
    buckets; pairs of one part are left out. ``leaders``: only pairs (a, b) whose a is the leader (0), or the first that isn't in
    its part (1), of like size in its bucket by the weight w, and of these the one that b shares most with."""

    def run(batches):
        held, waiting, size = None, [], 0
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            for found in pairs([x[: starts[-1]] for x in rows], starts):
                waiting.append(found)
                size += len(found)
                if size > 2_000_000:
                    waiting = [counted(waiting)]
                    size = len(waiting[0])
                    if size > 1_000_000:
                        yield batch_of(waiting[0])
                        waiting, size = [], 0
            held = [x[starts[-1] :] for x in rows]
        if held is not None:
            waiting += pairs(held, np.array([0, len(held[0])]))
        if waiting:
            yield batch_of(counted(waiting))

    def counted(found: list[np.ndarray]) -> np.ndarray:
        """Rows (a, na, b, nb, s) with the s of equal pairs summed: a task's pairs go on once, however many buckets they share."""
        rows = np.concatenate(found)
        order = np.lexsort((rows[:, 2], rows[:, 0]))
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])]) if len(rows) else np.array([], int)
        out = rows[first]
        out[:, 4] = np.add.reduceat(rows[:, 4], first) if len(first) else 0
        return out

    def batch_of(rows: np.ndarray):
        kinds = {"a": np.int64, "na": np.int32, "b": np.int64, "nb": np.int32, "s": np.int32}
        return pa.RecordBatch.from_pydict({name: pa.array(rows[:, k].astype(kind)) for k, (name, kind) in enumerate(kinds.items())})

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.c_[np.repeat(left[None, :], len(right), axis=0), right, np.ones(len(right), np.int64)]

    def pairs(rows, starts):
        several = np.flatnonzero(np.diff(starts) > 1)
        for start, end in zip(starts[several].tolist(), starts[several + 1].tolist()):
            cls, n, part, w = (x[start:end] for x in rows[1:])
            if (part == part[0]).all():
                continue
            both = np.c_[cls, n]
            waiting = np.lexsort((cls, -w))
            while len(waiting) > 1:
                first = waiting[0]
                like = 4 * np.maximum(n[waiting], n[first]) <= 5 * np.minimum(n[waiting], n[first])
                if leaders:
                    others = waiting[like & (part[waiting] != part[first])]
                    first = others[0] if len(others) else first
                found = waiting[like & (part[waiting] != part[first])]
                if len(found):
                    yield joined(both[first], both[found])
                waiting = waiting[~like]

    found = open_rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, na int, b long, nb int, s int")
    most = lambda c: f"cast(ceil(4 * {c} / 5) as int) - 1"
    able = found.groupBy("a", "na", "b", "nb").agg(F.sum("s").alias("s")).where(f"9 * (s + greatest({most('na')}, {most('nb')})) >= 4 * (na + nb)")
    return able.groupBy("b").agg(F.max_by("a", F.struct("s", "a")).alias("a")).select("a", "b")


def _able(na, a: np.ndarray, nb, b: np.ndarray) -> np.ndarray:
    """Which sets of sizes na, nb may be similar by the bits of their sketches a, b that the other one lacks."""
    lost = [np.bitwise_count(x).sum(axis=-1, dtype=np.int64) for x in (a & ~b, b & ~a)]
    return 9 * np.minimum(na - lost[0], nb - lost[1]) >= 4 * (na + nb)


def _near(n: np.ndarray, sketch: np.ndarray, lengths: np.ndarray):
    """A function of a set x and other sets: which of these may be similar to it."""
    at, rows = np.zeros(len(n), int), {}  # place of a set among those of its length; sketches by their length and bits
    for length in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == length)
        at[of] = np.arange(len(of))
        rows[length, length] = _folded(sketch[of].tolist())

    def folded(length: int, size: int) -> np.ndarray:
        if (length, size) not in rows:
            whole = rows[length, length]
            rows[length, size] = np.bitwise_or.reduce(whole.reshape(len(whole), -1, size // 8), axis=1)
        return rows[length, size]

    def near(x: int, others: np.ndarray) -> np.ndarray:
        out = 4 * np.maximum(n[others], n[x]) <= 5 * np.minimum(n[others], n[x])
        for length in np.unique(lengths[others[out]]).tolist():
            some = np.flatnonzero(out & (lengths[others] == length))
            size = min(length, int(lengths[x]))
            out[some] = _able(n[x], folded(int(lengths[x]), size)[at[x]], n[others[some]], folded(length, size)[at[others[some]]])
        return out

    return near


def _forest(batches):
    """Links (a, b) that join all sets of a bucket that may be similar by their sketches, whatever their parts, from rows
    (key, cls, n, part, sketch) sorted by key: fewer links than a task has sets."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def joined(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            if (p := root(x)) != (q := root(y)):
                parent[q] = p
                out.append((x, y))
        return out

    def linked(rows, starts):
        _, cls, n, _, sketch = rows
        n, lengths, size = n.astype(np.int64), np.fromiter(map(len, sketch), np.int64, len(sketch)), np.diff(starts)
        two = starts[:-1][size == 2]
        two = two[4 * np.maximum(n[two], n[two + 1]) <= 5 * np.minimum(n[two], n[two + 1])]
        for both in {*zip(lengths[two].tolist(), lengths[two + 1].tolist())}:
            of = two[(lengths[two] == both[0]) & (lengths[two + 1] == both[1])]
            bits = _folded([*sketch[of], *sketch[of + 1]])
            of = of[_able(n[of], bits[: len(of)], n[of + 1], bits[len(of) :])]
            yield from joined(cls[of], cls[of + 1])
        for start, end in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist()):
            of = cls[start:end]
            if len({root(x) for x in of.tolist()}) == 1:
                continue
            near, left = _near(n[start:end], sketch[start:end], lengths[start:end]), np.arange(end - start)
            while len(left):
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    found = near(x, left)
                    yield from joined(np.repeat(of[x], found.sum()), of[left[found]])
                    queue += left[found].tolist()
                    left = left[~found]

    def batch_of(found):
        return pa.RecordBatch.from_pydict({name: pa.array([x[k] for x in found], pa.int64()) for k, name in enumerate("ab")})

    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if len(rows[0]):
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            yield batch_of([*linked([x[: starts[-1]] for x in rows], starts)])
            held = [x[starts[-1] :] for x in rows]
        if len(parent) > AT_HAND:
            parent.clear()
    if held is not None:
        yield batch_of([*linked(held, np.array([0, len(held[0])]))])


def _joining(block: np.ndarray, cls: np.ndarray, part: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) between similar sets that join all parts that such links join: of sets of one block, or of sets of
    different ones if there are two."""
    n = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, starts = np.repeat(np.arange(len(sets)), n)[np.argsort(codes, kind="stable")], np.r_[0, np.cumsum(np.bincount(codes))]
    ends = np.r_[0, np.cumsum(n)]
    _, at, times = np.unique(part, return_inverse=True, return_counts=True)
    waiting, two, out = np.ones(len(sets), bool), (block != block[0]).any(), []
    for x in np.lexsort((at, times[at])).tolist():  # sets of large parts last: most of what follows them is theirs
        waiting[x] = False
        others = waiting & (at != at[x]) & (4 * np.maximum(n, n[x]) <= 5 * np.minimum(n, n[x]))
        others = np.flatnonzero(others & (block != block[x]) if two else others)
        if not len(others):
            continue
        shared = np.bincount(np.concatenate([owner[starts[c] : starts[c + 1]] for c in codes[ends[x] : ends[x + 1]].tolist()]), minlength=len(sets))
        for y in others[9 * shared[others] >= 4 * (n[x] + n[others])].tolist():
            if at[y] != at[x]:
                out.append((int(cls[x]), int(cls[y])))
                at[at == at[y]] = at[x]
    return out


def _between_parts(open_rows: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between similar sets that join all parts that such links join. ``open_rows`` (key, cls, n, part, sketch):
    buckets of several parts; ``sets`` (cls, n, part, first): every set. A set goes to as many tasks as its component has
    blocks of ``ELEMENTS``."""
    forest = written(open_rows.repartition("key").sortWithinPartitions("key").mapInArrow(_forest, "a long, b long").distinct(), "forest")
    near = connected_components(forest, "a", "b")
    members = written(near.join(sets, near["node"] == sets["cls"]).select("component", "cls", "n", "part", F.col("first.doc_id").alias("_id"), F.col("first._row").alias("_first")), "near-sets")
    discard(forest)
    several = members.groupBy("component").agg(F.expr(f"cast(ceil(sum(n) / {ELEMENTS}) as int)").alias("blocks"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
    dealt = members.join(several, "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    asked = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "part", "_id", "_first")

    def run(batches):
        at, held = None, []
        for batch in batches:
            for *key, block, cls, part, members in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if key != at:
                    yield from found(held)
                    at, held = key, []
                held.append((block, cls, part, np.frombuffer(members, np.uint64)))
        yield from found(held)

    def found(held):
        if len(held) > 1:
            block, cls, part, sets = zip(*held)
            links = _joining(np.array(block), np.array(cls), np.array(part), list(sets))
            yield pa.RecordBatch.from_pydict({name: pa.array([x[k] for x in links], pa.int64()) for k, name in enumerate("ab")})

    whole = _whole(docs, asked, "component long, i int, j int, block int, cls long, part long", shingle)
    return written(whole.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "a long, b long"), "similar")


def _several(batches):
    """The rows of buckets with sets of several parts, and how many sets these have (size), from rows sorted by key."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table["key"].to_numpy()
        cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        yield from _open(table.slice(0, cut), keys[:cut])
        held = table.slice(cut)
    if held is not None:
        yield from _open(held, held["key"].to_numpy())


def _open(table: pa.Table, keys: np.ndarray):
    if len(keys):
        part = table["part"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        mixed, sizes = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts), np.diff(np.r_[starts, len(keys)])
        table = table.append_column("size", pa.array(np.repeat(sizes, sizes).astype(np.int32)))
        yield from table.filter(pa.array(np.repeat(mixed, sizes))).combine_chunks().to_batches()


def groups(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, _row, part) of every row of docs (doc_id, _row, text): ``part`` names the group that links of a
    similarity of 0.8 or more reach. Fingerprints within ``radius`` bits are verified first."""
    marked = written(_sets_of(docs, shingle), "shingle-sets")
    first = F.min(F.struct("doc_id", "_row")).alias("first")
    classes = written(marked.groupBy("cls").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), first, F.first("firsts").alias("firsts"), F.first("sketch").alias("sketch")), "set-classes")

    by_fp = classes.groupBy("fp").agg(F.min("cls").alias("least"))
    near = links(by_fp.select("fp"), radius)
    ends = near.join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    equal = classes.join(by_fp, "fp").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    found = _verified(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(equal), docs, classes, shingle)

    def parts(linked: DataFrame) -> DataFrame:
        return written(connected_components(linked, "a", "b").withColumnRenamed("node", "cls"), "parts")

    part = lambda rows, of: rows.join(of, "cls", "left").withColumn("part", F.coalesce("component", "cls")).drop("component")
    of = parts(found)
    rows = part(classes.select("cls", "n", "firsts"), of).select(F.explode("firsts").alias("key"), "cls", "n", "part")
    columns = "key long, cls long, n int, part long, size int"
    buckets = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_several, columns), "shingle-buckets")
    weights = written(buckets.groupBy("cls").agg(F.sum("size").alias("w")), "weights")
    for leaders in (0, 1):
        rows = part(buckets.select("key", "cls", "n"), of).join(weights, "cls").select("key", "cls", "n", "part", "w")
        found = found.union(_verified(_pairs_in(rows, leaders), docs, classes, shingle))
        discard(of)
        of = parts(found)
    # what is left in buckets of several parts
    left = written(part(buckets.select("key", "cls", "n"), of).select("key", "cls", "n", "part").repartition("key").sortWithinPartitions("key").mapInArrow(_several, columns), "shingle-buckets")
    rows = left.drop("size").join(classes.select("cls", "sketch"), "cls").select("key", "cls", "n", "part", "sketch")
    found = found.union(_between_parts(rows, part(classes.select("cls", "n", "first"), of), docs, shingle))
    discard(of, left)
    of = parts(found)
    discard(buckets)
    return part(marked.select("doc_id", "_row", "cls"), of).select("doc_id", "_row", "part")
