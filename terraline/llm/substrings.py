"""Removal of byte strings that also start earlier in the corpus, by suffix arrays over sampled anchors.

Which bytes go: every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller doc_id, or in
the same document before). Matches never cross documents.

1. Anchors. A gram of ``GRAM`` bytes is an anchor if its hash is the least of all grams in some window of ``length``
   bytes. Equal windows have the anchor at the same place, about three bytes in a hundred are one, and an anchor's
   segment is all windows that hold it. Segments of equal text need no comparing: all but the earliest are covered.
   This collapses within each batch before the shuffle, so a passage that a third of all documents share is a row a batch.
2. Anchors that are left with several different segments send these segments, keyed by the anchor's hash, to tasks that
   lay them out as strings of aligned blocks and sort all suffixes (see ``suffix_order``). Suffixes that share nine
   blocks are neighbours; the ten bytes that a window has beside them tell equal windows apart exactly, and the earliest
   start of each stays.
3. An anchor with more than ``MAX_GROUP`` different segments sends single windows keyed by their own hash instead, so it
   too spreads over tasks.

Equal segments are told by 128 bits of two hashes. Defined results: a null text is empty; a null doc_id is the smallest;
rows that repeat a doc_id are one document, its rows in the order of their texts, and matches don't cross rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraline.session import written

LENGTH, GRAM, BLOCK = 100, 32, 10
#: Windows on either side of an anchor, and bytes of a whole segment.
REACH, WIDE = LENGTH - GRAM, 2 * LENGTH - GRAM
MAX_GROUP = 50_000
#: Segments that a task sorts at once.
AT_ONCE = 20_000

_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in order, for whole numbers that end in one smaller than all others.

    Suffixes are grouped by their Lyndon prefix. Groups are taken in descending order; the previous smaller suffix of each
    member (found by following such pointers) moves behind its own group, once for each time it is met, so groups grow
    by whole Lyndon words and nothing is renamed again. Then, from the smallest suffix on, the suffix before each placed
    one and its chain of previous smaller ones take the next free place of their groups.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place = [0] * n  # of each suffix in order
    group = [0] * n  # each suffix's group: the first place of the group
    size = [0] * n  # of the group that begins at a place
    first, last = 0, None
    for k, i in enumerate(order):
        if symbols[i] != last:
            first, last = k, symbols[i]
        place[i], group[i] = k, first
        size[first] += 1
    smaller = [-1] * n
    high = n - 1
    while high >= 0:
        start = group[order[high]]
        if start == high:
            i = order[high]
            j, g = i - 1, start
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            moves = ((1, [j]),) if j >= 0 else ()
        else:
            met: dict[int, int] = {}
            for i in sorted(order[start : high + 1]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    met[j] = met.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, times in met.items():
                by_times.setdefault(times, []).append(j)
            moves = sorted(by_times.items(), reverse=True)
        for _, some in moves:
            taken: dict[int, int] = {}
            for j in some:  # to the end of their groups
                g = group[j]
                left = size[g] - taken.get(g, 0) - 1
                k, other = place[j], order[g + left]
                order[k], order[g + left] = other, j
                place[other], place[j] = k, g + left
                taken[g] = taken.get(g, 0) + 1
            for g, many in taken.items():  # which they leave for a group of their own, if any member stays
                if many < size[g]:
                    size[g] -= many
                    new = g + size[g]
                    size[new] = many
                    for k in range(new, new + many):
                        group[order[k]] = new
        high = start - 1
    free = list(range(n))  # next free place of the group that begins here
    out, done = [-1] * n, [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = True
            i = smaller[i]
    return out


def anchors_of(data: bytes) -> np.ndarray:
    """(places, hashes) of a text's anchors."""
    n = len(data)
    if n < LENGTH:
        return np.array([], np.int64), np.array([], np.uint64)
    h, power, wide = _BYTE[np.frombuffer(data, np.uint8)], 0x9E3779B97F4A7C15, 1
    while wide < GRAM:
        h = h[: len(h) - wide] * np.uint64(power) + h[wide:]
        power, wide = power * power % 2**64, 2 * wide
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = _sliding(h, REACH + 1, np.minimum)
    edge = np.zeros(REACH, np.uint64)
    chosen = np.flatnonzero(h == _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum))
    return chosen, h[chosen]


def _sliding(x: np.ndarray, width: int, what) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = what(x[: len(x) - have], x[have:]), 2 * have
    rest = width - have
    return what(x[: len(x) - rest], x[rest:]) if rest else x


#: doc, at: the row's place in its document (by 2**32) plus the anchor's; h, d: hashes of anchor and segment; back, fwd:
#: the windows that hold the anchor start from at - back to at - fwd. Without d: fwd bytes from at on are covered.
_ANCHORS = "doc long, at long, h long, d long, back int, fwd int"
_COVERED = "doc long, at long, n int"


def _collapsed(doc, at, h, d, back, fwd):
    """Keeps the earliest of equal segments; what the others cover comes as (doc, at, n), joined where it touches."""
    order = np.lexsort((at, doc, d, h))
    doc, at, h, d, back, fwd = (x[order] for x in (doc, at, h, d, back, fwd))
    first = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.array([], bool)
    other = ~first
    return [x[first] for x in (doc, at, h, d, back, fwd)], _joined(doc[other], at[other] - back[other], at[other] - fwd[other] + LENGTH)


def _joined(doc, start, end):
    """(doc, start, n) of the union of ranges."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new, out = [0], [int(end[0])]
    for k, (a, b, same) in enumerate(zip(start[1:].tolist(), end[1:].tolist(), (doc[1:] == doc[:-1]).tolist()), 1):
        if same and a <= out[-1]:
            if b > out[-1]:
                out[-1] = b
        else:
            new.append(k)
            out.append(b)
    return doc[new], start[new], np.array(out) - start[new]


def _rows(kept, covered) -> pa.RecordBatch:
    doc, at, h, d, back, fwd = kept
    cdoc, cat, n = covered
    spread = (cdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # a key that spreads them
    return pa.RecordBatch.from_pydict(
        {
            "doc": pa.array(np.r_[doc, cdoc]),
            "at": pa.array(np.r_[at, cat]),
            "h": pa.array(np.r_[h, spread]),
            "d": pa.concat_arrays([pa.array(d.astype(np.int64)), pa.nulls(len(cdoc), pa.int64())]),
            "back": pa.array(np.r_[back, np.zeros(len(cdoc))].astype(np.int32)),
            "fwd": pa.array(np.r_[fwd, n].astype(np.int32)),
        }
    )


def _int64(x: list) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64) if len(x) else np.array([], np.int64)


def _anchor_rows(batches):
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        docs, places, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        parts = []
        for doc, place, text in zip(docs, places, texts):
            data = text.encode("utf-8", "replace")
            at, h = anchors_of(data)
            if len(at):
                n = len(data)
                back, fwd = np.minimum(at, REACH), np.maximum(0, at - (n - LENGTH))
                d = _int64([digest(data[p - b : p + LENGTH], b) for p, b in zip(at.tolist(), back.tolist())])
                parts.append((np.full(len(at), doc), at + (place << 32), h.view(np.int64), d, back, fwd))
        if parts:
            yield _rows(*_collapsed(*(np.concatenate(x) for x in zip(*parts))))


def _segments(batches):
    """From documents with the anchors that need comparing: their segments' bytes, and single windows of hot anchors."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        docs, places, texts, lists = (batch.column(i).to_pylist() for i in range(4))
        out, windows = [], {}  # a window that several hot anchors hold is one
        for doc, place, text, anchors in zip(docs, places, texts, lists):
            data, base = text.encode("utf-8", "replace"), place << 32
            for a in anchors:
                p, back, fwd = a["at"] - base, a["back"], a["fwd"]
                if p < 0 or p >= 1 << 32:
                    continue  # of another row with this id
                if a["hot"]:
                    for s in range(p - back, p - fwd + 1):
                        windows[doc, base + s] = data[s : s + LENGTH]
                else:
                    out.append((a["h"], doc, a["at"], back, fwd, data[p - back : p + LENGTH]))
        covered = (np.array([], np.int64),) * 3
        if windows:
            doc, at = (np.array(x) for x in zip(*windows))
            h, d = (_int64([digest(w, seed) for w in windows.values()]) for seed in (1, 2))
            kept, covered = _collapsed(doc, at, h, d, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64))
            out += [(h, doc, at, 0, 0, windows[doc, at]) for doc, at, h in zip(*(x.tolist() for x in kept[:3]))]
        h, doc, at, back, fwd, seg = zip(*out) if out else ((),) * 6
        m = len(covered[0])
        yield pa.RecordBatch.from_pydict(
            {
                "h": pa.array([*h, *(covered[0] * 31).tolist()], pa.int64()),
                "doc": pa.array([*doc, *covered[0].tolist()], pa.int64()),
                "at": pa.array([*at, *covered[1].tolist()], pa.int64()),
                "back": pa.array([*back, *[0] * m], pa.int32()),
                "fwd": pa.array([*fwd, *covered[2].tolist()], pa.int32()),
                "seg": pa.array([*seg, *[None] * m], pa.binary()),
            }
        )


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of pairs."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def covered_windows(doc, at, back, fwd, segs) -> tuple:
    """(doc, start, n) covered by windows of these segments that some other of them has earlier."""
    m = len(segs)
    back, fwd = back.astype(np.int64), fwd.astype(np.int64)
    lengths = np.array([len(s) for s in segs])
    texts = np.zeros((m, WIDE + BLOCK), np.uint8)
    for k, s in enumerate(segs):
        texts[k, REACH - back[k] : REACH - back[k] + len(s)] = np.frombuffer(s, np.uint8)
    begin, end = REACH - back, REACH - back + lengths
    skip, blocks = REACH % BLOCK, (WIDE - REACH % BLOCK) // BLOCK
    cells = np.ascontiguousarray(texts[:, skip : skip + blocks * BLOCK]).reshape(m * blocks, BLOCK)
    symbols = _ranks(np.ascontiguousarray(cells[:, :8]).view("<u8").ravel(), np.ascontiguousarray(cells[:, 8:]).view("<u2").ravel()).reshape(m, blocks)
    column = skip + BLOCK * np.arange(blocks)
    valid = (column >= begin[:, None]) & (column + BLOCK <= end[:, None])
    whole = np.c_[np.where(valid, symbols, 0), np.zeros(m, np.int64)]
    keep = np.c_[valid, np.ones(m, bool)]
    string = np.r_[whole[keep], -1]
    row, block = (x[keep] for x in np.broadcast_arrays(np.arange(m)[:, None], np.arange(blocks + 1)))
    sa = np.array(suffix_order(string.tolist()))
    full = LENGTH // BLOCK - 1
    run = np.lib.stride_tricks.sliding_window_view(np.r_[string, np.zeros(full, np.int64)], full)[: len(string)]
    sa = sa[(run[sa] > 0).all(axis=1)]
    if not len(sa):
        return (np.array([], np.int64),) * 3
    same = np.r_[False, (run[sa[1:]] == run[sa[:-1]]).all(axis=1)]
    family = np.cumsum(~same)
    shared = same | np.r_[same[1:], False]
    sa, family = sa[shared], family[shared]
    row, block = row[sa], block[sa]
    docs, starts = [], []
    for r in range(BLOCK):
        c = skip + BLOCK * block - r
        fits = (c >= REACH - back[row]) & (c <= REACH - fwd[row])
        rows, c, f = row[fits], c[fits], family[fits]
        if not len(rows):
            continue
        places = np.r_[np.arange(r), np.arange(r + BLOCK * full, LENGTH)]
        beside = texts[rows[:, None], c[:, None] + places]
        a, b = np.ascontiguousarray(beside[:, :8]).view("<u8").ravel(), np.ascontiguousarray(beside[:, 8:]).view("<u2").ravel()
        of, begins = doc[rows], at[rows] - REACH + c
        order = np.lexsort((begins, of, b, a, f))
        a, b, f, of, begins = (x[order] for x in (a, b, f, of, begins))
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (f[1:] != f[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (of != of[head]) | (begins != begins[head])
        docs.append(of[later]), starts.append(begins[later])
    if not docs:
        return (np.array([], np.int64),) * 3
    docs, starts = np.concatenate(docs), np.concatenate(starts)
    return _joined(docs, starts, starts + LENGTH)


def _compared(batches):
    """Reads segments sorted by key, whole keys at a time."""

    def result(parts):
        doc, at, n = parts
        return pa.RecordBatch.from_pydict({"doc": pa.array(doc, pa.int64()), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int32())})

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        plain = table.filter(pc.is_null(table["seg"]))
        if plain.num_rows:
            yield result((plain["doc"].to_numpy(), plain["at"].to_numpy(), plain["fwd"].to_numpy()))
        table = table.filter(pc.is_valid(table["seg"]))
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows > AT_ONCE:
            h = held["h"].to_numpy()
            edges = np.flatnonzero(h[1:] != h[:-1]) + 1
            cut = edges[edges <= AT_ONCE][-1] if len(edges) and edges[0] <= AT_ONCE else (edges[0] if len(edges) else 0)
            if not cut:
                break
            yield result(_of(held.slice(0, cut)))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield result(_of(held))


def _of(table: pa.Table) -> tuple:
    return covered_windows(*(table[c].to_numpy() for c in ("doc", "at", "back", "fwd")), table["seg"].to_pylist())


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): ``spans`` array<struct<start, end>> of the removed bytes, ``kept`` the others."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("doc_id").asc_nulls_first(), "text")) if ids else F.lit(0)
    rows = rows.withColumn("place", place.cast("long"))
    texts = rows.select("doc", "place", "text", "doc_id")

    anchors = texts.select("doc", "place", "text").mapInArrow(_anchor_rows, _ANCHORS)
    group = Window.partitionBy("h")
    seen = anchors.repartition("h").withColumns(
        {
            "first": (F.row_number().over(Window.partitionBy("h", "d").orderBy("doc", "at")) == 1) & F.col("d").isNotNull(),
            "least": F.min("d").over(group),
            "most": F.max("d").over(group),
        }
    )
    differ = F.col("least") != F.col("most")
    marks = written(seen.where(~F.col("first") | differ).select("h", "doc", "at", "back", "fwd", F.col("first").alias("compare"), F.col("d").isNull().alias("plain")), "anchors")

    asked = marks.where("compare").select("h", "doc", "at", "back", "fwd")
    hot = asked.groupBy("h").count().where(F.col("count") > MAX_GROUP).select("h", F.lit(True).alias("hot"))
    hot = written(hot, "hot-anchors")
    marked = asked.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if hot.limit(1).count() else asked.withColumn("hot", F.lit(False))
    lists = marked.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "back", "fwd", "hot")).alias("anchors"))
    segments = texts.join(lists, "doc").select("doc", "place", "text", "anchors").mapInArrow(_segments, "h long, doc long, at long, back int, fwd int, seg binary")
    compared = segments.repartition("h").sortWithinPartitions("h").mapInArrow(_compared, _COVERED)

    whole = marks.where("not compare").select("doc", F.when(F.col("plain"), F.col("at")).otherwise(F.col("at") - F.col("back")).alias("at"), F.when(F.col("plain"), F.col("fwd")).otherwise(F.col("back") - F.col("fwd") + LENGTH).alias("n"))
    covered = whole.union(compared).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("covered"))
    out = T.StructType([docs.select(F.col(doc_id).alias("doc_id")).schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])
    return texts.join(covered, "doc", "left").select("doc_id", "place", "text", "covered").mapInArrow(_cut, out)


def _cut(batches):
    for batch in batches:
        ids, sizes, spans, kept = batch.column(0), [], [], []
        for place, text, covered in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            data = text.encode("utf-8", "replace")
            ranges = sorted((c["at"] - (place << 32), c["n"]) for c in covered or () if c["at"] >> 32 == place)
            found: list[list[int]] = []
            for a, n in ranges:
                if found and a <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], a + n)
                else:
                    found.append([a, a + n])
            sizes.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in found])
            edges = [0, *(x for s in found for x in s), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
