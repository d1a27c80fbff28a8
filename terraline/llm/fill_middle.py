"""Fill-in-middle transformation of whole texts by one numpy kernel over an Arrow batch's UTF-8 bytes.

A unit is a run of ASCII letters or any other single character. Bytes are classed by a table (letter, continuation of a
character, anything else); a byte begins a unit if it is no continuation and, being a letter, follows no letter of its
document. Running sums of beginnings, counted anew for each document, number the units, and one ``searchsorted`` finds
the bytes at which all rows of a batch are cut. Cuts and forms come from a hash of seed and document, so a row's result
depends on its id and text alone, wherever it is computed.

Defined results: a null text is empty; a null id is the text "null" in the hash; empty texts and texts that hold a mark
stay plain; repeated rows are transformed alike; columns named like an output are replaced. Rows are independent: there
is no shuffle, and a kernel call works on at most ``SLICE`` bytes beyond its last text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What goes before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of texts that a kernel call takes; the text that reaches it is the last.
SLICE = 4 << 20

LETTER, CONTINUATION, OTHER = 1, 2, 0
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[128:192] = CONTINUATION
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True


def draws(doc_id: str, seed: int) -> Column:
    """array<long> of four numbers below 2**32: the first digit groups of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, plain_share: int, suffix_first_share: int):
    """All rows of a slice at once. ``data``: bytes; ``offsets``: where texts begin, and the end of the last;
    ``drawn``: four numbers a row. Returns (units, form by row: 0 plain, 1 prefix first, 2 suffix first, characters of
    prefix and of middle, output bytes, output offsets)."""
    first, last = offsets[:-1], offsets[1:]
    kind = _CLASS[data]
    begins = kind != CONTINUATION
    after_letter = np.zeros(len(data), bool)
    after_letter[1:] = kind[:-1] == LETTER
    after_letter[first[first < last]] = False  # a document's first byte follows nothing
    unit = begins & ~((kind == LETTER) & after_letter)
    units = np.cumsum(unit, dtype=np.int64)
    characters = np.r_[0, np.cumsum(begins, dtype=np.int64)]
    before = np.r_[0, units][first]  # units of earlier rows: each row counts from there
    n = np.r_[0, units][last] - before
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    at = np.searchsorted(units, (before[:, None] + cuts + 1).ravel()).reshape(-1, 2)
    at = np.where(cuts == n[:, None], last[:, None], at)  # all units before the cut: its end, not the next row's begin
    hit = np.flatnonzero((data[:-2] == ord("<")) & _IS_MARK[data[1:-1]] & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, int)
    row = np.searchsorted(last, hit, side="right")
    marked = np.zeros(len(n), bool)
    marked[row[hit + 3 <= last[row]]] = True
    plain = (n == 0) | marked | (drawn[:, 2] % 100 >= 100 - plain_share)
    suffix_first = ~plain & (drawn[:, 3] % 100 < suffix_first_share)
    form = np.where(plain, 0, np.where(suffix_first, 2, 1))
    a, b, end = at[:, 0], at[:, 1], len(data)
    # Six pieces a row, from the texts' bytes or from the marks that are put behind them.
    none, mark = np.zeros(len(n), np.int64), np.where(plain, 0, 3)
    head = np.where(suffix_first, end + 3, end)
    one, one_size = np.where(suffix_first, b, first), np.where(plain, last - first, np.where(suffix_first, last - b, a - first))
    second = np.where(suffix_first, end, end + 3)
    two, two_size = np.where(suffix_first, first, b), np.where(plain, 0, np.where(suffix_first, a - first, last - b))
    begin = np.stack([head, one, second, two, none + end + 6, a], axis=1).ravel()
    size = np.stack([mark, one_size, mark, two_size, mark, np.where(plain, 0, b - a)], axis=1).ravel()
    upto = np.cumsum(size)
    take = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - size), size)
    out = np.concatenate([data, _MARKS])[take]
    return n, form, characters[a] - characters[first], characters[b] - characters[a], out, np.r_[0, upto[5::6]]


FORMS = pa.array(["plain", "psm", "spm"])


def _slices(offsets: np.ndarray):
    """(from, to) rows, each at least one and within ``SLICE`` bytes before its last."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = min(rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE))))
        yield at, to
        at = to


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_share: int = 10, suffix_first_share: int = 20) -> DataFrame:
    """Adds ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.
    ``plain_share`` of a hundred rows stay plain; of the others ``suffix_first_share`` of a hundred put the suffix first."""
    kept = docs.drop("n", "form", "prefix_chars", "middle_chars", "output", "_draws").withColumn("_draws", draws(doc_id, seed))
    out = T.StructType([f for f in kept.schema.fields if f.name != "_draws"] + T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string").fields)
    names = [f.name for f in out.fields]

    def run(batches):
        for batch in batches:
            texts = batch.column(text).fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            drawn = batch.column("_draws").flatten().to_numpy().reshape(-1, 4)
            for at, to in _slices(offsets):
                low = offsets[at]
                n, form, prefix, middle, body, ends = transform(data[low : offsets[to]], offsets[at : to + 1] - low, drawn[at:to], plain_share, suffix_first_share)
                plain = form == 0
                output = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]).cast(pa.large_string()).cast(pa.string())
                new = {"n": pa.array(n), "form": FORMS.take(pa.array(form)), "prefix_chars": pa.array(prefix, mask=plain), "middle_chars": pa.array(middle, mask=plain), "output": output}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c).slice(at, to - at) for c in names], names)

    return kept.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Pieces hold no mark, and no mark can begin or end inside of another, so
    each mark is met once."""
    rest = lambda mark: F.split_part(output, F.lit(mark), F.lit(2))
    upto = lambda piece, mark: F.split_part(piece, F.lit(mark), F.lit(1))
    prefix = F.when(form == "psm", upto(rest(PREFIX), SUFFIX)).otherwise(upto(rest(PREFIX), MIDDLE))
    suffix = F.when(form == "psm", upto(rest(SUFFIX), MIDDLE)).otherwise(upto(rest(SUFFIX), PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, rest(MIDDLE), suffix))
