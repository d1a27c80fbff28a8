"""Byte-pair encoding and decoding of whole texts.

Every pre-token is a doubly linked list of symbols and a priority queue of the merges that its neighbours allow,
ordered by rank and then by place. A merge joins two symbols, unlinks the right one and queues the new neighbours; an
entry whose symbols have changed since it was queued is stale and skipped. Decoding concatenates vocabulary strings.

Defined results: a null text is an empty text (no ids, decoded ""); null ids decode to ""; an id that the vocabulary
lacks decodes to nothing; other columns pass through, and columns named like an output are replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens and whole words kept with their ids in each Python worker (about 120 MB); beyond it the memory starts anew.
REMEMBERED, REMEMBERED_WORDS = 400_000, 100_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def _char_class(prefix: str) -> str:
    """Ranges of the characters whose general category starts with ``prefix``, for a class of ``re``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == prefix
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def pre_token_pattern() -> re.Pattern:
    """The byte-level splitting pattern (contractions, letters, numbers, other signs, white space), in ``re``'s terms:
    white space is Unicode's White_Space, which lacks the four separators U+001C to U+001F that ``\\s`` has in Python."""
    letters, numbers = _char_class("L"), _char_class("N")
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


_WIDE = re.compile(r"\s\s")


#: Signs that are a pre-token of their own at a word's end.
_SIGNS = frozenset(".,;:!?()")


class _Words(dict):
    """Packed ids of words that follow ``prefix``, filled as words are met."""

    def __init__(self, vocabulary: Vocabulary, prefix: str):
        super().__init__()
        self.vocabulary, self.prefix = vocabulary, prefix

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.vocabulary.token(self.prefix + word)
        elif word[:-1].isalpha() and word[-1] in _SIGNS:
            ids = self.vocabulary.token(self.prefix + word[:-1]) + self.vocabulary.token(word[-1])
        else:
            ids = self.vocabulary.split(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """A byte-level BPE file in the tokenizers library's JSON form."""

    def __init__(self, content: str):
        said = json.loads(content)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        ids: dict[str, int] = said["model"]["vocab"]
        self.first = [ids[letters[b]] for b in range(256)]
        nothing: dict[int, int] = {}
        self.pairs = [nothing] * (max(ids.values()) + 1)
        self.results: list[int] = []
        for rank, pair in enumerate(said["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if self.pairs[ids[left]] is nothing:
                self.pairs[ids[left]] = {}
            self.pairs[ids[left]][ids[right]] = rank
            self.results.append(ids[left + right])
        self.strings: dict[int, bytes] = {i: bytes(byte_of[c] for c in s) for s, i in ids.items() if all(c in byte_of for c in s)}
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.table = [self.strings.get(i, b"") for i in range(max(self.strings) + 1)]
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens: dict[str, bytes] = {}
        self.first_words, self.spaced_words = _Words(self, ""), _Words(self, " ")

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token: best rank first, leftmost first among equal ranks. A queue entry is rank and place in
        one number; it is stale if the symbols now at its place have another rank."""
        symbols = [self.first[b] for b in token]
        n = len(symbols)
        if n < 2:
            return symbols
        pairs, results = self.pairs, self.results
        ranks = [pairs[a].get(b, -1) for a, b in zip(symbols, symbols[1:])]  # of a symbol and the next one, -1 if they don't merge
        queue = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return symbols
        ranks.append(-1)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            if ranks[i] != rank:
                continue
            j = after[i]
            made = symbols[i] = results[rank]
            symbols[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = r = pairs[made].get(symbols[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = r = pairs[symbols[h]].get(made, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def token(self, token: str) -> bytes:
        """Packed ids of a pre-token, remembered if it is short."""
        ids = self.tokens.get(token)
        if ids is None:
            ids = array("i", self.merge(token.encode())).tobytes()
            if len(token) <= 64:
                if len(self.tokens) >= REMEMBERED:
                    self.tokens.clear()
                self.tokens[token] = ids
        return ids

    def split(self, text: str) -> bytes:
        """Ids, packed, of a text in which no added token is looked for."""
        return b"".join(map(self.token, pre_token_pattern().findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian 32-bit integers. Where no white space stands beside other white
        space, a space belongs to the word after it and a line feed is a pre-token of its own, so whole words with
        their signs are looked up before anything is split further."""
        if self.split_added and any(a in text for a in self.added):
            parts = self.split_added.split(text)
            return b"".join(array("i", [self.added[p]]).tobytes() if p in self.added else self.encode_plain(p) for p in parts)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if _WIDE.search(text):
            return self.split(text)
        first, spaced, feed = self.first_words, self.spaced_words, self.split("\n")
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            if len(words) > 1:
                out.append(b"".join(map(spaced.__getitem__, words[1:])))
            out.append(feed)
        return b"".join(out[:-1])

    def decode(self, ids) -> str:
        table, n = self.table, len(self.table)
        try:
            return b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        except IndexError:
            return b"".join([table[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(content: str) -> Vocabulary:
    """One for each content and Python worker."""
    key = hash(content)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(content)
    return _vocabularies[key]


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(fields))


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``, an array<int>. The vocabulary (a fixed file of some MB, whatever the corpus) goes to the executors
    by broadcast, so only the driver needs the path. Rows stay in their partitions: no shuffle."""
    return _mapped(docs, vocabulary_path, text, ids, None)


def encode_decode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` and ``decoded``, what these ids decode to, in one pass."""
    return _mapped(docs, vocabulary_path, text, ids, decoded)


def _mapped(docs: DataFrame, vocabulary_path: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    with open(vocabulary_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = _with(docs.schema, *fields)

    def run(batches):
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                column = part.column(part.schema.get_field_index(text))
                found = [vocabulary.encode(value or "") for value in column.to_pylist()]
                offsets = np.cumsum([0] + [len(f) // 4 for f in found], dtype=np.int32)
                flat = np.frombuffer(b"".join(found), "<i4")
                strings = [vocabulary.decode(np.frombuffer(f, "<i4").tolist()) for f in found] if decoded else []
                made = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
                if decoded:
                    made[decoded] = pa.array(strings, pa.string())
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else part.column(part.schema.get_field_index(f.name)) for f in schema], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the vocabulary strings of ``ids``, joined; bytes that are no UTF-8 become U+FFFD."""
    with open(vocabulary_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def decode_ids(values):
        vocabulary = _vocabulary(content.value)
        return values.map(lambda v: "" if v is None else vocabulary.decode(v))

    return docs.withColumn(decoded, decode_ids(F.col(ids)))


@F.pandas_udf(T.StringType())
def _ids_digest(values):
    import hashlib

    return values.map(lambda v: hashlib.sha256(np.asarray([] if v is None else v, "<u4").tobytes()).hexdigest())


def ids_sha256(ids: Column) -> Column:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return _ids_digest(ids)
