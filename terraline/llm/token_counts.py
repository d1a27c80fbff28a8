"""Token counts of whole texts under a unigram model, without building the tokens.

Distinct pre-tokens go into a trie of bytes. A node's forward cost is the least sum of piece costs over all ways of
cutting the bytes that lead to it into vocabulary pieces; it depends on that prefix alone, so it is computed once however
many pre-tokens share the prefix. The node also stores how many pieces the cheapest way has (the fewest among equals),
which is a pre-token's count at its terminal node.

Piece costs come from a public vocabulary's ranks by Zipf's law, cost = ln(rank + 2.7), plus the logarithm of their
normaliser for every piece, as whole numbers of 2**-20, so equal costs are equal exactly.

Defined results: a null or empty text has no tokens; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terraline.llm.bpe import _SIGNS, _WIDE, _with, pre_token_pattern

#: Bounds of what a Python worker keeps; beyond them it starts anew. Results don't depend on them.
MAX_NODES, MAX_WORDS = 1_500_000, 400_000

PRE = 1 << 32


def piece_costs(content: str) -> dict[bytes, int]:
    """Costs by piece from lines of base64 bytes and rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    normaliser = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {piece: round((math.log(rank + 2.7) + normaliser) * 2**20) for piece, rank in ranks.items()}


class ForwardTrie:
    def __init__(self, costs: dict[bytes, int]):
        self.costs = costs
        ends: dict[bytes, set[int]] = {}
        for piece in costs:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths, from 2 on, of the pieces that end in two given bytes; every byte is a piece.
        self.lengths = {end: tuple(sorted(x)) for end, x in ends.items() if len(end) == 2}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.cost, self.count = [0], [0]

    def count_of(self, token: bytes) -> int:
        """Pieces of ``token``; adds the nodes of its path that are missing."""
        child, cost, count, costs, lengths = self.child, self.cost, self.count, self.costs, self.lengths
        if len(cost) > MAX_NODES:
            self.clear()
            return self.count_of(token)
        node, path = 0, [0]
        for depth, byte in enumerate(token, 1):
            key = node << 8 | byte
            node = child.get(key)
            if node is None:
                before = path[-1]
                least, pieces = cost[before] + costs[token[depth - 1 : depth]], count[before] + 1
                if depth > 1:
                    for length in lengths.get(token[depth - 2 : depth], ()):
                        if length > depth:
                            break
                        piece = costs.get(token[depth - length : depth])
                        if piece is not None:
                            before = path[depth - length]
                            piece += cost[before]
                            if piece < least or piece == least and count[before] < pieces:
                                least, pieces = piece, count[before] + 1
                node = child[key] = len(cost)
                cost.append(least)
                count.append(pieces)
            path.append(node)
        return count[node]


class _Words(dict):
    """Counts of words that follow ``prefix``, tokens and 2**32 times pre-tokens in one number, filled as words are met."""

    def __init__(self, counter: "Counter", prefix: str):
        super().__init__()
        self.counter, self.prefix = counter, prefix

    def __missing__(self, word: str) -> int:
        trie = self.counter.trie
        if word.isalpha():
            found = PRE + trie.count_of((self.prefix + word).encode())
        elif word[:-1].isalpha() and word[-1] in _SIGNS:
            found = 2 * PRE + trie.count_of((self.prefix + word[:-1]).encode()) + trie.count_of(word[-1].encode())
        else:
            found = self.counter.split(self.prefix + word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = found
        return found


class Counter:
    """Counts of whole texts: tokens and 2**32 times pre-tokens."""

    def __init__(self, content: str):
        self.trie = ForwardTrie(piece_costs(content))
        self.first, self.spaced = _Words(self, ""), _Words(self, " ")

    def split(self, text: str) -> int:
        tokens = pre_token_pattern().findall(text)
        return PRE * len(tokens) + sum(self.trie.count_of(t.encode()) for t in tokens)

    def text(self, text: str) -> int:
        """Where no white space stands beside other white space, a space goes with the word after it and a line feed
        is a pre-token of its own, so whole words are looked up."""
        if _WIDE.search(text):
            return self.split(text)
        lines = [line.split(" ") for line in text.split("\n")]
        total = (len(lines) - 1) * self.split("\n")
        for words in lines:
            total += self.first[words[0]] + sum(map(self.spaced.__getitem__, words[1:]))
        return total


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Adds ``n_pre_tokens`` and ``n_tokens`` (long). The ranks, a fixed file of under 1 MB, go out by broadcast."""
    with open(ranks_path, encoding="ascii") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = _with(docs.schema, T.StructField("n_pre_tokens", T.LongType()), T.StructField("n_tokens", T.LongType()))

    def run(batches):
        key = hash(content.value)
        if key not in _counters:
            _counters[key] = Counter(content.value)
        for batch in batches:
            found = [_counters[key].text(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            made = {"n_pre_tokens": pa.array([x >> 32 for x in found], pa.int64()), "n_tokens": pa.array([x & 0xFFFFFFFF for x in found], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(batch.schema.get_field_index(f.name)) for f in schema], [f.name for f in schema])

    return docs.mapInArrow(run, schema)
