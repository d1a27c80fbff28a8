"""Secret scans through a trigram inverted index, in Spark expressions only.

From each rule's regular expression a Boolean trigram query is derived: the literal runs that any match must hold, as
alternatives of trigram sets in lower case. The index is a table of postings (trigram, doc_id) for the trigrams that some
query names, written once and read by trigram; a query's postings are intersected by document, the documents that are
left are verified with the expression itself, and rules without mandatory trigrams verify every document. Trigrams are
looked for in lower case, so the candidates are a superset and the verified spans are exact.

Candidates are few beside the documents: they go to the texts by broadcast, as an id and a number whose bits are the
kinds, if they were counted below ``MAX_BROADCAST_CANDIDATES``, and texts don't move. Beyond that, texts and candidates
meet in a shuffle by id.

Spans are code points, end exclusive, leftmost and non-overlapping for each rule. Defined results: a null text is empty;
a null doc_id is a value like any other; rows that repeat a doc_id share candidates and are verified each by itself;
columns named like an output are replaced.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraline.llm.quality_rules import let
from terraline.session import fits, written


@dataclass(frozen=True)
class Rule:
    """``group`` with at least ``least`` characters makes a match count; in ``pattern`` (?i:...) marks letters of either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds and patterns that are looked for. The first three are the base kinds, in their order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,8}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,512}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: More candidates than this (an id and a number each) meet the texts by a shuffle instead of a broadcast.
MAX_BROADCAST_CANDIDATES = 200_000
#: Pieces that are folded into one array or string; longer lists are folded in parts, so that no fold grows by the square.
PART = 256
#: Alternatives that a literal run may have before it is cut.
MAX_ALTERNATIVES = 64


def _strings(node) -> list[str] | None:
    """All strings that a parsed item can match, if they are few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(value)]
    if op == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
        found = [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
        return found if len(found) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(value[3])
    if op == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        return None if None in parts else [s for p in parts for s in p]
    if op == "MAX_REPEAT" and value[1] <= 1:
        inner = _sequence(value[2])
        return None if inner is None else (["", *inner] if value[0] == 0 else inner)
    return None


def _sequence(items) -> list[str] | None:
    out = [""]
    for item in items:
        some = _strings(item)
        if some is None or len(some) * len(out) > MAX_ALTERNATIVES:
            return None
        out = [a + b for a, b in product(out, some)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams one of which any match holds entirely, in lower case; no sets if nothing is mandatory."""
    runs, run = [], [""]
    for item in [*regex_parser.parse(pattern), None]:
        some = _strings(item) if item else None
        if some is None or len(some) * len(run) > MAX_ALTERNATIVES:
            runs.append(run)
            run = [""] if some is None else some
        else:
            run = [a + b for a, b in product(run, some)]
    runs.append(run)
    clauses = [frozenset()]
    for alternatives in runs:
        sets = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in alternatives}
        if frozenset() in sets or len(sets) * len(clauses) > MAX_ALTERNATIVES:
            continue
        clauses = [a | b for a, b in product(clauses, sets)]
    return sorted(set(clauses) - {frozenset()}, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams."""
    present = let(F.lower(F.col(text)), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams])))
    return docs.select(F.explode(present).alias("trigram"), F.col(doc_id).alias("doc_id"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): of the kinds, by their place in ``queries`` as bits, whose trigram query a document's postings
    meet. The queries are a fixed small table; what is shuffled is a row for each document and clause."""
    places = {kind: place for place, kind in enumerate(queries)}
    rows = [(t, 1 << places[kind], n, 1 << k, (1 << len(clause)) - 1) for kind, clauses in queries.items() for n, clause in enumerate(clauses) for k, t in enumerate(sorted(clause))]
    terms = F.broadcast(index.sparkSession.createDataFrame(rows, "trigram string, kind long, clause int, bit long, all_bits long"))
    met = index.join(terms, "trigram").groupBy("doc_id", "kind", "clause").agg(F.bit_or("bit").alias("bits"), F.max("all_bits").alias("all_bits"))
    return met.where("bits = all_bits").groupBy("doc_id").agg(F.bit_or("kind").alias("kinds"))


def parts_of(pieces: Column) -> Column:
    """An array cut into arrays of at most ``PART``; one empty array if there is nothing."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(PART))
    return F.transform(starts, lambda i: F.slice(pieces, i, PART))


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end, kind>> of a rule's matches. The text is what lies between matches and the
    matches, in turn, so places are sums of their lengths: within a part of the matches, and from part to part."""
    kind = "array<struct<start:int,place:int,end:int,kind:string>>"
    nothing = F.array().cast(kind)
    span = lambda start, end: F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def within(part: Column) -> Column:
        """struct<at, out>: a part's length and its spans, from its own start."""

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["gap"])
            end = start + F.length(x["match"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.when(F.length(x["value"]) >= rule.least, F.array(span(start, end))).otherwise(nothing)).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)

    def moved(parts: Column) -> Column:
        """All parts' spans, from the start of the text."""
        begins = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(parts, begins, lambda p, at: F.transform(p["out"], lambda s: span(s["start"] + at, s["end"] + at))))

    def walk(pieces: Column) -> Column:
        zipped = F.zip_with(pieces["gaps"], F.arrays_zip(pieces["matches"], pieces["values"]), lambda g, m: F.struct(g.alias("gap"), m["matches"].alias("match"), m["values"].alias("value")))
        return let(F.filter(zipped, lambda x: x["match"].isNotNull()), lambda found: let(F.transform(parts_of(found), within), moved))

    def split(matches: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
        return F.when(F.size(matches) == 0, nothing).otherwise(let(F.struct(F.split(text, rule.pattern, -1).alias("gaps"), matches.alias("matches"), values.alias("values")), walk))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), split)


def queries_of(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """Trigram queries by kind, of the rules that have mandatory trigrams."""
    return {r.kind: q for r in rules if (q := trigram_query(r.pattern))}


def indexed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of ``docs`` for these rules, written; ``scan`` reads it as often as is wanted."""
    trigrams = sorted({t for clauses in queries_of(rules).values() for c in clauses for t in c})
    return written(trigram_index(docs, trigrams, doc_id, text).sortWithinPartitions("trigram"), "trigram-index")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Adds ``found``: array<struct<start, place, end, kind>> of all spans by start, then by the rules' order."""
    queries = queries_of(rules)
    kinds = written(candidates(indexed(docs, rules, doc_id, text) if index is None else index, queries).withColumnRenamed("doc_id", "_terraline_id").withColumnRenamed("kinds", "_terraline_kinds"), "candidates")
    kinds = F.broadcast(kinds) if fits(kinds, MAX_BROADCAST_CANDIDATES) else kinds
    joined = docs.drop("found", "_terraline_id", "_terraline_kinds").join(kinds, F.col(doc_id).eqNullSafe(F.col("_terraline_id")), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    asked = {kind: F.coalesce(F.col("_terraline_kinds").bitwiseAND(1 << place) != 0, F.lit(False)) for place, kind in enumerate(queries)}
    each = [F.when(asked[r.kind], spans_of(whole, r, n)).otherwise(F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")) if r.kind in asked else spans_of(whole, r, n) for n, r in enumerate(rules)]
    return joined.withColumn("found", F.sort_array(F.concat(*each))).drop("_terraline_id", "_terraline_kinds")


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``. Each part of the spans works on its own piece
    of the text, from where the parts before it end."""

    def replaced(part: Column, begin: Column, end: Column) -> Column:
        def step(piece: Column):
            def one(state: Column, s: Column) -> Column:
                start, new = s["start"] - begin, s["start"] - begin >= state["at"]
                out = F.when(new, F.concat(state["out"], F.substring(piece, state["at"] + 1, start - state["at"]), F.lit(mark))).otherwise(state["out"])
                return F.struct(F.greatest(state["at"], s["end"] - begin).alias("at"), out.alias("out"))

            return one

        return let(F.substring(text, begin + 1, end - begin), lambda piece: F.aggregate(part, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step(piece), lambda s: s["out"]))

    def joined(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.greatest(F.element_at(s, -1), F.array_max(F.transform(p, lambda x: x["end"]))))))
        last = lambda e: F.element_at(e, -1)
        return let(ends, lambda e: F.concat(F.array_join(F.zip_with(parts, F.arrays_zip(F.slice(e, 1, F.size(e) - 1).alias("a"), F.slice(e, 2, F.size(e) - 1).alias("b")), lambda p, x: replaced(p, x["a"], x["b"])), ""), F.substring(text, last(e) + 1, F.length(text))))

    return F.when(F.size(found) == 0, text).otherwise(let(parts_of(found), joined))
