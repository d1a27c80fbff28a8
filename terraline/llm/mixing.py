"""Mixing sources to target weights by hierarchical budgets, in Spark expressions only.

A token budget goes down a tree of domains, languages and sources. Siblings share their parent's budget by weight; one
that can't use its share (its capacity is its tokens times ``max_epochs``) leaves the rest to its siblings by their
weights, and only what a whole subtree can't use goes back to the subtree's own siblings. Shares are whole numbers; what
rounding down leaves goes, one each, to the first siblings that have room, so a budget is used up wherever there is
capacity. A leaf with budget b and a tokens takes b div a whole epochs and, from the next epoch's seeded order, the
longest prefix whose tokens fit into what is left.

Tokens are runs of letters, of digits and of other signs, which Spark counts by itself. A branch with a weight of 0 or
less has no capacity, nor has anything below it. Sums of tokens times weights are decimals, which hold a corpus of any
size.

The order of an epoch is that of md5(seed:epoch:doc_id). A leaf's prefix is found by the tokens of 4096 ranges of that
order and then within one range, so a leaf of any size spreads over all tasks; documents are then chosen by comparing
their md5 with the leaf's cut, without moving their texts.

Defined results: null levels are values of their own; rows with one doc_id in a leaf are chosen together; a document
without tokens is chosen with its place; a leaf without tokens gets nothing; a weight that isn't given is 1; an empty
table gives no rows; columns named domain or n_copies are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraline.session import fits, written

#: More leaves than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")
#: A token: letters, digits or other signs in a row.
TOKEN = r"\p{L}+|\p{N}+|[^\x09-\x0D\x20\p{L}\p{N}]+"


def domain_of(source: Column) -> Column:
    """The domain of a source: its number's remainder by 4, "other" if it has none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def _same(a: str, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{a}{n}"))
    return out


def shared(children: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """Adds ``budget`` to rows with ``capacity``, ``weight`` and ``given``, what all children of their parent share.

    Children go by capacity over weight. Up to some place they are full, which holds as long as a child's capacity is
    at most its share by weight of what the ones before left over; from that place on, all share the rest by weight.
    """
    order = [(F.col("capacity") / F.col("weight")).asc(), *[F.col(c).asc_nulls_first() for c in LEVELS if c in children.columns]]
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sums = children.withColumns({"_left": wide("given") - F.coalesce(F.sum(wide("capacity")).over(before), F.lit(0).cast("decimal(19,0)")), "_weights": F.sum("weight").over(after), "_place": F.row_number().over(group.orderBy(*order))})
    full = sums.withColumn("_full", wide("capacity") * wide("_weights") <= wide("_left") * wide("weight"))
    cut = F.min(F.when(~F.col("_full"), F.struct("_place", "_left", "_weights"))).over(group)
    share = F.expr("cast(cast(_cut._left as decimal(19,0)) * cast(weight as decimal(19,0)) div cast(_cut._weights as decimal(19,0)) as long)")
    open_ = F.col("_cut").isNotNull() & (F.col("_place") >= F.col("_cut._place"))
    shares = full.withColumn("_cut", cut).withColumn("_share", F.when(open_, share))
    over = F.col("_cut._left").cast("long") - F.sum("_share").over(group)
    budget = F.when(open_, F.col("_share") + (F.col("_place") - F.col("_cut._place") < over).cast("long")).otherwise(F.col("capacity"))
    return shares.withColumn("budget", budget).drop("_left", "_weights", "_place", "_full", "_cut", "_share", "given")


def budgets(leaves: DataFrame, total: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Adds ``budget`` to leaves (domain, lang, source, tokens)."""

    def weight(level: str) -> Column:
        out = F.lit(1).cast("long")
        for value, w in weights.get(level, {}).items():
            out = F.when(F.col(level) == value, F.lit(int(w)).cast("long")).otherwise(out)
        return out

    nodes = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    for level in LEVELS:
        nodes = nodes.where(weight(level) > 0)
    given: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        level, parent = LEVELS[:depth], LEVELS[: depth - 1]
        at = nodes.groupBy(*level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(level[-1]))
        if given is None:
            at = at.withColumn("given", F.lit(int(total)).cast("long"))
        else:
            up = given.select(*[F.col(c).alias(f"_{c}") for c in parent], F.col("budget").alias("given"))
            at = at.join(up, _same("_", parent)).drop(*[f"_{c}" for c in parent])
        given = shared(at, parent)
    out = given.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "budget")
    return leaves.join(out, _same("_", LEVELS), "left").drop(*[f"_{c}" for c in LEVELS]).withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def plan(docs: DataFrame, seed: int, share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves with tokens, budget, epochs (whole ones) and cut, the largest md5 of the next epoch's prefix ("" if none).
    ``docs``: doc_id, domain, lang, source and n_tokens. The total budget is ``share`` of all tokens, rounded down."""
    leaves = written(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    split = budgets(leaves, int(tokens * share), max_epochs, weights)
    split = written(split.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    placed = at_leaf(docs, split, seed).where("_leaf.rest > 0").select(*LEVELS, "_leaf.rest", "n_tokens", F.col("_mark").alias("mark"), F.substring("_mark", 1, 3).alias("part"))
    ranges = placed.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("in_part"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("part")
    summed = ranges.withColumn("end", F.sum("in_part").over(upto)).where("end > rest").groupBy(*[F.col(c).alias(f"_{c}") for c in LEVELS]).agg(F.min(F.struct("part", (F.col("end") - F.col("in_part")).alias("begin"))).alias("edge"))
    edges = _small(summed.select(*[f"_{c}" for c in LEVELS], F.col("edge.part").alias("_part"), F.col("edge.begin").alias("begin")))
    inside = placed.join(edges, _same("_", LEVELS) & (F.col("part") == F.col("_part"))).select(*LEVELS, "mark", "begin", "rest", "n_tokens")
    marks = inside.groupBy(*LEVELS, "mark").agg(F.sum("n_tokens").alias("n"), F.first("begin").alias("begin"), F.first("rest").alias("rest"))
    taken = marks.withColumn("end", F.col("begin") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("mark"))).where("end <= rest").groupBy(*LEVELS).agg(F.max("mark").alias("last"))
    # a leaf's cut: the last mark taken in its edge range, else all ranges before that one; without an edge, everything
    known = edges.select(*[F.col(f"_{c}").alias(f"e_{c}") for c in LEVELS], F.col("_part").alias("edge_part")).join(taken, _same("e_", LEVELS), "left").select(*[f"e_{c}" for c in LEVELS], F.coalesce("last", "edge_part").alias("edge_cut"))
    cut = F.when(F.col("rest") == 0, F.lit("")).otherwise(F.coalesce("edge_cut", F.lit("g")))
    return split.join(known, _same("e_", LEVELS), "left").select(*LEVELS, "tokens", "n_docs", "budget", "epochs", "rest", cut.alias("cut"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` written, and marked for broadcast only if it has few rows."""
    df = written(df, "leaves")
    return F.broadcast(df) if fits(df, MAX_BROADCAST_LEAVES) else df


def at_leaf(docs: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Adds to documents their leaf's columns as ``_leaf``, and ``_mark``, their place in the epoch after its whole ones."""
    columns = [c for c in leaves.columns if c in ("epochs", "rest", "cut")]
    right = _small(leaves.select(*[F.col(c).alias(f"_at_{c}") for c in LEVELS], F.struct(*columns).alias("_leaf")))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("_leaf.epochs") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.drop("_leaf", "_mark").join(right, _same("_at_", LEVELS)).drop(*[f"_at_{c}" for c in LEVELS]).withColumn("_mark", mark)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def mix(docs: DataFrame, seed: int = 17, share: float = 1.0, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, text: str = "text", domain: Column | None = None) -> DataFrame:
    """Chosen rows of ``docs`` with ``domain`` (of ``source`` if no column is given) and ``n_copies`` (1 or more), the
    epochs a row is in."""
    domain = domain_of(F.col("source")) if domain is None else domain
    narrow = docs.select("doc_id", domain.alias("domain"), "lang", "source", n_tokens(F.col(text)).alias("n_tokens"))
    leaves = plan(written(narrow, "tokens"), seed, share, max_epochs, weights or {})
    mine = docs.select(*[F.col(c) for c in docs.columns if c not in ("domain", "n_copies")], domain.alias("domain"))
    chosen = at_leaf(mine, leaves, seed).withColumn("n_copies", (F.col("_leaf.epochs") + F.when(F.col("_mark") <= F.col("_leaf.cut"), 1).otherwise(0)).cast("long"))
    return chosen.where("n_copies > 0").drop("_leaf", "_mark")
