"""Quality scores by a sparse rule ensemble.

Trees of a random forest are grown on statistics of labelled texts; every path from a root becomes a conjunctive rule
over the statistics. A logistic model with a lasso penalty weighs the rules, most get no weight, and what is left is one
Spark column expression, so scoring is a projection without Python.

The forest and the lasso are fitted by Spark on a bounded sample of labelled rows (``max_rows``, chosen by a hash of
the id); everything else sees all rows. Defined results: a null text is empty; ids without a label, or with a null one,
aren't learnt from; of several labels of an id the smallest counts; without labels of both kinds the score is their share
(0.5 without any) for all; columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraline.llm.quality_rules import let, words_of
from terraline.session import written

STATISTICS = ("log_words", "distinct_share", "word_length", "symbol_share", "upper_share", "mark_share", "digit_share", "dup_line_share")


def statistics(text: Column) -> Column:
    """struct of the statistics of a whole text."""
    whole = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(whole), F.lit(1)).cast("double")

    def share(kept: str) -> Column:
        return F.length(F.regexp_replace(whole, kept, "")) / size

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = let(words_of(text), lambda w: F.struct(F.log1p(F.size(w).cast("double")).alias("a"), (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).alias("b"), (F.length(F.array_join(w, "")) / F.greatest(F.size(w), F.lit(1))).alias("c")))
    repeated = let(lines, lambda x: 1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))
    parts = F.struct(words.alias("w"), share("[^#*$%&|<>]+").alias("s"), share("\\P{Lu}+").alias("u"), share("[^!?]+").alias("m"), share("[^0-9]+").alias("d"), repeated.alias("l"))
    return let(parts, lambda p: F.struct(p["w"]["a"].alias("log_words"), p["w"]["b"].alias("distinct_share"), p["w"]["c"].alias("word_length"), p["s"].alias("symbol_share"), p["u"].alias("upper_share"), p["m"].alias("mark_share"), p["d"].alias("digit_share"), p["l"].alias("dup_line_share")))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, "<=" or ">", threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, [stats[s] <= t if op == "<=" else stats[s] > t for s, op, t in self.conditions])


def rules_of(tree: str) -> list[Rule]:
    """All paths of a tree's text form, each bound at its tightest."""
    out, path = [], []
    for line in tree.splitlines():
        found = re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        if found[1] == "Else":
            # back to the matching "If"
            while path[-1][3] != len(line) - len(line.lstrip()):
                path.pop()
            path.pop()
        path.append((STATISTICS[int(found[2])], found[3], float(found[4]), len(line) - len(line.lstrip())))
        tight: dict[tuple[str, str], float] = {}
        for s, op, t, _ in path:
            tight[s, op] = t if (s, op) not in tight else (min if op == "<=" else max)(tight[s, op], t)
        out.append(Rule(tuple(sorted((s, op, t) for (s, op), t in tight.items()))))
    return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        """0 to 1, higher where label 1 is likelier."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", max_rows: int = 40_000, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> Ensemble:
    """Learns from the labelled rows of ``docs`` that aren't held out. At most about ``max_rows`` ids are sampled and
    broadcast, so texts don't move: their statistics are computed where they lie."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**53)) < 2**53 * max_rows // n)
    rows = docs.select("doc_id", text).join(F.broadcast(known), "doc_id").select("label", statistics(F.col(text)).alias("s"))
    sample = written(rows.select("label", "s.*"), "sample")
    share, kinds = sample.agg(F.avg("label"), F.count_distinct("label")).first()
    if kinds < 2:
        p = min(0.999, max(0.001, 0.5 if share is None else share))
        return Ensemble(math.log(p / (1 - p)), ())
    vectors = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted({r for t in forest.trees for r in rules_of(t.toDebugString)}, key=lambda r: r.conditions)
    held = sample.select("label", F.struct(*STATISTICS).alias("s"))
    met = held.select("label", array_to_vector(F.array(*[r.column(F.col("s")).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(met)
    weighed = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-9]
    return Ensemble(float(lasso.intercept), tuple(weighed))


def scored(docs: DataFrame, ensemble: Ensemble, text: str = "text") -> DataFrame:
    """Adds ``score``."""
    return docs.withColumn("score", let(statistics(F.col(text)), ensemble.score))
