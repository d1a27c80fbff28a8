"""Quality rules for documents and for the hosts they come from, in Spark expressions only.

Each document gets counts over its whole text. Base rules fail a text of under 50 words or one whose words lie for over
half in 3-word windows found again in the text. Soft rules fail a text of many signs or many repeated lines. Failures are
summed by host; a host's failure rate is shrunk towards all hosts' by a beta prior whose mean and strength are fitted to
the hosts' rates by moments. A host above ``max_host_rate`` loses all its documents, a host under ``trusted_host_rate``
keeps documents that fail a soft rule only, and between them such documents go.

Windows are told apart by their 64-bit hashes. Defined results: a null text has no words and fails; a null host is a
host of its own; an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraline.session import fits, written

SPACE = " \t\n\x0b\f\r"
#: More hosts than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_HOSTS = 100_000
#: The prior weighs at most as many documents.
MAX_STRENGTH = 1000.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; an empty array if there are none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included."""

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        three = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(n + 1, F.lit(0))).alias("b"), F.slice(w, F.lit(3), F.greatest(n, F.lit(0))).alias("c")), F.lit(1), F.greatest(n, F.lit(0)))
        return F.transform(three, lambda x: F.xxhash64(x))

    def starts(hashes: Column) -> Column:
        """Places of the windows whose hash another window has, in order."""
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(placed, lambda s: F.filter(F.arrays_zip(s.alias("x"), F.slice(s, F.lit(2), F.size(s)).alias("y")), lambda p: p["x"]["h"] == p["y"]["h"]))
        return let(twins, lambda t: F.sort_array(F.array_union(F.transform(t, lambda p: p["x"]["i"]), F.transform(t, lambda p: p["y"]["i"]))))

    def covered(at: Column) -> Column:
        following = F.arrays_zip(at.alias("x"), F.slice(at, F.lit(2), F.size(at)).alias("y"))
        return F.aggregate(following, F.lit(0).cast("long"), lambda total, p: total + F.least(F.lit(3), F.coalesce(p["y"] - p["x"], F.lit(3))))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered)))
    )


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long). No shuffle, no Python."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    both = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = docs.withColumn("_terraline_words", let(words_of(F.col(text)), counts)).withColumn("_terraline_lines", both)
    return found.withColumns({c: F.col(f"_terraline_words.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"_terraline_lines.{c}") for c in ("n_lines", "n_dup_lines")} | {"n_symbols": F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long")}).drop("_terraline_words", "_terraline_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    """Over one sign in ten word characters, or over 30 % of the lines repeated."""
    return (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))


def host_rates(checked: DataFrame, host: str) -> DataFrame:
    """(host, n_docs, n_failed, host_rate): each host's failure rate under the empirical beta prior, whose mean and
    strength are the only figures that come to the driver."""
    hosts = checked.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    n, failed, squares = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_docs") * share * share)).first()
    mean = failed / n if n else 0.5
    spread, room = (squares / n - mean * mean if n else 0.0), mean * (1 - mean)
    strength = MAX_STRENGTH if spread <= 0 or room <= 0 else min(MAX_STRENGTH, max(1.0, room / spread - 1))
    return hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_text: bool = True, max_host_rate: float = 0.5, trusted_host_rate: float = 0.02) -> DataFrame:
    """Adds the counts, base_failed, soft_failed, host_rate and kept to every row of ``docs``. The counted rows are
    written once; the hosts' sums shuffle a row for each host and task; their verdicts come back by broadcast if they
    are few, else by a join that can split a host of many rows."""
    counted = with_counts(docs, text).withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed())
    counted = written(counted.drop("kept", "host_rate", *([] if keep_text else [text])), "counted")
    rates = written(host_rates(counted, host).select(F.col("host").alias("_terraline_host"), "host_rate"), "host-rates")
    if fits(rates, MAX_BROADCAST_HOSTS):
        rates = F.broadcast(rates)
    joined = counted.join(rates, F.col(host).eqNullSafe(F.col("_terraline_host")), "left").drop("_terraline_host")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate) & (~F.col("soft_failed") | (F.col("host_rate") < trusted_host_rate))
    return joined.withColumn("kept", kept)
