"""From raw documents to encoded training data: each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraline.llm import bpe, mixing, quality_rules, queries, secrets, simhash
from terraline.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality_rules.judge(docs).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles at a similarity of 0.8 or more. Fingerprints within
    4 bits are tried first; what they leave is found by shared shingles."""
    return simhash.without_near_duplicates(docs, shingle=5, radius=4).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark."""
    text = secrets.redacted(F.col("text"), F.col("found"))
    return secrets.scan(docs).select("doc_id", text.alias("text"), "lang", "source", "n_chars").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


#: Target weights of the mix; other nodes weigh 1.
WEIGHTS = {"lang": {"en": 4}}


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by the target weights, at most two epochs of a source: a row for each epoch
    that a document is in."""
    chosen = mixing.mix(docs, seed=17, share=1.0, max_epochs=2, weights=WEIGHTS)
    return chosen.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    both = bpe.encode_decode(docs, queries.vocabulary("byte_bpe_50k.json"))
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL has no byte-pair encoding or XXH64; a test runs the stages on a small table and checks what each must do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
