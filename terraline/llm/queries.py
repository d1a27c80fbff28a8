"""The numbered queries over the shared tables, and their SQL where SQL can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraline.llm import bpe, exact_dedup, fill_middle, html_text, lexical, mixing, oracles, quality_rules, rule_ensemble, secrets, simhash, substrings, token_counts, topk
from terraline.session import run_folder


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; a parameter of the operators, read by the driver alone."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "ids", "decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.tiktoken")).drop("text")


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = rule_ensemble.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = rule_ensemble.scored(docs, ensemble).select("doc_id", "score")
    return score.select("doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["place"] < 3)
    count = lambda place: F.size(F.filter("found", lambda s: s["place"] == place)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("found")).alias("spans"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "kept")


#: The query's target weights; others are 1.
WEIGHTS = {"domain": {"domain0": 3, "domain1": 1, "domain2": 2, "domain3": 2}, "lang": {"en": 2}}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mix(docs, seed=17, share=1.0, max_epochs=2, weights=WEIGHTS).select("doc_id", "domain", "lang", "source", "n_copies")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_middle.fill_in_middle(docs, seed=1, plain_share=10, suffix_first_share=20)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), 50)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    index = exact_dedup.open_index(spark, f"{run_folder(spark)}/digest-index-{uuid.uuid4().hex}")
    found = exact_dedup.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), index, "documents")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_rule_ensemble, op4_secrets, op5_topk, op6_substrings, op7_quality_rules, op8_mixing, op9_simhash, op10_html, op11_fill_middle, op12_lexical, op13_exact_dedup)}
ORACLES = oracles.ORACLES | {"op8_mixing": oracles.op8(WEIGHTS, seed=17, max_epochs=2)}
