"""One registered query per training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corridor.llm import binary_ids, decontaminate, embedding_dedup, langid, line_dedup, lm, merkle, minhash, oracles, packing, prefix_trie, secret_scan, token_counts, toxicity
from corridor.llm.shared import workspace

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model(table(spark, sf_dir, "documents"), states=8, rounds=2, modulus=5, remainder=1)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "token-files")
    manifest = binary_ids.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return binary_ids.read_token_files(manifest, folder)


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, num=80, den=100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.word_lengths(table(spark, sf_dir, "documents")), sizes=packing.SIZES)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(size=3, num=85, den=100))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace(spark, "token-counts")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace(spark, "secrets")
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op11_line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents"), min_length=40, min_docs=5, keep="last")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_hmm_scores, op2_token_files, op3_embedding_duplicates, op4_toxicity, op5_contamination, op6_packing,
    op7_near_duplicates, op8_languages, op9_token_counts, op10_secrets, op11_line_duplicates, op12_merkle_proofs,
    op13_conversation_trie)}
ORACLES: dict[str, str] = oracles.ORACLES
