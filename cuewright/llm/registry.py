"""The ``opN_<name>`` queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, merkle, minhash, pair_index, quality_model, quality_rules, ranked_search, sharding, suffix_dedup, toxicity
from .shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark)).select("doc_id", "n_shingles", "component_id", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer's file is; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str, *, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"), dropout=dropout, seed=seed)


def encoded(spark: SparkSession, docs: DataFrame, *, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """doc_id, token_ids, n_tokens, lossless of each document."""
    Scratch(spark)
    coded = docs.select("doc_id", bpe.encode(F.col("text"), F.col("doc_id"), bpe.read_model(model_path()), dropout, seed).alias("x"))
    return coded.select("doc_id", F.col("x.ids").alias("token_ids"), F.size("x.ids").cast("long").alias("n_tokens"), F.col("x.lossless").alias("lossless"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), Scratch(spark))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), Scratch(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents have too."""
    found = suffix_dedup.spans_by_document(table(spark, sf_dir, "documents"), Scratch(spark))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",")
    return found.select("doc_id", words("repeated").alias("n_repeated"), words("removed").alias("n_removed"), shown("repeated").alias("repeated"), shown("removed").alias("removed"))


def op10_token_counts(spark: SparkSession, sf_dir: str, *, limit: int = 4096) -> DataFrame:
    Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", n_bytes, bpe.token_counts(F.col("text"), bpe.read_model(model_path())).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), Scratch(spark))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""
    Scratch(spark)
    tokenizer = bpe.read_model(model_path("word_bpe_49k.json"))
    coded = table(spark, sf_dir, "documents").select("doc_id", pair_index.encode(F.coalesce("text", F.lit("")), tokenizer).alias("ids"))
    both = coded.select("doc_id", "ids", pair_index.decode(F.col("ids"), tokenizer).alias("decoded"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bpe": op12_bpe,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
