"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionlens.llm import (backoff, bit_resample, decontaminate, gray_simhash, hamming_topk, harmonic, line_rules, nb_svm, plane_kmeans, prefix_bpe,
                            repair_codec, super_kmers, token_shortcut)
from fusionlens.session import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(_documents(spark, sf_dir))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> nb_svm.Model:
    """The model of ``labels.quality``, from the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return nb_svm.train(_documents(spark, sf_dir), labels, "quality", training=~held_out(F.col("id")))


def op2_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = nb_svm.classify(_documents(spark, sf_dir), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.near_duplicates(_documents(spark, sf_dir), width=4, max_bits=4)


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = super_kmers.remove_repeats(_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shortcut.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    repair_codec.write_ids(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = repair_codec.read_ids(spark, path).select(
        "doc_id", "part", "shard", F.col("start").alias("inside"), "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(repair_codec.shard_starts(spark, path), ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return hamming_topk.top_k(vectors, k=10, queries=F.col("id") % 20 == 0)


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = prefix_bpe.encode_and_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                        public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(_documents(spark, sf_dir)).drop("clean_text")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def op11_bit_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = bit_resample.resample(_documents(spark, sf_dir), _benchmark(spark, sf_dir))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_documents(spark, sf_dir), _benchmark(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op13_plane_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return plane_kmeans.cluster(vectors).withColumn("centroid_sha256", digest).drop("centroid")


QUERIES = {
    "op1_backoff": op1_backoff,
    "op2_nb_svm": op2_nb_svm,
    "op3_harmonic": op3_harmonic,
    "op4_gray_simhash": op4_gray_simhash,
    "op5_super_kmers": op5_super_kmers,
    "op6_token_shortcut": op6_token_shortcut,
    "op7_repair": op7_repair,
    "op8_hamming_topk": op8_hamming_topk,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_line_rules": op10_line_rules,
    "op11_bit_resample": op11_bit_resample,
    "op12_decontaminate": op12_decontaminate,
    "op13_plane_kmeans": op13_plane_kmeans,
}
ORACLE_SQL = {
    "op1_backoff": backoff.oracle(),
    "op5_super_kmers": super_kmers.oracle(),
    "op8_hamming_topk": hamming_topk.oracle(),
    "op10_line_rules": line_rules.oracle(),
    "op11_bit_resample": bit_resample.oracle(),
    "op12_decontaminate": decontaminate.oracle(),
    "op13_plane_kmeans": plane_kmeans.oracle(),
}
