"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm import binary_ids, bpe, common, conversation_repair, jaccard_join, lattice_lm, licenses, line_quality, packing, periodic_runs, pii, quality_cnn, rp_forest, substring


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(common.documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                             F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return (bpe.decode(digests, path, public_tokenizers.PATTERN)
            .select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")))


def op2_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = binary_ids.round_trip(spark, common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(common.documents(spark, sf_dir))


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = quality_cnn.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(common.documents(spark, sf_dir))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(common.documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove(common.documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(common.documents(spark, sf_dir), pii.session_key(spark)).select("doc_id", "text", "n_found", "n_changed")


def op11_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.detect(common.documents(spark, sf_dir), periodic_runs.planted))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_bit_plane_files, op3_line_frequency, op4_projection_forest,
                                    op5_best_fit_packing, op6_byte_cnn, op7_heavy_light_join, op8_license_rules, op9_repeated_passages, op10_feistel_pseudonyms,
                                    op11_subword_lattice, op12_periodic_runs, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_frequency": line_quality.ORACLE_SQL, "op7_heavy_light_join": jaccard_join.ORACLE_SQL,
            "op8_license_rules": licenses.ORACLE_SQL,
            "op9_repeated_passages": substring.ORACLE_SQL}
