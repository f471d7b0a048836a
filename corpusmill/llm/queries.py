"""Thin op queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import ann, bpe, cdc, divergence, fim, language_id, licenses, mixing, quality, sharding, simhash, token_counts, wrappers

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("rate")


def op2_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.audited(table(spark, sf_dir, "embeddings"))


def op3_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.edit_test(table(spark, sf_dir, "documents"))


def op4_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_FILE))
    return found.select("doc_id", "n_pretokens", "n_tokens", "log_p")


def bpe_digest(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(BPE_FILE))
    return coded.select(
        "doc_id",
        (F.octet_length("bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), seed="1").drop("text")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_flat_graph": op2_flat_graph,
        "op3_cdc": op3_cdc,
        "op4_hilbert": op4_hilbert,
        "op5_license_scan": op5_license_scan,
        "op6_wrapper": op6_wrapper,
        "op7_language_id": op7_language_id,
        "op8_simhash": op8_simhash,
        "op9_token_counts": op9_token_counts,
        "op10_bpe": op10_bpe,
        "op11_divergence": op11_divergence,
        "op12_fim": op12_fim,
        "op13_quality": op13_quality,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE_SQL, "op5_license_scan": licenses.ORACLE_SQL, "op11_divergence": divergence.ORACLE_SQL, "op12_fim": fim.ORACLE_SQL}
