"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from routelore.llm import language, merkle, mixing, neighbours, oracles, packing, repetition, resampling, sharding, simhash, token_counts, toxicity, url_filter, warc
from routelore.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, d: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.components(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_suffix_array_repetition")
def op7(spark: SparkSession, d: str) -> DataFrame:
    found = repetition.quality(table(spark, d, "documents").select("doc_id", "text"))
    return found.drop("text")


@query("op10_ppm_language_id")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return language.identified(table(spark, d, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_host_reputation", oracles.op9())
def op9(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judged(table(spark, d, "pages"), table(spark, d, "labels")).select("page_id", "host", "path", "rule", "verdict")


@query("op6_source_mixing", oracles.op6())
def op6(spark: SparkSession, d: str) -> DataFrame:
    found = mixing.calibrated(table(spark, d, "documents"))
    return found.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"),
        F.round("__probability", 9).alias("probability"), F.col("__sampled").alias("sampled"))


@query("op2_zip_archive_records", oracles.OP2)
def op2(spark: SparkSession, d: str) -> DataFrame:
    found = warc.round_trip(table(spark, d, "pages"), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_unigram_token_counts")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(table(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op4_toxicity_chain")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.judged(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op8_multiprobe_neighbours")
def op8(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query("op11_merkle_manifest", oracles.op11())
def op11(spark: SparkSession, d: str) -> DataFrame:
    tampered = F.expr("crc32(CAST(doc_id AS STRING)) % 2 = 0")
    found = merkle.manifest(table(spark, d, "documents"), tampered, F.regexp_replace("text", "\n", ""))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_importance_resampling", oracles.op12())
def op12(spark: SparkSession, d: str) -> DataFrame:
    found = resampling.resampled(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_external_shuffle")
def op13(spark: SparkSession, d: str) -> DataFrame:
    written = sharding.write_shards(table(spark, d, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return written.select("doc_id", sharding.record_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
