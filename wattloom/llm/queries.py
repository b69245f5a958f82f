"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import (
    centroids,
    decontaminate,
    licenses,
    packing,
    resample,
    secrets,
    sharding,
    simhash,
    token_store,
    topk,
    toxicity,
    url_rules,
    warc,
)
from wattloom.llm.common import table
from wattloom.storage import fresh_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_virtual_slots(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf, "documents"), fresh_path(spark, "slot-map"))
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    tokens = packing.tokenize(table(spark, sf, "documents"), _vocabulary("word_bpe_49k.json"), spaces=False, end_id=2)
    return packing.placed_pieces(packing.write_sequences(tokens, fresh_path(spark, "sequences")))


def op3_warc_reader(spark: SparkSession, sf: str) -> DataFrame:
    pages = warc.archive_pages(table(spark, sf, "pages"), fresh_path(spark, "archives"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op6_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return secrets.secret_digest(secrets.secrets_by_path(docs, fresh_path(spark, "ledger")))


def op7_license_join(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_digest(licenses.license_matches(table(spark, sf, "documents")))


def op8_ordinal_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit_severity(docs, table(spark, sf, "labels"))
    return toxicity.score_documents(docs, model)


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    stored = token_store.token_store(docs, fresh_path(spark, "token-files"), _vocabulary("byte_bpe_50k.json"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_impact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), "vec_id % 20 = 0")


def op11_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf, "pages"))


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster_digest(centroids.cluster_vectors(table(spark, sf, "embeddings")))


QUERIES = {
    "op1_virtual_slots": op1_virtual_slots,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_warc_reader": op3_warc_reader,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_license_join": op7_license_join,
    "op8_ordinal_toxicity": op8_ordinal_toxicity,
    "op9_token_files": op9_token_files,
    "op10_impact_top_k": op10_impact_top_k,
    "op11_url_rules": op11_url_rules,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_centroid_clustering": op13_centroid_clustering,
}
