"""Cleaning a corpus: toxic documents go, one document of each near-duplicate group stays,
contaminated documents go, secrets are blanked out, and what is left is packed into windows.

Each stage gets what its predecessor kept, as a table that was written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import decontaminate, packing, secrets, simhash, toxicity
from wattloom.llm.common import table
from wattloom.storage import fresh_path, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected. The model is fitted on the labelled documents of the corpus."""
    model = toxicity.fit_severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, fresh_path(spark, "ledger"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str, sequences: str | None = None) -> DataFrame:
    """Where each piece lies in the sequences, which are written to the folder ``sequences``."""
    import public_tokenizers

    tokens = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), spaces=False, end_id=2)
    return packing.placed_pieces(packing.write_sequences(tokens, sequences or fresh_path(spark, "sequences")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", blank_secrets),
    ("packing", pack_windows),
]

#: A fitted model, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, sequences: str | None = None) -> DataFrame:
    """The pieces of the packed corpus; its windows are written to ``sequences``, if given."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        more = {"sequences": sequences} if name == "packing" else {}
        docs = materialise(stage(spark, docs, sf_dir, **more), name)
    return docs
