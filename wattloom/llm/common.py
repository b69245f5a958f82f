"""What several operators share: words, the per-process cache, shared files, batches."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and every byte outside [0-9a-z\x80-\xff] to a space. In UTF-8, a character
#: from U+0080 on has only bytes from 0x80 on, so splitting the bytes splits the characters.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def word_list(raw: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of letters, digits and characters from U+0080 on."""
    return raw.translate(WORD_BYTES).split()


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is an empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python process. Functions travel by value, so globals of this module are
    copied for every task; what is costly to build is kept on ``sys`` between tasks."""
    kept = sys.__dict__.setdefault("_wattloom_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget_kept(name: str) -> None:
    """Drop this process's objects whose key begins with ``name``, so that later tasks have their memory."""
    kept = sys.__dict__.get("_wattloom_llm", {})
    for key in [x for x in kept if x[0] == name]:
        del kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``mapInArrow`` for functions that need one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def file_system(uri: str):
    """The pyarrow file system of a shared folder, and the path in it (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def join_hot(
    rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, heaviest: int = 1000
) -> DataFrame:
    """``rows`` left join ``table`` on ``key``, where one key may hold a third of the rows.

    ``table`` is written and has one row per key. The ``heaviest`` keys by number of rows (``key, n``
    in ``counts``, if known) are broadcast with their row of ``table``, if any; their rows, and those
    without a key, stay spread by task. Any other key holds at most 1 in ``heaviest`` + 1 of the rows.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    names = [c for c in table.columns if c != key]
    known = counts.where(F.col(key).isNotNull() & (F.col("n") > 1))
    top = known.orderBy(F.desc("n"), key).limit(heaviest).select(key)
    value = F.struct(*names).alias("_value")
    hot = top.join(table, key, "left").select(F.col(key).alias("_key"), F.lit(True).alias("_hot"), value)
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").drop("_key")
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    place = 1 + 64 * F.spark_partition_id() + F.pmod(F.monotonically_increasing_id(), F.lit(64))
    salted = tagged.withColumn("_salt", F.when(spread, place).otherwise(F.lit(0)).cast("long"))
    # A literal 0 would be taken out of the join's keys.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("long").alias("_zero")
    plain = table.select(F.col(key).alias("_key"), F.struct(*names).alias("_other"), zero)
    matched = salted.join(plain, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    found = F.when(F.col("_hot"), F.col("_value")).otherwise(F.col("_other"))
    return matched.select(*rows.columns, *[found[c].alias(c) for c in names])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_key():
    """64-bit hash and length of ``text``: tells rows with one id and different texts apart."""
    return F.struct(
        F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size")
    )
