"""Namespaces, tables and views of a run kept in the session catalogue."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.schema import READINGS
from wattloom.sources.readings import checked_readings, stage_readings
from wattloom.storage import fresh_path, run_of


def reset_namespace(spark: SparkSession, name: str) -> None:
    """Drop the namespace with everything in it and create it anew in the shared folder."""
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_path(spark, name)}'")


def create_readings_table(spark: SparkSession, table: str) -> None:
    """An empty table with the readings schema."""
    empty = spark.createDataFrame([], READINGS)
    empty.write.mode("overwrite").saveAsTable(table)


def load_readings_csv(spark: SparkSession, path: str, table: str) -> None:
    """Append a CSV to an existing readings table, the whole of it or nothing.

    Every line is parsed once, into a staging table. If a line is no reading, ``BadLines`` names the
    first of them by file and text, and the table is as it was; else the staged rows are appended.
    """
    with run_of(spark):
        checked_readings(stage_readings(spark, path)).write.mode("append").insertInto(table)


def save_table(
    df: DataFrame,
    table: str,
    distributed_by: Sequence[str] = (),
    buckets: int | None = None,
    splits: int = 4,
) -> DataFrame:
    """Materialise ``df`` as ``table``, replacing an older one, and return the table.

    With ``distributed_by`` the table is bucketed on those columns, so later joins and
    groupings on them need no shuffle. Choose ``buckets`` so that a bucket is about 128 MB to
    1 GB. Each bucket is written by about ``splits`` tasks as that many files, whatever its keys
    hold, so a hot key is not one task here. A reader takes a bucket as one task: where a key may be
    hot, such as the meter of raw readings, use ``save_distributed``.
    """
    if distributed_by:
        if buckets is None:
            raise ValueError("a distributed table needs a number of buckets")
        first, *rest = distributed_by
        bucket = F.pmod(F.hash(*distributed_by), F.lit(buckets))
        part = F.pmod(F.xxhash64(*df.columns), F.lit(splits))
        dealt = df.repartition(buckets * splits, bucket, part)
        writer = dealt.write.bucketBy(buckets, first, *rest)
    else:
        writer = df.write
    writer.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


@dataclass(frozen=True)
class Distributed:
    """A table by key in two parts that share no key: ``ordinary``, bucketed on the key, and ``hot``, whose
    keys are cut by a salt. ``salts`` has ``n_rows`` and ``splits`` of every hot key."""

    ordinary: DataFrame
    hot: DataFrame
    salts: DataFrame

    def rows(self) -> DataFrame:
        return self.ordinary.unionByName(self.hot)

    def by_key(self, per_key: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``per_key`` of the whole table, for a function whose result for a key depends on that key's rows only.

        The bucketed part is not shuffled; a hot key is read by several tasks and meets after partial aggregates.
        """
        return per_key(self.ordinary).unionByName(per_key(self.hot))


def save_distributed(df: DataFrame, table: str, key: str, buckets: int) -> Distributed:
    """Write ``df`` distributed by ``key`` as ``table``, ``table_hot`` and ``table_salts``, replacing older ones.

    A key is hot if it has more rows than an average bucket, so fewer than ``buckets`` keys are; it is cut
    into as many splits as average buckets fit into it, by a hash of the whole row. ``df`` is read twice
    for this: give a written table.
    """
    total = df.count()
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    splits = F.ceil(F.col("n_rows") * buckets / F.lit(max(total, 1))).cast("int").alias("splits")
    hot = counts.where(F.col("n_rows") * buckets > total).select("*", splits)
    salts = save_table(hot.coalesce(1), f"{table}_salts")
    keys = F.broadcast(salts.select(key, "splits"))  # fewer than ``buckets`` rows
    ordinary = df.join(keys.drop("splits"), key, "left_anti").select(*df.columns)
    of_hot = df.join(keys, key).withColumn("salt", F.pmod(F.xxhash64(*df.columns), "splits").cast("int"))
    parts = salts.agg(F.sum("splits")).first()[0] or 1
    dealt = of_hot.select(*df.columns, "salt").repartition(int(parts), key, "salt")
    return Distributed(
        save_table(ordinary, table, [key], buckets),
        save_table(dealt, f"{table}_hot").drop("salt"),
        salts,
    )


def read_distributed(spark: SparkSession, table: str) -> Distributed:
    """The parts that ``save_distributed`` wrote."""
    return Distributed(spark.table(table), spark.table(f"{table}_hot").drop("salt"), spark.table(f"{table}_salts"))


def save_spread(df: DataFrame, table: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Materialise ``df`` without a key, in files of about ``rows_per_file`` rows; return the table.

    A row's file depends on its values and the number of rows only, so a second run writes the same files; equal
    rows are in one file.
    """
    files = max(1, -(-df.count() // rows_per_file))
    place = F.pmod(F.xxhash64(*df.columns), F.lit(files)).cast("int")
    df.repartitionById(files, place).sortWithinPartitions(*df.columns).write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def create_view(df: DataFrame, name: str) -> None:
    """Name a lazy query."""
    df.createOrReplaceTempView(name)
