"""Inputs of the registered queries, derived from the driver's tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of one-minute readings for every supplier, with all kinds of trouble.

    By key modulo 20: 3 starts late, 7 misses a minute, 11 is all zero, 13 constant,
    17 repeats an instant, 19 is nearly zero; the others are square waves with a ripple.
    """
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    spread = keys.repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    minutes = spread.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("m"))
    daily = minutes.where(
        "NOT (s_suppkey % 20 = 3 AND m < 394) AND NOT (s_suppkey % 20 = 7 AND m = 700)"
    ).selectExpr(
        "CAST(s_suppkey AS INT) AS building_num",
        "CAST(1301702400 + 60 * m AS BIGINT) AS tslocal",
        """CASE
             WHEN s_suppkey % 20 = 11 THEN 0e0
             WHEN s_suppkey % 20 = 13 THEN 1.5e0
             WHEN s_suppkey % 20 = 19 THEN (m % 2) / 1073741824e0
             ELSE (64 * (floor(m * (1 + s_suppkey % 4) / 720e0) % 2) * (1 + s_suppkey % 5)
                   + (m * 37 + s_suppkey * 101) % 64) / 64e0
           END AS usagekw""",
    )
    repeated = keys.where("s_suppkey % 20 = 17").selectExpr(
        "CAST(s_suppkey AS INT) AS building_num",
        "CAST(1301702700 AS BIGINT) AS tslocal",
        "0.25e0 AS usagekw",
    )
    return daily.unionByName(repeated)


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as irregular meters: one meter per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("building_num"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("tslocal"),
        F.col("value").alias("usagekw"),
    )


def hot_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as readings of their suppliers; one meter has half of all rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END AS INT) AS building_num",
        "CAST(60 * (l_orderkey + l_linenumber) AS BIGINT) AS tslocal",
        "CAST(l_quantity AS DOUBLE) AS usagekw",
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors; the ids of a signal twice as long go with them."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("bgid"),
        F.col("label").alias("building_num"),
        F.col("embedding").cast("array<double>").alias("pgram_norm_arr"),
        F.sequence(F.lit(0), F.size("embedding") * 2 - 1).alias("win_id_arr"),
    )
