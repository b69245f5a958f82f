"""From numbered readings to one normalised signal per meter.

Every function takes readings of complete meters (or what was made of them), so the
groups per meter are bounded by the expected number of readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RAW_ARRAYS = ["rgid", "rid", "tslocal", "tslocal_fromzero", "usagekw"]


def drop_all_zero(with_ids: DataFrame) -> DataFrame:
    """Remove meters that only ever report zero; add seconds since the meter's first reading.

    Range test and offset share one pass over the meter instead of joining it back.
    """
    meter = Window.partitionBy("bgid")
    alive = (F.col("minu") != 0.0) | (F.col("maxu") != 0.0)
    return (
        with_ids.withColumn("minu", F.min("usagekw").over(meter))
        .withColumn("maxu", F.max("usagekw").over(meter))
        .withColumn("tslocal_fromzero", F.col("tslocal") - F.min("tslocal").over(meter))
        .where(alive)
        .select(
            "rgid", "bgid", "rid", "building_num", "tslocal", "tslocal_fromzero", "usagekw"
        )
    )


def window_sum(nozero: DataFrame, window_seconds: int = 300, with_arrays: bool = False) -> DataFrame:
    """Sum usage over tumbling windows that start with the meter's first reading.

    ``with_arrays`` also keeps the window's raw values, ordered and including missing
    ones; leave it off unless they are needed, because it defeats partial aggregation.
    """
    windows = nozero.withColumn(
        "win_id", F.expr(f"cast(cast(tslocal_fromzero AS int) div {window_seconds} AS int)")
    )
    aggregates = [F.sum("usagekw").alias("usagekw_sum_5min")]
    if with_arrays:
        members = F.struct("rid", "rgid", "tslocal", "tslocal_fromzero", "usagekw")
        aggregates.append(F.sort_array(F.collect_list(members)).alias("members"))
    summed = windows.groupBy("bgid", "win_id", "building_num").agg(*aggregates)
    columns = ["bgid", "win_id", "usagekw_sum_5min", "building_num"]
    if with_arrays:
        columns += [F.col(f"members.{c}").alias(f"{c}_arr") for c in _RAW_ARRAYS]
    return summed.select(*columns)


def normalize_signal(windows: DataFrame) -> DataFrame:
    """Centre each meter's signal and divide it by its sum of squared deviations.

    The divisor is the sum itself, not its root. A constant signal has divisor 0 and gets
    NULL; ``series_arrays`` drops such meters. Both windows share one shuffle and sort.
    """
    meter = Window.partitionBy("bgid")
    deviation = F.col("usagekw_sum_5min") - F.col("usagekw_sum_5min_mean")
    arrays = [c for c in windows.columns if c.endswith("_arr")]
    return (
        windows.withColumn("usagekw_sum_5min_mean", F.avg("usagekw_sum_5min").over(meter))
        .withColumn("usagekw_sum_5min_norm_denom", F.sum(deviation * deviation).over(meter))
        .withColumn(
            "usagekw_sum_5min_norm", F.try_divide(deviation, F.col("usagekw_sum_5min_norm_denom"))
        )
        .select(
            "bgid",
            "win_id",
            "usagekw_sum_5min",
            "usagekw_sum_5min_norm",
            "usagekw_sum_5min_mean",
            "usagekw_sum_5min_norm_denom",
            "building_num",
            *arrays,
        )
    )


def usable_divisor(name: str, least: float) -> Column:
    """A divisor that is a number above ``least``. NaN is larger than any number in Spark."""
    return (F.col(name) > least) & (F.col(name) < float("inf"))


def rejected_meters(normalized: DataFrame, min_denominator: float = 1e-10) -> DataFrame:
    """How many meters ``series_arrays`` drops: ``constant`` and ``not_finite`` ones."""
    per_meter = normalized.groupBy("bgid").agg(F.max("usagekw_sum_5min_norm_denom").alias("d"))
    wild = F.isnan("d") | (F.col("d") == float("inf"))
    return per_meter.agg(
        F.count_if(~wild & (F.col("d") <= min_denominator)).alias("constant"),
        F.count_if(wild).alias("not_finite"),
    )


def series_arrays(normalized: DataFrame, min_denominator: float = 1e-10) -> DataFrame:
    """One row per meter with its signal as ordered arrays. Near-constant meters are dropped, and
    those with a missing, NaN or infinite value (``rejected_meters`` counts them)."""
    ordered = F.sort_array(
        F.collect_list(F.struct("win_id", "usagekw_sum_5min", "usagekw_sum_5min_norm"))
    )
    return (
        normalized.where(usable_divisor("usagekw_sum_5min_norm_denom", min_denominator))
        .groupBy("bgid", "building_num")
        .agg(
            F.first("usagekw_sum_5min_mean").alias("usagekw_sum_5min_mean"),
            F.first("usagekw_sum_5min_norm_denom").alias("usagekw_sum_5min_norm_denom"),
            ordered.alias("points"),
        )
        .select(
            "bgid",
            "building_num",
            "usagekw_sum_5min_mean",
            "usagekw_sum_5min_norm_denom",
            F.col("points.win_id").alias("win_id_arr"),
            F.col("points.usagekw_sum_5min").alias("usagekw_sum_5min_arr"),
            F.col("points.usagekw_sum_5min_norm").alias("usagekw_sum_5min_norm_arr"),
        )
    )
