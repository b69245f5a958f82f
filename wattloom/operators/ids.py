"""Dense ids for meters and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_meters(meters: DataFrame) -> DataFrame:
    """Add ``bgid`` (1, 2, ... by ``building_num``) and ``rows_before`` to a table of meters.

    Input: one row per ``building_num`` with its ``n_rows``. ``rows_before`` counts the
    readings of all lower meters. A running number over all meters would put them in one
    task; the id is a 32-bit integer, so its upper and lower half give two levels with at
    most 65,536 rows per task each, whatever the ids are.
    """
    split = meters.withColumn("upper", F.shiftright("building_num", 16))
    per_upper = split.groupBy("upper").agg(
        F.count("*").alias("meters_in"), F.sum("n_rows").alias("rows_in")
    )
    earlier = Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_upper.select(
        "upper",
        F.coalesce(F.sum("meters_in").over(earlier), F.lit(0)).alias("meters_below"),
        F.coalesce(F.sum("rows_in").over(earlier), F.lit(0)).alias("rows_below"),
    )
    within = Window.partitionBy("upper").orderBy("building_num")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        split.join(F.broadcast(offsets), "upper")
        .withColumn("bgid", F.col("meters_below") + F.row_number().over(within))
        .withColumn(
            "rows_before",
            F.col("rows_below") + F.coalesce(F.sum("n_rows").over(before), F.lit(0)),
        )
        .drop("upper", "meters_below", "rows_below")
    )


def assign_ids(clean: DataFrame) -> DataFrame:
    """Add ``rgid`` (over all readings), ``bgid`` (meter) and ``rid`` (within the meter).

    Takes the result of ``complete_readings``: a meter has a fixed number of readings at
    distinct instants, so ordering one meter is a bounded piece of work. ``rgid`` follows
    from the readings of lower meters plus ``rid``. The input is read twice; materialise
    it first if it is expensive.
    """
    ids = number_meters(clean.groupBy("building_num").agg(F.count("*").alias("n_rows")))
    position = Window.partitionBy("building_num").orderBy("tslocal")
    return (
        clean.withColumn("rid", F.row_number().over(position).cast("long"))
        .join(ids.select("building_num", "bgid", "rows_before"), "building_num")
        .select(
            (F.col("rows_before") + F.col("rid")).alias("rgid"),
            "bgid",
            "rid",
            "building_num",
            "tslocal",
            "usagekw",
        )
    )
