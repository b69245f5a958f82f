"""Which meters report regularly, and which of them completely.

Nothing here orders or collects a meter as a whole: one meter may hold a large
share of all readings. Gaps are counted inside time slots of bounded length and
stitched together at the slot edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.storage import materialise

#: Default of ``heaviest``: meters with the most readings that get separate treatment before a
#: shuffle. After they are taken out, no meter holds more than 1/(HEAVIEST + 1) of all readings.
HEAVIEST = 2000

#: Over how many artificial keys the readings of such meters are spread.
SPREAD = 1 << 20

_REGULAR = "diff_ct = 1"


def meter_summary(
    readings: DataFrame, interval_seconds: int = 60, usage_range: bool = False
) -> DataFrame:
    """One row per meter: number of readings, gaps of exactly one interval, and span.

    ``diff_ct = ct_tslocal - ct_deltatime_60sec`` is 1 if and only if every reading
    but the first follows its predecessor by exactly ``interval_seconds``. A repeated
    instant is a gap of 0 and makes a meter irregular; a lone reading passes.
    ``usage_range`` adds ``min_usage`` and ``max_usage``; without it usage is not read.

    How: 60 intervals form a block, 24 blocks a slot. Within a block the instants with the
    same remainder modulo the interval are one 64-bit mask, so readings shrink by up to 60
    in a plain hash aggregate before the first shuffle, and repeated instants collapse there.
    A slot is then at most 24 masks for a meter that keeps to its raster.

    Skew: no group depends on how many readings a meter has or how often one repeats; a slot
    holds at most ``1440 * interval_seconds`` distinct instants.
    """
    return summary_of_masks(slot_masks(readings, interval_seconds, usage_range), interval_seconds)


def slot_masks(readings: DataFrame, interval_seconds: int = 60, usage_range: bool = False) -> DataFrame:
    """The state behind ``meter_summary``: a row per meter, slot, block and remainder.

    States of two sets of readings become that of both by ``merge_masks``, whatever they have in common.
    """
    slot, block = 1440 * interval_seconds, 60 * interval_seconds
    usage = ", min(usagekw) AS min_usage, max(usagekw) AS max_usage" if usage_range else ""
    query = f"""
WITH placed AS (
  SELECT *,
         tslocal - pmod(tslocal, {slot}) AS slot,
         tslocal - pmod(tslocal, {block}) AS block,
         pmod(tslocal, {interval_seconds}) AS remainder,
         shiftleft(1L, cast(pmod(tslocal, {block}) div {interval_seconds} AS int)) AS bit
  FROM {{readings}}
)
SELECT building_num, slot, block, remainder, bit_or(bit) AS mask,
       count(*) AS n_rows, count(tslocal) AS n,
       min(tslocal) AS first_ts, max(tslocal) AS last_ts{usage}
FROM placed GROUP BY building_num, slot, block, remainder"""
    return readings.sparkSession.sql(query, readings=readings)


def merge_masks(masks: DataFrame) -> DataFrame:
    """One state from the rows of several."""
    aggregates = {
        "mask": F.bit_or,
        "n_rows": F.sum,
        "n": F.sum,
        "first_ts": F.min,
        "last_ts": F.max,
        "min_usage": F.min,
        "max_usage": F.max,
    }
    keys = ["building_num", "slot", "block", "remainder"]
    return masks.groupBy(*keys).agg(*[f(c).alias(c) for c, f in aggregates.items() if c in masks.columns])


def summary_of_masks(masks: DataFrame, interval_seconds: int = 60) -> DataFrame:
    """``meter_summary`` from the state of ``slot_masks``."""
    slot, block = 1440 * interval_seconds, 60 * interval_seconds
    ranges, no_ranges, merged = "", "", ""
    if "min_usage" in masks.columns:
        ranges = ", min_usage, max_usage"
        no_ranges = ", CAST(NULL AS DOUBLE) AS min_usage, CAST(NULL AS DOUBLE) AS max_usage"
        merged = ", min(min_usage) AS min_usage, max(max_usage) AS max_usage"
    query = f"""
WITH slots AS (
  SELECT building_num, slot, sum(n_rows) AS n_rows, sum(n) AS n,
         min(first_ts) AS first_ts, max(last_ts) AS last_ts,
         min(remainder) AS low, max(remainder) AS high,
         sort_array(collect_list(struct(block, remainder, mask, first_ts))
                    FILTER (WHERE block IS NOT NULL)) AS parts{merged}
  FROM {{masks}} GROUP BY building_num, slot
),
-- Masks of more than one raster are spelled out again as instants.
spelled AS (
  SELECT *, CASE WHEN low <> high THEN
    sort_array(flatten(transform(parts, p ->
      if(bit_count(p.mask) = 1, array(p.first_ts),
         transform(filter(sequence(0, 59), b -> (shiftright(p.mask, b) & 1L) <> 0L),
                   b -> p.block + b * {interval_seconds} + p.remainder))))) END AS instants
  FROM slots
),
-- On one raster, neighbouring bits are regular gaps: inside a mask, and from the last bit of a
-- block to the first bit of the next one.
gaps AS (
  SELECT *, CASE
    WHEN low = high THEN
      aggregate(parts, 0L, (c, p) -> c + bit_count(p.mask & shiftleft(p.mask, 1)))
      + size(filter(parts, (p, i) -> i > 0 AND p.block - get(parts, i - 1).block = {block}
          AND (p.mask & 1L) <> 0L AND (get(parts, i - 1).mask & {1 << 59}L) <> 0L))
    WHEN low <> high THEN
      size(filter(instants, (t, i) -> i > 0 AND t - get(instants, i - 1) = {interval_seconds}))
    ELSE 0 END AS n_regular
  FROM spelled
),
-- Every slot hands its last instant to the slot behind it. A predecessor one interval back can
-- only be in the same or the previous slot, so no ordering is needed.
edges AS (
  SELECT building_num, inline(array(
    struct(slot, n_rows, n, n_regular, first_ts, CAST(NULL AS BIGINT) AS previous_ts{ranges}),
    struct(slot + {slot} AS slot, 0L AS n_rows, 0L AS n, 0L AS n_regular,
           CAST(NULL AS BIGINT) AS first_ts, last_ts AS previous_ts{no_ranges})))
  FROM gaps
),
stitched AS (
  SELECT building_num, sum(n_rows) AS n_rows, sum(n) AS n,
         sum(n_regular) + CASE WHEN max(first_ts) - max(previous_ts) = {interval_seconds}
                               THEN 1 ELSE 0 END AS n_regular,
         max(first_ts) AS first_ts, max(previous_ts) AS previous_ts{merged}
  FROM edges GROUP BY building_num, slot
)
SELECT *, ct_tslocal - ct_deltatime_60sec AS diff_ct FROM (
  SELECT building_num, sum(n) AS ct_tslocal, sum(n_regular) AS ct_deltatime_60sec,
         min(first_ts) AS ts_start, max(previous_ts) AS ts_end, sum(n_rows) AS n_rows{merged}
  FROM stitched GROUP BY building_num)"""
    return masks.sparkSession.sql(query, masks=masks)


def interval_check(readings: DataFrame, interval_seconds: int = 60) -> DataFrame:
    """Gap statistics of every meter."""
    return meter_summary(readings, interval_seconds).select(
        "building_num", "ct_tslocal", "ct_deltatime_60sec", "diff_ct"
    )


def interval_histogram(checked: DataFrame) -> DataFrame:
    """How many meters have which ``diff_ct``; takes the result of ``interval_check``."""
    return checked.groupBy("diff_ct").agg(F.count("*").alias("ct_buildings")).orderBy("diff_ct")


def regular_readings(
    readings: DataFrame,
    interval_seconds: int = 60,
    summary: DataFrame | None = None,
    heaviest: int = HEAVIEST,
) -> DataFrame:
    """The readings of meters whose every gap is one interval.

    The summary (one row per meter) is written first: it is used twice, and its real size
    then decides how the readings are matched against it. ``summary`` is an already written
    one; all functions here that need it take it.
    """
    meters = _written(summary, lambda: meter_summary(readings, interval_seconds))
    return _readings_of(readings, meters, _REGULAR, heaviest)


def count_regular_meters(
    readings: DataFrame, interval_seconds: int = 60, summary: DataFrame | None = None
) -> DataFrame:
    """How many meters are regular. Read off the summary: the readings need no second pass."""
    regular = (summary or meter_summary(readings, interval_seconds)).where(_REGULAR)
    return regular.agg(F.count("building_num").alias("ct_buildings"))


def meter_spans(
    readings: DataFrame, interval_seconds: int = 60, summary: DataFrame | None = None
) -> DataFrame:
    """First and last instant and number of readings of every regular meter."""
    regular = (summary or meter_summary(readings, interval_seconds)).where(_REGULAR)
    return regular.where(F.col("building_num").isNotNull()).select(
        "building_num", "ts_start", "ts_end", "ct_tslocal"
    )


def span_histogram(spans: DataFrame) -> DataFrame:
    """How many meters share a span; takes the result of ``meter_spans``."""
    keys = ["ts_start", "ts_end", "ct_tslocal"]
    return spans.groupBy(*keys).agg(F.count("*").alias("ct")).orderBy(*keys)


def complete_meters(
    readings: DataFrame,
    interval_seconds: int = 60,
    expected_readings: int = 1440,
    require_common_span: bool = False,
    usage_range: bool = False,
    summary: DataFrame | None = None,
) -> DataFrame:
    """``meter_summary`` with a column ``usable``: regular and with the expected readings.

    By default only the number of readings counts. ``require_common_span`` also asks for
    the most frequent start and end among such meters (earliest span on ties); give it a
    written ``summary``, which it reads twice.
    """
    if summary is None:
        summary = meter_summary(readings, interval_seconds, usage_range)
    usable = F.expr(
        f"{_REGULAR} AND ct_tslocal = {expected_readings} AND building_num IS NOT NULL"
    )
    if not require_common_span:
        return summary.withColumn("usable", usable)
    common = (
        summary.where(usable)
        .groupBy("ts_start", "ts_end")
        .agg(F.count("*").alias("meters"))
        .orderBy(F.desc("meters"), "ts_start", "ts_end")
        .limit(1)
        .select("ts_start", "ts_end", F.lit(True).alias("common"))
    )
    joined = summary.join(F.broadcast(common), ["ts_start", "ts_end"], "left")
    return joined.withColumn("usable", usable & F.coalesce("common", F.lit(False))).drop("common")


def complete_readings(
    readings: DataFrame,
    interval_seconds: int = 60,
    expected_readings: int = 1440,
    require_common_span: bool = False,
    summary: DataFrame | None = None,
    heaviest: int = HEAVIEST,
) -> DataFrame:
    """The readings of usable meters: exactly ``expected_readings`` each, all instants distinct.

    As in ``regular_readings`` the summary is written first.
    """
    if require_common_span:
        summary = _written(summary, lambda: meter_summary(readings, interval_seconds))
    judged = complete_meters(
        readings, interval_seconds, expected_readings, require_common_span, summary=summary
    )
    meters = materialise(judged, "meters")
    usable = meters.where("usable").select("building_num")
    return without_heavy_rejects(readings, meters, heaviest).join(usable, "building_num", "left_semi").select(
        *readings.columns
    )


def _written(summary: DataFrame | None, compute: Callable[[], DataFrame]) -> DataFrame:
    return materialise(compute(), "meters") if summary is None else summary


def without_heavy_rejects(
    readings: DataFrame, meters: DataFrame, heaviest: int = HEAVIEST
) -> DataFrame:
    """Drop the readings of the largest unusable meters before anything is shuffled.

    The list has at most ``heaviest`` rows, so it can be broadcast. What is left is safe
    to shuffle by meter: a usable meter is bounded by its expected readings, an unusable
    one holds at most 1/(heaviest + 1) of the input, and the join by meter lets Spark split
    partitions that are still too large. Raise ``heaviest`` with the input.
    """
    heavy = (
        meters.where("NOT usable AND building_num IS NOT NULL")
        .orderBy(F.desc("n_rows"), "building_num")
        .limit(heaviest)
        .select("building_num")
    )
    return readings.where(F.col("building_num").isNotNull()).join(
        F.broadcast(heavy), "building_num", "left_anti"
    )


def completeness_histogram(clean: DataFrame) -> DataFrame:
    """How many meters have how many readings."""
    per_meter = clean.groupBy("building_num").agg(F.count("*").alias("ct_ts"))
    return per_meter.groupBy("ct_ts").agg(F.count("*").alias("ct_buildings")).orderBy("ct_ts")


def _readings_of(
    readings: DataFrame, meters: DataFrame, accepted: str, heaviest: int = HEAVIEST
) -> DataFrame:
    """Readings of accepted meters when an accepted meter itself may be huge.

    The verdict on the heaviest meters is broadcast (at most ``heaviest`` rows): rejected
    ones stop at the scan, accepted ones are known to stay and get keys that no meter has,
    which spreads them over all partitions. The others are matched by meter as usual.
    """
    known = meters.where(F.col("building_num").isNotNull()).withColumn("accepted", F.expr(accepted))
    heavy = (
        known.orderBy(F.desc("n_rows"), "building_num")
        .limit(heaviest)
        .select("building_num", F.col("accepted").alias("heavy_accepted"))
    )
    beyond_int = 1 << 33
    spread_key = F.pmod(F.xxhash64("tslocal"), F.lit(SPREAD)) + F.lit(beyond_int)
    tagged = (
        readings.where(F.col("building_num").isNotNull())
        .join(F.broadcast(heavy), "building_num", "left")
        .where(F.coalesce("heavy_accepted", F.lit(True)))
        .withColumn(
            "match_key",
            F.when(F.col("heavy_accepted"), spread_key).otherwise(F.col("building_num").cast("long")),
        )
    )
    others = known.where("accepted").select(
        F.col("building_num").cast("long").alias("match_key"), F.lit(True).alias("matched")
    )
    kept = tagged.join(others, "match_key", "left").where("heavy_accepted OR matched")
    return kept.select(*readings.columns)
