"""The assembled job: from readings to the tables of the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.assemble import (
    attach_rounds,
    number_paths,
    overall_cluster_id,
    placed_columns,
    unnest_profiles,
)
from wattloom.operators.cluster import (
    Fit,
    Round,
    assign_rounds,
    hierarchical_kmeans,
    kmeans_lloyd,
    kmeans_mllib,
)
from wattloom.operators.features import periodogram
from wattloom.operators.ids import number_meters
from wattloom.operators.quality import complete_meters, without_heavy_rejects
from wattloom.operators.signal import usable_divisor
from wattloom.operators.views import (
    closest_profiles,
    cluster_centroids,
    polar_layout,
    unnest_cluster_centroids,
)
from wattloom.schema import ProfileConfig
from wattloom.storage import materialise, run_of


def meter_series(readings: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Normalised signal of every usable meter, straight from the raw readings.

    Gives the same table as quality filter, ids, zero filter, window sums, normalisation
    and arrays one after the other. All decisions about a meter (regular, complete, alive,
    number, start) are taken on one row per meter first, and these small tables are
    written: their real size decides how they are joined. So the readings are scanned twice and
    shuffled at most once by meter; everything behind stays in that partitioning.
    """
    summary = materialise(
        complete_meters(
            readings,
            config.interval_seconds,
            config.expected_readings,
            config.require_common_span,
            usage_range=True,
        ),
        "meters",
    )
    # Numbers are given before dead meters go, so they have holes afterwards.
    alive = number_meters(summary.where("usable")).where("min_usage <> 0 OR max_usage <> 0")
    meters = materialise(alive.select("building_num", "bgid", "ts_start"), "live-meters")
    windows = (
        without_heavy_rejects(readings, summary)
        .join(meters, "building_num")
        .withColumn(
            "win_id", F.expr(f"cast((tslocal - ts_start) div {config.window_seconds} AS int)")
        )
        .groupBy("building_num", "bgid", "win_id")
        .agg(F.sum("usagekw").alias("usage"))
    )
    signal = windows.groupBy("building_num", "bgid").agg(
        F.avg("usage").alias("mean"),
        F.sort_array(F.collect_list(F.struct("win_id", "usage"))).alias("points"),
    )
    squares = F.transform("points.usage", lambda v: (v - F.col("mean")) * (v - F.col("mean")))
    denominator = F.aggregate(squares, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    scaled = signal.withColumn("denominator", denominator).where(
        usable_divisor("denominator", config.min_denominator)
    )
    return scaled.select(
        "bgid",
        "building_num",
        F.col("mean").alias("usagekw_sum_5min_mean"),
        F.col("denominator").alias("usagekw_sum_5min_norm_denom"),
        F.col("points.win_id").alias("win_id_arr"),
        F.col("points.usage").alias("usagekw_sum_5min_arr"),
        F.transform(
            "points.usage", lambda v: (v - F.col("mean")) / F.col("denominator")
        ).alias("usagekw_sum_5min_norm_arr"),
    )


def fit_rounds(
    features: DataFrame, config: ProfileConfig = ProfileConfig(), method: str | Fit = "mllib"
) -> list[Round]:
    """Cluster the features over several rounds.

    ``mllib`` scales best and stops on centroid movement; ``lloyd`` stops on the fraction
    of reassigned points. A function from points to centroids may be given instead.
    """
    if callable(method):
        fit = method
    elif method == "mllib":
        def fit(points):
            return kmeans_mllib(points, config.k, seed=config.seed, max_iter=config.max_iter)
    elif method == "lloyd":
        def fit(points):
            return kmeans_lloyd(
                points,
                config.k,
                seed=config.seed,
                max_iter=config.max_iter,
                min_frac_reassigned=config.min_frac_reassigned,
            )
    else:
        raise ValueError("method must be 'mllib', 'lloyd' or a function")
    return hierarchical_kmeans(features, fit, config.k, config.rounds)


def profile_load(
    readings: DataFrame, config: ProfileConfig = ProfileConfig(), method: str | Fit = "mllib"
) -> dict[str, DataFrame]:
    """Run the whole job and return its tables by name.

    Three tables are written on the way, because clustering and the results read them
    again: the features, the same with cluster and distance per round, and where every meter
    stands (ids and distances, no arrays). Paths are numbered once. Centroids are k broadcast rows
    per round and meet the meters only where a result shows arrays. ``write_tables`` keeps the results.
    """
    series = meter_series(readings, config)
    features = materialise(periodogram(series, taper=config.taper), "features")
    model = fit_rounds(features, config, method)
    assigned = materialise(assign_rounds(features, model), "assigned")
    overall = overall_cluster_id(attach_rounds(assigned, model), number_paths(assigned))
    placed = materialise(overall.select(*placed_columns(overall)), "placed")
    centroids = cluster_centroids(overall, placed)
    return {
        "features": features,
        "overall": overall,
        "profiles": unnest_profiles(overall),
        "layout": polar_layout(placed, config.seed),
        "centroids": centroids,
        "centroid_points": unnest_cluster_centroids(centroids),
        "closest_profiles": closest_profiles(overall, config.closest, placed),
    }


def write_tables(
    tables: dict[str, DataFrame], folder: str, names: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Write the results of ``profile_load`` as Parquet under ``folder`` and read them back.

    The new tables depend on nothing else.
    """
    written = {}
    for name in names or tables:
        path = f"{folder}/{name}"
        tables[name].write.mode("overwrite").parquet(path)
        written[name] = tables[name].sparkSession.read.schema(tables[name].schema).parquet(path)
    return written


def profile_to_folder(
    readings: DataFrame,
    folder: str,
    config: ProfileConfig = ProfileConfig(),
    method: str | Fit = "mllib",
    names: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """``profile_load`` with its results written under ``folder``; the tables on the way are deleted."""
    with run_of(readings.sparkSession):
        return write_tables(profile_load(readings, config, method), folder, names)
