"""Times the stages of a run. Prints one line of JSON.

The readings are derived once and written before the clock starts. Every stage is timed
on its own from written inputs, the better of two runs, so that compiling generated code
does not count; ``profile_load`` is the whole job from raw readings.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from crosscheck import fixtures  # noqa: E402
from wattloom.operators import assemble, cluster, features, fit, ids, quality, signal, views  # noqa: E402
from wattloom.plans.profile import fit_rounds, meter_series, profile_load  # noqa: E402
from wattloom.schema import ProfileConfig  # noqa: E402
from wattloom.sources import readings as io  # noqa: E402
from wattloom.storage import fresh_path, materialise  # noqa: E402


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wattloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], None]) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    config = ProfileConfig()
    readings = materialise(fixtures.readings(spark, sf_dir), "readings")
    n_readings = readings.count()
    csv = fresh_path(spark, "csv")
    io.write_readings_csv(readings, csv)
    clean = materialise(quality.complete_readings(readings), "clean")
    numbered = materialise(ids.assign_ids(clean), "numbered")
    nozero = materialise(signal.drop_all_zero(numbered), "nozero")
    windows = materialise(signal.window_sum(nozero), "windows")
    normalized = materialise(signal.normalize_signal(windows), "normalized")
    series = materialise(signal.series_arrays(normalized), "series")
    points = materialise(features.periodogram(series), "features")
    model = fit_rounds(points, config)
    rounds = materialise(cluster.assign_rounds(points, model), "rounds")
    overall = assemble.overall_cluster_id(assemble.attach_rounds(rounds, model), assemble.number_paths(rounds))
    placed = materialise(overall.select(*assemble.placed_columns(overall)), "placed")
    assigned = materialise(cluster.assign_clusters(points, model[0].centroids, config.k), "assigned")
    centroids = assemble.centroid_rows(cluster.centroid_table(spark, config.k, model[0].centroids))
    measured = materialise(assemble.distance_to_centroid(assigned, centroids), "measured")
    summary = materialise(quality.meter_summary(readings), "summary")
    spans = materialise(quality.meter_spans(readings, summary=summary), "spans")

    def whole(method: str) -> None:
        for name, table in profile_load(readings, config, method).items():
            if name != "features":
                drain(table)

    stages = {
        "read_readings": lambda: drain(io.read_readings(spark, csv)),
        "sample_readings": lambda: drain(io.sample_readings(readings)),
        "interval_histogram": lambda: drain(
            quality.interval_histogram(quality.interval_check(readings))
        ),
        "count_regular_meters": lambda: drain(quality.count_regular_meters(readings)),
        "meter_spans": lambda: drain(quality.meter_spans(readings)),
        "complete_readings": lambda: drain(quality.complete_readings(readings)),
        "count_regular_meters_of_summary": lambda: drain(
            quality.count_regular_meters(readings, summary=summary)
        ),
        "span_histogram": lambda: drain(quality.span_histogram(spans)),
        "regular_readings": lambda: drain(quality.regular_readings(readings)),
        "completeness_histogram": lambda: drain(quality.completeness_histogram(clean)),
        "assign_ids": lambda: drain(ids.assign_ids(clean)),
        "drop_all_zero": lambda: drain(signal.drop_all_zero(numbered)),
        "window_sum": lambda: drain(signal.window_sum(nozero)),
        "window_sum_arrays": lambda: drain(signal.window_sum(nozero, with_arrays=True)),
        "normalize_signal": lambda: drain(signal.normalize_signal(windows)),
        "series_arrays": lambda: drain(signal.series_arrays(normalized)),
        "periodogram": lambda: drain(features.periodogram(series)),
        "meter_series": lambda: drain(meter_series(readings)),
        "hierarchical_kmeans_mllib": lambda: fit_rounds(points, config),
        "hierarchical_kmeans_lloyd": lambda: fit_rounds(points, config, "lloyd"),
        "hierarchical_kmeans_parallel_seeds": lambda: fit_rounds(
            points, config, lambda p: cluster.kmeans_lloyd(p, config.k, seeding="parallel")
        ),
        "assign_rounds": lambda: drain(cluster.assign_rounds(points, model)),
        "assign_clusters": lambda: drain(
            cluster.assign_clusters(points, model[0].centroids, config.k)
        ),
        "distance_to_centroid": lambda: drain(assemble.distance_to_centroid(assigned, centroids)),
        "merge_rounds": lambda: drain(assemble.merge_rounds([measured, measured, measured])),
        "cluster_sse": lambda: drain(fit.cluster_sse(rounds, config.rounds)),
        "silhouette": lambda: drain(fit.silhouette(rounds, config.rounds)),
        "overall_cluster_id": lambda: drain(overall),
        "unnest_profiles": lambda: drain(assemble.unnest_profiles(overall)),
        "polar_layout": lambda: drain(views.polar_layout(placed)),
        "unnest_cluster_centroids": lambda: drain(
            views.unnest_cluster_centroids(views.cluster_centroids(overall, placed))
        ),
        "closest_profiles": lambda: drain(views.closest_profiles(overall, placed=placed)),
        "profile_load": lambda: whole("mllib"),
    }
    seconds: dict[str, float] = {}
    for name, run in stages.items():
        seconds[name] = round(min(timed(run) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "load profiling, raw readings to dashboard tables",
                "value": seconds["profile_load"],
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "readings": n_readings,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
