"""One Spark query per operator. Doubles are rounded and arrays unnested here, in the copy
that is compared, never in the operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosscheck import fixtures
from crosscheck.fixtures import embedding_points, event_readings
from wattloom.functions import vectors
from wattloom.operators import assemble, cluster, features, fit, ids, quality, relational, seeding, signal, views
from wattloom.plans.profile import meter_series, profile_load
from wattloom.schema import ProfileConfig
from wattloom.sources import catalog, gap_state
from wattloom.sources import readings as io
from wattloom.storage import fresh_path, materialise

#: Clusters and rounds of every fit; seeds, updates and stop rule are the operators' defaults.
K, ROUNDS = 10, 3
#: Only where the number of updates is the feature.
UPDATES = 3

_COARSE = ("usagekw", "usagekw_sum_5min", "usagekw_sum_5min_mean", "usagekw_sum_5min_norm_denom")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles to ``digits``; adding 0.0 turns -0.0 into 0.0."""
    return _doubles(df, lambda name: F.round(name, digits))


def fine(df: DataFrame) -> DataFrame:
    """Seven significant digits: spectra and distances of the readings go from 1e-8 to 1. What is under 1e-12
    is rounding noise. Sums and means of usage have 6 digits."""

    def settled(name: str) -> Column:
        if name in _COARSE:
            return F.round(name, 6)
        digits = F.format_string("%.6e", F.col(name)).cast("double")
        return F.when(F.abs(name) < 1e-12, F.lit(0.0)).when(F.col(name).isNotNull(), digits)

    return _doubles(df, settled)


def _doubles(df: DataFrame, settle: Callable[[str], Column]) -> DataFrame:
    columns = [(settle(name) + 0.0).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes]
    return df.select(*columns)


# --- sources and sinks


def read_readings(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "readings-csv")
    io.write_readings_csv(fixtures.readings(spark, sf), path)
    return io.read_readings(spark, path)


def _meter_folder(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "meter-files")
    per_meter = fixtures.readings(spark, sf).repartition("building_num")
    per_meter.write.partitionBy("building_num").csv(path)
    return path


_METER_IN_FOLDER = r"building_num=(\d+)/"


def ingest_meter_files(spark: SparkSession, sf: str) -> DataFrame:
    return io.ingest_meter_files(spark, _meter_folder(spark, sf), _METER_IN_FOLDER, recursive=True)


def ingest_named_files(spark: SparkSession, sf: str) -> DataFrame:
    """The id stands in the file's name, behind a prefix, as in the raw data."""
    source, target = _meter_folder(spark, sf), fresh_path(spark, "named-files")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(files.Path(target))
    for part in system.globStatus(files.Path(f"{source}/building_num=*/*.csv")):
        meter = part.getPath().getParent().getName().partition("=")[2]
        system.rename(part.getPath(), files.Path(f"{target}/Home_minute_{meter}.csv"))
    return io.ingest_meter_files(spark, target)


def rows_per_file(spark: SparkSession, sf: str) -> DataFrame:
    files = io.rows_per_file(spark, _meter_folder(spark, sf), recursive=True)
    meter = F.regexp_extract("file_path", _METER_IN_FOLDER, 1).cast("int")
    return files.groupBy(meter.alias("building_num")).agg(F.sum("n_rows").alias("n_rows"))


def readings_table(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "readings-csv")
    io.write_readings_csv(fixtures.readings(spark, sf), path)
    catalog.reset_namespace(spark, "wattloom_check")
    catalog.create_readings_table(spark, "wattloom_check.readings")
    catalog.load_readings_csv(spark, path, "wattloom_check.readings")
    loaded = spark.table("wattloom_check.readings")
    bucketed = catalog.save_table(loaded, "wattloom_check.by_meter", ["building_num"], buckets=8)
    catalog.create_view(quality.interval_check(bucketed), "wattloom_check_gaps")
    return catalog.save_table(spark.table("wattloom_check_gaps"), "wattloom_check.gaps")


def hot_meter_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The gap check over a table by meter in which one meter is cut into several tasks."""
    catalog.reset_namespace(spark, "wattloom_hot_check")
    readings = materialise(fixtures.hot_readings(spark, sf), "readings")
    table = catalog.save_distributed(readings, "wattloom_hot_check.by_meter", "building_num", buckets=8)
    return table.by_key(quality.interval_check)


def spread_table(spark: SparkSession, sf: str) -> DataFrame:
    catalog.reset_namespace(spark, "wattloom_spread")
    return catalog.save_spread(fixtures.readings(spark, sf), "wattloom_spread.readings", 20_000)


def single_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "one-file") + ".csv"
    io.write_single_csv(fixtures.readings(spark, sf), path, 40_000)
    return io.read_readings(spark, path)


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Readings as text, with faults by meter and minute: a missing field, one too many, words for numbers."""
    path = fresh_path(spark, "faulty-csv")
    minute = F.expr("CAST((tslocal - 1301702400) div 60 AS INT)")
    fields = [F.col(c).cast("string") for c in ("building_num", "tslocal")]
    whole = F.concat_ws(",", *fields, minute.cast("string"))
    faulty = (
        F.when((F.col("building_num") % 9 == 1) & (minute % 100 == 7), F.concat_ws(",", *fields))
        .when((F.col("building_num") % 9 == 4) & (minute % 50 == 3), F.concat(whole, F.lit(",9")))
        .when((F.col("building_num") % 9 == 7) & (minute % 360 == 0), F.concat_ws(",", F.lit("meter"), *fields[1:], F.lit("low")))
        .otherwise(whole)
    )
    fixtures.readings(spark, sf).select(faulty.alias("value")).write.text(path)
    found = io.bad_lines(io.stage_readings(spark, path))
    return found.groupBy("line").agg(F.sum("copies").alias("copies"))


def sample_readings(spark: SparkSession, sf: str) -> DataFrame:
    return io.sample_readings(fixtures.readings(spark, sf))


# --- quality


def interval_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.interval_check(fixtures.readings(spark, sf))


def interval_check_events(spark: SparkSession, sf: str) -> DataFrame:
    return quality.interval_check(event_readings(spark, sf))


def incremental_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a state that three loads have built: mornings, then evenings, then late readings."""
    folder = fresh_path(spark, "gap-state")
    readings = materialise(fixtures.readings(spark, sf), "readings")
    late, noon = F.pmod(F.xxhash64("building_num", "tslocal"), F.lit(10)) == 0, 1301702400 + 43_200
    for part in (~late & (F.col("tslocal") < noon), ~late & (F.col("tslocal") >= noon), late):
        gap_state.load_gaps(readings.where(part), folder)
    return gap_state.gap_summary(spark, folder).select("building_num", "ct_tslocal", "ct_deltatime_60sec", "diff_ct")


def interval_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.interval_histogram(quality.interval_check(fixtures.readings(spark, sf)))


def interval_histogram_events(spark: SparkSession, sf: str) -> DataFrame:
    return quality.interval_histogram(quality.interval_check(event_readings(spark, sf)))


def regular_readings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.regular_readings(fixtures.readings(spark, sf))


def count_regular_meters(spark: SparkSession, sf: str) -> DataFrame:
    return quality.count_regular_meters(fixtures.readings(spark, sf))


def meter_spans(spark: SparkSession, sf: str) -> DataFrame:
    return quality.meter_spans(fixtures.readings(spark, sf))


def span_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.span_histogram(quality.meter_spans(fixtures.readings(spark, sf)))


def complete_readings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.complete_readings(fixtures.readings(spark, sf))


def complete_readings_common_span(spark: SparkSession, sf: str) -> DataFrame:
    return quality.complete_readings(fixtures.readings(spark, sf), require_common_span=True)


def completeness_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.completeness_histogram(complete_readings(spark, sf))


# --- ids and signal


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ids.assign_ids(materialise(complete_readings(spark, sf), "clean"))


def drop_all_zero(spark: SparkSession, sf: str) -> DataFrame:
    return signal.drop_all_zero(assign_ids(spark, sf))


def window_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signal.window_sum(drop_all_zero(spark, sf)))


def window_sum_arrays(spark: SparkSession, sf: str) -> DataFrame:
    windows = signal.window_sum(drop_all_zero(spark, sf), with_arrays=True)
    names = ["rgid", "rid", "tslocal", "tslocal_fromzero", "usagekw"]
    return rounded(assemble.unnest_together(windows, {f"{n}_arr": n for n in names}))


def normalize_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Values of nearly constant meters are about 1e7 instead of 1e-4: fewer digits of them."""
    scaled = signal.normalize_signal(signal.window_sum(drop_all_zero(spark, sf)))
    value = F.col("usagekw_sum_5min_norm")
    settled = F.when(F.col("usagekw_sum_5min_norm_denom") > 1e-10, value).otherwise(F.round(value, 3))
    return fine(scaled.withColumn("usagekw_sum_5min_norm", settled))


def _unnest_series(series: DataFrame) -> DataFrame:
    names = ["win_id", "usagekw_sum_5min", "usagekw_sum_5min_norm"]
    return fine(assemble.unnest_together(series, {f"{n}_arr": n for n in names}))


def series_arrays(spark: SparkSession, sf: str) -> DataFrame:
    windows = signal.window_sum(drop_all_zero(spark, sf))
    return _unnest_series(signal.series_arrays(signal.normalize_signal(windows)))


def meter_series_direct(spark: SparkSession, sf: str) -> DataFrame:
    return _unnest_series(meter_series(fixtures.readings(spark, sf)))


# --- spectra


def _unnest_spectrum(spectra: DataFrame) -> DataFrame:
    names = {"pgram_pt_id_arr": "pgram_pt_id", "pgram_norm_arr": "pgram_norm"}
    return assemble.unnest_together(spectra.select("bgid", *names), names)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    series = meter_series(fixtures.readings(spark, sf))
    return materialise(features.periodogram(series), "features")


def periodogram(spark: SparkSession, sf: str) -> DataFrame:
    series = meter_series(fixtures.readings(spark, sf))
    return fine(_unnest_spectrum(features.periodogram(series)))


def _relational(spark: SparkSession, sf: str, taper: float) -> DataFrame:
    series = meter_series(fixtures.readings(spark, sf))
    names = {"win_id_arr": "pos", "usagekw_sum_5min_norm_arr": "value"}
    points = assemble.unnest_together(series.select("bgid", *names), names)
    found = relational.spectrum_points(points, taper=taper)
    return fine(found.select("bgid", F.col("pt_id").alias("pgram_pt_id"), F.col("power").alias("pgram_norm")))


def periodogram_relational(spark: SparkSession, sf: str) -> DataFrame:
    return _relational(spark, sf, 0.0)


def periodogram_relational_tapered(spark: SparkSession, sf: str) -> DataFrame:
    return _relational(spark, sf, 0.1)


def periodogram_tapered(spark: SparkSession, sf: str) -> DataFrame:
    series = meter_series(fixtures.readings(spark, sf))
    return fine(_unnest_spectrum(features.periodogram(series, taper=0.1)))


def periodogram_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf).withColumnRenamed("pgram_norm_arr", "signal")
    positions = points.withColumn("positions", F.expr("slice(win_id_arr, 1, size(signal))"))
    return rounded(_unnest_spectrum(features.periodogram(positions, "signal", "positions")))


# --- vectors and clustering


def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("pgram_norm_arr")
    other = F.reverse(v)
    computed = embedding_points(spark, sf).select(
        "bgid",
        vectors.dot(v, other).alias("dot_reversed"),
        vectors.l2(v, other).alias("l2_reversed"),
        F.col("win_id_arr").alias("positions"),
        vectors.subtract(v, other).alias("differences"),
        vectors.pad_to(v, F.size("win_id_arr")).alias("padded"),
        vectors.zeros(F.size(v)).alias("nothing"),
        vectors.filled(-9999, F.size(v)).alias("fill"),
    )
    names = {"positions": "pos", "differences": "difference", "padded": "padded_value", "nothing": "zero", "fill": "filler"}
    return rounded(assemble.unnest_together(computed, names))


def _matrix_rows(spark: SparkSession, matrix: np.ndarray, k: int) -> DataFrame:
    rows = assemble.centroid_rows(cluster.centroid_table(spark, k, matrix))
    long = rows.select("cluster_id", F.posexplode("centroid_array").alias("pos", "centroid_value"))
    return rounded(long)


def _start(points: DataFrame) -> np.ndarray:
    """The lowest ids: for the two queries that test single updates from a given start."""
    return cluster.first_points(points, K)


def _fit(points: DataFrame) -> np.ndarray:
    """As the job does it: k-means++, at most 100 updates, until under 0.001 change cluster."""
    return cluster.kmeans_lloyd(points, K)


def kmeans_seeds(spark: SparkSession, sf: str) -> DataFrame:
    seeds = cluster.kmeans_seeds(embedding_points(spark, sf), K)
    return _matrix_rows(spark, seeds, K)


def lloyd_step(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf)
    moved, _ = cluster.lloyd_step(points, _start(points))
    return _matrix_rows(spark, moved, K)


def lloyd_fixed_iters(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf)
    return _matrix_rows(spark, cluster.lloyd(points, _start(points), UPDATES, 0.0), K)


def kmeans_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_rows(spark, _fit(embedding_points(spark, sf)), K)


def kmeans_lloyd_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The same fit, with bounds in place of most distances."""
    return _matrix_rows(spark, cluster.kmeans_lloyd(embedding_points(spark, sf), K, bounds=True), K)


def kmeans_parallel_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_rows(spark, seeding.kmeans_parallel_seeds(embedding_points(spark, sf), K), K)


def kmeans_parallel_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_rows(spark, cluster.kmeans_lloyd(embedding_points(spark, sf), K, seeding="parallel"), K)


def kmeans_manhattan_medians(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf)
    return _matrix_rows(spark, cluster.kmeans_lloyd(points, K, distance="manhattan", aggregate="median"), K)


def kmeans_cosine_unit_means(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf)
    return _matrix_rows(spark, cluster.kmeans_lloyd(points, K, distance="cosine", aggregate="unit mean"), K)


#: Groups within a label, and again within a group, by a remainder modulo 4: one holds half of the points.
_GROUPS, _GROUP = 3, "CASE {0} WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END"


def _shifted(points: DataFrame) -> DataFrame:
    """Points with one right clustering on three levels: labels far apart, groups within them, and groups
    within those again. On the last two levels one group is the largest beyond doubt."""
    second, third = (F.expr(_GROUP.format(f"pmod({x}, 4)")) for x in ("bgid", "bgid div 4"))
    shift = 100_000.0 * F.col("building_num") + 1_000.0 * second + 10.0 * third
    moved = F.transform("pgram_norm_arr", lambda x: x + shift)
    return points.withColumn("pgram_norm_arr", moved)


def _labels(points: DataFrame) -> int:
    return points.select("building_num").distinct().count()


def kmeans_mllib(spark: SparkSession, sf: str) -> DataFrame:
    """Whatever the library's seeding, a cluster is a label: named by its lowest id."""
    points = embedding_points(spark, sf)
    k = _labels(points)
    moved = materialise(_shifted(points), "shifted")
    centroids = cluster.kmeans_mllib(moved, k)
    assigned = materialise(cluster.assign_clusters(moved, centroids, k), "assigned")
    rows = assemble.centroid_rows(cluster.centroid_table(spark, k, centroids))
    measured = assemble.distance_to_centroid(assigned, rows)
    named = measured.groupBy("cluster_id").agg(
        F.min("bgid").alias("lowest_bgid"),
        F.count("*").alias("size"),
        F.sum(F.col("l2dist") * F.col("l2dist")).alias("sse"),
    )
    values = rows.select("cluster_id", F.posexplode("centroid_array").alias("pos", "centroid_value"))
    return rounded(named.join(values, "cluster_id").drop("cluster_id"), 4)


def _assigned_embeddings(spark: SparkSession, sf: str, distance: str = "euclidean") -> DataFrame:
    points = embedding_points(spark, sf)
    return cluster.assign_clusters(points, _fit(points), K, distance=distance)


def assign_clusters_by_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Also fitted with that distance: seeds, assignment and stop rule."""
    return _fit_and_assign(spark, sf, "cosine")


def assign_clusters_by_manhattan(spark: SparkSession, sf: str) -> DataFrame:
    return _fit_and_assign(spark, sf, "manhattan")


def _fit_and_assign(spark: SparkSession, sf: str, distance: str) -> DataFrame:
    points = embedding_points(spark, sf)
    centroids = cluster.kmeans_lloyd(points, K, distance=distance)
    return cluster.assign_clusters(points, centroids, K, distance=distance).select("bgid", "cluster_id")


def assign_clusters(spark: SparkSession, sf: str) -> DataFrame:
    names = {
        "pgram_pt_id_arr_padded": "pgram_pt_id_padded",
        "pgram_norm_arr_padded": "pgram_norm_padded",
    }
    kept = _assigned_embeddings(spark, sf).select("k", "cluster_id", "bgid", *names)
    return rounded(assemble.unnest_together(kept, names))


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_sizes(_assigned_embeddings(spark, sf))


def largest_cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    assigned = _assigned_embeddings(spark, sf)
    largest, _ = cluster.largest_cluster(assigned)
    return cluster.cluster_members(assigned, largest, 1).select("k_r1", "cluster_id_r1", "bgid")


def _assigned_rounds(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf)
    model = cluster.hierarchical_kmeans(points, _fit, K, ROUNDS)
    return cluster.assign_rounds(points, model)


def hierarchical_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_assigned_rounds(spark, sf).drop("building_num", "pgram_norm_arr", "win_id_arr"))


def hierarchical_kmeans_mllib(spark: SparkSession, sf: str) -> DataFrame:
    """All rounds on points with one right answer; clusters are named by their lowest id."""
    points = embedding_points(spark, sf)
    k = _labels(points)
    moved = materialise(_shifted(points), "shifted")
    model = cluster.hierarchical_kmeans(
        moved, lambda m: cluster.kmeans_mllib(m, k if m is moved else _GROUPS), k, ROUNDS
    )
    assigned = materialise(cluster.assign_rounds(moved, model), "assigned")
    suffixes = cluster.round_suffixes(ROUNDS)
    for suffix in suffixes:
        lowest = assigned.where(f"cluster_id{suffix} IS NOT NULL").groupBy(f"cluster_id{suffix}")
        named = lowest.agg(F.min("bgid").alias(f"lowest_bgid{suffix}"))
        assigned = assigned.join(named, f"cluster_id{suffix}", "left")
    names = [f"{c}{suffix}" for suffix in suffixes for c in ("lowest_bgid", "l2dist")]
    return rounded(assigned.select("bgid", *names), 4)


def cluster_sse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fit.cluster_sse(_assigned_rounds(spark, sf), ROUNDS))


def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fit.silhouette(materialise(_assigned_rounds(spark, sf), "assigned"), ROUNDS))


# --- centroids, distances, rounds


def _fitted_table(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.centroid_table(spark, K, _fit(embedding_points(spark, sf)))


def unnest_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assemble.unnest_centroids(_fitted_table(spark, sf)))


def centroid_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = assemble.centroid_rows(_fitted_table(spark, sf))
    return rounded(
        rows.select("k", "cluster_id", F.posexplode("centroid_array").alias("pos", "centroid_value"))
    )


def distance_to_centroid(spark: SparkSession, sf: str) -> DataFrame:
    rows = assemble.centroid_rows(_fitted_table(spark, sf))
    measured = assemble.distance_to_centroid(_assigned_embeddings(spark, sf), rows)
    kept = measured.select("k", "cluster_id", "bgid", "l2dist", "win_id_arr", "km_centroid_padded")
    names = {"win_id_arr": "pos", "km_centroid_padded": "centroid_value"}
    return rounded(assemble.unnest_together(kept, names))


def _round_columns(merged: DataFrame) -> DataFrame:
    arrays = {
        "win_id_arr": "win_id",
        "usagekw_sum_5min_arr": "usagekw_sum_5min",
        "usagekw_sum_5min_norm_arr": "usagekw_sum_5min_norm",
        "pgram_norm_arr_padded": "pgram_norm_padded",
    }
    wanted = ["bgid", "building_num"]
    for suffix in cluster.round_suffixes(ROUNDS):
        wanted += [f"k{suffix}", f"cluster_id{suffix}", f"l2dist{suffix}"]
        arrays[f"km_centroid_padded{suffix}"] = f"centroid_value{suffix}"
    return fine(assemble.unnest_together(merged.select(*wanted, *arrays), arrays))


def merge_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Round by round: fit, assign, measure; then joined by meter."""
    members = _features(spark, sf)
    measured = []
    for number in range(1, ROUNDS + 1):
        centroids = _fit(members)
        assigned = cluster.assign_clusters(members, centroids, K)
        rows = assemble.centroid_rows(cluster.centroid_table(spark, K, centroids))
        measured.append(assemble.distance_to_centroid(assigned, rows))
        if number < ROUNDS:
            largest, _ = cluster.largest_cluster(assigned)
            kept = cluster.cluster_members(assigned, largest, number)
            members = materialise(kept.select(*members.columns), "members")
    return _round_columns(assemble.merge_rounds(measured))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    points = _features(spark, sf)
    model = cluster.hierarchical_kmeans(points, _fit, K, ROUNDS)
    return assemble.attach_rounds(cluster.assign_rounds(points, model), model)


def assign_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return _round_columns(_merged(spark, sf))


def _overall(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(assemble.overall_cluster_id(_merged(spark, sf)), "overall")


def overall_cluster_id(spark: SparkSession, sf: str) -> DataFrame:
    later = [f"km_centroid_padded_r{n}_nonull" for n in range(2, ROUNDS + 1)]
    arrays = {
        "win_id_arr": "win_id",
        "usagekw_sum_5min_arr": "usagekw_sum_5min",
        "usagekw_sum_5min_norm_arr": "usagekw_sum_5min_norm",
        "pgram_pt_id_arr_padded": "pgram_pt_id_padded",
        "pgram_norm_arr_padded": "pgram_norm_padded",
        "km_centroid_padded": "km_centroid_padded_unnest",
        **{c: c.replace("padded", "padded_unnest") for c in later},
    }
    return fine(assemble.unnest_together(_overall(spark, sf), arrays))


def unnest_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return fine(assemble.unnest_profiles(_overall(spark, sf)))


# --- views


def polar_layout(spark: SparkSession, sf: str) -> DataFrame:
    return fine(views.polar_layout(_overall(spark, sf)))


def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    centroids = views.cluster_centroids(_overall(spark, sf))
    arrays = [name for name, kind in centroids.dtypes if kind.startswith("array")]
    return fine(assemble.unnest_together(centroids, {a: a.replace("_arr", "") for a in arrays}))


def unnest_cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return fine(views.unnest_cluster_centroids(views.cluster_centroids(_overall(spark, sf))))


def closest_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return fine(views.closest_profiles(_overall(spark, sf)))


def profile_load_layout(spark: SparkSession, sf: str) -> DataFrame:
    config = ProfileConfig(k=K, rounds=ROUNDS)
    tables = profile_load(fixtures.readings(spark, sf), config, "lloyd")
    return fine(tables["layout"])


def profile_load_mllib(spark: SparkSession, sf: str) -> DataFrame:
    tables = profile_load(fixtures.readings(spark, sf), ProfileConfig())
    return fine(tables["closest_profiles"])


QUERIES = {
    "read_readings": read_readings,
    "ingest_meter_files": ingest_meter_files,
    "ingest_named_files": ingest_named_files,
    "rows_per_file": rows_per_file,
    "readings_table": readings_table,
    "rejected_lines": rejected_lines,
    "hot_meter_gaps": hot_meter_gaps,
    "spread_table": spread_table,
    "single_csv": single_csv,
    "incremental_gaps": incremental_gaps,
    "sample_readings": sample_readings,
    "interval_check": interval_check,
    "interval_check_events": interval_check_events,
    "interval_histogram": interval_histogram,
    "interval_histogram_events": interval_histogram_events,
    "regular_readings": regular_readings,
    "count_regular_meters": count_regular_meters,
    "meter_spans": meter_spans,
    "span_histogram": span_histogram,
    "complete_readings": complete_readings,
    "complete_readings_common_span": complete_readings_common_span,
    "completeness_histogram": completeness_histogram,
    "assign_ids": assign_ids,
    "drop_all_zero": drop_all_zero,
    "window_sum": window_sum,
    "window_sum_arrays": window_sum_arrays,
    "normalize_signal": normalize_signal,
    "series_arrays": series_arrays,
    "meter_series": meter_series_direct,
    "periodogram": periodogram,
    "periodogram_tapered": periodogram_tapered,
    "periodogram_relational": periodogram_relational,
    "periodogram_relational_tapered": periodogram_relational_tapered,
    "periodogram_embeddings": periodogram_embeddings,
    "vector_functions": vector_functions,
    "kmeans_seeds": kmeans_seeds,
    "lloyd_step": lloyd_step,
    "lloyd_fixed_iters": lloyd_fixed_iters,
    "kmeans_lloyd": kmeans_lloyd,
    "kmeans_lloyd_bounded": kmeans_lloyd_bounded,
    "kmeans_parallel_seeds": kmeans_parallel_seeds,
    "kmeans_parallel_lloyd": kmeans_parallel_lloyd,
    "kmeans_manhattan_medians": kmeans_manhattan_medians,
    "kmeans_cosine_unit_means": kmeans_cosine_unit_means,
    "kmeans_mllib": kmeans_mllib,
    "assign_clusters": assign_clusters,
    "assign_clusters_by_cosine": assign_clusters_by_cosine,
    "assign_clusters_by_manhattan": assign_clusters_by_manhattan,
    "cluster_sizes": cluster_sizes,
    "largest_cluster_members": largest_cluster_members,
    "hierarchical_lloyd": hierarchical_lloyd,
    "hierarchical_kmeans_mllib": hierarchical_kmeans_mllib,
    "cluster_sse": cluster_sse,
    "silhouette": silhouette,
    "unnest_centroids": unnest_centroids,
    "centroid_rows": centroid_rows,
    "distance_to_centroid": distance_to_centroid,
    "merge_rounds": merge_rounds,
    "assign_rounds": assign_rounds,
    "overall_cluster_id": overall_cluster_id,
    "unnest_profiles": unnest_profiles,
    "polar_layout": polar_layout,
    "cluster_centroids": cluster_centroids,
    "unnest_cluster_centroids": unnest_cluster_centroids,
    "closest_profiles": closest_profiles,
    "profile_load_layout": profile_load_layout,
    "profile_load_mllib": profile_load_mllib,
}
