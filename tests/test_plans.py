"""What the physical plans must and must not contain."""

import re

import pytest

from crosscheck import fixtures, queries
from tests.conftest import SF
from wattloom.operators import assemble, cluster, ids, quality, signal, views
from wattloom.plans.profile import meter_series
from wattloom.sources import catalog
from wattloom.storage import materialise


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df, name):
    return [line for line in plan(df).splitlines() if re.search(rf"\b{name}\b", line)]


@pytest.fixture(scope="module")
def readings(spark, sf):
    return materialise(fixtures.readings(spark, sf), "readings")


@pytest.fixture(scope="module")
def overall(spark, sf):
    return queries._overall(spark, sf)


def test_gap_check_reads_two_columns_and_never_orders_a_meter(readings):
    df = quality.interval_check(readings)
    scan = plan(df)
    assert "ReadSchema: struct<building_num:int,tslocal:bigint>" in scan
    assert not operators(df, "Window") and not operators(df, "Join")
    shuffles = operators(df, "Exchange")
    assert len(shuffles) == 4  # masks, slots, edges of slots, meters
    assert "slot" in shuffles[1] and "slot" in shuffles[2] and "block" in shuffles[3]
    assert "HashAggregate" in scan and "collect_set" not in scan


def test_heaviest_meters_are_found_by_a_bounded_top_list(readings):
    df = quality.complete_readings(readings)
    assert "TakeOrderedAndProject(limit=2000" in plan(df)
    assert "LeftAnti" in plan(df) and "LeftSemi" in plan(df)
    assert "PushedFilters: [IsNotNull(building_num)" in plan(df)


def test_ids_use_no_global_window_over_readings(readings):
    df = ids.assign_ids(materialise(quality.complete_readings(readings), "clean"))
    single = operators(df, "SinglePartition")
    assert len(single) == 1  # totals per upper half of the id, at most 65,536 rows
    windows = [line for line in operators(df, "Window") if "row_number" in line]
    assert all("building_num" in line or "upper" in line for line in windows)


def test_signal_steps_shuffle_once_per_key(readings):
    numbered = materialise(ids.assign_ids(quality.complete_readings(readings)), "numbered")
    assert len(operators(signal.drop_all_zero(numbered), "Exchange")) == 1
    windows = materialise(signal.window_sum(signal.drop_all_zero(numbered)), "windows")
    normalized = signal.normalize_signal(windows)
    assert len(operators(normalized, "Exchange")) == 1
    assert len(operators(signal.series_arrays(normalized), "Exchange")) == 1


def test_shuffled_readings_keep_their_partitioning(readings, no_broadcast):
    """Without broadcast the join by meter is the only shuffle behind the scan of the readings."""
    df = meter_series(readings)
    shuffles = operators(df, "Exchange")
    by_meter = [s for s in shuffles if "hashpartitioning(building_num" in s]
    assert len(by_meter) == 2  # readings and live meters; none for windows or arrays
    assert not operators(df, "CartesianProduct") and not operators(df, "BroadcastNestedLoopJoin")


def test_bucketed_readings_are_not_shuffled(spark, readings, no_broadcast):
    catalog.reset_namespace(spark, "wattloom_plans")
    bucketed = catalog.save_table(readings, "wattloom_plans.readings", ["building_num"], buckets=8)
    assert not operators(quality.interval_check(bucketed), "Exchange")
    shuffles = operators(meter_series(bucketed), "Exchange")
    by_meter = [s for s in shuffles if "hashpartitioning(building_num" in s]
    assert len(by_meter) == 1  # the live meters
    catalog.reset_namespace(spark, "wattloom_plans")


def test_common_span_reads_a_written_summary(spark, readings):
    summary = materialise(quality.meter_summary(readings), "summary")
    df = quality.complete_meters(readings, require_common_span=True, summary=summary)
    assert not [s for s in operators(df, "FileScan") if re.search(r"\btslocal:", s)]
    assert len(operators(quality.complete_meters(readings, require_common_span=True), "FileScan")) == 2


def test_closest_profiles_limits_before_the_shuffle(overall):
    df = views.closest_profiles(overall)
    assert len(operators(df, "WindowGroupLimit")) == 2
    text = plan(df)
    assert text.index("Generate inline") < text.index("LeftSemi")  # restricted first, then unnested


def test_layout_aggregates_instead_of_ordering_clusters(overall):
    df = views.polar_layout(overall)
    assert not operators(df, "Window")
    assert "ReadSchema: struct<cluster_id_all:bigint,l2dist:double>" in plan(df)


def test_overall_numbers_only_distinct_paths(spark, sf):
    df = assemble.overall_cluster_id(materialise(queries._merged(spark, sf), "merged"))
    assert len(operators(df, "SinglePartition")) == 1
    assert not operators(df, "SortMergeJoin")


def test_points_meet_the_model_once_per_pass(spark, sf):
    points = materialise(queries._features(spark, sf), "features")
    model = cluster.hierarchical_kmeans(points, queries._fit, 10, 2)
    merged = assemble.attach_rounds(cluster.assign_rounds(points, model), model)
    assert len(operators(merged, "ArrowEvalPython")) == 1
    # As in the job: ids and distances are written, so the search is not run again.
    written = materialise(cluster.assign_rounds(points, model), "assigned")
    overall = assemble.overall_cluster_id(assemble.attach_rounds(written, model))
    assert not operators(overall, "ArrowEvalPython")
    assert not operators(overall, "SortMergeJoin")
    assigned = cluster.assign_clusters(points, model[0].centroids, 10)
    rows = assemble.centroid_rows(cluster.centroid_table(spark, 10, model[0].centroids))
    assert len(operators(assemble.distance_to_centroid(assigned, rows), "ArrowEvalPython")) == 1
    assert len(operators(cluster.cluster_members(assigned, 0, 1), "ArrowEvalPython")) == 1


@pytest.mark.parametrize("name", ["unnest_profiles", "unnest_cluster_centroids"])
def test_unnesting_is_one_generator(spark, overall, name):
    df = (
        assemble.unnest_profiles(overall)
        if name == "unnest_profiles"
        else views.unnest_cluster_centroids(views.cluster_centroids(overall))
    )
    assert len(operators(df, "Generate")) == 1


def test_no_arrays_among_keys_or_in_the_join_of_rounds(spark, overall):
    centroids = views.cluster_centroids(overall)
    keys = [s for s in operators(centroids, "HashAggregate") if "km_centroid" in s or "_arr" in s]
    assert not keys
    members = materialise(queries._features(spark, SF), "features")
    model = cluster.hierarchical_kmeans(members, queries._fit, 10, 1)
    assigned = cluster.assign_clusters(members, model[0].centroids, 10)
    rows = assemble.centroid_rows(cluster.centroid_table(spark, 10, model[0].centroids))
    measured = materialise(assemble.distance_to_centroid(assigned, rows), "measured")
    merged = assemble.merge_rounds([measured, measured])
    lines = plan(merged).splitlines()
    at = next(n for n, line in enumerate(lines) if "FullOuter" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = lines[at + 1 :]
    inside = [line for n, line in enumerate(below) if all(len(x) - len(x.lstrip(" :+-")) > depth for x in below[: n + 1])]
    # Both sides of the join: the first one carries its own centroids, the later one none.
    later = [line for line in [lines[at], *inside] if "_r2" in line]
    assert later and not [line for line in later if "km_centroid_padded_r2" in line]


@pytest.fixture(scope="module")
def tables(spark, readings):
    from wattloom.plans.profile import profile_load
    from wattloom.schema import ProfileConfig

    return profile_load(readings, ProfileConfig(), "lloyd")


@pytest.fixture
def long_lines(spark):
    """Plans with their schemas in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_results_of_the_job_look_for_no_paths_and_read_arrays_only_to_show_them(tables, long_lines):
    """On the frames the job returns: paths were numbered before, and meters were placed once."""
    for name in ("overall", "profiles", "centroids", "centroid_points", "closest_profiles"):
        text = plan(tables[name])
        assert "distinct" not in text and "row_number() OVER (ORDER" not in text
        assert len([s for s in operators(tables[name], "FileScan") if "_arr:array" in s]) == 1
    assert {"cluster_id_r2_nonull", "cluster_id_r3_nonull"} <= set(tables["layout"].columns)
    layout = plan(tables["layout"])
    assert "array<" not in layout and len(operators(tables["layout"], "FileScan")) == 2
    ranked = [s for s in operators(tables["closest_profiles"], "FileScan") if "l2dist_all" in s]
    assert len(ranked) == 1 and "array<" not in ranked[0]


def test_silhouette_is_two_passes(spark, sf, monkeypatch):
    from wattloom.operators import fit

    passes = []
    points = materialise(queries._features(spark, sf), "features")
    model = cluster.hierarchical_kmeans(points, queries._fit, 4, 3)
    assigned = materialise(cluster.assign_rounds(points, model), "assigned")
    for step in ("_cluster_sums", "_silhouette_sums"):
        run = getattr(fit, step)
        monkeypatch.setattr(fit, step, lambda *a, run=run, step=step: passes.append(step) or run(*a))
    assert fit.silhouette(assigned, 3).count() == 3 and passes == ["_cluster_sums", "_silhouette_sums"]
