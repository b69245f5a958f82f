import math

import pytest
from pyspark.sql import functions as F

from crosscheck import queries
from tests.helpers import rows
from wattloom.operators import assemble, cluster, views
from wattloom.storage import materialise


@pytest.fixture(scope="module")
def merged(spark, sf):
    return materialise(queries._merged(spark, sf), "merged")


@pytest.fixture(scope="module")
def overall(merged):
    return materialise(assemble.overall_cluster_id(merged), "overall")


def test_paths_are_numbered_densely(merged, overall):
    paths = merged.select("cluster_id", "cluster_id_r2", "cluster_id_r3").distinct().count()
    numbers = {r[0] for r in overall.select("cluster_id_all").distinct().collect()}
    assert numbers == set(range(paths)) and overall.count() == merged.count()


def test_row_counts_tie_out(overall):
    sizes = [r[0] for r in overall.groupBy("cluster_id_all").count().select("count").collect()]
    assert assemble.unnest_profiles(overall).count() == 288 * sum(sizes)
    assert views.closest_profiles(overall).count() == 288 * sum(min(5, s) for s in sizes)
    centroids = views.cluster_centroids(overall)
    assert centroids.count() == len(sizes)
    assert views.unnest_cluster_centroids(centroids).count() == 288 * len(sizes)
    assert views.polar_layout(overall).count() == sum(sizes)


def test_relative_distance_stays_within_one_on_request(overall):
    layout = views.polar_layout(overall, max_over="l2dist_all")
    radius = F.sqrt(F.col("l2dist_rel_xcoord") ** 2 + F.col("l2dist_rel_ycoord") ** 2)
    assert layout.select(F.max(radius)).collect()[0][0] == pytest.approx(1.0)


def small_overall(spark):
    data = [(b, 0 if b < 8 else 1, 0, 1.0 if b < 8 else 0.0) for b in range(9)]
    df = spark.createDataFrame(data, "bgid long, cluster_id_all long, cluster_id int, l2dist_all double")
    half = [F.array(F.lit(1.0), F.lit(2.0)).alias(c) for c in ("usagekw_sum_5min_arr", "km_centroid_padded")]
    return df.select("*", F.col("l2dist_all").alias("l2dist"), F.array(F.lit(0), F.lit(1)).alias("win_id_arr"), *half)


def test_ties_at_the_last_rank_go_to_lower_ids(spark):
    closest = views.closest_profiles(small_overall(spark)).select("bgid").distinct()
    assert rows(closest) == [(0,), (1,), (2,), (3,), (4,), (8,)]


def test_cluster_without_extent_sits_at_the_origin(spark):
    layout = {r.bgid: r for r in views.polar_layout(small_overall(spark)).collect()}
    assert (layout[8].l2dist_rel_xcoord, layout[8].l2dist_rel_ycoord) == (0.0, 0.0)
    assert all(0 < r.theta < 2 * math.pi for r in layout.values())
    again = {r.bgid: r.theta for r in views.polar_layout(small_overall(spark).repartition(5)).collect()}
    assert again == {b: r.theta for b, r in layout.items()}


def test_arrays_are_unnested_in_lockstep(spark):
    df = spark.createDataFrame([(1, [1, 2], [3.0])], "id int, a array<int>, b array<double>")
    out = assemble.unnest_together(df, {"a": "x", "b": "y"})
    assert out.columns == ["id", "x", "y"]
    assert rows(out) == [(1, 1, 3.0), (1, 2, None)]


def test_arrays_that_are_not_there_lose_no_row(spark):
    data = [(1, [1, 2], None), (2, None, [5.0]), (3, [], [6.0]), (4, None, None), (5, [], []), (6, [None], [7.0])]
    df = spark.createDataFrame(data, "id int, a array<int>, b array<double>")
    assert rows(assemble.unnest_together(df, {"a": "x", "b": "y"})) == [
        (1, 1, None), (1, 2, None), (2, None, 5.0), (3, None, 6.0), (4, None, None), (5, None, None), (6, None, 7.0),
    ]
    with pytest.raises(ValueError):
        assemble.unnest_together(df, {"c": "x"})


def test_odd_series_are_padded_to_their_length(spark):
    import numpy as np

    df = spark.createDataFrame(
        [(1, [0, 1, 2, 3, 4], [1.0, 2.0])], "bgid long, win_id_arr array<int>, pgram_norm_arr array<double>"
    )
    centroids = np.array([[1.0, 1.0]])
    assigned = cluster.assign_clusters(df, centroids, 1)
    measured = assemble.distance_to_centroid(
        assigned, assemble.centroid_rows(cluster.centroid_table(spark, 1, centroids))
    ).collect()[0]
    assert measured.pgram_norm_arr_padded == [1.0, 2.0, 0.0, 0.0, 0.0]
    assert measured.km_centroid_padded == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert measured.l2dist == 1.0
