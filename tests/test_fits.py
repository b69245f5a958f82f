"""Seeding in few passes, bounds in place of distances, and centroids other than means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosscheck.fixtures import embedding_points
from tests.test_cluster import blobs, frame  # noqa: F401
from wattloom.functions.vectors import distances_to
from wattloom.operators import bounded, cluster, seeding


def distances(points, centroids, distance):
    every = np.stack([distances_to(points, c, distance) for c in centroids], axis=1)
    return np.sqrt(every) if distance == "euclidean" else every


# --- seeds


def test_parallel_seeds_do_not_depend_on_partitioning(spark, blobs):
    one = seeding.kmeans_parallel_seeds(frame(spark, blobs, 1), 6)
    many = seeding.kmeans_parallel_seeds(frame(spark, blobs, 9), 6)
    assert (one == many).all() and len(np.unique(one, axis=0)) == 6
    assert all((blobs == seed).all(axis=1).any() for seed in one)
    other = seeding.kmeans_parallel_seeds(frame(spark, blobs, 9), 6, seed=7)
    assert not np.array_equal(one, other)


@pytest.mark.parametrize("k", [2, 40])
def test_parallel_seeds_take_as_many_passes_whatever_k(spark, blobs, monkeypatch, k):
    passes = []
    measured = seeding._measured
    monkeypatch.setattr(seeding, "_measured", lambda s, fresh, *a: passes.append(len(fresh)) or measured(s, fresh, *a))
    found = seeding.kmeans_parallel_seeds(frame(spark, blobs), k)
    assert len(found) == k
    assert len(passes) <= 4  # and one for the first seed
    assert sum(passes) <= 1 + 3 * 2 * k + 6 * np.sqrt(6 * k)


def test_parallel_seeds_spread_over_the_groups(spark, blobs):
    groups = np.repeat(np.arange(4), [150, 30, 20, 10])
    found = seeding.kmeans_parallel_seeds(frame(spark, blobs), 4)
    assert {int(groups[(blobs == seed).all(axis=1)][0]) for seed in found} == {0, 1, 2, 3}


@pytest.mark.parametrize("distance", ["euclidean", "cosine", "manhattan"])
def test_parallel_seeds_of_few_points(spark, distance):
    points = np.repeat([[1.0, 2.0], [4.0, 1.0]], 5, axis=0)
    found = seeding.kmeans_parallel_seeds(frame(spark, points), 3, distance=distance)
    assert sorted(found.tolist()) == [[1.0, 2.0], [4.0, 1.0]]
    one = seeding.kmeans_parallel_seeds(frame(spark, points[:5]), 3, distance=distance)
    assert one.tolist() == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        seeding.kmeans_parallel_seeds(frame(spark, np.zeros((0, 2))), 2)


def test_weights_count(blobs):
    """A heavy candidate among equally far ones is chosen first nearly always."""
    candidates, ids = np.eye(5), list(range(5))
    chosen = [seeding.weighted_seeds(ids, candidates, np.array([1, 1, 1, 1, 1e6]), 2, s, "euclidean") for s in range(50)]
    assert all(c[0] == 4 for c in chosen) and {c[1] for c in chosen} == {0, 1, 2, 3}
    assert seeding.weighted_seeds(ids, candidates, np.array([1, 0, 0, 0, 1.0]), 5, 1, "euclidean") in ([0, 4], [4, 0])


def test_fit_from_parallel_seeds(spark, blobs):
    fitted = cluster.kmeans_lloyd(frame(spark, blobs), 4, seeding="parallel", min_frac_reassigned=1e-9)
    again, _ = cluster.lloyd_step(frame(spark, blobs), fitted)
    assert again == pytest.approx(fitted)
    with pytest.raises(ValueError):
        cluster.kmeans_lloyd(frame(spark, blobs), 4, seeding="random")


# --- bounds


def test_bounds_give_the_same_centroids(spark, blobs):
    start = blobs[::20]
    df = frame(spark, blobs)
    fit = bounded.lloyd_bounded(df, start, 100, 1e-9)
    assert fit.centroids == pytest.approx(cluster.lloyd(df, start, 100, 1e-9), abs=1e-9)
    assert fit.measured[0] == fit.of[0] == len(blobs) * len(start)
    assert sum(fit.measured) < sum(fit.of)


def test_bounds_halve_the_distances_on_embeddings(spark):
    points = embedding_points(spark, "/root/testdata/sf0.1")
    start = cluster.first_points(points, 100)
    fit = bounded.lloyd_bounded(points, start, 30, 0.001)
    assert fit.centroids == pytest.approx(cluster.lloyd(points, start, 30, 0.001), abs=1e-9)
    assert sum(fit.measured) < 0.5 * sum(fit.of)


def test_bounds_with_equal_centroids_and_empty_clusters(spark, blobs):
    start = np.vstack([blobs[:3], blobs[:1], np.full((1, 6), 1e6)])
    df = frame(spark, blobs)
    assert bounded.lloyd_bounded(df, start, 4, 0.0).centroids == pytest.approx(cluster.lloyd(df, start, 4, 0.0), abs=1e-9)
    one = bounded.lloyd_bounded(df, blobs[:1], 4, 0.0).centroids
    assert one == pytest.approx(blobs.mean(axis=0, keepdims=True))
    with pytest.raises(ValueError):
        bounded.lloyd_bounded(frame(spark, np.zeros((0, 2))), np.zeros((1, 2)))
    with pytest.raises(ValueError):
        cluster.kmeans_lloyd(df, 3, distance="cosine", bounds=True)


def test_bounds_leave_no_tables_behind(spark, blobs, monkeypatch):
    paths = []
    fresh = bounded.fresh_path
    monkeypatch.setattr(bounded, "fresh_path", lambda *a: paths.append(fresh(*a)) or paths[-1])
    bounded.lloyd_bounded(frame(spark, blobs), blobs[:4], 5, 0.0)
    assert len(paths) == 5
    for path in paths:
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(path).count()


# --- aggregates


PAIRS = [("euclidean", "mean"), ("cosine", "unit mean"), ("manhattan", "median")]


def objective(points, centroids, distance):
    least = distances(points, centroids, distance).min(axis=1)
    return (least**2).sum() if distance == "euclidean" else least.sum()


@pytest.mark.parametrize("distance, aggregate", PAIRS)
def test_the_objective_never_rises(spark, blobs, distance, aggregate):
    df, centroids, last = frame(spark, blobs), blobs[:4], np.inf
    for _ in range(6):
        cost = objective(blobs, centroids, distance)
        assert cost <= last * (1 + 1e-12)
        last = cost
        centroids, _ = cluster.lloyd_step(df, centroids, distance=distance, aggregate=aggregate)


def test_medians_by_definition(spark, blobs):
    start = np.vstack([blobs[:3], np.full((1, 6), 1e6)])
    df = frame(spark, blobs)
    moved, fraction = cluster.lloyd_step(df, start, distance="manhattan", aggregate="median")
    ids = distances(blobs, start, "manhattan").argmin(axis=1)
    for c in range(3):
        mine = np.sort(blobs[ids == c], axis=0)
        assert moved[c] == pytest.approx(mine[(len(mine) + 1) // 2 - 1])
    assert moved[3] == pytest.approx(start[3]) and fraction == 1.0
    _, again = cluster.lloyd_step(df, moved, start, distance="manhattan", aggregate="median")
    assert again == pytest.approx((distances(blobs, moved, "manhattan").argmin(axis=1) != ids).mean())


def test_unit_means_by_definition(spark, blobs):
    points = np.vstack([blobs, np.zeros((1, 6))])
    start = blobs[[0, 160, 185]]
    moved, _ = cluster.lloyd_step(frame(spark, points), start, distance="cosine", aggregate="unit mean")
    ids = distances(points, start, "cosine").argmin(axis=1)
    for c in range(3):
        mine = points[ids == c]
        length = np.sqrt((mine**2).sum(axis=1, keepdims=True))
        total = (mine / np.where(length > 0, length, 1)).sum(axis=0)
        assert moved[c] == pytest.approx(total / np.sqrt(total @ total))


def test_directions_that_cancel_out_leave_the_centroid(spark):
    moved, _ = cluster.lloyd_step(
        frame(spark, [[1.0, 0.0], [-1.0, 0.0]]), np.array([[0.0, 2.0]]), distance="cosine", aggregate="unit mean"
    )
    assert moved.tolist() == [[0.0, 2.0]]


def test_only_known_aggregates(spark, blobs):
    with pytest.raises(ValueError):
        cluster.lloyd_step(frame(spark, blobs), blobs[:2], aggregate="mode")


def test_medians_meet_as_sketches(spark, blobs):
    """Sketches are filled before the shuffle: no values of a cluster travel."""
    df = frame(spark, blobs).select(F.posexplode("pgram_norm_arr").alias("pos", "value"))
    plan = df.groupBy("pos").agg(F.percentile_approx("value", 0.5, cluster.MEDIAN_ACCURACY))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "partial_percentile_approx" in text and "collect_list" not in text
