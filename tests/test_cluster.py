import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from wattloom.functions.vectors import nearest_centroid
from wattloom.operators import assemble, cluster, fit


def frame(spark, matrix, parts=3):
    data = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, "bgid long, pgram_norm_arr array<double>").repartition(parts)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6)) * 10
    return np.concatenate([rng.normal(size=(n, 6)) + c for n, c in zip((150, 30, 20, 10), centres)])


def assignment(points, centroids):
    distances = np.sqrt(((points[:, None] - centroids[None]) ** 2).sum(-1))
    return distances.argmin(1), distances.min(1)


def test_nearest_centroid(spark, blobs):
    df = frame(spark, blobs).withColumn("n", nearest_centroid(F.col("pgram_norm_arr"), blobs[::40]))
    ids, distances = assignment(blobs, blobs[::40])
    for row in df.collect():
        assert row.n.column_id == ids[row.bgid]
        assert row.n.distance == pytest.approx(distances[row.bgid])


def test_lowest_id_wins_ties_and_null_stays_null(spark):
    df = spark.createDataFrame([([0.0, 0.0],), (None,)], "v array<double>").coalesce(1)
    equal = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    got = df.select(nearest_centroid(F.col("v"), equal).column_id).collect()
    assert [r[0] for r in got] == [0, None]


def test_lloyd_step_is_the_mean_and_keeps_empty_clusters(spark, blobs):
    start = np.vstack([blobs[:3], np.full((1, 6), 1e6)])
    moved, fraction = cluster.lloyd_step(frame(spark, blobs), start)
    ids, _ = assignment(blobs, start)
    for c in range(3):
        assert moved[c] == pytest.approx(blobs[ids == c].mean(0))
    assert moved[3] == pytest.approx(start[3]) and fraction == 1.0
    _, again = cluster.lloyd_step(frame(spark, blobs), moved, start)
    assert again == pytest.approx((assignment(blobs, moved)[0] != ids).mean())


def test_objective_never_rises(spark, blobs):
    df, centroids, last = frame(spark, blobs), blobs[:4], np.inf
    for _ in range(5):
        cost = (assignment(blobs, centroids)[1] ** 2).sum()
        assert cost <= last + 1e-9
        last = cost
        centroids, _ = cluster.lloyd_step(df, centroids)


def test_stop_rule_reaches_a_fixed_point(spark, blobs):
    df = frame(spark, blobs)
    centroids = cluster.kmeans_lloyd(df, 4, min_frac_reassigned=1e-9)
    again, _ = cluster.lloyd_step(df, centroids)
    assert again == pytest.approx(centroids)


def test_seeds_do_not_depend_on_partitioning(spark, blobs):
    one = cluster.kmeans_seeds(frame(spark, blobs, 1), 4)
    many = cluster.kmeans_seeds(frame(spark, blobs, 9), 4)
    assert (one == many).all() and len(np.unique(one, axis=0)) == 4
    other = cluster.kmeans_seeds(frame(spark, blobs, 9), 4, seed=7)
    assert not np.array_equal(one, other)


def test_fewer_distinct_points_than_k(spark):
    points = np.repeat([[1.0, 2.0]], 5, axis=0)
    assert cluster.kmeans_seeds(frame(spark, points), 3).tolist() == [[1.0, 2.0]]
    assert cluster.kmeans_lloyd(frame(spark, points), 3).tolist() == [[1.0, 2.0]]
    assert len(cluster.kmeans_mllib(frame(spark, points), 3)) == 1


def test_no_points(spark):
    with pytest.raises(ValueError):
        cluster.kmeans_lloyd(frame(spark, np.zeros((0, 2))), 2)


def test_only_known_distances(spark, blobs):
    with pytest.raises(ValueError):
        cluster.kmeans_lloyd(frame(spark, blobs), 2, distance="chebyshev")
    with pytest.raises(ValueError):
        cluster.kmeans_mllib(frame(spark, blobs), 2, distance="manhattan")


def test_mllib_points_are_at_their_nearest_centroid(spark, blobs):
    df = frame(spark, blobs)
    first = cluster.kmeans_mllib(df, 4, seed=3)
    assert first == pytest.approx(cluster.kmeans_mllib(df, 4, seed=3))
    moved, _ = cluster.lloyd_step(df, first)
    assert moved == pytest.approx(first, abs=1e-2)


def test_largest_cluster_prefers_the_lower_id(spark):
    df = spark.createDataFrame([(2,), (2,), (1,), (1,), (0,)], "cluster_id int")
    assert cluster.largest_cluster(df) == (1, 2)
    assert rows(cluster.cluster_sizes(df)) == [(0, 1), (1, 2), (2, 2)]


def hierarchy(spark, blobs, **options):
    return cluster.hierarchical_kmeans(
        frame(spark, blobs), lambda p: cluster.lloyd(p, cluster.first_points(p, 3), 3, 0.0), 3, **options
    )


def test_hierarchy_follows_the_largest_cluster(spark, blobs):
    model = hierarchy(spark, blobs, rounds=3)
    members = np.arange(len(blobs))
    got = {r.bgid: r for r in cluster.assign_rounds(frame(spark, blobs), model).collect()}
    for suffix, stage in zip(["", "_r2", "_r3"], model):
        ids, distances = assignment(blobs[members], stage.centroids)
        for position, point in enumerate(members):
            assert got[point][f"k{suffix}"] == 3
            assert got[point][f"cluster_id{suffix}"] == ids[position]
            assert got[point][f"l2dist{suffix}"] == pytest.approx(distances[position])
        for point in set(range(len(blobs))) - set(members):
            assert got[point][f"cluster_id{suffix}"] is None
        if stage.split is not None:
            assert stage.split == np.bincount(ids).argmax()
            members = members[ids == stage.split]
    leaves = {(r.cluster_id, r.cluster_id_r2, r.cluster_id_r3) for r in got.values()}
    assert len(leaves) == 2 + 2 + 3


def test_hierarchy_with_given_cluster(spark, blobs):
    assert hierarchy(spark, blobs, rounds=2, split_clusters=[1])[0].split == 1


@pytest.mark.parametrize("fit", ["lloyd", "mllib"])
@pytest.mark.parametrize("points", [1, 4, 30])
def test_every_round_has_its_columns_however_few_points(spark, blobs, points, fit):
    """The largest cluster has at most k points; the schema must not depend on that."""
    chosen = cluster.kmeans_lloyd if fit == "lloyd" else cluster.kmeans_mllib
    df = frame(spark, blobs[:points])
    model = cluster.hierarchical_kmeans(df, lambda p: chosen(p, 10), 10, rounds=3)
    assert len(model) == 3
    assigned = cluster.assign_rounds(df, model)
    for suffix in ("", "_r2", "_r3"):
        assert {f"k{suffix}", f"cluster_id{suffix}", f"l2dist{suffix}"} <= set(assigned.columns)
        assert assigned.where(f"cluster_id{suffix} IS NOT NULL").count() > 0


def test_a_chosen_cluster_without_points_leaves_empty_rounds(spark, blobs):
    model = hierarchy(spark, blobs, rounds=3, split_clusters=[99, 0])
    assert [len(r.centroids) for r in model] == [3, 0, 0]
    got = cluster.assign_rounds(frame(spark, blobs), model)
    assert got.where("cluster_id_r2 IS NOT NULL OR k_r3 IS NOT NULL").count() == 0
    assert got.where("cluster_id IS NOT NULL").count() == len(blobs)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_a_bad_value_in_a_vector_is_an_error(spark, bad):
    df = spark.createDataFrame([([0.0, 1.0],), ([bad, 1.0],)], "pgram_norm_arr array<double>")
    with pytest.raises(Exception, match="missing or non-finite"):
        cluster.lloyd_step(df, np.zeros((1, 2)))
    with pytest.raises(Exception, match="missing or non-finite"):
        df.select(nearest_centroid(F.col("pgram_norm_arr"), np.zeros((1, 2))).distance).collect()


@pytest.mark.parametrize("distance", ["euclidean", "cosine", "manhattan"])
def test_distances_by_definition(spark, blobs, distance):
    centroids = blobs[::50]
    pairs = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()),
        "cosine": lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b)),
        "manhattan": lambda a, b: np.abs(a - b).sum(),
    }
    near = nearest_centroid(F.col("pgram_norm_arr"), centroids, distance)
    for row in frame(spark, blobs).withColumn("n", near).collect():
        every = [pairs[distance](blobs[row.bgid], c) for c in centroids]
        assert row.n.column_id == int(np.argmin(every))
        assert row.n.distance == pytest.approx(min(every))


def test_fit_measures(spark, blobs):
    df = frame(spark, blobs)
    one_in_each_group = blobs[[0, 150, 180, 200]]
    model = cluster.hierarchical_kmeans(
        df, lambda p: cluster.kmeans_lloyd(p, 4, start=one_in_each_group if p is df else None), 4, rounds=2
    )
    assigned = cluster.assign_rounds(df, model).cache()
    sums = {(r["round"], r.cluster_id): (r["count"], r.sse) for r in fit.cluster_sse(assigned, 2).collect()}
    ids, distances = assignment(blobs, model[0].centroids)
    for c in range(4):
        assert sums[1, c] == (int((ids == c).sum()), pytest.approx((distances[ids == c] ** 2).sum()))
    assert sum(n for (r, _), (n, _) in sums.items() if r == 2) == np.bincount(ids).max()
    values = {r["round"]: r.silhouette for r in fit.silhouette(assigned, 2).collect()}
    assert values[1] > 0.8 and -1 <= values[2] <= 1
    alone = cluster.assign_rounds(df, [cluster.Round(1, blobs[:1])])
    assert fit.silhouette(alone, 1).first().silhouette is None


@pytest.mark.parametrize("distance", ["euclidean", "cosine"])
def test_silhouette_by_definition(spark, blobs, distance):
    points = np.vstack([blobs[::5], [[500.0] * 6]])  # the last one is alone in its cluster
    model = [cluster.Round(3, points[[0, 35, -1]])]
    df = frame(spark, points)
    assigned = cluster.assign_rounds(df, model)
    ids, _ = assignment(points, model[0].centroids)
    unit = points / np.sqrt((points**2).sum(1, keepdims=True))
    away = 1 - unit @ unit.T if distance == "cosine" else ((points[:, None] - points[None]) ** 2).sum(-1)
    values = []
    for n, own in enumerate(ids):
        mine = (ids == own) & (np.arange(len(ids)) != n)
        near = away[n, mine].mean() if mine.any() else 0
        other = min(away[n, ids == c].mean() for c in set(ids.tolist()) - {own})
        values.append((other - near) / max(other, near) if mine.any() else 0.0)
    assert fit.silhouette(assigned, 1, distance=distance).first().silhouette == pytest.approx(np.mean(values))
    with pytest.raises(ValueError):
        fit.silhouette(assigned, 1, distance="manhattan")
    assert fit.silhouette(assigned.limit(0), 1).first().silhouette is None


def test_centroids_long_and_by_row(spark):
    matrix = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]])
    model = cluster.centroid_table(spark, 3, matrix)
    assert rows(assemble.unnest_centroids(model)) == [
        (3, 1, 1, 1.0), (3, 1, 2, 2.0), (3, 2, 3, 3.0), (3, 2, 4, 4.0), (3, 3, 5, 1.0), (3, 3, 6, 2.0),
    ]
    assert rows(assemble.centroid_rows(model)) == [
        (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 2), (3, [3.0, 4.0], 1),
    ]
