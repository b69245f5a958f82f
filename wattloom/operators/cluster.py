"""k-means on vectors, assignment, and repeated splitting of the largest cluster.

A model is a k x d numpy matrix: its size depends on k and the vector length, never on
the number of points. Points stay in DataFrames throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.hashing import hash_uniform
from wattloom.functions.vectors import (
    batch_matrix,
    check_distance,
    nearest_centroid,
    nearest_rows,
    pad_to,
)
from wattloom.operators.bounded import lloyd_bounded
from wattloom.operators.seeding import kmeans_parallel_seeds
from wattloom.storage import materialise

#: Distances of the library's k-means; ``kmeans_lloyd`` knows ``vectors.DISTANCES``.
MLLIB_DISTANCES = ("euclidean", "cosine")

#: What a centroid is made of: the mean of its points, the mean of their directions (at unit length; for
#: cosine distances), or the median of every component (for Manhattan distances).
AGGREGATES = ("mean", "unit mean", "median")


def kmeans_mllib(
    points: DataFrame,
    k: int,
    vector: str = "pgram_norm_arr",
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 1e-4,
    distance: str = "euclidean",
) -> np.ndarray:
    """Centroids from the library's k-means with parallel k-means++ seeding.

    Stops when no centroid moves further than ``tol``. May return fewer than ``k``
    centroids if there are fewer distinct points. Its seeding depends on how the points are
    partitioned; ``kmeans_lloyd`` does not. Points are handled row by row: the library's blocks of
    rows don't expect fewer start centroids than ``k``.
    """
    if distance not in MLLIB_DISTANCES:
        raise ValueError(f"the library knows the distances {MLLIB_DISTANCES}")
    features = points.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, distanceMeasure=distance, solver="row").fit(features)
    return np.array(model.clusterCenters())


def kmeans_seeds(
    points: DataFrame,
    k: int,
    vector: str = "pgram_norm_arr",
    point_id: str = "bgid",
    seed: int = 42,
    distance: str = "euclidean",
) -> np.ndarray:
    """k-means++ seeds: each next seed is drawn with weight D^2, the squared distance to
    the nearest seed so far.

    A weighted draw is the maximum of ``ln(u) / weight`` over uniform ``u``, so one pass
    per seed with a distributed maximum does it. ``u`` is a hash of the point's id: the same
    points give the same seeds in any partitioning. Stops early when every remaining point
    coincides with a seed.
    """
    data = points.select(
        F.col(point_id).alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    chosen: list[list[float]] = []
    for step in range(k):
        draw = F.log(hash_uniform(f"{seed}/{step}", F.col("id")))
        if chosen:
            weighed = data.withColumn("d", nearest_centroid(F.col("v"), np.array(chosen), distance).distance)
            weighed = weighed.where("d > 0").withColumn("key", draw / (F.col("d") * F.col("d")))
        else:
            weighed = data.withColumn("key", draw)
        best = weighed.orderBy(F.desc("key"), "id").select("v").head(1)
        if not best:
            break
        chosen.append(list(best[0].v))
    if not chosen:
        raise ValueError("no points to choose seeds from")
    return np.array(chosen)


def first_points(
    points: DataFrame, k: int, vector: str = "pgram_norm_arr", point_id: str = "bgid"
) -> np.ndarray:
    """The vectors with the ``k`` lowest ids: reproducible start values."""
    rows = points.orderBy(point_id).select(F.col(vector).cast("array<double>").alias("v")).head(k)
    return np.array([row.v for row in rows])


def lloyd_step(
    points: DataFrame,
    centroids: np.ndarray,
    previous: np.ndarray | None = None,
    vector: str = "pgram_norm_arr",
    distance: str = "euclidean",
    aggregate: str = "mean",
) -> tuple[np.ndarray, float]:
    """Move every centroid to the ``aggregate`` of its points; also the fraction of points that
    changed cluster since ``previous``.

    Each partition reduces its points to k partial sums before anything is shuffled, so a
    cluster that holds nearly all points costs the same as any other. Old assignments are
    not stored: both are recomputed from the two models. An empty cluster stays in place, and so
    does one whose directions cancel out.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"aggregate must be one of {AGGREGATES}")
    if aggregate == "median":
        return _median_step(points, centroids, previous, vector, distance)
    totals = _partial_sums(points, centroids, previous, vector, distance, aggregate == "unit mean")
    # At most k * (d + 1) + 1 rows: the size of the model.
    summed = totals.groupBy("cluster_id", "pos").agg(F.sum("total").alias("total")).toArrow()
    cluster_id, pos, total = (summed[c].to_numpy() for c in ("cluster_id", "pos", "total"))
    k, width = centroids.shape
    sums, sizes = np.zeros((k, width)), np.zeros(k)
    values = pos >= 0
    sums[cluster_id[values], pos[values]] = total[values]
    sizes[cluster_id[pos == _SIZE]] = total[pos == _SIZE]
    changed = float(total[pos == _CHANGED].sum())
    if not sizes.sum():
        raise ValueError("no points to cluster")
    held = sizes > 0
    moved = centroids.astype(np.float64).copy()
    moved[held] = sums[held] / sizes[held, None]
    if aggregate == "unit mean":
        length = np.sqrt((moved * moved).sum(axis=1))
        held &= length > 0
        moved[held] /= length[held, None]
        moved[~held] = centroids[~held]
    return moved, changed / sizes.sum()


def _median_step(
    points: DataFrame, centroids: np.ndarray, previous: np.ndarray | None, vector: str, distance: str
) -> tuple[np.ndarray, float]:
    """``lloyd_step`` with the lower median of every component.

    Medians come from mergeable quantile sketches, one per cluster and component, that each partition
    fills before the shuffle: a cluster of any size is k * d sketches per partition. Clusters of up
    to ``MEDIAN_ACCURACY`` points have the exact median, larger ones a value whose rank is at most 1 in
    ``MEDIAN_ACCURACY`` off.
    """
    values = F.col(vector).cast("array<double>")
    assigned = points.select(values.alias("v"), nearest_centroid(values, centroids, distance).column_id.alias("cluster_id"))
    before = F.lit(None).cast("int") if previous is None else nearest_centroid(F.col("v"), previous, distance).column_id
    compared = assigned.withColumn("before", before).where("cluster_id IS NOT NULL")
    changed = (~F.col("before").eqNullSafe(F.col("cluster_id"))).cast("int").alias("changed")
    long = compared.select("cluster_id", changed, F.posexplode("v").alias("pos", "value"))
    medians = long.groupBy("cluster_id", "pos").agg(
        F.percentile_approx("value", 0.5, MEDIAN_ACCURACY).alias("median"),
        F.count("*").alias("size"),
        F.sum("changed").alias("changed"),
    )
    moved, size, switched = centroids.astype(np.float64).copy(), 0, 0
    for row in medians.collect():  # k * d rows: the size of the model
        moved[row.cluster_id, row.pos] = row.median
        if row.pos == 0:
            size, switched = size + row["size"], switched + row.changed
    if not size:
        raise ValueError("no points to cluster")
    return moved, switched / size


#: Accuracy of the quantile sketches behind medians.
MEDIAN_ACCURACY = 10_000


def lloyd(
    points: DataFrame,
    start: np.ndarray,
    max_iter: int = 100,
    min_frac_reassigned: float = 0.001,
    vector: str = "pgram_norm_arr",
    distance: str = "euclidean",
    aggregate: str = "mean",
) -> np.ndarray:
    """Iterate ``lloyd_step`` until fewer than ``min_frac_reassigned`` of the points change
    cluster, at most ``max_iter`` times. ``points`` is read once per iteration."""
    previous, current = None, start
    for _ in range(max_iter):
        moved, fraction = lloyd_step(points, current, previous, vector, distance, aggregate)
        previous, current = current, moved
        if fraction < min_frac_reassigned:
            break
    return current


def kmeans_lloyd(
    points: DataFrame,
    k: int,
    vector: str = "pgram_norm_arr",
    point_id: str = "bgid",
    seed: int = 42,
    max_iter: int = 100,
    min_frac_reassigned: float = 0.001,
    start: np.ndarray | None = None,
    distance: str = "euclidean",
    aggregate: str = "mean",
    seeding: str = "plusplus",
    bounds: bool = False,
) -> np.ndarray:
    """k-means++ (or given ``start`` centroids) with the stop rule on reassigned points.

    Points go to the centroid that is nearest by ``distance``; a centroid is the ``aggregate`` of its
    points. The objective never rises with the mean under Euclidean, the unit mean under cosine and
    the median under Manhattan distances; other pairs are allowed. ``seeding`` by "plusplus" takes a
    pass per seed, by "parallel" five passes. ``bounds`` skips distances that can't change anything (Euclidean
    distances and means only). The id and vector of the points are kept in memory, or on the
    executors' disks, during the fit: lost ones are computed again from the source.
    """
    check_distance(distance)
    if seeding not in ("plusplus", "parallel"):
        raise ValueError("seeding must be 'plusplus' or 'parallel'")
    if bounds and (distance, aggregate) != ("euclidean", "mean"):
        raise ValueError("bounds need Euclidean distances and means")
    data = points.select(point_id, vector).persist()
    try:
        if start is None:
            choose = kmeans_seeds if seeding == "plusplus" else kmeans_parallel_seeds
            start = choose(data, k, vector, point_id, seed, distance)
        if bounds:
            return lloyd_bounded(data, start, max_iter, min_frac_reassigned, vector).centroids
        return lloyd(data, start, max_iter, min_frac_reassigned, vector, distance, aggregate)
    finally:
        data.unpersist()


def centroid_table(spark: SparkSession, k: int, centroids: np.ndarray) -> DataFrame:
    """A model as a one-row table ``(k, centroids)`` with the centroids as a 2-D array."""
    return spark.createDataFrame(
        [(k, centroids.tolist())], "k int, centroids array<array<double>>"
    )


def assign_clusters(
    points: DataFrame,
    centroids: np.ndarray,
    k: int,
    vector: str = "pgram_norm_arr",
    point_ids: str = "win_id_arr",
    distance: str = "euclidean",
) -> DataFrame:
    """Add ``k``, the nearest centroid's ``cluster_id``, and the vector padded to the length
    of ``point_ids``. The model travels with the function; nothing is joined."""
    length = F.size(point_ids)
    nearest = nearest_centroid(F.col(vector).cast("array<double>"), centroids, distance)
    return points.select(
        F.lit(k).alias("k"),
        nearest.column_id.alias("cluster_id"),
        *[c for c in points.columns if c not in ("k", "cluster_id")],
        F.col(point_ids).alias("pgram_pt_id_arr_padded"),
        pad_to(F.col(vector).cast("array<double>"), length).alias("pgram_norm_arr_padded"),
    )


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """Number of points per cluster."""
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("count")).orderBy("cluster_id")


def largest_cluster(assigned: DataFrame) -> tuple[int, int]:
    """Id and size of the largest cluster; the lowest id on ties. Sizes are k rows."""
    rows = cluster_sizes(assigned.where("cluster_id IS NOT NULL")).collect()
    if not rows:
        raise ValueError("nothing is assigned")
    best = max(rows, key=lambda r: (r["count"], -r["cluster_id"]))
    return best["cluster_id"], best["count"]


def cluster_members(assigned: DataFrame, cluster_id: int, round_number: int) -> DataFrame:
    """Points of one cluster as input of the next round; its ids are kept under
    ``k_r<round>`` and ``cluster_id_r<round>``."""
    return assigned.where(F.col("cluster_id") == cluster_id).withColumnsRenamed(
        {"k": f"k_r{round_number}", "cluster_id": f"cluster_id_r{round_number}"}
    )


@dataclass(frozen=True)
class Round:
    """One round: its centroids, and which of its clusters the next round splits (if any)."""

    k: int
    centroids: np.ndarray
    split: int | None = None


Fit = Callable[[DataFrame], np.ndarray]


def hierarchical_kmeans(
    points: DataFrame,
    fit: Fit,
    k: int,
    rounds: int = 3,
    vector: str = "pgram_norm_arr",
    split_clusters: list[int] | None = None,
    distance: str = "euclidean",
) -> list[Round]:
    """Cluster, then cluster the largest cluster again, ``rounds`` times in all.

    ``split_clusters`` names the clusters to split instead of the largest. Every round is run,
    however few points it has: a fit gives fewer than ``k`` centroids then, and the rounds
    behind a cluster without points have none. The members of a split cluster are written
    out, because the next fit reads them once per iteration.
    """
    model: list[Round] = []
    members = points
    for number in range(rounds):
        centroids = fit(members)
        if number == rounds - 1:
            model.append(Round(k, centroids))
            break
        nearest = nearest_centroid(F.col(vector).cast("array<double>"), centroids, distance)
        assigned = members.withColumn("cluster_id", nearest.column_id)
        split = split_clusters[number] if split_clusters else largest_cluster(assigned)[0]
        model.append(Round(k, centroids, split))
        members = materialise(
            assigned.where(F.col("cluster_id") == split).drop("cluster_id"), f"members-r{number + 2}"
        )
        if split_clusters and members.isEmpty():
            nothing = Round(k, np.zeros((0, centroids.shape[1])))
            model += [nothing] * (rounds - number - 1)
            break
    return model


def assign_rounds(
    points: DataFrame,
    model: list[Round],
    vector: str = "pgram_norm_arr",
    distance: str = "euclidean",
) -> DataFrame:
    """Add cluster and distance of every round: ``k, cluster_id, l2dist``, then with suffix
    ``_r2``, ``_r3``, ...; NULL where a point was not clustered again.

    Follows the splits inside one pass over the points. This equals assigning every round
    by itself and joining the results, but moves no data at all.
    """
    names = round_suffixes(len(model))
    path = F.col("path_of_point")
    added = []
    for suffix, stage in zip(names, model):
        was_here = path[f"cluster_id{suffix}"].isNotNull()
        added += [
            F.when(was_here, F.lit(stage.k)).alias(f"k{suffix}"),
            path[f"cluster_id{suffix}"].alias(f"cluster_id{suffix}"),
            path[f"l2dist{suffix}"].alias(f"l2dist{suffix}"),
        ]
    followed = points.withColumn("path_of_point", _path(F.col(vector).cast("array<double>"), model, distance))
    return followed.select(*points.columns, *added)


def round_suffixes(rounds: int) -> list[str]:
    """Column suffixes of the rounds: none for the first, then ``_r2``, ``_r3``, ..."""
    return ["" if number == 1 else f"_r{number}" for number in range(1, rounds + 1)]


_SIZE, _CHANGED = -1, -2


def _partial_sums(
    points: DataFrame,
    centroids: np.ndarray,
    previous: np.ndarray | None,
    vector: str,
    distance: str,
    unit: bool = False,
) -> DataFrame:
    """Per partition: sum per cluster and position, points per cluster, changed points; ``unit`` adds
    up directions instead of vectors."""
    model = np.ascontiguousarray(centroids, dtype=np.float64)
    old = None if previous is None else np.ascontiguousarray(previous, dtype=np.float64)
    k, width = model.shape

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, changed = np.zeros((k, width)), np.zeros(k), 0.0
        for batch in batches:
            block, _ = batch_matrix(batch.column(0), width)
            ids, _ = nearest_rows(block, model, distance)
            if old is None:
                changed += len(block)
            else:
                changed += np.count_nonzero(nearest_rows(block, old, distance)[0] != ids)
            if unit:
                length = np.sqrt(np.einsum("ij,ij->i", block, block))
                block = block / np.where(length > 0, length, 1.0)[:, None]
            for cluster in np.unique(ids):
                mine = block[ids == cluster]
                sums[cluster] += mine.sum(axis=0)
                sizes[cluster] += len(mine)
        cluster_id = np.concatenate([np.repeat(np.arange(k), width), np.arange(k), [0]])
        pos = np.concatenate([np.tile(np.arange(width), k), np.full(k, _SIZE), [_CHANGED]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cluster_id.astype(np.int32)),
                pa.array(pos.astype(np.int32)),
                pa.array(np.concatenate([sums.ravel(), sizes, [changed]])),
            ],
            names=["cluster_id", "pos", "total"],
        )

    vectors = points.select(F.col(vector).cast("array<double>").alias("v"))
    return vectors.mapInArrow(reduce_partition, "cluster_id int, pos int, total double")


def _path(vector: Column, model: list[Round], distance: str) -> Column:
    """Struct of cluster and distance per round for one point."""
    names = [f"{c}{s}" for s in round_suffixes(len(model)) for c in ("cluster_id", "l2dist")]
    kinds = ["int", "double"] * len(model)
    matrices = [np.ascontiguousarray(r.centroids, dtype=np.float64) for r in model]
    splits = [r.split for r in model]

    @F.arrow_udf(", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
    def follow(batch: pa.Array) -> pa.Array:
        block, present = batch_matrix(batch, matrices[0].shape[1])
        rows = np.flatnonzero(present)
        columns = []
        for matrix, split in zip(matrices, splits):
            ids, measured = nearest_rows(block, matrix, distance)
            all_ids = np.zeros(len(batch), dtype=np.int32)
            distances = np.zeros(len(batch))
            missing = np.ones(len(batch), dtype=bool)
            all_ids[rows], distances[rows], missing[rows] = ids, measured, False
            columns += [pa.array(all_ids, mask=missing), pa.array(distances, mask=missing)]
            stay = ids == split if split is not None else np.zeros(len(ids), dtype=bool)
            block, rows = block[stay], rows[stay]
        return pa.StructArray.from_arrays(columns, names=names)

    return follow.asNondeterministic()(vector)  # as in nearest_centroid
