"""Clustering of whole-number vectors with a nearest-centroid search that skips most distances.

Equal-average equal-variance search: centroids are sorted by the sum of their components. For a vector, the
scan starts at its own sum and goes outward. With s the sum, and v = sqrt(d * sum of squares - s * s) the
scaled deviation, of d components, the squared distance of x and c is at least (s(x) - s(c))^2 / d, and at least
((s(x) - s(c))^2 + (v(x) - v(c))^2) / d. The first bound only grows outward, so the scan stops when
it exceeds the least distance so far; the second one rejects single centroids. What is left is
measured in whole numbers. Sums are compared exactly; the deviation's bound gives way by more
than its rounding error.

A pass over the vectors returns the sums of each cluster per partition, so a cluster with nearly all
vectors, or one vector that is a third of all rows, is no hot spot. The model, k x d numbers, is all that
reaches the driver.

Edge cases: null vectors, vectors of another length, and those that hold a null, NaN or infinite
component take no part and have no row; a null id is kept and hashes as ``null``; repeated rows are vectors each, also as
starts; fewer vectors than k give as many centroids; equally near centroids: the smaller number; an empty table gives
an empty result; other columns are ignored. Scaled components of ``2 ** 30 / width`` and more are an error: the sums that
the bounds need would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.storage import materialise

#: Bound of component times width: width * sum of squares stays below 2 ** 60.
_LARGEST = 1 << 30


def whole_vectors(vectors: DataFrame, width: int, scale: float) -> DataFrame:
    """``vec_id, v``: vectors of ``width`` usable components as whole numbers, written as a table."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("x").isNotNull() & (F.size("x") == width)).where(finite)
    return materialise(kept.select("vec_id", F.transform("x", lambda x: F.floor(scale * x)).alias("v")), "whole-vectors")


class SortedCentroids:
    """Centroids by the sum of their components, with the figures that the bounds need."""

    def __init__(self, centroids: np.ndarray):
        self.width = centroids.shape[1]
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.rows, self.sums = centroids[self.number], sums[self.number]
        self.spread = self._spread(self.rows, self.sums)

    def _spread(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.sqrt(self.width * np.einsum("ij,ij->i", rows, rows) - sums * sums)  # exact under the root

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance per row; how many distances were taken."""
        n, k, width = len(rows), len(self.rows), self.width
        sums = rows.sum(axis=1)
        spread = self._spread(rows, sums)
        upper = np.searchsorted(self.sums, sums)
        lower = upper - 1
        best = np.full(n, -1)
        least = np.full(n, np.iinfo(np.int64).max)
        active, taken = np.arange(n), 0
        far = np.iinfo(np.int64).max
        while len(active):
            lo, hi = lower[active], upper[active]
            down = np.where(lo >= 0, sums[active] - self.sums[np.maximum(lo, 0)], far)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[active], far)
            below = down <= up
            gap = np.where(below, down, up)
            at = np.where(below, lo, hi)
            # The gaps only grow from here: beyond the reach nothing is nearer.
            reach = np.sqrt(width * least[active].astype(np.float64)) * (1 + 1e-9) + 1
            going = (gap != far) & (gap <= reach)
            active, gap, at, below = active[going], gap[going], at[going], below[going]
            lower[active[below]] -= 1
            upper[active[~below]] += 1
            apart = gap.astype(np.float64) ** 2 + (spread[active] - self.spread[at]) ** 2
            rounding = 1e-12 * (spread[active] + self.spread[at]) ** 2 + 1
            bound = (apart * (1 - 1e-9) - rounding) / width
            near = bound <= least[active]
            who, which = active[near], at[near]
            taken += len(who)
            difference = rows[who] - self.rows[which]
            squared = np.einsum("ij,ij->i", difference, difference)
            number = self.number[which]
            closer = (squared < least[who]) | ((squared == least[who]) & (number < best[who]))
            least[who[closer]], best[who[closer]] = squared[closer], number[closer]
        return best, least, taken


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if rows.size and max(int(rows.max()), -int(rows.min())) * width >= _LARGEST:
        raise ValueError(f"a scaled component is 2 ** 30 / {width} or more")
    return rows


def start_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    hashed = whole.select(F.sha2(named, 256).alias("hash"), "v")
    # Hashes first: every task sends k of them to the driver, but only the chosen vectors.
    smallest = hashed.select("hash").orderBy("hash").limit(k).collect()
    if not smallest:
        return np.zeros((0, 0), np.int64)
    first = hashed.where(F.col("hash") <= smallest[-1].hash).orderBy("hash", "v").limit(k).collect()
    return np.array([x.v for x in first], np.int64)


def cluster_sums(whole: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and sizes of the clusters around ``centroids``, exact."""
    k, width = centroids.shape

    def reduce_partition(batches):
        search, sums = SortedCentroids(centroids), np.zeros((k, width + 1), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            best, _, _ = search.nearest(rows)
            order = np.argsort(best, kind="stable")
            held, starts, sizes = np.unique(best[order], return_index=True, return_counts=True)
            if len(held):
                sums[held, :width] += np.add.reduceat(rows[order], starts, axis=0)
                sums[held, width] += sizes
        held = np.flatnonzero(sums[:, width])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(held, width + 1)),
                pa.array(np.tile(np.arange(width + 1), len(held))),
                pa.array(sums[held].ravel()),
            ],
            ["cluster", "pos", "total"],
        )

    partial = whole.select("v").mapInArrow(reduce_partition, "cluster long, pos long, total long")
    summed = partial.groupBy("cluster", "pos").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((k, width + 1), np.int64)
    out[summed["cluster"].to_numpy(), summed["pos"].to_numpy()] = summed["total"].to_numpy()
    return out[:, :width], out[:, width]


def fit_centroids(whole: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """``rounds`` times: every vector to its nearest centroid, every non-empty centroid to the floor of its
    vectors' mean."""
    centroids = start_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        sums, sizes = cluster_sums(whole, centroids)
        held = sizes > 0
        centroids = centroids.copy()
        centroids[held] = sums[held] // sizes[held, None]
    return centroids


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def search_partition(batches):
        search = SortedCentroids(centroids)
        for batch in batches:
            best, least, _ = search.nearest(_matrix(batch.column("v"), centroids.shape[1]))
            columns = [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return whole.select("vec_id", "v").mapInArrow(search_partition, "vec_id long, cluster int, distance long")


@dataclass(frozen=True)
class Clusters:
    """The final centroids, and where every vector went (a written table)."""

    centroids: np.ndarray
    assigned: DataFrame


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: float = 64.0
) -> Clusters:
    whole = whole_vectors(vectors, width, scale)
    centroids = fit_centroids(whole, k, rounds, seed)
    if not len(centroids):
        nothing = whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(centroids, nothing)
    return Clusters(centroids, materialise(assign(whole, centroids), "assigned"))


def cluster_digest(found: Clusters) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector."""
    spark = found.assigned.sparkSession
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    total = sum(x.cluster_inertia for x in sums)
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    model = [(x.cluster, x.cluster_inertia, total, named[x.cluster]) for x in sums]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = F.broadcast(spark.createDataFrame(model, schema))
    return found.assigned.join(rows, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
