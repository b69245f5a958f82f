"""Lloyd updates that skip most distances, by bounds that are carried from update to update.

With every point go its cluster, an upper bound of the distance to its centroid and a lower bound of the
distance to each other one. When centroids move, the bounds move with them. A centroid is measured only if its lower
bound, and half its distance from the point's own centroid, lie below the upper bound. One lower bound for
all centroids would be smaller to keep, but with many components it saves next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.vectors import batch_matrix
from wattloom.storage import fresh_path, remove_path

_STATE = "v array<double>, cluster_id int, upper double, lower binary, changed boolean, measured int"
#: Bounds give way by more than their rounding errors.
_SLACK = 1 + 1e-9
#: Points that a task measures at a time.
_ROWS = 2048


@dataclass
class BoundedFit:
    """Final centroids; distances taken in each update, and what a search of all would have taken."""

    centroids: np.ndarray
    measured: list[int] = field(default_factory=list)
    of: list[int] = field(default_factory=list)


def _distances(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    difference = points - centroid
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def _stored(lower: np.ndarray) -> pa.Array:
    """Lower bounds in single precision, never rounded up; a row of bytes per point."""
    narrow = lower.astype("<f4")
    narrow = np.where(narrow > lower, np.nextafter(narrow, np.float32(-np.inf)), narrow).astype("<f4")
    ends = np.arange(len(lower) + 1, dtype=np.int32) * (4 * lower.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(lower), [None, pa.py_buffer(ends), pa.py_buffer(narrow.tobytes())])


def lloyd_bounded(
    points: DataFrame,
    start: np.ndarray,
    max_iter: int = 100,
    min_frac_reassigned: float = 0.001,
    vector: str = "pgram_norm_arr",
) -> BoundedFit:
    """The centroids of ``cluster.lloyd`` with Euclidean distances and means.

    Every update writes the points with their bounds, 4 bytes for each centroid, anew and deletes the table
    before; it pays when vectors are long and k is large, so that the distances saved outweigh that.
    """
    spark = points.sparkSession
    old, centroids = None, np.ascontiguousarray(start, np.float64)
    fit = BoundedFit(centroids)
    state = points.select(F.col(vector).cast("array<double>").alias("v"))
    path = None
    try:
        for _ in range(max_iter):
            before, path = path, fresh_path(spark, "bounds")
            _update(state, centroids, old).write.parquet(path)
            if before:
                remove_path(spark, before)
            state = spark.read.schema(_STATE).parquet(path)
            sums, sizes, changed, measured = _sums(state, *centroids.shape)
            if not sizes.sum():
                raise ValueError("no points to cluster")
            held = sizes > 0
            old, centroids = centroids, centroids.copy()
            centroids[held] = sums[held] / sizes[held, None]
            fit.measured.append(measured)
            fit.of.append(int(sizes.sum()) * len(centroids))
            if changed / sizes.sum() < min_frac_reassigned:
                break
    finally:
        if path:
            remove_path(spark, path)
    fit.centroids = centroids
    return fit


def _update(state: DataFrame, centroids: np.ndarray, old: np.ndarray | None) -> DataFrame:
    """Points with cluster and bounds for ``centroids``; they were those for ``old`` before."""
    k, width = centroids.shape
    moved = np.zeros(k) if old is None else _distances(centroids, old)
    half = np.stack([_distances(centroids, c) for c in centroids]) / 2
    half[np.arange(k), np.arange(k)] = np.inf
    nearest = half.min(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield one(batch.slice(at, _ROWS))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, _ = batch_matrix(batch.column("v"), width)
        place = np.arange(len(rows))
        if old is None:
            lower = np.stack([_distances(rows, c) for c in centroids], axis=1)
            ids = lower.argmin(axis=1).astype(np.int32)
            upper = lower[place, ids]
            changed, measured = np.ones(len(rows), bool), np.full(len(rows), k, np.int32)
        else:
            before = batch.column("cluster_id").to_numpy()
            kept = np.frombuffer(b"".join(batch.column("lower").to_pylist()), "<f4").reshape(-1, k)
            ids, upper = before.copy(), batch.column("upper").to_numpy() + moved[before]
            lower = np.maximum(kept.astype(np.float64) / _SLACK - moved, 0.0)
            measured = np.zeros(len(rows), np.int32)

            def open_to(c: int | slice, who: np.ndarray) -> np.ndarray:
                """Whether a centroid, or each of them, may be nearer than the upper bound."""
                reach = upper[who] * _SLACK
                reach = reach if isinstance(c, int) else reach[:, None]
                return (lower[who, c] <= reach) & (half[ids[who], c] <= reach)

            who = np.flatnonzero(upper * _SLACK >= nearest[ids])
            who = who[open_to(slice(None), who).any(axis=1)]
            own = rows[who] - centroids[ids[who]]
            upper[who] = np.sqrt(np.einsum("ij,ij->i", own, own))
            lower[who, ids[who]] = upper[who]
            measured[who] += 1
            for c in range(k):
                near = who[open_to(c, who) & (ids[who] != c)]
                away = _distances(rows[near], centroids[c])
                lower[near, c] = away
                measured[near] += 1
                closer = (away < upper[near]) | ((away == upper[near]) & (c < ids[near]))
                ids[near[closer]], upper[near[closer]] = c, away[closer]
            changed = ids != before
        vectors = batch.column("v").filter(batch.column("v").is_valid())
        arrays = [pa.array(ids), pa.array(upper), _stored(lower), pa.array(changed), pa.array(measured)]
        return pa.RecordBatch.from_arrays([vectors, *arrays], ["v", "cluster_id", "upper", "lower", "changed", "measured"])

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sums and sizes of the clusters, points that changed cluster, distances taken: partial sums per task."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, width + 1))
        for batch in batches:
            rows, _ = batch_matrix(batch.column("v"), width)
            ids = batch.column("cluster_id").to_numpy()
            for cluster in np.unique(ids):
                mine = rows[ids == cluster]
                total[cluster, :width] += mine.sum(axis=0)
                total[cluster, width] += len(mine)
            total[k, 0] += np.count_nonzero(batch.column("changed").to_numpy(zero_copy_only=False))
            total[k, width] += batch.column("measured").to_numpy().sum()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total.ravel()[held])], ["place", "total"])

    partial = state.select("v", "cluster_id", "changed", "measured").mapInArrow(reduce_partition, "place long, total double")
    summed = partial.groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((k + 1) * (width + 1))
    out[summed["place"].to_numpy()] = summed["total"].to_numpy()
    out = out.reshape(k + 1, width + 1)
    return out[:k, :width], out[:k, width], int(out[k, 0]), int(out[k, width])
