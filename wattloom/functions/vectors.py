"""Column helpers on ``array<double>`` vectors.

Nearest-centroid search runs in Arrow batches on numpy: a batch of list values is
one contiguous buffer there, so a whole batch is a matrix without copying.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(n: Column) -> Column:
    """An array of ``n`` zeros."""
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def filled(value: float, n: Column) -> Column:
    """An array of ``n`` copies of ``value``."""
    return F.array_repeat(F.lit(float(value)), n.cast("int"))


def pad_to(vector: Column, n: Column) -> Column:
    """Append zeros until the vector has ``n`` values."""
    return F.concat(vector, zeros(n - F.size(vector)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors of equal length."""
    difference = subtract(a, b)
    squares = F.transform(difference, lambda v: v * v)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def batch_matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-null vectors of a batch as a matrix, and which rows they are.

    A missing, NaN or infinite value is an error: it has no nearest centroid, and one such
    point would take the whole centroid with it.
    """
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if flat.null_count or not np.isfinite(values).all():
        raise ValueError("a vector has a missing or non-finite value")
    lengths = vectors.drop_null().value_lengths().to_numpy(zero_copy_only=False)
    if lengths.size and (lengths != width).any():
        raise ValueError(f"expected vectors of {width} values")
    return values.reshape(-1, width).astype(np.float64, copy=False), present


#: Distances that the nearest-centroid search knows.
DISTANCES = ("euclidean", "cosine", "manhattan")


def distances_to(points: np.ndarray, centroid: np.ndarray, distance: str) -> np.ndarray:
    """Distance of every row to one centroid; Euclidean ones are squared.

    Differences are taken directly instead of expanding the product: with close centroids
    the expansion loses the digits that decide the winner. The cosine distance of a zero
    vector is 1.
    """
    if distance == "cosine":
        lengths = np.sqrt(np.einsum("ij,ij->i", points, points)) * np.sqrt(centroid @ centroid)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(lengths > 0, 1.0 - points @ centroid / lengths, 1.0)
    delta = points - centroid
    if distance == "manhattan":
        return np.abs(delta).sum(axis=1)
    return np.einsum("ij,ij->i", delta, delta)


def nearest_rows(
    points: np.ndarray, centroids: np.ndarray, distance: str = "euclidean"
) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (lowest on ties) and the distance to it.

    Memory stays at one batch-sized buffer.
    """
    best = np.zeros(len(points), dtype=np.int32)
    least = np.full(len(points), np.inf)
    for index, centroid in enumerate(centroids):
        measured = distances_to(points, centroid, distance)
        closer = measured < least
        best[closer] = index
        least[closer] = measured[closer]
    return best, np.sqrt(least) if distance == "euclidean" else least


def check_distance(distance: str) -> None:
    if distance not in DISTANCES:
        raise ValueError(f"distance must be one of {DISTANCES}")


def nearest_centroid(vector: Column, centroids: np.ndarray, distance: str = "euclidean") -> Column:
    """``struct(column_id, distance)`` of the nearest of ``centroids``.

    ``centroids`` is a k x d matrix: it belongs to the model, not to the data, so it
    travels with the function. A null vector has a null answer.

    Declared nondeterministic although it is not: otherwise a filter or join on the result is
    pushed below the projection and the search runs twice. Bind it to a column before using
    several of its fields.
    """
    check_distance(distance)
    model = np.ascontiguousarray(centroids, dtype=np.float64)

    @F.arrow_udf("struct<column_id: int, distance: double>")
    def search(vectors: pa.Array) -> pa.Array:
        points, present = batch_matrix(vectors, model.shape[1])
        ids = np.zeros(len(vectors), dtype=np.int32)
        measured = np.zeros(len(vectors))
        ids[present], measured[present] = nearest_rows(points, model, distance)
        return pa.StructArray.from_arrays(
            [pa.array(ids), pa.array(measured)],
            names=["column_id", "distance"],
            mask=pa.array(~present),
        )

    return search.asNondeterministic()(vector)
