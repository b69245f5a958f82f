"""How well the clusters of each round fit: sums of squared errors and silhouettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.vectors import batch_matrix
from wattloom.operators.cluster import round_suffixes

#: Distances whose mean over a cluster follows from the cluster's sums.
SILHOUETTE_DISTANCES = ("euclidean", "cosine")


def cluster_sse(assigned: DataFrame, rounds: int) -> DataFrame:
    """``round, cluster_id, count, sse`` of the result of ``assign_rounds``: points and the sum of their
    squared distances. One pass and one small shuffle for all rounds."""
    per_round = [
        F.struct(
            F.lit(number).alias("round"),
            F.col(f"cluster_id{suffix}").alias("cluster_id"),
            F.col(f"l2dist{suffix}").alias("distance"),
        )
        for number, suffix in enumerate(round_suffixes(rounds), 1)
    ]
    long = assigned.select(F.inline(F.array(*per_round))).where("cluster_id IS NOT NULL")
    return long.groupBy("round", "cluster_id").agg(
        F.count("*").alias("count"), F.sum(F.col("distance") * F.col("distance")).alias("sse")
    )


def silhouette(
    assigned: DataFrame, rounds: int, vector: str = "pgram_norm_arr", distance: str = "euclidean"
) -> DataFrame:
    """``round, silhouette``: the mean over the points of a round, with squared Euclidean or cosine distances.

    Two passes for all rounds, and no pair of points meets: the first one sums up every cluster of every
    round, the second measures each point against these sums, rounds x k rows of the model's size. A point
    alone in its cluster counts 0; a zero vector is at cosine distance 1 from all. A round with fewer than
    two clusters has no value. ``assigned`` should be a written table.
    """
    if distance not in SILHOUETTE_DISTANCES:
        raise ValueError(f"distance must be one of {SILHOUETTE_DISTANCES}")
    spark = assigned.sparkSession
    ids = [F.coalesce(f"cluster_id{s}", F.lit(-1)).alias(f"c{n}") for n, s in enumerate(round_suffixes(rounds))]
    rows = assigned.select(F.col(vector).cast("array<double>").alias("v"), *ids).where("c0 >= 0")
    first = rows.select(F.size("v")).head(1)
    if not first:
        return spark.createDataFrame([(n + 1, None) for n in range(rounds)], "round int, silhouette double")
    width = first[0][0]
    sums = _cluster_sums(rows, rounds, width, distance)
    totals = _silhouette_sums(rows, sums, width, distance)
    values = [(n + 1, totals[n][0] / totals[n][1] if totals[n][1] else None) for n in range(rounds)]
    return spark.createDataFrame(values, "round int, silhouette double")


def _vectors(batch: pa.RecordBatch, width: int, distance: str) -> tuple[np.ndarray, np.ndarray]:
    """The points of a batch, at unit length for cosine distances, and their squared lengths."""
    rows, _ = batch_matrix(batch.column("v"), width)
    squares = np.einsum("ij,ij->i", rows, rows)
    if distance == "cosine":
        length = np.sqrt(squares)
        rows = rows / np.where(length > 0, length, 1.0)[:, None]
    return rows, squares


def _cluster_sums(rows: DataFrame, rounds: int, width: int, distance: str) -> list[dict[int, np.ndarray]]:
    """For every round: cluster id to component sums, sum of squared lengths, and size."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            points, squares = _vectors(batch, width, distance)
            for number in range(rounds):
                ids = batch.column(f"c{number}").to_numpy()
                for cluster in np.unique(ids[ids >= 0]).tolist():
                    mine = ids == cluster
                    total = held.setdefault((number, cluster), np.zeros(width + 2))
                    total[:width] += points[mine].sum(axis=0)
                    total[width] += squares[mine].sum()
                    total[width + 1] += np.count_nonzero(mine)
        keys = [(n, c, p) for n, c in held for p in range(width + 2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[at] for k in keys], pa.int32()) for at in range(3)]
            + [pa.array(np.concatenate([np.zeros(0), *held.values()]))],
            ["number", "cluster", "pos", "total"],
        )

    partial = rows.mapInArrow(reduce_partition, "number int, cluster int, pos int, total double")
    found: list[dict[int, np.ndarray]] = [{} for _ in range(rounds)]
    for x in partial.groupBy("number", "cluster", "pos").agg(F.sum("total").alias("total")).collect():
        found[x.number].setdefault(x.cluster, np.zeros(width + 2))[x.pos] = x.total
    return found


def _silhouette_sums(
    rows: DataFrame, sums: list[dict[int, np.ndarray]], width: int, distance: str
) -> list[tuple[float, int]]:
    """Sum of the silhouettes and number of points of every round; no points where fewer than two clusters are."""

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(sums), 2))
        for batch in batches:
            points, squares = _vectors(batch, width, distance)
            for number, clusters in enumerate(sums):
                ids = batch.column(f"c{number}").to_numpy()
                here = ids >= 0
                if len(clusters) < 2 or not here.any():
                    continue
                names = np.array(sorted(clusters))
                model = np.array([clusters[c] for c in names.tolist()])
                size = model[:, width + 1]
                inner = points[here] @ model[:, :width].T
                if distance == "cosine":
                    apart = size - inner
                else:
                    apart = squares[here][:, None] * size + model[:, width] - 2 * inner
                own = np.searchsorted(names, ids[here])
                place = np.arange(len(own))
                near = np.maximum(apart[place, own], 0) / np.maximum(size[own] - 1, 1)
                mean = np.maximum(apart, 0) / size
                mean[place, own] = np.inf
                away = mean.min(axis=1)
                largest = np.maximum(near, away)
                value = np.where(largest > 0, (away - near) / np.where(largest > 0, largest, 1.0), 0.0)
                totals[number] += value[size[own] > 1].sum(), len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(totals[:, 0]), pa.array(totals[:, 1])],
            ["number", "total", "n"],
        )

    partial = rows.mapInArrow(reduce_partition, "number int, total double, n double")
    found = partial.groupBy("number").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    by_round = {x.number: (x.total, int(x.n)) for x in found}
    return [by_round.get(n, (0.0, 0)) for n in range(len(sums))]
