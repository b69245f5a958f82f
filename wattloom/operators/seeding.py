"""Start centroids in a few passes, however many there are to be.

Candidates are drawn in rounds: about ``oversample * k`` points a round, each with a probability in
proportion to its squared distance from the nearest candidate so far. That distance is kept with the points
and compared with the new candidates only. At the end every candidate weighs as many points as are
nearest to it, and k-means++ on the weighed candidates picks ``k`` of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.hashing import hash_uniform
from wattloom.functions.vectors import batch_matrix, check_distance, distances_to, nearest_rows
from wattloom.storage import materialise, run_of

#: Squared distances are added up as whole parts of the largest one, so that the sum is the same in any order.
_PARTS = float(1 << 40)


def kmeans_parallel_seeds(
    points: DataFrame,
    k: int,
    vector: str = "pgram_norm_arr",
    point_id: str = "bgid",
    seed: int = 42,
    distance: str = "euclidean",
    rounds: int = 3,
    oversample: float = 2.0,
) -> np.ndarray:
    """At most ``k`` seeds: ``rounds`` + 2 passes over the vectors whatever ``k``.

    Draws are hashes of the point's id, and sums don't depend on their order: the same points give the
    same seeds in any partitioning. Ids must be unique. The driver holds the candidates, about
    ``1 + rounds * oversample * k`` vectors, a multiple of the model. Fewer seeds come back if there are fewer
    distinct points; if the draws found fewer than ``k`` candidates while points are left that coincide with
    none, further rounds follow.
    """
    check_distance(distance)
    spark = points.sparkSession
    with run_of(spark):
        data = points.select(F.col(point_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        first = data.orderBy(F.desc(hash_uniform(f"{seed}/0", F.col("id"))), "id").head(1)
        if not first:
            raise ValueError("no points to choose seeds from")
        ids, candidates = [first[0].id], np.array([first[0].v])
        state = _measured(data, candidates, 0, distance)
        done = 0
        while done < rounds or len(candidates) < k:
            done += 1
            drawn = _draw(state, oversample * k, f"{seed}/round{done}")
            if drawn is None:
                break  # every point coincides with a candidate
            if not drawn:
                continue
            ids += [x.id for x in drawn]
            fresh = np.array([x.v for x in drawn])
            state = _measured(state, fresh, len(candidates), distance)
            candidates = np.concatenate([candidates, fresh])
        counts = state.groupBy("near").count().collect()  # a row per candidate at most
        weights = np.zeros(len(candidates))
        weights[[x.near for x in counts]] = [x["count"] for x in counts]
    return candidates[weighted_seeds(ids, candidates, weights, k, seed, distance)]


def _measured(state: DataFrame, fresh: np.ndarray, known: int, distance: str) -> DataFrame:
    """``id, v, d, near``: distance to and number of the nearest candidate, now that ``fresh`` ones follow
    the ``known`` ones; written as a table."""
    width = fresh.shape[1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, present = batch_matrix(batch.column("v"), width)
            if not present.all():
                raise ValueError("a point has no vector")
            near, d = nearest_rows(block, fresh, distance)
            near, d = near + known, _settled(d, distance)
            if known:
                before = batch.column("d").to_numpy()
                closer = d < before
                d = np.where(closer, d, before)
                near = np.where(closer, near, batch.column("near").to_numpy())
            columns = [batch.column("id"), batch.column("v"), pa.array(d), pa.array(near.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "d", "near"])

    kind = state.schema["id"].dataType.simpleString()
    return materialise(state.mapInArrow(compare, f"id {kind}, v array<double>, d double, near int"), "seeding")


def _settled(d: np.ndarray, distance: str) -> np.ndarray:
    """Cosine distances under 1e-12 are rounding: the directions are the same."""
    return np.where(d < 1e-12, 0.0, d) if distance == "cosine" else d


def _draw(state: DataFrame, wanted: float, name: str) -> list | None:
    """Points with the chance ``wanted * d^2 / sum of d^2``; None if all distances are 0."""
    largest = state.agg(F.max("d")).first()[0]
    if not largest:
        return None
    part = F.col("d") * F.col("d") / F.lit(largest * largest)
    whole = F.floor(part * _PARTS).cast("decimal(38,0)")
    total = float(state.agg(F.sum(whole)).first()[0]) / _PARTS
    chance = F.lit(wanted) * part / F.lit(total)
    lucky = state.where(hash_uniform(name, F.col("id")) < chance).where("d > 0")
    return lucky.select("id", "v").orderBy("id").collect()  # about ``wanted`` rows


def weighted_seeds(
    ids: list, candidates: np.ndarray, weights: np.ndarray, k: int, seed: int, distance: str
) -> list[int]:
    """Places of at most ``k`` candidates by k-means++ with weights: each next one has the largest
    ``ln(u) / (weight * d^2)``, where ``u`` is a hash of its id and ``d`` the distance to the nearest chosen one."""
    chosen: list[int] = []
    away = np.full(len(ids), np.inf)
    for step in range(k):
        free = weights > 0 if not chosen else (weights > 0) & (away > 0)
        if not free.any():
            break
        keys = np.full(len(ids), -np.inf)
        for n in np.flatnonzero(free).tolist():
            weight = weights[n] * (away[n] * away[n] if chosen else 1.0)
            keys[n] = math.log(_uniform(f"{seed}/{step}", ids[n])) / weight
        chosen.append(int(np.argmax(keys)))
        found = distances_to(candidates, candidates[chosen[-1]], distance)
        away = np.minimum(away, _settled(np.sqrt(found) if distance == "euclidean" else found, distance))
    return chosen


def _uniform(name: str, key: object) -> float:
    """``hash_uniform`` of one key, here."""
    return (int(hashlib.md5(f"{name}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32
