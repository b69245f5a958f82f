import hashlib
import math
import random

import numpy as np
import pytest

from wattloom.llm import centroids, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def expected(rows, k=16, rounds=3, width=64, seed=1):
    """Everything by definition, in whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    if not kept:
        return []

    def named(i):
        return hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()

    model = [v for _, v in sorted(kept, key=lambda x: (named(x[0]), x[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(model))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        model = [
            [sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(model)
        ]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model]
    total = sum(inertia.values())
    return sorted(((i, n, d, inertia[n], total, said[n]) for i, d, n in found), key=repr)


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_query(spark, sf):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(queries.op13_centroid_clustering(spark, sf)) == expected(rows)


def odd_vectors(width=8):
    rng = random.Random(3)
    rows = [(n, [rng.gauss(0, 1) for _ in range(width)]) for n in range(200)]
    rows += [(300 + n, [0.5] * width) for n in range(120)]  # one vector as a third of all
    rows += [(500, None), (501, [None] * width), (502, [math.nan] + [0.0] * (width - 1)), (503, [math.inf] * width)]
    rows += [(504, [1.0]), (505, []), (None, [0.25] * width), (None, [-3.0] * width), (None, [0.25] * width)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (506, [0.0] * width), (507, [-1e-9] * width), (508, [9e3] * width)]
    return rows


@pytest.mark.parametrize("k", [1, 16, 400])
def test_odd_vectors(spark, clashing, k):
    rows = odd_vectors()
    vectors = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).drop("label")).selectExpr(
        "*", "'y' AS v", "'y' AS cluster", "'y' AS distance", "'y' AS hash"
    )
    found = centroids.cluster_vectors(vectors.repartition(5), k=k, width=8)
    assert got(centroids.cluster_digest(found)) == expected(rows, k, width=8)


def test_nothing(spark):
    empty = centroids.cluster_vectors(spark.createDataFrame([], VECTORS))
    assert got(centroids.cluster_digest(empty)) == []
    unusable = spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], VECTORS)
    assert centroids.cluster_digest(centroids.cluster_vectors(unusable)).count() == 0


def test_components_beyond_the_bound_are_an_error(spark):
    vectors = spark.createDataFrame([(1, [1e9] * 64, 0)], VECTORS)
    with pytest.raises(Exception, match="scaled component"):
        centroids.cluster_vectors(vectors)


@pytest.mark.parametrize("spread", [3, 1000, 1 << 22])
def test_search_is_exact_and_skips_distances(spread):
    rng = np.random.default_rng(spread)
    middle = rng.integers(-spread, spread, (200, 1))
    model = middle + rng.integers(-spread // 8 - 1, spread // 8 + 2, (200, 64))
    model[50:60] = model[0]  # equal centroids: the smallest number
    model[60:70] = -model[0]
    rows = np.concatenate([model[rng.integers(0, 200, 500)] + rng.integers(-2, 3, (500, 64)), model])
    best, least, taken = centroids.SortedCentroids(model).nearest(rows)
    every = ((rows[:, None, :] - model[None, :, :]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert taken < 0.5 * every.size


def test_bounds_hold_for_vectors_without_deviation():
    model = np.array([[5] * 64, [-5] * 64, [0] * 64, [(1 << 23)] * 64, [(1 << 23) - 1] * 64])
    rows = np.array([[4] * 64, [(1 << 23) - 1] * 64, [3] * 32 + [2] * 32, [0] * 63 + [1]])
    best, least, _ = centroids.SortedCentroids(model).nearest(rows)
    every = ((rows[:, None, :] - model[None, :, :]) ** 2).sum(axis=2)
    assert best.tolist() == every.argmin(axis=1).tolist() and least.tolist() == every.min(axis=1).tolist()
