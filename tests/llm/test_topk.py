import math
import random

import numpy as np
import pytest

from wattloom.llm import queries, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def expected(rows, step=20, k=20):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for q, a in usable:
        if q % step == 0:
            scores = sorted(
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b)
            )
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_query(spark, sf):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(x) for x in queries.op10_impact_top_k(spark, sf).collect()) == expected(rows)


def odd_vectors():
    random.seed(3)
    rows = [(n, [random.gauss(0, 1) for _ in range(8)]) for n in range(300)]
    rows += [(300 + n, [0.5] * 8) for n in range(60)]  # ties
    rows += [(400, None), (401, [None] * 8), (420, [math.nan] + [0.0] * 7), (440, [math.inf] * 8), (None, [1.0] * 8)]
    rows += [(460, [1.0, 2.0]), (461, [3.0, -1.0]), (480, []), (500, [0.0] * 8), (520, [-1e-9] * 8), (521, [9e4] * 8)]
    return rows


@pytest.mark.parametrize("block", [8192, 64])
def test_odd_vectors(spark, clashing, block):
    rows = odd_vectors()
    vectors = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).drop("label"))
    got = topk.top_k(vectors, "vec_id % 20 = 0", block=block, query_block=16).collect()
    assert sorted(tuple(x) for x in got) == expected(rows)


def test_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), "vec_id % 20 = 0").count() == 0


@pytest.mark.parametrize("spread", [40, 5000])
def test_early_stop_is_exact(spread):
    rng = np.random.default_rng(5)
    values = rng.integers(-spread, spread, (3000, 16))
    values[:400] = values[0]
    index = topk.ImpactIndex(np.arange(3000), values)
    for q in (0, 5, 2999):
        every = values @ values[q]
        want = sorted((-int(s), i) for i, s in enumerate(every) if i != q)[:20]
        for floor in (None, float(-want[-1][0]), float(-want[5][0])):
            places, scores = index.top(q, values[q], 20, floor, few=30)
            got = [(-int(s), int(i)) for s, i in zip(scores, index.ids[places])]
            assert got == [x for x in want if floor is None or -x[0] >= floor]


def test_levels_fall_and_hold_every_dimension():
    rng = np.random.default_rng(6)
    index = topk.ImpactIndex(np.arange(500), rng.integers(-9, 9, (500, 32)))
    query = rng.integers(-9, 9, 32).astype(float)
    order, starts = index.levels(query)
    impact = np.abs(query) * index.range
    assert sorted(order.tolist()) == list(range(32)) and len(starts) <= topk.LEVELS + 2
    steps = np.floor(impact * topk.LEVELS / impact.max())[order]
    assert (np.diff(steps) <= 0).all()
    assert [len(set(steps[a:b])) for a, b in zip(starts[:-1], starts[1:])] == [1] * (len(starts) - 1)


def test_a_floor_saves_most_of_the_rescoring():
    rng = np.random.default_rng(7)
    values = rng.normal(0, 8, (8192, 64)).astype(np.int64)
    index, rescored = topk.ImpactIndex(np.arange(8192), values), []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            rescored.append(len(self))
            return np.asarray(self) @ other

    index.values = values.view(Counted)
    for query in values[:50]:
        floor = float(np.sort(values @ query)[-40])
        index.top(-1, query, 20, floor)
    assert sum(rescored) / 50 < 0.07 * 8192


def test_repeated_queries_have_their_results_again(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (20, [1.0, 0.0])]
    got = topk.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), "vec_id % 20 = 0").collect()
    near, far = [(20, 1, 1, 2048), (20, 2, 2, 1024)], [(20, 1, 2, 2048), (20, 2, 1, 1024)]
    assert sorted(map(tuple, got)) == sorted(near * 2 + far)
