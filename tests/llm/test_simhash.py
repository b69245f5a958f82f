import random

import numpy as np
import pytest

from tests.llm import brute
from wattloom.llm import queries, simhash


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(x.doc_id, brute.simhash(x.text)) for x in docs]
    want = sorted((i, f"{fp:016x}", c) for i, fp, c in brute.components(prints))
    assert sorted(tuple(x) for x in queries.op5_simhash(spark, sf).collect()) == want


def groups(docs):
    found = simhash.near_duplicate_groups(docs)
    return sorted(str((x.doc_id, x.fp % (1 << 64), x.component_id)) for x in found.collect())


def test_odd_rows(make_docs, odd_rows, clashing):
    prints = [(i, brute.simhash(t)) for i, t in odd_rows]
    assert groups(clashing(make_docs(odd_rows))) == sorted(map(str, brute.components(prints)))


def test_nothing(make_docs):
    assert groups(make_docs([])) == []
    assert simhash.without_near_duplicates(make_docs([])).count() == 0


def near_values(count, seed):
    """Fingerprints in clouds, in chains, and alone."""
    random.seed(seed)
    values = set()
    for _ in range(6):
        centre = random.getrandbits(64)
        for _ in range(count):
            values.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))))
        for _ in range(30):
            centre ^= sum(1 << b for b in random.sample(range(64), 4))
            values.add(centre)
    values.update(random.getrandbits(64) for _ in range(200))
    return sorted(values)


@pytest.mark.parametrize("tile", [16, 4096])
def test_all_links_are_found_in_buckets_of_any_size(spark, tile):
    values = near_values(60, tile)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.linked_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, tile)
    labels = {x.node: x.label for x in simhash.components(links).collect()}
    ids = dict(zip(signed, values))
    for a, b in [(x.a, x.b) for x in links.collect()]:
        assert a != b
    groups_got, groups_want = {}, {}
    for s in signed:
        groups_got.setdefault(labels.get(s, s), set()).add(ids[s])
    for n, fp, c in brute.components(list(enumerate(values))):
        groups_want.setdefault(c, set()).add(fp)
    assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_want.values()))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_slices_compare_like_popcount(radius):
    values = np.array(near_values(40, radius), np.uint64)
    sizes = np.array([1, 63, 64, 65, len(values) - 193])
    pairs = set()
    for a, b in simhash.BitSlices(values.view(np.int64), sizes).near(radius, step=50):
        assert len(set(zip(a.tolist(), b.tolist())) & pairs) == 0
        pairs.update(zip(a.tolist(), b.tolist()))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    want = {
        (i, j)
        for first, last in zip(bounds, bounds[1:])
        for i in range(first, last)
        for j in range(i + 1, last)
        if (int(values[i]) ^ int(values[j])).bit_count() <= radius
    }
    assert pairs == want


@pytest.mark.parametrize("blocks", [5, 6, 7, 8, 9, 10])
def test_linked_fingerprints_share_a_bucket(blocks):
    random.seed(blocks)
    masks = [m % (1 << 64) for m in simhash.bucket_masks(blocks, 4)]
    for _ in range(300):
        a = random.getrandbits(64)
        b = a ^ sum(1 << x for x in random.sample(range(64), 4))
        assert any(a & m == b & m for m in masks)


def test_one_row_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows + [(20, "equal text of two rows"), (21, "one  two three four five"), (22, "ONE two three four five")])
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    assert (5, "equal text of two rows") in got and (21, "one  two three four five") in got
    assert (1, None) in got and (None, "a row without an id, and with words") in got
    assert not {2, 3, 6, 20, 22} & {i for i, _ in got}
    assert got.count((7, "a repeated row")) == 1 and (7, "another text with the same id") in got


def test_columns_of_the_input_keep_their_values(make_docs, clashing, odd_rows):
    names = ["_text_key", "_id", "_key", "row", "key", "id", "own_id", "keeper", "label", "node"]
    docs = clashing(make_docs(odd_rows))
    docs = docs.selectExpr("*", *[f"'y' AS {n}" for n in names if n not in docs.columns])
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert all(x[n] == "y" for x in kept.collect() for n in names if n != "label")
