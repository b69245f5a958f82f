import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wattloom.llm import queries, resample

TARGET = "item_id long, text string"


def grams(text, most=1):
    found = brute.words(text)
    return [" ".join(found[at : at + n]) for n in range(1, most + 1) for at in range(len(found) - n + 1)]


def expected(docs, target, most=1, buckets=10_000, min_words=20, percent=10):
    def count(texts):
        out = np.zeros(buckets, np.int64)
        for text in texts:
            for gram in grams(text, most):
                out[zlib.crc32(gram.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    ss, tt = int(s.sum()), int(t.sum())
    rows = []
    for doc, text in docs:
        mine = [zlib.crc32(g.encode()) % buckets for g in grams(text, most)]
        weight = sum(
            math.floor(1000 * math.log(float((int(t[b]) + 1) * (ss + buckets)) / float((int(s[b]) + 1) * (tt + buckets))))
            for b in mine
        )
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc, len(mine), weight, score, None, len(brute.words(text))])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for n, row in enumerate(fit[: percent * len(fit) // 100]):
        row[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_query(spark, sf):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(queries.op12_importance_resampling(spark, sf)) == expected(docs, target)


def many(odd_rows):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "é1", "漢字", "x"] + [f"w{n}" for n in range(300)]
    made = [(100 + n, " ".join(rng.choices(words, k=rng.randrange(10, 60)))) for n in range(400)]
    copies = [(n, "one text that very many rows hold " * 4) for n in range(600, 800)]
    return [*odd_rows, *made, *copies, *[(None, copies[0][1])] * 30, *[(900, made[0][1])] * 50]


@pytest.mark.parametrize("most", [1, 3])
def test_odd_rows(spark, make_docs, odd_rows, clashing, most):
    rows = many(odd_rows)
    target = ["alpha beta w1 w2", None, "", "W1 w2 é1"]
    items = spark.createDataFrame(list(enumerate(target)), TARGET).withColumn("buckets", F.lit(1))
    docs = clashing(make_docs(rows)).select("*", *[F.lit("y").alias(n) for n in ("weight", "rank", "buckets", "row_id")])
    found = got(resample.resample(docs.repartition(5), items, most))
    assert found == expected(rows, target, most)
    ranks = sorted(x[4] for x in found if x[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_nothing(spark, make_docs):
    items = spark.createDataFrame([(1, "a target")], TARGET)
    assert resample.resample(make_docs([]), items).count() == 0
    few = make_docs([(n, "too short") for n in range(30)])
    assert {x.rank for x in resample.resample(few, items).collect()} == {None}
    rows = [(n, f"w{n} " * 30) for n in range(20)]
    assert got(resample.resample(make_docs(rows), spark.createDataFrame([], TARGET))) == expected(rows, [])


def test_words_of_neighbours_make_no_n_grams():
    texts = [b"one two", b"", b"  ", b"Three", b"four,five six", b"\xc3\xa9t\xc3\xa9"]
    n_words, n_features, flat = resample.batch_features(texts, 2, resample.Hasher(1 << 31))
    want = [[zlib.crc32(g.encode()) % (1 << 31) for g in grams(x.decode(), 2)] for x in texts]
    assert n_words.tolist() == [2, 0, 0, 1, 3, 1]
    assert n_features.tolist() == [len(x) for x in want]
    assert flat.tolist() == [b for x in want for b in x]


def test_slices_cover_every_text():
    texts = [b"x" * n for n in (1, 9, 0, 30, 2, 2, 11)]
    found = [texts[part] for part in resample._slices(texts, 10)]
    assert [x for part in found for x in part] == texts
    assert all(len(part) == 1 or sum(map(len, part)) <= 10 for part in found)
    assert list(resample._slices([])) == []


def test_hasher_forgets_and_stays_right():
    bucket = resample.Hasher(97, limit=10)
    assert [bucket[b"%d" % n] for n in range(50)] == [zlib.crc32(b"%d" % n) % 97 for n in range(50)]
    assert len(bucket) <= 10


def test_the_sample_looks_like_the_target(spark, make_docs):
    rng = random.Random(8)
    rows = [(n, " ".join(rng.choices(("law", "court", "judge") if n % 4 == 0 else ("goal", "team", "match"), k=25))) for n in range(400)]
    items = spark.createDataFrame([(1, "the court and the judge read the law " * 20)], TARGET)
    drawn = resample.resample(make_docs(rows), items).where("rank IS NOT NULL").collect()
    assert len(drawn) == 40 and all(x.doc_id % 4 == 0 for x in drawn)


def test_ranks_need_no_single_task(spark, make_docs):
    """The sort is by range; the only window is over a row per partition."""
    weighed = spark.range(5000).selectExpr(
        "id AS row_id", "id AS doc_id", "30L AS n_words", "30L AS n_features", "id % 7 AS weight", "id % 7 AS score"
    )
    drawn = resample.draw(weighed)
    ranks = sorted((x["rank"], x.score, x.doc_id) for x in drawn.where("rank IS NOT NULL").collect())
    want = sorted(range(5000), key=lambda n: (-(n % 7), n))[:500]
    assert ranks == [(n + 1, i % 7, i) for n, i in enumerate(want)]
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert len(windows) == 1 and "part" in windows[0]
