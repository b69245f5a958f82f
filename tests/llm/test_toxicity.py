import math
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from wattloom.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_thresholds_and_weights_of_known_grades():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2, (4000, 3)) * rng.random((4000, 3)) * 2
    score = values @ [3.0, -2.0, 0.0]
    grades = ((score + rng.logistic(size=4000))[:, None] > [1.0, 2.5]).sum(1)
    rows = [dict(enumerate(x)) for x in values.tolist()]
    weights, cuts = toxicity.fit_ordinal(rows, grades.tolist(), 3, 2, steps=800)
    assert np.allclose(weights, [3, -2, 0], atol=0.35) and np.allclose(cuts, [1, 2.5], atol=0.35)


def test_held_out_documents(spark):
    """Fitted on the labels of half of the documents, judged on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_severity(docs, labels.where("doc_id % 2 = 0"))
    scored = toxicity.score_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [x.rejected for x in scored if x.toxic]
    clean = [x.rejected for x in scored if not x.toxic]
    assert len(toxic) > 100 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01


def test_query(spark, sf):
    got = queries.op8_ordinal_toxicity(spark, sf).collect()
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for x in got:
        assert list(x.above) == sorted(x.above, reverse=True)
        assert x.expected_severity == pytest.approx(sum(x.above)) and x.rejected == (x.above[0] > 0.5)
    known = [(x.rejected, labels[x.doc_id]) for x in got if x.doc_id in labels]
    assert np.mean([r == bool(t) for r, t in known]) >= 0.95
    assert np.mean([r for r, t in known if not t]) <= 0.005


def toxic_docs():
    clean = [(n, f"some plain text number {n} of the corpus") for n in range(60)]
    toxic = [(100 + n, "some plain text " + "dreadful " * (1 + n % 5) + f"number {n}") for n in range(30)]
    return clean + toxic


def labels_of(spark, rows):
    return spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows], LABELS)


def test_grades_rise_with_density(spark, make_docs, odd_rows, clashing):
    rows = toxic_docs()
    odd_rows = [(i if i is None else 1000 + i, text) for i, text in odd_rows]  # ids of their own
    docs = clashing(make_docs(rows + [(200, "dreadfully " * 50), (201, "a dreadful text " + "plain " * 20_000)] + odd_rows))
    model = toxicity.fit_severity(docs, labels_of(spark, rows))
    got = {x.doc_id: x for x in toxicity.score_documents(docs, model).collect()}
    assert all(got[i].rejected == (i >= 100) for i, _ in rows)
    assert got[104].expected_severity > got[100].expected_severity and got[200].grade == 3
    # One word in 20,003 counts, wherever it stands, but is too thin to reject the text.
    assert got[1].expected_severity < got[201].expected_severity < got[100].expected_severity
    assert not got[201].rejected
    assert not any(got[i].rejected for i, _ in odd_rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == 60 + 1 + len(odd_rows)


def test_bounded_sample_and_odd_labels(spark, make_docs):
    rows = toxic_docs()
    labels = labels_of(spark, rows).unionByName(spark.createDataFrame([(0, 1, None), (None, 1, 1), (100, 0, 0)], LABELS))
    sample = toxicity.labelled_sample(make_docs(rows), labels, 40)
    assert sample.count() == 40
    model = toxicity.fit_severity(make_docs(rows), labels)
    assert toxicity.score_documents(make_docs([(1, "dreadful")]), model).first().rejected


def features_of(text):
    """By the description: words, and their beginnings of 4 to 6 bytes."""
    words = [w.encode() for w in brute.words(text)]
    return words, [f for w in words for f in ["=" + w.decode("latin-1"), *("^" + w[:n].decode("latin-1") for n in (4, 5, 6) if len(w) >= n)]]


def named(feature):
    return feature.decode("latin-1")


def test_query_by_its_description(spark, sf):
    """Features, grades, the optimum of the likelihood and the scores, restated without the operator's code."""
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    parsed = {i: features_of(t) for i, t in docs}
    toxic = [set(parsed[i][1]) for i, y in labels.items() if y]
    clean = [set(parsed[i][1]) for i, y in labels.items() if not y]
    count, against = Counter(f for x in toxic for f in x), Counter(f for x in clean for f in x)
    odds = {
        f: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((against[f] + 0.5) / (len(clean) + 1))
        for f, n in count.items()
        if n >= max(3, 0.02 * len(toxic))
    }
    chosen = {f for f, x in odds.items() if x >= 3.5}
    model = toxicity.fit_severity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    place = {named(f): n for f, n in model.features.items()}
    assert set(place) == chosen and len(chosen) < 4096

    def values(i):
        words, found = parsed[i]
        hits = [f for f in found if f in chosen]
        row = np.zeros(len(chosen) + 1)
        if hits:
            row[[place[f] for f in hits]] = 1
            row[-1] = math.log1p(1000 * len(hits) / len(words))
        return row

    matrix = np.array([values(i) for i in labels])
    dense = matrix[:, -1]
    cuts = np.quantile([d for d, y in zip(dense, labels.values()) if y], [1 / 3, 2 / 3])
    grades = np.array([1 + int((d > cuts).sum()) if y else 0 for d, y in zip(dense, labels.values())])

    def loss(weights, thresholds):
        above = 1 / (1 + np.exp(np.clip(thresholds - (matrix @ weights)[:, None], -40, 40)))
        steps = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        chance = np.maximum(-np.diff(steps, axis=1)[np.arange(len(grades)), grades], 1e-9)
        return -np.log(chance).mean() + 0.01 / len(grades) * weights @ weights

    best = loss(model.weights, model.thresholds)
    assert best < 0.25 * loss(np.zeros(len(chosen) + 1), np.array([2.0, 3.0, 4.0]))
    rng = np.random.default_rng(2)
    for _ in range(200):  # nothing near it is better by much
        nudge, shift = rng.normal(0, 0.05, len(model.weights)), np.sort(rng.normal(0, 0.05, 3))
        assert loss(model.weights + nudge, model.thresholds + shift) > best - 2e-3
    for x in queries.op8_ordinal_toxicity(spark, sf).collect():
        above = 1 / (1 + np.exp(model.thresholds - values(x.doc_id) @ model.weights))
        assert x.n_words == len(parsed[x.doc_id][0]) and list(x.above) == pytest.approx(above.tolist())
        assert x.grade == int(np.argmax(-np.diff([1.0, *above, 0.0]))) and x.rejected == (above[0] > 0.5)


@pytest.mark.parametrize("count", [0, 1, 37, 400, 5000])
def test_the_smallest_hashes_are_chosen_without_ranking_all(spark, count):
    known = spark.range(400).selectExpr("id AS doc_id", "0 AS toxic").repartition(5)
    got = {x.doc_id for x in toxicity._smallest_hashes(known, count).collect()}
    want = known.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(count).collect()
    assert got == {x.doc_id for x in want}
    assert toxicity._smallest_hashes(known.limit(0), 5).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(100, 1, 1)]])
def test_without_both_classes_nothing_is_rejected(spark, make_docs, rows):
    docs = make_docs(toxic_docs())
    model = toxicity.fit_severity(docs, spark.createDataFrame(rows, LABELS))
    got = toxicity.score_documents(docs, model)
    assert got.where("rejected OR expected_severity > 0").count() == 0 and got.count() == 90


def test_nothing(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    model = toxicity.fit_severity(make_docs([]), labels)
    assert toxicity.score_documents(make_docs([]), model).count() == 0


def test_a_repeated_id_is_sampled_once(spark, make_docs):
    rows = toxic_docs()
    many = [(100, f"a quite ordinary text, number {n % 40}") for n in range(200)]
    labels = labels_of(spark, rows)
    sample = toxicity.labelled_sample(make_docs(rows + many), labels, 20_000)
    assert sample.count() == len(rows)
    assert sample.where("toxic").count() == sum(i >= 100 for i, _ in rows)
    assert toxicity.labelled_sample(make_docs(rows + many), labels, 10).count() == 10
    model = toxicity.fit_severity(make_docs(rows + many), labels)
    scored = toxicity.score_documents(make_docs(rows + many), model).collect()
    assert len(scored) == len(rows) + len(many)
    assert {x.doc_id: x.rejected for x in scored if x.doc_id != 100} == {i: i >= 100 for i, _ in rows if i != 100}
