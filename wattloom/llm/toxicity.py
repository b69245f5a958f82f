"""Severity of toxic text by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w x - t_j) with one weight vector for all thresholds t_0 < t_1 < ...; the
expected severity is the sum of these probabilities, and a document is rejected when it is more
likely than not above grade 0.

The labels say toxic or not, not how much. Grades 1 to ``grades`` of the toxic documents are equal
groups by density: occurrences of the chosen features per word. Features are words and their
beginnings (4 to 6 bytes, so that inflected and compound forms count) that occur much more often in
toxic documents than in others; their value is 1 where they occur, and one more feature is
log(1 + 1000 * density).

The model is fitted on at most ``sample_docs`` labelled documents, those with the smallest hash of
their id, read whole; of rows with one id the text with the smallest hash stands for all, so no id
dominates the fit. Everything is scored, whole, without a shuffle.

Edge cases: a null or empty text has no features and gets the model's severity for none; repeated rows
get equal rows; a null id gets a row; of several labels of one id the largest counts, null labels
don't; without labels, or with one class only, severity is 0 and nothing is rejected; an empty table
gives an empty result; other columns are ignored (``keep_clean`` returns them).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_batches, raw_texts, word_list
from wattloom.storage import materialise

_BEGINNINGS = (4, 5, 6)


def word_features(word: bytes) -> list[bytes]:
    """A word, and its beginnings if it is longer than them."""
    return [b"=" + word, *(b"^" + word[:n] for n in _BEGINNINGS if len(word) >= n)]


@dataclass
class SeverityModel:
    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray
    reject_above: float = 0.5

    def values(self, words: list[bytes], memo: dict) -> dict[int, float]:
        """Features of a text that are not 0: 1 for each chosen one in it, and their density last."""
        found: Counter = Counter()
        for word in words:
            known = memo.get(word)
            if known is None:
                known = tuple(self.features[f] for f in word_features(word) if f in self.features)
                if len(memo) > 500_000:
                    memo.clear()
                memo[word] = known
            for feature in known:
                found[feature] += 1
        if not found:
            return {}
        density = float(np.log1p(1000 * sum(found.values()) / len(words)))
        return dict.fromkeys(found, 1.0) | {len(self.features): density}

    def score(self, values: dict[int, float]) -> float:
        return float(sum(self.weights[k] * v for k, v in values.items()))

    def above(self, score: float) -> list[float]:
        """P(grade > j) for each threshold."""
        return (1 / (1 + np.exp(self.thresholds - score))).tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """``text, toxic`` of at most ``sample_docs`` labelled documents, as a written table."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = _smallest_hashes(known, sample_docs)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ids may repeat here
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))  # also before the shuffle
    single = joined.groupBy("doc_id").agg(first.text.alias("text"), F.max("toxic").alias("toxic"))
    return materialise(single.select("text", (F.col("toxic") > 0).alias("toxic")), "labelled")


def _smallest_hashes(known: DataFrame, count: int) -> DataFrame:
    """The ``count`` rows with the smallest hash of their id. Counts per upper 16 bits of the hash find the
    range that holds the last one, so only that range is ranked, whatever the number of rows and tasks."""
    hashed = known.withColumn("hash", F.xxhash64("doc_id")).withColumn("range", F.shiftright("hash", 48))
    sizes = sorted(map(tuple, hashed.groupBy("range").agg(F.count("*")).collect()))  # at most 65,536 rows
    left, last = count, None
    for number, size in sizes:
        last = number
        if size >= left:
            break
        left -= size
    if last is None:
        return known
    ranked = hashed.where(F.col("range") == last).orderBy("hash", "doc_id").limit(max(left, 0))
    return hashed.where(F.col("range") < last).unionByName(ranked).select(*known.columns)


def _document_counts(sample: DataFrame, wanted: frozenset | None) -> DataFrame:
    """Number of documents with each feature (of ``wanted``, if given)."""

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch, "text"):
                features = {f for w in set(word_list(raw)) for f in word_features(w)}
                counts.update(features if wanted is None else features & wanted)
        names = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(names, ["feature", "n"])

    partial = sample.select("text").mapInArrow(count, "feature binary, n long")
    return partial.groupBy("feature").agg(F.sum("n").alias("n"))


def choose_features(
    sample: DataFrame, least: int, share: float, log_odds: float, limit: int, considered: int = 50_000
) -> dict[bytes, int]:
    """At most ``limit`` features with the strongest evidence, of those that at least ``least`` toxic
    documents, and this ``share`` of them, have. Of these, the ``considered`` most frequent ones are compared
    with the clean documents."""
    toxic, clean = sample.where("toxic"), sample.where("NOT toxic")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    often = _document_counts(toxic, None).where(F.col("n") >= max(least, share * n_toxic)).orderBy(F.desc("n"), "feature")
    in_toxic = {bytes(x.feature): x.n for x in often.limit(considered).collect()}
    rows = _document_counts(clean, frozenset(in_toxic)).collect()  # at most ``considered``
    in_clean = {bytes(x.feature): x.n for x in rows}
    odds = {
        f: np.log((n + 0.5) / (n_toxic + 1)) - np.log((in_clean.get(f, 0) + 0.5) / (n_clean + 1))
        for f, n in in_toxic.items()
    }
    strong = sorted((-x * in_toxic[f], f) for f, x in odds.items() if x >= log_odds)
    return {f: n for n, (_, f) in enumerate(strong[:limit])}


def fit_ordinal(
    rows: list[dict], values: list[int], width: int, levels: int, l2: float = 0.02, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by gradient steps (Adam) on the likelihood of the grades.

    ``rows`` are sparse: feature to value. Grade ``g`` of ``levels`` + 1 has the probability
    P(> g - 1) - P(> g).
    """
    place = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column = np.array([k for x in rows for k in x], np.int64)
    value = np.array([v for x in rows for v in x.values()])
    grade = np.array(values)
    # Thresholds are the first one and logarithms of the gaps, so they stay in order.
    theta = np.concatenate([np.zeros(width), [2.0], np.zeros(levels - 1)])
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, cuts = _unpack(theta, width)
        score = np.bincount(place, value * weights[column], len(rows)) if len(column) else np.zeros(len(rows))
        upper = np.append(np.inf, -cuts)[:, None] + score  # row g: the margin above threshold g - 1
        up = 1 / (1 + np.exp(-np.clip(upper[grade, np.arange(len(rows))], -40, 40)))
        lower = np.vstack([upper[1:], np.full(len(rows), -np.inf)])[grade, np.arange(len(rows))]
        low = 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        chance = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / chance, low * (1 - low) / chance
        d_up[grade == 0], d_low[grade == levels] = 0, 0
        slope = -(d_up - d_low) / len(rows)
        d_weights = np.bincount(column, value * slope[place], width) if len(column) else np.zeros(width)
        d_cuts = np.zeros(levels)
        np.add.at(d_cuts, grade[grade > 0] - 1, d_up[grade > 0] / len(rows))
        np.add.at(d_cuts, grade[grade < levels], -d_low[grade < levels] / len(rows))
        tail = np.cumsum(d_cuts[::-1])[::-1]
        gradient = np.concatenate([d_weights + l2 / len(rows) * weights, [tail[0]], tail[1:] * np.exp(theta[width + 1 :])])
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return _unpack(theta, width)


def _unpack(theta: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return theta[:width], theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1 :]))])


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    grades: int = 3,
    sample_docs: int = 20_000,
    least: int = 3,
    share: float = 0.02,
    log_odds: float = 3.5,
    limit: int = 4096,
    considered: int = 50_000,
) -> SeverityModel:
    """Choose features and fit the model on a bounded sample of labelled documents.

    The bounds of the fit, none of which touches what is scored: ``sample_docs`` documents are read;
    features of fewer than ``least`` toxic documents or less than ``share`` of them are left out, and so are those
    with log odds under ``log_odds``; of the rest the ``considered`` most frequent are looked at and the
    ``limit`` with the strongest evidence kept. What is lost by the last two is weak evidence from rare words: a
    toxic document that holds none of the kept features gets the severity of a text without any.
    """
    sample = labelled_sample(docs, labels, sample_docs)
    features = choose_features(sample, least, share, log_odds, limit, considered)
    if not features:
        return SeverityModel({}, np.zeros(0), np.full(grades, np.inf))
    model = SeverityModel(features, np.zeros(len(features) + 1), np.zeros(grades))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo: dict = {}
        values = [model.values(word_list(x), memo) for x in raw_texts(batch, "text")]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("toxic"),
                pa.array([list(x) for x in values], pa.list_(pa.int64())),
                pa.array([list(x.values()) for x in values], pa.list_(pa.float64())),
            ],
            ["toxic", "features", "amounts"],
        )

    kinds = "toxic boolean, features array<long>, amounts array<double>"
    rows = map_batches(sample.select("toxic", "text"), count, kinds).collect()  # at most sample_docs
    sparse = [dict(zip(x.features, x.amounts)) for x in rows]
    dense = [x.get(len(features), 0.0) for x in sparse]
    cuts = np.quantile([d for x, d in zip(rows, dense) if x.toxic], np.arange(1, grades) / grades)
    values = [1 + int(np.searchsorted(cuts, d, "left")) if x.toxic else 0 for x, d in zip(rows, dense)]
    model.weights, model.thresholds = fit_ordinal(sparse, values, len(features) + 1, grades)
    return model


def score_documents(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """``doc_id, n_words, expected_severity, grade, above, rejected`` of every row; ``above`` has
    P(grade > j) and ``grade`` is the most probable one."""

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"doc_id": i, **x} for i, x in zip(batch.column("doc_id").to_pylist(), _scores(batch, model))], _SCORES
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n_words long, expected_severity double, grade int, above array<double>, rejected boolean"
    return map_batches(rows, score, kinds)


_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("expected_severity", pa.float64()),
        ("grade", pa.int32()),
        ("above", pa.list_(pa.float64())),
        ("rejected", pa.bool_()),
    ]
)


def _scores(batch: pa.RecordBatch, model: SeverityModel):
    memo: dict = {}
    for raw in raw_texts(batch, "text"):
        words = word_list(raw)
        above = model.above(model.score(model.values(words, memo)))
        each = -np.diff([1.0, *above, 0.0])
        yield {
            "n_words": len(words),
            "expected_severity": float(sum(above)),
            "grade": int(np.argmax(each)),
            "above": above,
            "rejected": above[0] > model.reject_above,
        }


def keep_clean(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """Rows of ``docs``, all columns, that are not rejected."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not x["rejected"] for x in _scores(batch, model)]))

    return map_batches(docs, keep, docs.schema)
