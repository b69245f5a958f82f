"""Importance resampling towards a target: documents whose word n-grams look like the target's.

Features are hashed n-grams. Every text is read once: a batch's texts are joined with a separator, one
regular expression finds all words of the batch, the documents' offsets are searched for the
words' places, n-grams that reach over two documents are masked, and the rest are counted by bucket.
The buckets of each document are written as a small table, so weights need no second reading
of the texts. A bucket's gain is the scaled logarithm of its share in the target over its share
in the corpus; a document's weight is the sum over its features, its score the weight plus Gumbel
noise from a hash of its id, so the highest scores are a sample without replacement.

The share of documents to draw is exact: a histogram of at most ``_BINS`` bins finds the bin of the last
one, rows in that bin and above are sorted over range partitions, and their ranks are the
partitions' offsets plus the place in them. No task holds more than a partition.

Edge cases: a null or empty text has no words and weight 0; repeated rows are drawn each; a null id
hashes as ``null`` and comes first among equal scores; rows of equal score and id
have equal results but for their ranks; an empty corpus gives an empty result, an empty target a gain by the corpus alone; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import WORD_BYTES, raw_texts
from wattloom.storage import fresh_path, materialise

_WORD = re.compile(rb"[^ ]+")
_BINS = 65_536
_FEATURES = "row_id long, doc_id long, n_words long, n_features long, buckets binary"


class Hasher(dict):
    """Bucket of an n-gram's bytes; about ``limit`` of them are remembered."""

    def __init__(self, buckets: int, limit: int = 300_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[gram] = bucket = zlib.crc32(gram) % self.buckets
        return bucket


def batch_features(texts: list[bytes], most: int, bucket: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch: words per document, features per document, and all buckets, document by document."""
    joined = b" ".join(texts).translate(WORD_BYTES)  # what separates words is a space now, as between texts
    words = _WORD.findall(joined)
    plain = np.frombuffer(joined or b" ", np.uint8) != 32
    starts = np.flatnonzero(plain & ~np.append(False, plain[:-1]))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.searchsorted(offsets, starts, "right") - 1
    owners, found = [], []
    for n in range(1, most + 1):
        last = owner[n - 1 :]
        grams = words if n == 1 else map(b" ".join, zip(*(words[at:] for at in range(n))))
        buckets = np.fromiter(map(bucket.__getitem__, grams), np.int64, len(last))
        inside = owner[: len(last)] == last
        owners.append(last[inside])
        found.append(buckets[inside])
    whose, flat = np.concatenate(owners), np.concatenate(found)
    if most > 1:
        order = np.argsort(whose, kind="stable")
        whose, flat = whose[order], flat[order]
    return np.bincount(owner, minlength=len(texts)), np.bincount(whose, minlength=len(texts)), flat


def _slices(texts: list[bytes], limit: int = 4 << 20) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    first, held = 0, 0
    for n, text in enumerate(texts):
        if n > first and held + len(text) > limit:
            yield slice(first, n)
            first, held = n, 0
        held += len(text)
    if texts:
        yield slice(first, len(texts))


def hashed_features(docs: DataFrame, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """``row_id, doc_id, n_words, n_features, buckets`` of every row (uint32, little-endian), as a written table."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )

    def extract(batches):
        bucket = Hasher(buckets)
        for batch in batches:
            raws = raw_texts(batch, "text")
            for part in _slices(raws):
                n_words, n_features, flat = batch_features(raws[part], most, bucket)
                ends = 4 * np.cumsum(n_features)
                body = flat.astype("<u4").tobytes()
                rows = [body[a:b] for a, b in zip((ends - 4 * n_features).tolist(), ends.tolist())]
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id").slice(part.start, size),
                        batch.column("doc_id").slice(part.start, size),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(n_features.astype(np.int64)),
                        pa.array(rows, pa.binary()),
                    ],
                    ["row_id", "doc_id", "n_words", "n_features", "buckets"],
                )

    path = fresh_path(docs.sparkSession, "hashed-features")
    texts.mapInArrow(extract, _FEATURES).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_FEATURES).parquet(path)


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features per bucket over all rows: each task counts its own, ``buckets`` rows meet at the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), "<u4")
            total += np.bincount(flat, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = features.select("buckets").mapInArrow(count, "bucket long, n long")
    summed = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """``floor(scale * ln(share in the target / share in the corpus))``, one added to every count."""
    buckets = len(corpus)
    above = (target + 1.0) * (float(corpus.sum()) + buckets)
    below = (corpus + 1.0) * (float(target.sum()) + buckets)
    return np.floor(scale * np.log(above / below)).astype(np.int64)


def weigh(features: DataFrame, gains: np.ndarray, seed: int = 2024, scale: float = 1000.0) -> DataFrame:
    """``row_id, doc_id, n_words, n_features, weight, score``."""
    schema = "row_id long, doc_id long, n_words long, n_features long, weight long"

    def weights(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("n_features").to_numpy()
            flat = np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u4")
            upto = np.append(0, np.cumsum(gains[flat]))
            ends = np.cumsum(sizes)
            weight = upto[ends] - upto[ends - sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight)], [*batch.schema.names[:4], "weight"])

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-scale) * F.log(-F.log((drawn + 0.5) / F.lit(2.0**32))))
    return features.mapInArrow(weights, schema).withColumn("score", F.col("weight") + noise)


def _ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``, 1 for the highest score; written in range partitions, whose sizes give the offsets."""

    def number(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(seen + 1, seen + batch.num_rows + 1)
            seen += batch.num_rows
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])

    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("row_id")]
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialise(sorted_rows.mapInArrow(number, f"{kinds}, part long, place long"), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("base") + F.col("place")).drop("part", "place", "base")


def draw(weighed: DataFrame, min_words: int = 20, percent: int = 10) -> DataFrame:
    """Add ``rank`` 1, 2, ... to the ``percent`` % (rounded down) of rows with at least ``min_words`` words
    that have the highest scores; NULL for the others. ``weighed`` should be a written table."""
    fit = F.col("n_words") >= min_words
    span = weighed.where(fit).agg(F.count("*"), F.min("score"), F.max("score")).first()
    wanted = percent * span[0] // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return weighed.select("*", unranked)
    low, width = span[1], max(1, math.ceil((span[2] - span[1] + 1) / _BINS))
    place = F.floor((F.col("score") - low) / width)
    bins = weighed.where(fit).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).collect()
    left = wanted
    for bin_, n in sorted(map(tuple, bins), reverse=True):
        cut, left = bin_, left - n
        if left <= 0:
            break
    above = fit & (place >= cut)
    ranked = _ranked(weighed.where(above))
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.select(*weighed.columns, "rank").unionByName(weighed.where(~above).select("*", unranked))


def resample(
    docs: DataFrame,
    target: DataFrame,
    most: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    min_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``doc_id, text``; ``target`` has ``text``."""
    corpus = hashed_features(docs, most, buckets)
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most, buckets)
    gains = bucket_gains(bucket_counts(corpus, buckets), bucket_counts(wanted, buckets))
    weighed = materialise(weigh(corpus, gains, seed), "weighed")
    return draw(weighed, min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
