"""Which words of a document stand inside a passage of a benchmark.

A prefix-filtered set join at containment 1. The windows of the items are sets of word shingles.
All shingles of the benchmark are counted over all documents; ordered by rarity, a window at
containment 1 needs a prefix of one shingle, its rarest. A document is a candidate for a window
where that shingle occurs; the length bound (the window must lie inside the document) and the
positional bound (it must start at a fixed distance before the shingle) leave one place, and there
the words are compared exactly.

The benchmark is cut into blocks of about ``block_words`` window words, each small enough to go
to every task. Blocks are handled one after the other: the index of one is built, sent out, its hits are
written, and it is dropped before the next one. Documents carry numbers of windows; the items that
hold a window, however many, are joined to them in Spark.

Edge cases: a null or empty text has no words and is clean; a null or empty item has no window; items of
fewer than ``window`` words are one window; repeated items each count; a null item id counts as the
string ``null``; repeated rows each get their own result; an empty benchmark leaves all
documents clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_batches, raw_texts, word_list
from wattloom.storage import materialise

_HITS = "doc_id long, text_hash long, n_words long, starts array<long>, ends array<long>, windows array<long>"


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``words`` (space-joined) of every distinct window, with the items that hold it."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, windows = [], []
        for item, raw in zip(batch.column("item_id").to_pylist(), raw_texts(batch, "text")):
            words = word_list(raw)
            places = range(max(1, len(words) - window + 1)) if words else ()
            for found in {b" ".join(words[at : at + window]) for at in places}:
                ids.append("null" if item is None else str(item))
                windows.append(found.decode())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.string())], ["item_id", "words"])

    return map_batches(benchmark.select("item_id", "text"), cut, "item_id string, words string")


class WindowIndex:
    """Windows of one block by their rarest shingle, as distance of the shingle from the start."""

    def __init__(self, windows: list[tuple[int, str]], shingle: int):
        self.shingle = shingle
        self.windows = [(tuple(x.encode().split()), number) for number, x in windows]
        self.words: dict[bytes, int] = {}
        for words, _ in self.windows:
            for word in words:
                self.words.setdefault(word, len(self.words) + 1)
        self.coded = [np.array([self.words[w] for w in words]) for words, _ in self.windows]
        self.shingles: dict[int, int] = {}  # code to number
        for coded in self.coded:
            for code in self._codes(coded).tolist():
                self.shingles.setdefault(code, len(self.shingles))
        self.known = np.sort(np.fromiter(self.shingles, np.int64, len(self.shingles)))
        self.anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _codes(self, coded: np.ndarray) -> np.ndarray:
        """A number for each shingle, equal for equal shingles; short windows are one shingle.

        Different shingles may share a number: that only adds a candidate or a count.
        """
        size = min(self.shingle, len(coded))
        codes = np.full(len(coded) - size + 1, size, np.int64)
        for at in range(size):
            codes = codes * np.int64(1_000_003) + coded[at : at + len(codes)]
        return codes

    def anchor(self, counts: np.ndarray) -> None:
        """Choose the rarest shingle of each window."""
        for number, coded in enumerate(self.coded):
            codes = self._codes(coded).tolist()
            place = min(range(len(codes)), key=lambda at: (counts[self.shingles[codes[at]]], codes[at], at))
            self.anchors[codes[place]].append((number, place))

    def places(self, words: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the benchmark's shingles in a document."""
        coded = np.fromiter(map(self.words.get, words, _zeros()), np.int64, len(words))
        at_all, codes_all = [], []
        for size in sizes:
            if size > len(coded) or not len(self.known):
                continue
            inside = coded != 0
            runs = inside[: len(coded) - size + 1].copy()
            for at in range(1, size):
                runs &= inside[at : at + len(runs)]
            at = np.flatnonzero(runs)
            codes = np.full(len(at), size, np.int64)
            for step in range(size):
                codes = codes * np.int64(1_000_003) + coded[at + step]
            near = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            known = self.known[near] == codes
            at_all.append(at[known])
            codes_all.append(codes[known])
        if not at_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at_all), np.concatenate(codes_all)

    def sizes(self) -> tuple[int, ...]:
        return tuple(sorted({min(self.shingle, len(x)) for x in self.coded}))

    def count(self, words: list[bytes], sizes: tuple[int, ...], counts: np.ndarray) -> None:
        _, codes = self.places(words, sizes)
        for code in codes.tolist():
            counts[self.shingles[code]] += 1

    def hits(self, words: list[bytes], sizes: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
        """Covered runs of words, and the numbers of the windows that occur."""
        spans, found = [], set()
        places, codes = self.places(words, sizes)
        for at, code in zip(places.tolist(), codes.tolist()):
            for number, distance in self.anchors.get(code, ()):
                wanted, name = self.windows[number]
                start = at - distance
                if start < 0 or start + len(wanted) > len(words):
                    continue
                if tuple(words[start : start + len(wanted)]) == wanted:
                    spans.append((start, start + len(wanted)))
                    found.add(name)
        starts, ends = merge_spans(spans)
        return starts, ends, sorted(found)


def _zeros():
    from itertools import repeat

    return repeat(0)


def merge_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Disjoint runs in order that cover the same words."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


@dataclass(frozen=True)
class Benchmark:
    """Written tables: ``window, words`` of the distinct windows, and ``window, item_id``."""

    windows: DataFrame
    items: DataFrame
    blocks: int
    shingle: int


def benchmark_windows(
    benchmark: DataFrame, window: int = 13, shingle: int = 5, block_words: int = 4_000_000
) -> Benchmark:
    """The windows of a benchmark, to be handled ``block_words`` words at a time."""
    cut = materialise(item_windows(benchmark, window).distinct(), "item-windows")
    numbered = cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id())
    windows = materialise(numbered, "windows")
    items = materialise(cut.join(windows, "words").select("window", "item_id"), "window-items")
    return Benchmark(windows, items, max(1, -(-windows.count() * window // block_words)), shingle)


def block_indexes(docs: DataFrame, bench: Benchmark) -> Iterator[WindowIndex]:
    """An index for every block of the benchmark in turn; ``docs`` give the order of its shingles."""
    place = F.pmod(F.xxhash64("words"), F.lit(bench.blocks))
    for block in range(bench.blocks):
        rows = bench.windows.where(place == block).select("window", "words").orderBy("words").collect()
        index = WindowIndex([(x.window, x.words) for x in rows], bench.shingle)
        index.anchor(shingle_counts(docs, index))
        yield index


def shingle_counts(docs: DataFrame, index: WindowIndex) -> np.ndarray:
    """Occurrences of each of the block's shingles over all documents."""
    sizes, total = index.sizes(), len(index.shingles)
    handle = docs.sparkSession.sparkContext.broadcast(index)  # at most block_words words

    def count(batches):
        counts = np.zeros(total, np.int64)
        for batch in batches:
            for raw in raw_texts(batch, "text"):
                handle.value.count(word_list(raw), sizes, counts)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["shingle", "n"])

    partial = docs.select("text").mapInArrow(count, "shingle long, n long")
    counts = np.zeros(total, np.int64)
    for row in partial.groupBy("shingle").agg(F.sum("n").alias("n")).collect():  # a row per shingle of the block
        counts[row.shingle] = row.n
    handle.destroy()
    return counts


def _hits(docs: DataFrame, index: WindowIndex, every_row: bool) -> DataFrame:
    """Runs of hit words and windows found, by one block; written. Rows without a hit are left out, unless
    ``every_row`` is wanted."""
    handle, sizes = docs.sparkSession.sparkContext.broadcast(index), index.sizes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for raw in raw_texts(batch, "text"):
            words = word_list(raw)
            found.append((len(words), *handle.value.hits(words, sizes)))
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3]
        columns = [pa.array([x[n] for x in found], kind) for n, kind in enumerate(kinds)]
        names = ["doc_id", "text_hash", "n_words", "starts", "ends", "windows"]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)

    found = map_batches(rows, find, _HITS)
    written = materialise(found if every_row else found.where(F.size("windows") > 0), "hits")
    handle.destroy()
    return written


def contamination(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """``doc_id, n_words, starts, ends, items`` of every row: runs of hit words and items found."""
    parts = [_hits(docs, index, not number) for number, index in enumerate(block_indexes(docs, bench))]
    found = materialise(_combine(parts).withColumn("row", F.monotonically_increasing_id()), "contamination")
    named = found.select("row", F.explode("windows").alias("window")).join(bench.items, "window")
    items = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return found.join(items, "row", "left").select("doc_id", "n_words", "starts", "ends", F.coalesce("items", none).alias("items"))


def _combine(parts: list[DataFrame]) -> DataFrame:
    """Every row of the first block with the hits of the others. Equal rows have equal hits, which are taken
    once and joined to each of them."""
    first, others = parts[0], parts[1:]
    if not others:
        return first
    keys = ["doc_id", "text_hash"]
    several = [x.dropDuplicates(keys) for x in others]
    later = reduce(DataFrame.unionByName, several).groupBy(*keys).agg(
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("more_spans"),
        F.flatten(F.collect_list("windows")).alias("more_windows"),
    )
    later = later.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "more_spans", "more_windows")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    joined = first.join(later, same, "left").drop("id", "hash")

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        spans = [
            merge_spans([*zip(x["starts"], x["ends"]), *((y["starts"], y["ends"]) for y in x["more_spans"] or ())])
            for x in rows
        ]
        windows = [[*x["windows"], *(x["more_windows"] or ())] for x in rows]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in ([y[0] for y in spans], [y[1] for y in spans], windows)]
        names = ["doc_id", "text_hash", "n_words", "starts", "ends", "windows"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *lists], names)

    return map_batches(joined, merge, _HITS)


def verdicts(found: DataFrame) -> DataFrame:
    """Digest of ``contamination``: counts, hash of the items, and the rule of one word in twenty."""
    hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (n, x) -> n + x)")
    counted = found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Verdict on every document."""
    return verdicts(contamination(docs, benchmark_windows(benchmark, window)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 4_000_000) -> DataFrame:
    """Rows of ``docs``, all columns, that are not contaminated.

    A benchmark of one block goes along with the documents: no join and no shuffle. With more, the
    contaminated ones are found block by block and taken out by a join.
    """
    bench = benchmark_windows(benchmark, window, block_words=block_words)
    if bench.blocks > 1:
        return _without_dirty(docs, bench)
    index = next(block_indexes(docs, bench))
    handle, sizes = docs.sparkSession.sparkContext.broadcast(index), index.sizes()

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = []
        for raw in raw_texts(batch, "text"):
            words = word_list(raw)
            starts, ends, _ = handle.value.hits(words, sizes)
            clean.append(not _dirty(sum(ends) - sum(starts), len(words)))
        return batch.filter(pa.array(clean))

    return map_batches(docs, keep, docs.schema)


def _dirty(hit: int, words: int) -> bool:
    return hit > 0 and 20 * hit >= words


def _without_dirty(docs: DataFrame, bench: Benchmark) -> DataFrame:
    parts = [_hits(docs, index, not number) for number, index in enumerate(block_indexes(docs, bench))]
    hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (n, x) -> n + x)")
    dirty = _combine(parts).where((hit > 0) & (20 * hit >= F.col("n_words")))
    keys = dirty.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("own_hash"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    return rows.join(materialise(keys, "contaminated"), same, "left_anti").select("row.*")
