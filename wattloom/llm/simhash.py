"""Near-duplicate groups by SimHash fingerprints.

A fingerprint has 64 bits, from the hashes of all word shingles. Two fingerprints link when they
differ in at most ``radius`` bits. All linked pairs are found: the bits are cut into ``m`` blocks,
and for every choice of ``m - radius`` blocks, fingerprints that agree on them share a bucket; linked
ones agree on at least one choice. In a bucket the fingerprints are compared bit-sliced: 64 of them
stand side by side as 64 bit planes, carry-save counters add up the differing bits of all at once,
and a block is left as soon as every distance in it exceeds the radius.

Buckets of more than ``tile`` fingerprints are cut into tiles, and pairs of tiles are compared by
different tasks. A bucket gives a star per component of its own, not its pairs. Components follow by
passing the smallest label along links and from label to label, each round written as a table.

Edge cases: texts of fewer words than a shingle are one shingle; a null or empty text has
fingerprint 0 and links like any other; repeated rows each get a row; a null id takes part, the
component id is the smallest id that is not null (null if all are); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import join_hot, map_batches, raw_texts, text_key
from wattloom.llm.encoder import expand
from wattloom.storage import materialise

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(raw: bytes, shingle: int) -> list[int]:
    """XXH64 with seed 42 of every shingle: words in lower case (A-Z), joined by single spaces."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, 42)]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)][shingle - 1 :]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)]


def fingerprint(hashes: list[int]) -> int:
    """Bits that are set in over half of the hashes."""
    if not hashes:
        return 0
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(raw), 255):  # 255 ones still fit a byte
        bits = np.unpackbits(raw[at : at + 255], axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, text_key, fp`` (the 64 bits as a signed number) of every row."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(raw, shingle)) for raw in raw_texts(batch, "text")]
        fp = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), fp], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return map_batches(rows, compute, "doc_id long, text_key struct<hash: long, size: int>, fp long")


def bucket_masks(blocks: int, radius: int) -> list[int]:
    """The bits on which the fingerprints of a bucket agree, for each choice of blocks."""
    edges = [round(64 * n / blocks) for n in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


class BitSlices:
    """Fingerprints of many buckets, 64 to a block, as planes of bits."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values = values.view(np.uint64)
        firsts = np.cumsum(sizes) - sizes
        rank = np.arange(len(values)) - np.repeat(firsts, sizes)
        blocks = -(-sizes // 64)
        first_block = np.repeat(np.cumsum(blocks) - blocks, sizes)
        self.lane = (rank % 64).astype(np.uint64)
        self.own = first_block + rank // 64
        self.more = np.repeat(blocks, sizes) - rank // 64  # own block and those behind it
        starts = np.flatnonzero(rank % 64 == 0)
        self.starts = starts
        length = np.diff(starts, append=len(values)).astype(np.uint64)
        self.lanes = _FULL >> (np.uint64(64) - length)
        self.planes = [
            np.bitwise_or.reduceat(((self.values >> np.uint64(k)) & _ONE) << self.lane, starts)
            for k in range(64)
        ]

    def near(self, radius: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places with at most ``radius`` differing bits, each once."""
        ends = np.cumsum(self.more)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            rows = np.arange(at, stop)
            who = np.repeat(rows, self.more[rows])
            block = expand(self.own[rows], self.more[rows])
            yield from self._compare(who, block, radius)
            at = stop

    def _compare(self, who: np.ndarray, block: np.ndarray, radius: int):
        behind = _FULL << self.lane[who] << _ONE  # lanes behind the own one
        left = np.where(self.own[who] == block, behind, _FULL) & self.lanes[block]
        kept = left != 0
        who, block, left = who[kept], block[kept], left[kept]
        counters = [np.zeros(len(who), np.uint64) for _ in range(max(1, radius.bit_length()))]
        for plane in range(64):
            own = np.uint64(0) - ((self.values[who] >> np.uint64(plane)) & _ONE)
            carry = self.planes[plane][block] ^ own
            for n, counter in enumerate(counters):
                carry, counters[n] = counter & carry, counter ^ carry
            left &= ~carry  # the counters ran over
            if plane % 8 == 7:
                left &= ~_above(counters, radius)
                kept = left != 0
                if not kept.all():
                    who, block, left = who[kept], block[kept], left[kept]
                    counters = [x[kept] for x in counters]
                if not len(who):
                    return
        for first in range(0, len(who), 1 << 14):  # at most 2^20 pairs at a time
            bits = np.unpackbits(left[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            entry, lane = np.nonzero(bits)
            yield who[first + entry], self.starts[block[first + entry]] + lane


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], _FULL)
    for n in range(len(counters) - 1, -1, -1):
        if radius >> n & 1:
            equal = equal & counters[n]
        else:
            above = above | equal & counters[n]
            equal = equal & ~counters[n]
    return above


def stars(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smaller place's value) that connect what is linked within each bucket."""
    label = np.arange(len(values))
    for a, b in BitSlices(values, sizes).near(radius):
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (jumped := label[label] != label).any():
                label[jumped] = label[label[jumped]]
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def linked_pairs(distinct: DataFrame, radius: int, tile: int = 4096, blocks: int | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all linked ones.

    ``blocks`` defaults to ``radius + 2``: at a radius of 4, 15 rows per fingerprint in buckets by
    21 bits. One more block means more copies and smaller buckets; the links stay the same.
    """
    masks = bucket_masks(blocks or radius + 2, radius)
    choice = F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.lit(m).alias("mask")) for n, m in enumerate(masks)]))
    rows = distinct.select("fp", choice.alias("c")).select(
        "fp", F.col("c.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("key")
    )
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    known = rows.join(large, ["choice", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    single = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    dealt = known.select("fp", "choice", "key", F.explode(F.coalesce(pairs, single)).alias("t"))
    bucket = ["choice", "key", "t"]
    sorted_ = dealt.repartition(*bucket).sortWithinPartitions(*bucket, "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, sizes in _whole_buckets(batches):
            a, b = stars(values, sizes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    narrow = sorted_.select("fp", F.xxhash64(*bucket).alias("bucket"))
    return narrow.mapInArrow(compare, "a long, b long").distinct()


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and sizes of the buckets with two members or more; a bucket may span batches."""
    held = np.zeros((2, 0), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "bucket")])
        rows = np.concatenate([held, rows], axis=1)
        cut = np.flatnonzero(rows[1] != rows[1, -1]) if rows.shape[1] else np.zeros(0, int)
        last = int(cut[-1]) + 1 if len(cut) else 0
        yield from _shared(rows[:, :last])
        held = rows[:, last:]
    yield from _shared(held)


def _shared(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not rows.shape[1]:
        return
    firsts = np.flatnonzero(np.append(True, rows[1, 1:] != rows[1, :-1]))
    sizes = np.diff(firsts, append=rows.shape[1])
    several = np.repeat(sizes > 1, sizes)
    if several.any():
        yield rows[0, several], sizes[sizes > 1]


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that can be reached, for every node of a link."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both, "links")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        hooked = materialise(hooked, "hooked")
        target = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = hooked.join(target, "label").select("node", F.least("label", "next").alias("label"), "old")
        jumped = materialise(jumped, "jumped")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, text_key, fp, component_id, keeper``; ``keeper`` is the row that stands for its group:
    smallest id, then text key."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    distinct = materialise(prints.groupBy("fp").agg(first), "distinct-fingerprints")
    labels = components(linked_pairs(distinct.select("fp"), radius))
    labelled = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "first"
    )
    group = labelled.groupBy("label").agg(F.min("first").alias("keeper"))
    members = materialise(labelled.drop("first").join(group, "label").select("fp", "keeper"), "members")
    return join_hot(prints, members, "fp").select(
        "doc_id", "text_key", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper"
    )


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def without_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group, all columns: the row with the smallest id, then text key."""
    keepers = near_duplicate_groups(docs, shingle, radius).select("keeper.*").distinct()
    named = keepers.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_key().alias("own_key"))
    kept = keyed.join(named, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    return kept.dropDuplicates(["id", "key"]).select("row.*")
