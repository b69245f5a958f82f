"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become whole numbers. Candidates are cut into blocks, queries too, and each pair of blocks
is a task. A block's index holds a posting segment per dimension: the values of all its candidates there. For
a query a segment has a quantised impact, the width of the range of its products, in ``LEVELS`` steps of
the largest one. Segments are processed level by level, from the highest impact down. What a candidate may still
gather is at most the length of the query in the dimensions that are left times its own length in them.
Processing stops only when this proves that few candidates may still be among the k best; these,
and only these, are rescored exactly.

One block is searched first. The k-th best score that a query finds there is a floor: it goes with the query to all other
blocks, where most candidates fall below it at the first test.

Vectors that are null or hold a null, NaN or infinite component take no part.

Edge cases: ties go to the smaller id; repeated rows take part each (a query leaves out all rows of
its own id, and a repeated query row has its result again); rows with a null id take no part; queries shorter or longer than a candidate don't meet it:
vectors are grouped by length; fewer than k candidates give all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.storage import materialise

_FOUND = "query_row long, query_id long, vec_id long, score long"
LEVELS = 8


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id, v``: usable vectors as whole numbers."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where("vec_id IS NOT NULL AND x IS NOT NULL").where(finite)
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(scale * x)).alias("v"))


class ImpactIndex:
    """Posting segments of one block of candidates: a row of values per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.width = values.shape[1]
        largest = float(np.abs(values).max(initial=0))
        # Single precision is exact for these sums, or else double precision is nearly so.
        self.kind = np.float32 if largest * largest * max(self.width, 1) < 1 << 24 else np.float64
        self.postings = np.ascontiguousarray(values.T, self.kind)
        self.squares = self.postings * self.postings
        self.length = self.squares.sum(axis=0)
        self.range = (values.max(axis=0) - values.min(axis=0)).astype(np.float64)

    def levels(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions by falling quantised impact, and where each level begins."""
        impact = np.abs(query) * np.maximum(self.range, 1)
        step = np.floor(impact * (LEVELS / max(impact.max(initial=0), 1e-9))).astype(np.int64)
        order = np.argsort(-step, kind="stable")
        return order, np.append(np.flatnonzero(np.diff(step[order], prepend=-1)), self.width)

    def top(
        self, query_id: int, query: np.ndarray, k: int, floor: float | None = None, few: int | None = None, left: float = 0.1
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best other candidates, best first; with a ``floor``, of those
        that reach it.

        Tests begin when less than the share ``left`` of the query's squared length is left, or at the last
        level; up to ``few`` candidates are rescored.
        """
        few = max(k, len(self.ids) // 16 if few is None else few)
        q = query.astype(np.float64)
        kind = self.kind if self.kind is np.float64 or np.abs(q).max(initial=0) * np.abs(self.postings).max(initial=0) * self.width < 1 << 24 else np.float64
        order, starts = self.levels(q)
        ahead = np.append(np.cumsum((q * q)[order][::-1])[::-1], 0.0)
        gathered, rest = np.zeros(len(self.ids), kind), self.length.astype(kind)
        others = self.ids != query_id
        possible = np.flatnonzero(others)
        done = 0
        for end in starts[1:].tolist():
            if end < self.width and ahead[end] > left * ahead[0]:
                continue
            chosen = order[done:end]
            gathered += q[chosen].astype(kind) @ self.postings[chosen].astype(kind, copy=False)
            rest -= self.squares[chosen].sum(axis=0, dtype=kind)
            done = end
            if floor is None and len(possible) >= k:
                # Any k candidates have a k-th best score; those that lead now have a high one.
                lead = possible[np.argpartition(-gathered[possible], k - 1)[:k]]
                floor = float((self.values[lead] @ query).min())
            if floor is not None:
                more = np.sqrt(np.maximum(rest, 0) * ahead[end])
                reach = gathered + more
                possible = np.flatnonzero((reach * (1 + 1e-6 * np.sign(reach)) + 1 >= floor) & others)
            if len(possible) <= few:
                break
        exact = self.values[possible] @ query
        if floor is not None:
            possible, exact = possible[exact >= floor], exact[exact >= floor]
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return possible[best], exact[best]


def _matrix(entries: pa.StructArray) -> np.ndarray:
    return entries.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(entries), -1)


def top_k(vectors: DataFrame, is_query: str, k: int = 20, block: int = 8192, query_block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of every query; ``is_query`` is a condition.

    Blocks hold about ``block`` candidates and ``query_block`` queries; every pair of blocks has a key
    of its own, so pairs are dealt evenly and a task holds one pair.
    """
    numbered = whole_vectors(vectors).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(numbered, "whole-vectors").withColumn("width", F.size("v"))
    counts = rows.groupBy("width").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"),
        F.ceil(F.count_if(F.expr(is_query)) / query_block).cast("int").alias("query_blocks"),
    )
    sized = rows.join(counts.where("query_blocks > 0"), "width")
    queries = sized.where(is_query)

    def blocked(part: DataFrame, number: Column, entry: list, name: str) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "v", "row"), number).cast("int").alias(name)
        placed = part.select("width", place, "blocks", "query_blocks", F.struct(*entry).alias("entry"))
        held = F.array_sort(F.collect_list("entry")).alias(f"{name}_rows")
        return placed.groupBy("width", name, "blocks", "query_blocks").agg(held)

    candidates = materialise(blocked(sized, F.col("blocks"), ["vec_id", "v"], "block"), "blocks")

    def pairs(asked: DataFrame, blocks: DataFrame, first: int) -> DataFrame:
        """Every block of queries with the blocks from ``first`` on (only the first block, if that is 0)."""
        last = F.col("blocks") - 1 if first else F.lit(0)
        spread = blocked(asked, F.col("query_blocks"), ["row", "vec_id", "floor", "v"], "query_block").where(last >= first)
        left = spread.select("width", "query_block", "query_block_rows", F.explode(F.sequence(F.lit(first), last)).alias("block"))
        numbers = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block")
        right = blocks.select("width", "block", "block_rows", numbers)
        return left.join(right, ["width", "block", "query_block"]).select("block_rows", "query_block_rows")

    def search(batches):
        for batch in batches:
            for a, b in zip(batch.column("block_rows"), batch.column("query_block_rows")):
                index = ImpactIndex(a.values.field("vec_id").to_numpy(), _matrix(a.values))
                asked = zip(*(b.values.field(x).to_pylist() for x in ("row", "vec_id", "floor")), _matrix(b.values))
                found = [([], [], [], [])]
                for row, query_id, floor, query in asked:
                    places, scores = index.top(query_id, query, k, floor)
                    found.append((np.full(len(places), row), np.full(len(places), query_id), index.ids[places], scores))
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score"])

    first = pairs(queries.withColumn("floor", F.lit(None).cast("double")), candidates.where("block = 0"), 0)
    near = materialise(first.mapInArrow(search, _FOUND), "first-block")
    reached = near.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = reached.where(F.col("n") >= k).select("row", F.col("least").cast("double").alias("floor"))
    rest = pairs(queries.join(floors, "row", "left"), candidates.where("block > 0"), 1)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    found = near.unionByName(rest.mapInArrow(search, _FOUND)).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
