"""Packing documents into windows of tokens by best-fit decreasing.

``tokenize`` writes the ids of every document once. Overlong documents are cut into full windows;
what is left of them is placed like any other document: pieces are dealt over groups of about
``group_windows`` windows, sorted by falling length, and each goes to the open window that it fits
most tightly. A segment tree over the remaining capacities finds that window. ``write_sequences``
deals the pieces with their ids, so that a group's task places them and writes its sequences;
``placed_pieces`` reads the plan back from that table. ``pack`` makes the plan alone, without shuffling
ids, and ``packed_sequences`` brings ids and plan together.

Edge cases: a null text is empty and has the end id alone; repeated rows are packed each, under a
``row_id`` of their own; a null id is packed like any other; an empty table gives an empty plan; a piece as long as a window fills it;
equal lengths go by id, start and checksum; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import forget_kept
from wattloom.llm.encoder import encoder
from wattloom.storage import fresh_path

_TOKENS = "row_id long, doc_id long, doc_tokens long, ids binary"


class OpenWindows:
    """Windows that still have room, by remaining capacity; the tree counts them per range."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window) -> None:
        self.stacks[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int):
        """The window with the least capacity of at least ``need``, and that capacity; else None."""
        node = self.leaves + need
        while not self.count[node]:
            while node & 1:  # a right child: what is larger lies further up
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node *= 2
            node += not self.count[node]
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.stacks[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int, tree: OpenWindows, opened: int) -> tuple[list, int]:
    """(window, offset) for each length in turn, and the number of windows opened so far."""
    places = []
    for length in lengths:
        if (found := tree.take(length)) is None:
            found, opened = (opened, window), opened + 1
        number, capacity = found
        places.append((number, window - capacity))
        if capacity > length:
            tree.put(capacity - length, number)
    return places, opened


def tokenize(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int) -> DataFrame:
    """``row_id, doc_id, doc_tokens, ids`` of every row, written as a table in the shared folder.

    ``row_id`` is a number of its own for each row of the written table; ids are little-endian whole
    numbers of 2 bytes where the vocabulary allows it, else of 4.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def encode(batches):
        for batch in batches:
            encode_runs = encoder(tokenizer, spaces)
            kind = "<u4" if encode_runs.vocabulary > 65_536 or end_id > 65_535 else "<u2"
            for first, found in encode_runs.runs(batch.column("text"), end_id):
                rows = batch.slice(first, len(found))
                sizes = pa.array(np.fromiter(map(len, found), np.int64, len(found)))
                ids = pa.array([x.astype(kind).tobytes() for x in found], pa.binary())
                names = ["row_id", "doc_id", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], sizes, ids], names)

    path = fresh_path(docs.sparkSession, "tokens")
    texts.mapInArrow(encode, _TOKENS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_TOKENS).parquet(path)


def _ids(stored: bytes, count: int) -> np.ndarray:
    """The ids of a stored run of ``count``."""
    return np.frombuffer(stored, "<u2" if len(stored) == 2 * count else "<u4")


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_id long"


def _dealt(tokens: DataFrame, window: int, group_windows: int, with_ids: bool = False) -> DataFrame:
    """Pieces, with their ids if wanted, a partition per group, in the order in which they are placed."""
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / (window * group_windows)))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield from _cut(batch.slice(at, 1024))

    def _cut(batch: pa.RecordBatch):
        sizes, stored = batch.column("doc_tokens").to_numpy(), batch.column("ids").to_pylist()
        row, start, length, crc, parts = [], [], [], [], []
        for n, (size, ids) in enumerate(zip(sizes.tolist(), stored)):
            wide = _ids(ids, size)
            for at in range(0, size, window):
                part = wide[at : at + window]
                row.append(n)
                start.append(at)
                length.append(len(part))
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                parts.append(part.tobytes())
        named = batch.select(["doc_id", "doc_tokens", "row_id"]).take(pa.array(row, pa.int64()))
        columns = [named.column(0), *(pa.array(x, pa.int64()) for x in (start, length, crc)), named.column(1), named.column(2)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_id"]
        if with_ids:
            columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)

    pieces = tokens.select("doc_id", "doc_tokens", "row_id", "ids").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)
    dealt = pieces.repartition(groups, F.xxhash64("row_id", "start"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32", "row_id")


def pack(tokens: DataFrame, window: int = 4096, group_windows: int = 512) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, row_id, sequence_id, offset``.

    ``sequence_id`` is the number of the group in the upper bits and of the window in it below.
    A group is sorted by Spark, which spills; a task holds its open windows only.
    """
    falling = _dealt(tokens, window, group_windows)

    def place(batches):
        tree, opened, group = OpenWindows(window), 0, TaskContext.get().partitionId()
        for batch in batches:
            places, opened = best_fit(batch.column("length").to_pylist(), window, tree, opened)
            numbers = np.array(places, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((group << 40) + numbers[:, 0]), pa.array(numbers[:, 1])],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in falling.schema]
    return falling.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack_documents(
    docs: DataFrame, tokenizer: str, spaces: bool = False, end_id: int = 2, window: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """The written tokens and the plan over them."""
    tokens = tokenize(docs, tokenizer, spaces, end_id)
    return tokens, pack(tokens, window)


def _widened(batches):
    for batch in batches:
        stored = zip(batch.column("ids").to_pylist(), batch.column("doc_tokens").to_pylist())
        ids = pa.array([_ids(x, n).astype("<u4").tobytes() for x, n in stored], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), ids], ["row_id", "ids"])


def packed_sequences(tokens: DataFrame, plan: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, n_tokens``: ids of each window (little-endian uint32).

    Padded to ``window`` ids, but a sequence whose length is a power of two stays as it is. A window's
    rows are bounded by its length, so a group fits a task whatever the corpus.
    """
    wide = tokens.select("row_id", "doc_tokens", "ids").mapInArrow(_widened, "row_id long, ids binary")
    cut = wide.alias("t").join(plan.alias("p"), "row_id")
    part = F.expr("substring(t.ids, CAST(4 * p.start + 1 AS INT), CAST(4 * p.length AS INT))")
    parts = cut.select("p.sequence_id", F.struct("p.offset", part.alias("ids"), "p.length").alias("part"))
    grouped = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    used = F.expr("aggregate(parts, 0L, (n, x) -> n + x.length)")
    pad = pad_id.to_bytes(4, "little").hex()
    joined = "aggregate(parts, X'', (all, x) -> concat(all, x.ids))"
    size = f"IF(n_tokens & (n_tokens - 1) = 0, n_tokens, {window})"
    ids = F.expr(f"rpad({joined}, CAST(4 * {size} AS INT), X'{pad}')")
    return grouped.withColumn("n_tokens", used).select("sequence_id", ids.alias("ids"), "n_tokens")


_PIECE = "row_id: long, doc_id: long, doc_tokens: long, start: long, offset: long, length: long"
_SEQUENCES = f"sequence_id long, ids binary, n_tokens long, pieces array<struct<{_PIECE}>>"


def write_sequences(
    tokens: DataFrame, path: str, window: int = 4096, group_windows: int = 512, pad_id: int = 0
) -> DataFrame:
    """``sequence_id, ids, n_tokens, pieces``, written to ``path``: the sequences of ``packed_sequences``
    with the pieces in them, ``offset`` and ``length`` as they lie there.

    A task holds the ids of its group, about ``4 * window * group_windows`` bytes.
    """

    def fill(batches):
        forget_kept("encoder")  # its ids are written
        tree, opened, group = OpenWindows(window), 0, TaskContext.get().partitionId()
        kept, places = [], []
        for batch in batches:
            found, opened = best_fit(batch.column("length").to_pylist(), window, tree, opened)
            places += found
            kept.append(batch)
        if places:
            placed = np.array(places, np.int64)
            pieces = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept.clear()
            yield from _sequences(pieces, placed[:, 0], placed[:, 1], group << 40, window, pad_id)

    falling = _dealt(tokens, window, group_windows, with_ids=True)
    falling.mapInArrow(fill, _SEQUENCES).write.option("compression", "zstd").parquet(path)
    return tokens.sparkSession.read.schema(_SEQUENCES).parquet(path)


def _sequences(pieces: pa.RecordBatch, windows: np.ndarray, offsets: np.ndarray, first: int, window: int, pad_id: int):
    """Batches of at most 64 sequences with their pieces."""
    order = np.lexsort((offsets, windows))
    bounds = np.append(np.flatnonzero(np.diff(windows[order], prepend=-1)), len(order))
    for at in range(0, len(bounds) - 1, 64):
        ends = bounds[at : at + 65]
        rows = pieces.take(pa.array(order[ends[0] : ends[-1]]))
        stored = zip(rows.column("ids").to_pylist(), rows.column("length").to_pylist())
        ids = [_ids(x, n).astype("<u4") for x, n in stored]
        ends = ends - ends[0]
        sequences, totals, begins = [], [], []
        for start, end in zip(ends[:-1], ends[1:]):
            begins.append(np.cumsum([0, *map(len, ids[start : end - 1])]))
            sequence = np.concatenate(ids[start:end])
            total = len(sequence)
            size = total if total & (total - 1) == 0 else window
            sequences.append(np.append(sequence, np.full(size - total, pad_id, "<u4")).tobytes())
            totals.append(total)
        columns = {x: rows.column(x) for x in ("row_id", "doc_id", "doc_tokens", "start")}
        columns["offset"] = pa.array(np.concatenate(begins).astype(np.int64))
        columns["length"] = pa.array(np.fromiter(map(len, ids), np.int64, len(ids)))
        inside = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(first + windows[order[bounds[at : at + len(sequences)]]]),
                pa.array(sequences, pa.binary()),
                pa.array(totals, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inside),
            ],
            ["sequence_id", "ids", "n_tokens", "pieces"],
        )


def placed_pieces(sequences: DataFrame) -> DataFrame:
    """The columns of ``pack``, from written sequences: the checksum is that of the ids at ``offset``."""
    crc = "crc32(substring(ids, CAST(4 * x.offset + 1 AS INT), CAST(4 * x.length AS INT)))"
    pieces = F.expr(f"transform(pieces, x -> struct(x AS piece, {crc} AS ids_crc32))")
    found = sequences.select("sequence_id", F.explode(pieces).alias("x")).select("sequence_id", "x.*")
    names = ["piece.doc_id", "piece.start", "piece.length", "ids_crc32", "piece.doc_tokens", "piece.row_id"]
    return found.select(*names, "sequence_id", "piece.offset")
