"""Token ids in binary files: one shared zstandard dictionary, one frame per document.

``write_token_files`` range-partitions the documents by id, encodes them, and writes one file per
partition in ascending id order; each document is a frame of its own, compressed with a dictionary
trained on serialized id arrays. A file holds the SHA-256 of its dictionary, the frames and an index
with the offset of each frame, so that one document is read without the others (``TokenFile.get``).
A manifest row per file is committed by Spark; files of failed attempts are in no manifest.

Edge cases: a null text counts as empty and gives the end id alone; rows with one id are all kept,
ordered by the CRC-32 of their text and then by the text; a null id comes first; an empty table
gives no file and no row; other columns are ignored.

The dictionary is a compression aid, ids do not depend on it: it is trained on at most
``sample_docs`` documents of at most ``sample_bytes`` bytes each, those with the smallest hash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.llm.common import file_system, per_process
from wattloom.llm.encoder import encoder

_MAGIC = b"WLTOK001"
_FOOTER = "<QQQ8s"
_ENTRY = np.dtype(
    [("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("size", "<u4"), ("tokens", "<u8")]
)
_MANIFEST = "part int, path string, dictionary string, dictionary_sha256 string, docs long, tokens long"

_MANIFEST_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("path", pa.string()),
        ("dictionary", pa.string()),
        ("dictionary_sha256", pa.string()),
        ("docs", pa.int64()),
        ("tokens", pa.int64()),
    ]
)


def train_dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """Dictionary bytes; the samples' own bytes where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


class TokenFileWriter:
    """Frames of documents, then the index, then the footer."""

    def __init__(self, sink, dictionary: bytes, wide: bool):
        import zstandard

        self.sink, self.kind = sink, "<u4" if wide else "<u2"
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary)).compress
        self.entries: list[tuple] = []
        self.tokens = 0
        head = _MAGIC + bytes([4 if wide else 2]) + hashlib.sha256(dictionary).digest()
        sink.write(head)
        self.offset = len(head)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.pack(ids.astype(self.kind).tobytes())
        self.sink.write(frame)
        self.entries.append((doc_id or 0, doc_id is not None, self.offset, len(frame), len(ids)))
        self.offset += len(frame)
        self.tokens += len(ids)

    def close(self) -> None:
        index = np.array(self.entries, _ENTRY).tobytes()
        self.sink.write(index)
        self.sink.write(struct.pack(_FOOTER, self.offset, len(index), len(self.entries), _MAGIC))
        self.sink.close()


class TokenFile:
    """Random access to one file: ``get`` reads the footer, the index and the wanted frames only."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        system, name = file_system(path)
        self.source = system.open_input_file(name)
        head = self.source.read_at(len(_MAGIC) + 33, 0)
        if head[: len(_MAGIC)] != _MAGIC:
            raise ValueError(f"{path} is no token file")
        if head[len(_MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = {2: "<u2", 4: "<u4"}[head[len(_MAGIC)]]
        end = self.source.size()
        at, size, count, magic = struct.unpack(
            _FOOTER, self.source.read_at(struct.calcsize(_FOOTER), end - struct.calcsize(_FOOTER))
        )
        self.index = np.frombuffer(self.source.read_at(size, at), _ENTRY)
        if magic != _MAGIC or len(self.index) != count:
            raise ValueError(f"{path} has a broken index")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack(frame), self.kind).astype("<u4")

    def get(self, doc_id: int) -> list[np.ndarray]:
        rows = self.index[(self.index["doc_id"] == doc_id) & (self.index["known"] == 1)]
        return [self.ids(self.source.read_at(int(x["size"]), int(x["offset"]))) for x in rows]

    def runs(self, limit: int):
        """Entries with their frames in file order, about ``limit`` bytes per read."""
        first = 0
        while first < len(self.index):
            start = int(self.index[first]["offset"])
            last = int(np.searchsorted(self.index["offset"], start + limit))
            last = max(last, first + 1)
            stop = int(self.index[last - 1]["offset"]) + int(self.index[last - 1]["size"])
            block = self.source.read_at(stop - start, start)
            entries = self.index[first:last]
            begins = (entries["offset"].astype("i8") - start).tolist()
            # A frame is copied alone: cutting off what lies before it would copy the rest of the block each time.
            yield entries, [block[at : at + size] for at, size in zip(begins, entries["size"].tolist())]
            first = last


def read_dictionary(path: str) -> bytes:
    system, name = file_system(path)
    with system.open_input_stream(name) as source:
        return source.read()


def _sample(texts: DataFrame, count: int, largest: int) -> list[str]:
    """``count`` texts of at most ``largest`` bytes, those with the smallest hash of id and text.

    Only hashes are ranked, ``count`` of 16 bytes from each task; then the texts with these are read.
    """
    small = texts.where(F.octet_length("text") <= largest)
    named = small.select("text", F.xxhash64("doc_id").alias("by_id"), F.xxhash64("text").alias("by_text"))
    keys = named.select("by_id", "by_text").orderBy("by_id", "by_text").limit(count).collect()
    if not keys:
        return []
    # Rows equal in both hashes may stand at the end of the list more than once: the limit holds for texts too.
    last = F.struct(F.lit(keys[-1].by_id).alias("by_id"), F.lit(keys[-1].by_text).alias("by_text"))
    chosen = named.where(F.struct("by_id", "by_text") <= last)
    rows = chosen.orderBy("by_id", "by_text").limit(len(keys)).select("text").collect()
    return [x.text for x in rows]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    spaces: bool = True,
    end_id: int = 0,
    files: int | None = None,
    sample_docs: int = 1000,
    sample_bytes: int = 16_384,
    remember: int = 300_000,
    run_bytes: int = 8 << 20,
) -> DataFrame:
    """Write ``doc_id, text`` as token files in ``folder``; return the manifest.

    ``files`` defaults to the session's number of shuffle partitions. An executor needs the index of
    its file (29 bytes per document) in memory, besides ``run_bytes`` of text with its ids and at most
    ``remember`` words per worker.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    encode = encoder(tokenizer, spaces, remember)
    wide = encode.vocabulary > 65_536 or end_id > 65_535
    ids = encode.encode(_sample(texts, sample_docs, sample_bytes), end_id)
    dictionary = train_dictionary([x.astype("<u4" if wide else "<u2").tobytes() for x in ids])
    digest = hashlib.sha256(dictionary).hexdigest()
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    dictionary_path = f"{folder}/dictionary-{digest}"
    with system.open_output_stream(f"{root}/dictionary-{digest}") as sink:
        sink.write(dictionary)
    handle = spark.sparkContext.broadcast(dictionary)  # at most 32 KB

    def write(batches):
        writer, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, root = file_system(folder)
                name = f"tokens-{part:06d}-{uuid.uuid4().hex}"
                writer = TokenFileWriter(system.open_output_stream(f"{root}/{name}"), handle.value, wide)
            ids_of = batch.column("doc_id").to_pylist()
            for first, found in encoder(tokenizer, spaces, remember).runs(batch.column("text"), end_id, run_bytes):
                for doc_id, ids in zip(ids_of[first:], found):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            row = [part, f"{folder}/{name}", dictionary_path, digest, len(writer.entries), writer.tokens]
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST_ARROW.names, row))], _MANIFEST_ARROW)

    crc = F.crc32("text")
    ordered = texts.repartitionByRange(files, "doc_id", crc).sortWithinPartitions("doc_id", crc, "text")
    ordered.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (little-endian uint32).

    ``start`` counts the ids of all documents before it: files by part, documents by place.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    columns = ["doc_id", "start", "n_tokens", "ids"]

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = ("dictionary", row["dictionary"])
                dictionary = per_process(key, lambda p=row["dictionary"]: read_dictionary(p))
                file, start = TokenFile(row["path"], dictionary), row["base"]
                for entries, frames in file.runs(block_bytes):
                    known = entries["known"].astype(bool)
                    sizes = entries["tokens"].astype("i8")
                    ends = start + np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(entries["doc_id"], pa.int64(), mask=~known),
                            pa.array(ends - sizes),
                            pa.array(sizes),
                            pa.array([file.ids(x).tobytes() for x in frames], pa.binary()),
                        ],
                        columns,
                    )
                    start = int(ends[-1])

    spread = based.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_store(docs: DataFrame, folder: str, tokenizer: str, **options) -> DataFrame:
    """Write the token files and read them back."""
    return read_token_files(write_token_files(docs, folder, tokenizer, **options))


def find_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents named ``doc_id``, from the indexes of the files alone."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    schema = "ids binary"

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = TokenFile(row["path"], read_dictionary(row["dictionary"])).get(doc_id)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary())], ["ids"])

    return [np.frombuffer(x.ids, "<u4") for x in manifest.mapInArrow(look, schema).collect()]
