"""WARC archives: one gzip member per record, written by tasks and read back in sequence.

Of the records with equal payloads of at least ``least`` bytes, the one with the smallest page id
is a response and the others are revisits that refer to it; shorter ones are all responses. The
reader inflates member after member from a stream, frames the block by Content-Length, and compares
the digest of every block; it never holds more than one record.

Spark commits a manifest row per finished archive, so files of failed attempts are never read.

Edge cases: a null html is an empty payload; a null page id is a revisit where an equal payload has
an id, else a response; rows with the same smallest id are all responses; a null url gives no
target URI, line ends in one are percent-encoded; an empty table gives no archive and no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import file_system, join_hot
from wattloom.storage import materialise

_MANIFEST = "path string, records long, bytes long"
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string,"
    " refers_to long, payload binary"
)
_RECORDS_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record that breaks the format or its own digest."""


def record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_digest, first_id``; ``first_id`` is null for short payloads.

    Only digests that occur twice come back to the pages; they are grouped with partial aggregates,
    so a payload with a third of all pages is one row per task before the shuffle. Neither its pages nor
    those with short or empty payloads meet in one task afterwards.
    """
    payloads = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    groups = payloads.groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"),
        F.count("*").alias("n"),
        F.max(F.octet_length("payload")).alias("size"),
    )
    repeated = materialise(groups.where("n > 1"), "payload-groups")
    long = repeated.where(F.col("size") >= least).select("payload_digest", "first_id")
    return join_hot(payloads, long, "payload_digest", repeated.select("payload_digest", "n"))


def _header(pairs: list[tuple[str, object]]) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in pairs if value is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def _uri(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")


def build_record(row: dict) -> bytes:
    """One gzip member."""
    payload, digest, first = row["payload"], row["payload_digest"], row["first_id"]
    revisit = first is not None and row["page_id"] != first
    block = b"" if revisit else payload
    head = _header(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", "2000-01-01T00:00:00Z"),
            ("WARC-Target-URI", _uri(row["url"])),
            ("WARC-Profile", _PROFILE if revisit else None),
            ("WARC-Refers-To", f"<urn:page:{first}>" if revisit else None),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Page-ID", row["page_id"]),
            ("X-Payload-Length", len(payload)),
            ("Content-Type", "text/html"),
            ("Content-Length", len(block)),
        ]
    )
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def write_archives(typed: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write the records of every task into archives of about ``archive_bytes``; the manifest."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        sink, done = None, {}
        for batch in batches:
            for row in (x for part in _narrow(batch) for x in part.to_pylist()):
                if sink is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                    done = {"path": f"{folder}/{name}", "records": 0, "bytes": 0}
                member = build_record(row)
                sink.write(member)
                done["records"] += 1
                done["bytes"] += len(member)
                if done["bytes"] >= archive_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([done], _MANIFEST_ARROW)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([done], _MANIFEST_ARROW)

    rows = typed.select("page_id", "url", "payload", "payload_digest", "first_id")
    rows.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return typed.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _narrow(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def read_members(source, chunk: int = 1 << 18) -> Iterator[bytes]:
    """Content of each gzip member of a stream, inflated as the bytes come in."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    while piece := source.read(chunk):
        while piece:
            begun = True
            parts.append(inflate.decompress(piece))
            piece = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise BadRecord("the last gzip member is cut off")


def parse_record(content: bytes) -> dict:
    """Fields of one record; raises if framing or a digest is wrong."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise BadRecord("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadRecord("Content-Length and block differ")
    digest = hashlib.sha256(block).hexdigest()
    if fields["warc-block-digest"] != f"sha256:{digest}":
        raise BadRecord("the block has another digest")
    kind, payload = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    length = int(fields["x-payload-length"])
    if kind == "response" and (payload != digest or length != size):
        raise BadRecord("the payload has another digest or length")
    refers = fields.get("warc-refers-to")
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": payload,
        "refers_to": int(refers.removeprefix("<urn:page:").removesuffix(">")) if refers else None,
        "payload": block,
    }


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of all archives of a manifest; a revisit has an empty payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in (x for batch in batches for x in batch.column("path").to_pylist()):
            system, name = file_system(path)
            with system.open_input_stream(name, compression=None) as source:
                for content in read_members(source):
                    rows.append(parse_record(content))
                    size += len(content) + 1000
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, _RECORDS_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _RECORDS_ARROW)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks).mapInArrow(read, _RECORDS)


def archive_pages(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write all pages and read them back."""
    return read_archives(write_archives(record_types(pages, least), folder))
