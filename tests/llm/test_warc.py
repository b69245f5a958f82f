import gzip
import hashlib
import io

import pytest

from wattloom.llm import queries, warc

PAGES = "page_id long, url string, html string"
LONG = "<p>equal</p>" * 20


def expected(rows, least=100):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same, default=None)
        revisit = len(raw) >= least and first is not None and page != first
        kind = "revisit" if revisit else "response"
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), kind, first if revisit else None))
    return sorted(map(str, out))


def digest(rows):
    return sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in rows)


def test_query(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert digest(queries.op3_warc_reader(spark, sf).collect()) == expected(rows)


def test_odd_pages(spark, folder, clashing):
    rows = [
        (1, "http://a/", None),
        (2, None, ""),
        (3, "http://a/b c\r\nX-Page-ID: 9", LONG),
        (4, "http://é/", LONG),
        (4, "http://again/", LONG),
        (3, "http://a/", LONG),
        (5, "u", "short"),
        (6, "u", "short"),
        (None, "u", LONG),
        (None, "u", "x" * 200),
        (7, "u", "y" * 3_000_000),
        (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 10),
    ]
    pages = clashing(spark.createDataFrame(rows, PAGES))
    found = warc.archive_pages(pages, folder).collect()
    assert digest(found) == expected(rows)
    assert {x.page_id: bytes(x.payload) for x in found if x.record_type == "response"}[7] == b"y" * 3_000_000
    assert all(x.payload == b"" for x in found if x.record_type == "revisit")


def test_no_pages(spark, folder):
    assert warc.archive_pages(spark.createDataFrame([], PAGES), folder).count() == 0


def test_archives_are_cut_and_every_record_is_a_member(spark, folder):
    pages = spark.createDataFrame([(n, "u", f"page {n}" * 50) for n in range(30)], PAGES)
    manifest = warc.write_archives(warc.record_types(pages), folder, archive_bytes=1000)
    assert manifest.count() > 2
    path = manifest.first().path.removeprefix("file://")
    with open(path, "rb") as source:
        members = list(warc.read_members(source, chunk=7))
    with gzip.open(path) as source:
        assert source.read() == b"".join(members)
    assert len(members) == manifest.first().records


def record(**changes):
    row = {"page_id": 1, "url": "u", "payload": b"some payload", "first_id": None}
    row["payload_digest"] = hashlib.sha256(row["payload"]).hexdigest()
    return gzip.decompress(warc.build_record(row | changes))


def test_broken_records_are_refused():
    assert warc.parse_record(record())["payload"] == b"some payload"
    with pytest.raises(warc.BadRecord, match="digest"):
        warc.parse_record(record().replace(b"some payload", b"same payload"))
    with pytest.raises(warc.BadRecord, match="Content-Length"):
        warc.parse_record(record().replace(b"some payload", b"some"))
    with pytest.raises(warc.BadRecord, match="cut off"):
        list(warc.read_members(io.BytesIO(gzip.compress(record())[:-20])))
