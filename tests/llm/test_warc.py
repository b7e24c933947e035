import gzip

import pytest

from refweave.llm import warc


def test_members_are_gzip_files_of_their_own():
    record = warc.encode_record(7, "http://a/é", "é".encode(), None, warc._sha1("é".encode()))
    fields, block = warc.parse_record(gzip.decompress(record))
    assert fields["warc-type"] == "response" and block.decode() == "é"


def test_stream_in_any_steps_and_broken_archives():
    data = b"".join(warc.encode_record(k, None, bytes([65 + k % 20]) * (k * 997), None if k % 3 else 0, warc._sha1(bytes([65 + k % 20]) * (k * 997))) for k in range(40))
    for step in (1, 7, 1000, len(data)):
        members = list(warc.inflated_members(iter([data[i : i + step] for i in range(0, len(data), step)])))
        assert [warc.parse_record(m)[0]["warc-record-id"] for m in members] == [f"<urn:page:{k}>" for k in range(40)]
    with pytest.raises(ValueError):
        list(warc.inflated_members(iter([data[:-5]])))
    head, block = gzip.decompress(data[: len(warc.encode_record(0, None, b"", 0, warc._sha1(b"")))]), b""
    with pytest.raises(ValueError):
        warc.parse_record(head.replace(b"Content-Length: 0", b"Content-Length: 1"))


def test_round_trip_with_nulls_and_repeats(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.shared_dir(spark) + "/warc-test"
    files = warc.write_warc(warc.planned_records(pages), folder)
    got = warc.read_warc(files, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [
        (0, "response", 0, 1), (1, "response", 0, 1), (2, "revisit", 1, 1), (2, "revisit", 1, 1), (3, "response", 0, 0), (4, "revisit", 3, 0), (5, "response", 0, 300_000),
    ]
    empty = warc.write_warc(warc.planned_records(pages.limit(0)), folder)
    assert warc.read_warc(empty, folder).count() == 0
