"""WARC archives: written with one gzip member for each record, read back sequentially.

Writing: digests and lengths are computed by built-in functions. Each payload's
smallest page_id comes from an aggregation over digests (partial before the shuffle), and
is joined back by digest as narrow rows through ``skew.lookup``, so the pages of a payload that a third of all pages share
get it where they are. The
revisits found so meet the payloads by page_id. Each task streams its records into
part files of the shared folder, under a name of its own attempt, and moves each into place when it
is whole; the list of files is itself written as a table before anything is read, so a lost
executor only repeats its own files.

Reading: the files, whose number and bytes the manifest has, are dealt to tasks of one to a few files each. A task inflates a file member by member with zlib's incremental
decompressor in fixed steps. The record's header says its Content-Length as soon as it is there; the member must end just behind the two line breaks after so many
bytes, else it is broken. Block and
payload digests are verified; memory is bounded by the largest record. A broken frame or digest raises.

A record is a response (payload: the page in UTF-8) or a revisit of the response with the
same payload, without a body. Payloads below ``least_bytes`` are always responses.

Cases: null html is the empty payload; null urls are written empty; a null page_id is kept, is always a response
and revisited by none; rows that repeat page_id and payload are all responses where they have the smallest id, else
all revisits; ties (equal payloads) go to the smallest page_id; very long pages are whole, in memory one at a time; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm.common import bounded, cut, shared_dir, table
from refweave.operators.skew import lookup

STEP = 1 << 16
FILE_BYTES = 64 << 20
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None, digest: str) -> bytes:
    """One record as a gzip member. The record's id carries the page_id; ``WARC-X-Payload-Length`` the length that a revisit leaves out."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_sha1(body)}"),
        ("WARC-X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(body))),
    ]
    head = VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head + body + b"\r\n\r\n") + deflate.flush()


def framed_length(member: bytes | bytearray) -> int | None:
    """The length of a record by its Content-Length, header and line breaks included; None while the header isn't whole."""
    end = member.find(b"\r\n\r\n")
    if end < 0:
        return None
    for line in bytes(member[:end]).split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return end + 4 + int(value) + 4
    raise ValueError("a record without Content-Length")


def inflated_members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated records of a stream of gzip members, framed by their Content-Length."""
    inflate, out, length = zlib.decompressobj(31), bytearray(), None
    begun = False

    def add(more: bytes) -> None:
        nonlocal out, length
        out += more
        length = framed_length(out) if length is None else length
        if length is not None and len(out) > length:
            raise ValueError("a member goes on beyond its record's Content-Length")

    for chunk in chunks:
        while chunk:
            begun = True
            add(inflate.decompress(chunk, STEP))
            while not inflate.eof and inflate.unconsumed_tail:
                add(inflate.decompress(inflate.unconsumed_tail, STEP))
            if not inflate.eof:
                break
            if len(out) != length:
                raise ValueError("a member ends before its record's Content-Length")
            yield bytes(out)
            chunk, inflate, out, length, begun = inflate.unused_data, zlib.decompressobj(31), bytearray(), None, False
    if begun:
        raise ValueError("the archive ends within a record")


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-cased names) and block of a member that is one record."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is not its Content-Length")
    block = rest[:n]
    if fields["warc-block-digest"] != f"sha1:{_sha1(block)}" or (fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{_sha1(block)}"):
        raise ValueError(f"digest mismatch in {fields['warc-record-id']}")
    return fields, block


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def planned_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): what to write for each page; refers_to is null for responses."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marks = sized.select("page_id", F.octet_length("html").alias("n"), F.sha1(F.col("html").cast("binary")).alias("sha1"))
    marks = marks.filter(F.col("page_id").isNotNull() & (F.col("n") >= least_bytes)).select("page_id", "sha1")
    shared = marks.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("pages")).filter(F.col("last") > F.col("first"))
    shared = cut(shared.select("sha1", "first", "pages"))
    total = shared.agg(F.sum("pages").alias("n")).first()["n"] or 0  # pages with a payload that comes again
    again = lookup(marks, shared, "sha1", "pages", total).filter(F.col("page_id") > F.col("first"))
    again = again.select(F.col("page_id").alias("again"), F.col("sha1").alias("payload"), F.col("first").alias("refers_to")).distinct()
    same = (F.col("page_id") == F.col("again")) & (F.sha1(F.col("html").cast("binary")) == F.col("payload"))
    return sized.join(again, same, "left").select("page_id", "url", "html", "refers_to")


def write_warc(planned: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``planned_records`` rows below ``folder`` (a URI that all executors share); the table of files."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        done, out, path, n, size = [], None, "", 0, 0

        def close() -> None:
            nonlocal out, n, size
            if out is not None:
                out.close()
                store.move(f"{path}.part", path)
                done.append((path, n, size))
                out, n, size = None, 0, 0

        for part in parts:
            for page_id, url, html, ref in zip(part["page_id"], part["url"], part["html"], part["refers_to"], strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}.part", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                record = encode_record(page_id, url, payload, ref, _sha1(payload))
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= file_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    # Ids travel as text: pandas would make a nullable long a double.
    return cut(bounded(planned).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string")).mapInPandas(write, MANIFEST))


def read_warc(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """``RECORDS`` of the archives of a table of files; payload is null for revisits, and for all if ``payloads`` is off."""

    def page(value: str) -> str | None:
        return value.removeprefix("<urn:page:").removesuffix(">") or None

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(folder)
        for part in parts:
            for path in part["path"]:
                batch, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in inflated_members(iter(lambda stream=stream: stream.read(STEP), b"")):
                        f, block = parse_record(member)
                        revisit = f["warc-type"] == "revisit"
                        batch.append((page(f["warc-record-id"]), f["warc-target-uri"], int(f["warc-x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], page(f["warc-refers-to"]) if revisit else None, block if payloads and not revisit else None))
                        size += len(batch[-1][-1] or b"") + 200
                        if size >= 8 << 20:
                            yield frame(batch)
                            batch, size = [], 0
                yield frame(batch)

    def frame(batch: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(batch, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"payload_bytes": "int64"})

    # A given number of partitions is kept: one for each file up to what runs at once, then by bytes.
    known = files.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    lanes = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-(known["bytes"] or 0) // (4 * FILE_BYTES)))
    read = files.repartition(max(1, min(known["n"], lanes))).mapInPandas(rows, RECORDS)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    files = write_warc(planned_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0), folder)
    return read_warc(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hex digits of the digest are four characters.
    four = " || ".join(f"substr('{alphabet}', (('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> {shift}) % 32 + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {four}), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM m"""


ORACLE = _oracle()
