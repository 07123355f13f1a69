"""WARC (operator 10): archives written with an index first, then read by coalesced byte ranges.

Writing: every page becomes one gzip member of a WARC file in the shared folder; of equal payloads (SHA-1 and length of the UTF-8
html) the page with the smallest id is a response, the others are revisit records without payload. A task writes to files of its own
under fresh names and the index lists only what finished tasks wrote, so lost or repeated tasks leave unreferenced files, not wrong rows.
Reading: index rows are sorted by offset within each archive (whose size is bounded), cut into ranges of neighbours, and each range is
read at once and parsed; response payloads are checked against their digest.

Cases: null html is an empty payload; a null url gives a record without target URI (control characters of others are percent-encoded in the header, the index keeps the url as it is);
repeated rows with the smallest id are all responses (and repeat their record id, as the same record); rows that share an id but not a payload are records of
their own (ids hold the payload's digest); a page with a null id is a response and is never referred to; empty tables give an empty index and no archive; columns
other than the three are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import scratch_path, table

INDEX_SCHEMA = "archive string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def filesystem(uri: str):
    """File system and path of a URI; executors reach the shared folder through it."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record, uncompressed. A revisit's block holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id}:{digest}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP length and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(found["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    found["http_length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    found["payload"] = payload
    return found


def _identity() -> list[Column]:
    """SHA-1 and length of the payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return [F.unhex(F.sha1(payload.cast("binary"))).alias("digest"), F.octet_length(payload).alias("size")]


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, size, refers_to of the payloads that repeat one of a smaller id. Ids and digests are shuffled, no html."""
    keyed = pages.select("page_id", *_identity())
    groups = keyed.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(groups, ["digest", "size"]).where("page_id > refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 64 << 20, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under folder and returns their index, itself a table under folder.

    Payloads under min_bytes are always responses. An archive is closed once it has archive_bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fs = name = None
        size = 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                payload = x["payload"] or b""
                digest = base32_sha1(payload)
                refers_to = x["refers_to"] if len(payload) >= min_bytes else None
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(_record(x["page_id"], x["url"], payload, digest, len(payload), refers_to, date)) + pack.flush()
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs, path = filesystem(folder)
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                rows.append((f"{folder}/{name}", size, len(member), x["page_id"], x["url"], len(payload), digest, "response" if refers_to is None else "revisit", refers_to))
                size += len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])
        if out is not None:
            out.close()

    html = F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    again = revisits(pages).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("size").alias("__size"), "refers_to")
    same = (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size"))
    ready = pages.select("page_id", "url", html, *_identity()).join(again, same, "left").select("page_id", "url", "payload", "refers_to")
    index = f"{folder}/index"
    ready.mapInArrow(write, INDEX_SCHEMA).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(index)


def plan_ranges(index: DataFrame, range_bytes: int = 8 << 20, max_gap: int = 64 << 10) -> DataFrame:
    """Byte ranges over the selected index rows: neighbours at most max_gap apart, about range_bytes at most together.

    The window runs within one archive, whose size writing bounds.
    """
    by_offset = Window.partitionBy("archive").orderBy("offset")
    apart = F.col("offset") - F.lag(F.col("offset") + F.col("length"), 1, 0).over(by_offset)
    cut = index.select("archive", "offset", "length").withColumn("jump", (apart > max_gap).cast("int"))
    runs = cut.select("archive", "offset", "length", F.sum("jump").over(by_offset).alias("run"), F.floor(F.sum("length").over(by_offset) / range_bytes).alias("part"))
    members = F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members")
    return runs.groupBy("archive", "run", "part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), members)


def read_records(index: DataFrame, with_payload: bool = True, range_bytes: int = 8 << 20, max_gap: int = 64 << 10) -> DataFrame:
    """Reads the selected records by coalesced ranges and parses them. A response whose payload differs from its digest raises.

    The ranges are dealt out by the archive bytes behind them (known from the index), not by the size of their few index rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for x in batch.to_pylist():
                fs, path = filesystem(x["archive"])
                with fs.open_input_file(path) as file:
                    file.seek(x["start"])
                    data = file.read(x["end"] - x["start"])
                rows = []
                for m in x["members"]:
                    at = m["offset"] - x["start"]
                    found = parse_record(zlib.decompress(data[at : at + m["length"]], 31))
                    number = lambda key: int(v[1]) if (v := re.fullmatch(r"<urn:page:(-?\d+):[A-Z2-7]+>", found.get(key, ""))) else None  # noqa: E731, B023
                    digest, size = found["warc-payload-digest"].removeprefix("sha1:"), found["http_length"]
                    if found["warc-type"] == "response":
                        size = len(found["payload"])
                        if base32_sha1(found["payload"]) != digest:
                            raise ValueError(f"the payload at {x['archive']}:{m['offset']} differs from its digest")
                    rows.append((number("warc-record-id"), found.get("warc-target-uri"), found["warc-type"], number("warc-refers-to"), size, digest, found["payload"] if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * range_bytes)))
    return plan_ranges(index, range_bytes, max_gap).repartition(tasks, "archive", "start").mapInArrow(read, RECORD_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
