from __future__ import annotations

import gzip
import uuid

from tidepanel.llm import warc as A
from tidepanel.llm.common import scratch_path

ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/ 3\r\n", "é" * 10), (4, None, None), (5, "http://b/", ""), (6, "http://b/6", "y" * 3_000_000), (6, "http://b/6", "y" * 3_000_000), (None, "http://c/", "<p>x</p>"), (9, "http://a/9", "\r\n\r\nHTTP")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, h, "z", 0) for i, u, h in rows], "page_id long, url string, html string, archive string, offset int")


def test_round_trip(spark):
    folder = scratch_path(spark, "t")
    index = A.write_archives(pages(spark), folder, archive_bytes=500)
    out = A.read_records(index).collect()
    by_id = {r.page_id: r for r in out}
    assert len(out) == len(ROWS)
    for i, _, h in ROWS:
        data = (h or "").encode()
        r = by_id[i]
        assert r.payload_bytes == len(data) and r.payload_digest == A.base32_sha1(data)
        if r.record_type == "response":
            assert r.payload == data
    kinds = {i: (r.record_type, r.refers_to) for i, r in by_id.items()}
    assert kinds[1] == ("response", None) and kinds[2] == ("revisit", 1) and kinds[5] == ("revisit", 4) and kinds[6] == ("response", None) and kinds[None][0] == "response"
    assert by_id[3].url == "http://a/%203%0D%0A"


def test_archives_are_plain_gzip_and_index_gives_each_record(spark):
    folder = scratch_path(spark, "t")
    index = A.write_archives(pages(spark).coalesce(1), folder).collect()
    assert index
    for r in index:
        fs, path = A.filesystem(r.archive)
        with fs.open_input_file(path) as f:
            data = f.read()
        raw = gzip.decompress(data[r.offset : r.offset + r.length])
        assert raw.startswith(b"WARC/1.1\r\n") and A.parse_record(raw)["warc-type"] == r.record_type
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(x.archive == r.archive for x in index)


def test_ranges_cover_selected_records_and_join_neighbours(spark):
    rows = [(i, f"http://h/{i}", f"{i} {uuid.uuid4()}" * 20) for i in range(60)]
    index = A.write_archives(pages(spark, rows).coalesce(1), scratch_path(spark, "t"))
    wanted = index.where("page_id < 20 or page_id > 50")
    ranges = A.plan_ranges(wanted, range_bytes=4000, max_gap=0).collect()
    assert len(ranges) < 29 and sum(len(r.members) for r in ranges) == 29
    assert all(r.start <= m.offset and m.offset + m.length <= r.end for r in ranges for m in r.members)
    assert sorted(r.page_id for r in A.read_records(wanted).collect()) == [*range(20), *range(51, 60)]


def test_one_id_with_several_payloads(spark):
    rows = [(1, "u", "x"), (5, "u", "x"), (5, "u", "other!!!"), (5, "u", "y"), (7, "u", "y"), (7, "u", "other!!!"), (2, "u", "y")]
    out = A.read_records(A.write_archives(pages(spark, rows), scratch_path(spark, "t"))).collect()
    got = sorted((r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to or 0) for r in out)
    want = []
    for i, _, h in rows:
        first = min(j for j, _, g in rows if g == h)
        want.append((i, A.base32_sha1(h.encode()), len(h), "response" if first == i else "revisit", 0 if first == i else first))
    assert got == sorted(want)
    assert {r.payload for r in out if r.record_type == "response"} == {b"x", b"other!!!", b"y"}


def test_reading_is_spread_over_tasks(spark):
    rows = [(i, f"http://h/{i}", f"{i} {uuid.uuid4()}" * 20) for i in range(200)]
    index = A.write_archives(pages(spark, rows).repartition(2), scratch_path(spark, "t"))
    assert A.read_records(index, range_bytes=1000, max_gap=0).rdd.getNumPartitions() >= 4


def test_smaller_payloads_are_responses(spark):
    out = {r.page_id: r.record_type for r in A.read_records(A.write_archives(pages(spark), scratch_path(spark, "t"), min_bytes=9)).collect()}
    assert out[2] == "response" and out[5] == "response"


def test_empty_table_and_query(spark):
    assert A.read_records(A.write_archives(pages(spark, []), scratch_path(spark, "t"))).count() == 0
    out = {r.page_id: r for r in A.op10_warc(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    first: dict = {}
    for p in sorted(rows, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    for p in rows:
        r, data = out[p.page_id], (p.html or "").encode()
        want = (len(data), A.base32_sha1(data)) + (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
