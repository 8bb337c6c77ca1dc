"""WARC records: parts, round trip, chosen records."""

import base64
import hashlib

from llm import warc

from twinledger.session import scratch_path

PAGES = [(1, "http://a", None), (2, "http://b", ""), (None, "http://c", ""), (3, "http://d", "x"), (2, "http://b", ""), (5, None, "x"), (None, None, "y"), (None, "z", "y"),
         (6, "http://l", "Größe " * 60_000), (7, "http://n\r\nX: 1", "line\r\n\r\nline"), (8, "http://m", "Größe " * 60_000)]


def brute(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        low = first.get(html or "")
        revisit = low is not None and page != low
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_edges(spark):
    pages = spark.createDataFrame([(*p, 0, "q") for p in PAGES], "page_id long, url string, html string, first int, payload string")
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(PAGES)


def test_chosen_records_with_payload(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    index = warc.write(warc.decided(pages), folder, archive_bytes=200)
    assert index.count() == len(PAGES) and index.where("length <= 0").count() == 0
    got = {r.page_id: r for r in warc.read(index.where("page_id in (3, 7, 8)"), folder, payload=True).collect()}
    assert set(got) == {3, 7, 8} and bytes(got[7].payload) == b"line\r\n\r\nline" and got[8].payload is None and got[8].refers_to == 6


def test_an_archive_is_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 10)
    pages = spark.range(300).selectExpr("id as page_id", "'http://u' as url", "sha2(cast(id as string), 512) as html").coalesce(1)
    folder = scratch_path(spark, "warc-test")
    index = warc.write(warc.decided(pages), folder)
    told = warc.read(index, folder)
    assert index.select("archive").distinct().count() == 1 and told.rdd.getNumPartitions() > 20
    assert sorted(r.page_id for r in told.collect()) == list(range(300))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_ranges_share_a_read():
    assert warc.ranges([(0, 10), (10, 5), (20, 5), (1000, 10)], gap=5, most=100) == [(0, 25, [0, 1, 2]), (1000, 1010, [3])]
    assert warc.ranges([(0, 60), (60, 60)], gap=5, most=100) == [(0, 60, [0]), (60, 120, [1])]


def test_record_is_a_member_of_its_own():
    member, digest = warc.record(4, "http://u", b"body", None, None, False)
    fields, block = warc.parse(member)
    assert fields["WARC-Type"] == "response" and block.endswith(b"\r\n\r\nbody") and fields["WARC-Payload-Digest"] == f"sha1:{digest}"
