"""Archives: round trip, revisits, ranges."""

import base64
import hashlib

from voxtally.llm import warc


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_ranges_join_up_to_gap_and_size():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5)], max_gap=4, max_read=100) == [(0, 15, 2), (20, 25, 1)]
    assert warc.coalesced([(0, 10), (12, 5), (17, 90)], max_gap=4, max_read=100) == [(0, 17, 2), (17, 107, 1)]
    assert warc.coalesced([]) == []


def test_records_come_back(spark):
    long = "é<p>" * 200_000
    rows = [
        (5, "http://a/\r\nWARC-Type: x", "same", 1), (3, None, "same", 1), (9, "u", None, 1), (4, "u", "", 1),
        (7, "u", long, 1), (None, "u", "same", 1), (None, "u", "alone", 1), (3, "u", "same", 1), (8, "u", "x\r\n\r\ny", 1),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, file int").repartition(3)
    index = warc.write_archives(df)
    assert index.columns == ["file", "offset", "length", "url", "payload_digest", "page_id"]
    got = sorted(
        ((r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode(), r.payload_bytes, r.payload_digest)
         for r in warc.read_records(index).collect()),
        key=str,
    )
    d = lambda t: (len(t.encode()), sha(t.encode()))
    want = sorted(
        [
            (5, "revisit", 3, None, *d("same")), (3, "response", None, "same", *d("same")),
            (3, "response", None, "same", *d("same")), (9, "revisit", 4, None, *d("")),
            (4, "response", None, "", *d("")), (7, "response", None, long, *d(long)),
            (None, "revisit", 3, None, *d("same")), (None, "response", None, "alone", *d("alone")),
            (8, "response", None, "x\r\n\r\ny", *d("x\r\n\r\ny")),
        ],
        key=str,
    )
    assert got == want
    some = warc.read_records(index.where("page_id in (7, 8)")).collect()
    assert {r.page_id for r in some} == {7, 8}
    assert warc.read_records(warc.write_archives(df.limit(0))).collect() == []


def test_small_payloads_stay(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_records(warc.write_archives(df, min_payload=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
