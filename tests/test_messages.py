"""Captured HTTP messages: parsing, archives cut at every byte, and the way to page captures."""

import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from webgauge.sources import messages as m
from webgauge.sources.captures import deflate, inflate


def record(i, body=b"x", lines=(), status=200):
    return m.format_record(f"https://a.example/{i}", None, m.format_message(status, "OK", "1.1", [{"name": n, "value": v} for n, v in lines], body))


def read_in_ranges(data, size):
    """URLs of all records, the file cut into ranges of a size."""
    records = m.Records(io.BytesIO(data), len(data))
    return [fields["warc-target-uri"] for lo in range(0, len(data), size) for fields, _ in records.in_range(lo, min(lo + size, len(data)))]


def test_every_cut_gives_every_record_once():
    rng = random.Random(3)
    data = b"".join(record(i, rng.randbytes(rng.randint(0, 300)) + b"\r\n\r\nWARC/1.0\r\n" * (i % 3 == 0)) for i in range(12))
    expected = [f"https://a.example/{i}" for i in range(12)]
    for size in [*range(1, 40), *range(40, len(data) + 50, 97)]:
        assert read_in_ranges(data, size) == expected, size


def test_an_archive_in_a_body_is_not_taken_for_records():
    inner = b"".join(record(f"inner{i}", b"y" * 50) for i in range(5))
    data = record(0) + record(1, inner) + record(2, inner[:-40]) + record(3)
    for size in range(1, len(data), 61):
        assert read_in_ranges(data, size) == [f"https://a.example/{i}" for i in range(4)], size


def test_a_capture_that_broke_off_loses_its_last_record_at_most():
    whole = b"".join(record(i, b"z" * 200) for i in range(6))
    for cut in range(1, 190, 13):
        for size in (64, 500, 10_000):
            assert read_in_ranges(whole[:-cut], size)[:5] == [f"https://a.example/{i}" for i in range(5)]
    assert read_in_ranges(b"", 10) == []


def message(head, body=b""):
    return m.parse_message("\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + body)


def test_headers_keep_order_and_repeats():
    got = message(["HTTP/1.1 301 Moved Permanently", "Location: /a", "X-A: 1", "x-a: 2", "Location: /b", "Set-Cookie: a=1", "X-Long: begins", "  goes on", "Cookie: a", "cookie: b", "broken", "X-E:"])
    assert got["raw_headers"][:4] == [{"name": "Location", "value": "/a"}, {"name": "X-A", "value": "1"}, {"name": "x-a", "value": "2"}, {"name": "Location", "value": "/b"}]
    assert dict(got["headers"]) == {"location": "/a", "x-a": "1, 2", "set-cookie": "a=1", "x-long": "begins goes on", "cookie": "a; b", "x-e": ""}
    assert (got["status"], got["status_message"], got["http_version"], got["location"], got["error"]) == (301, "Moved Permanently", "1.1", "/a", None)


@pytest.mark.parametrize(
    "head, body, plain, total, error",
    [
        (["HTTP/1.1 200 OK", "Transfer-Encoding: chunked"], b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\nTrailer: 1\r\n\r\n", b"abcde", 5, None),
        (["HTTP/1.1 200 OK", "Transfer-Encoding: gzip, Chunked"], b"a\r\n0123456789\r\n", b"0123456789", 10, "chunks end early"),
        (["HTTP/1.1 200", "Transfer-Encoding: chunked"], b"5\r\nab", b"ab", 2, "chunks end early"),
        (["HTTP/1.1 200", "Transfer-Encoding: chunked"], b"x\r\nab", b"", 0, "chunk without a size"),
        (["HTTP/1.0 204 No Content"], b"", b"", 0, None),
        (["HTTP/1.1 200 OK", "Content-Length: 3"], b"abcd", b"abc", 3, None),
        (["HTTP/1.1 200 OK", "Content-Length: 9"], b"abcd", b"abcd", 4, "body ends early"),
        (["HTTP/1.1 200 OK", "Content-Length: many"], b"abcd", b"abcd", 4, None),
        (["not http"], b"abcd", b"abcd", 4, "no status line"),
    ],
)
def test_bodies(head, body, plain, total, error):
    got = message(head, body)
    assert (got["body"], got["transfer_bytes"], got["error"]) == (plain, total, error)


def test_a_body_beyond_the_limit_is_cut_and_counted():
    sent = m.format_message(200, "OK", "1.1", [{"name": "Transfer-Encoding", "value": "chunked"}], b"q" * 10_000)
    got = m.parse_message(sent, limit=5000)
    assert (len(got["body"]), got["transfer_bytes"], got["truncated"], got["error"]) == (5000, 10_000, True, None)
    assert m.parse_message(b"")["error"] == "no status line"


def test_bodies_are_inflated(spark):
    plain = b"some text " * 50
    raw = zlib.compressobj(wbits=-15)
    cases = [
        (gzip.compress(plain), "gzip", plain), (gzip.compress(plain) + gzip.compress(b"more"), "GZIP", plain + b"more"), (gzip.compress(plain) + b"rest", "x-gzip", plain), (zlib.compress(plain), "deflate", plain),
        (raw.compress(plain) + raw.flush(), "deflate", plain), (gzip.compress(plain)[:-9], "gzip", gzip.compress(plain)[:-9]), (plain, "gzip", plain), (plain, "br", plain), (plain, None, plain), (b"", "gzip", b""), (None, "gzip", None),
    ]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, e) for i, (b, e, _) in enumerate(cases)], "i int, body binary, encoding string")
    got = {r.i: r.plain for r in df.select("i", inflate(F.col("body"), F.col("encoding")).alias("plain")).collect()}
    assert [None if got[i] is None else bytes(got[i]) for i in range(len(cases))] == [p for _, _, p in cases]
    again = df.select("i", inflate(deflate(F.col("body"), F.lit("gzip")), F.lit("gzip")).alias("x"), "body")
    assert all(r.x == r.body for r in again.collect())


ROWS = "url string, fetched_at timestamp, status int, status_message string, http_version string, raw_headers array<struct<name:string,value:string>>, body binary, status_text string"


def test_archives_are_written_and_read(spark, tmp_path):
    folder = str(tmp_path / "archive")
    rows = [(f"https://a.example/{i}", None, 200 + i % 3, "Fine", "1.1", [("Content-Type", "text/html; charset=utf-8"), ("A", "b\r\nc")], bytearray(f"<p>é {i}\r\n\r\nWARC/1.1\r\n".encode()), "x") for i in range(40)]
    rows += [(None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    m.write_messages(df.repartition(3), folder)
    m.write_messages(df.limit(0), folder)
    (tmp_path / "archive" / ".part-of-a-lost-task.warc").write_bytes(record(99))
    got = m.read_messages(spark, folder, split_bytes=700)
    assert got.rdd.getNumPartitions() > 10
    found = {r.url: r for r in m.captures_of_messages(got).collect()}
    assert len(found) == 41 and found[""].status == 200 and found["https://a.example/7"].html == "<p>é 7\r\n\r\nWARC/1.1\r\n"
    r = found["https://a.example/7"]
    assert (r.status, r.site_key, r.origin, r.headers["a"], r.truncated) == (201, "a.example", "https://a.example", "b c", False)
    df.limit(5).select(*m.WRITTEN).write.format(m.NAME).mode("overwrite").save(folder)
    assert m.read_messages(spark, folder).count() == 5
    assert m.read_messages(spark, folder, max_bytes=3).where("truncated").count() == 5


def test_messages_feed_the_audit(spark, tmp_path):
    """From archive bytes to findings: headers and size reach the rules."""
    from webgauge.plans import report

    page = b"<!doctype html><html lang=en><head><title>A page about solar panels for homes</title></head><body><h1>Solar</h1><p>text"
    lines = [("Content-Type", "text/html"), ("Content-Encoding", "gzip"), ("X-Powered-By", "x"), ("Transfer-Encoding", "chunked")]
    df = spark.createDataFrame([("https://a.example/", None, 200, "OK", "1.1", lines, bytearray(gzip.compress(page)), "x")], ROWS)
    folder = str(tmp_path / "archive")
    m.write_messages(df, folder)
    pages = m.captures_of_messages(m.read_messages(spark, folder)).withColumns({"page_id": F.lit(1), "as_of": F.lit("2024-06-01").cast("timestamp")})
    found = {(r.check, r.find_pos): r.status for r in report.findings(report.audited(pages)).collect()}
    assert found[("HTTP header", 1)] == "warn" and found[("HTTP header", 2)] == "ok"
