"""Certificates and name answers made by the tests themselves, and the guard by captured answers."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from webgauge.sources.probes import certificate_facts, der_time, dns_answer, dns_name, guarded, host_addresses, with_certificates


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def name(organization=None, tag=0x0C, filler=0):
    pair = lambda oid, kind, value: der(0x31, der(0x30, der(0x06, oid), der(kind, value)))
    parts = [pair(b"\x55\x04\x06", 0x13, b"DE"), pair(b"\x55\x04\x03", 0x0C, b"common" + b"x" * filler)]
    if organization is not None:
        parts.insert(1, pair(b"\x55\x04\x0a", tag, organization))
    return der(0x30, *parts)


def cert(issuer=b"Let us Trust", begin=(0x17, b"240101000000Z"), end=(0x17, b"240301120000Z"), version=True, tag=0x0C):
    algorithm = der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x0b"), der(0x05))
    body = [der(0xA0, der(0x02, b"\x02"))] if version else []
    body += [der(0x02, b"\x01" * 18), algorithm, name(issuer, tag), der(0x30, der(*begin), der(*end)), name(b"Subject Org", filler=300), der(0x30, algorithm, der(0x03, b"\x00" * 270))]
    return der(0x30, der(0x30, *body), algorithm, der(0x03, b"\x00" * 257))


def utc(*parts):
    return datetime.datetime(*parts, tzinfo=datetime.timezone.utc)


def test_certificates():
    got = certificate_facts(cert())
    assert (got["issuer"], got["valid_from"], got["valid_to"]) == ("Let us Trust", utc(2024, 1, 1), utc(2024, 3, 1, 12))
    assert certificate_facts(cert(version=False))["valid_to"] == utc(2024, 3, 1, 12)
    assert certificate_facts(cert(issuer=None))["issuer"] is None
    assert certificate_facts(cert("Über".encode("utf-16-be"), tag=0x1E))["issuer"] == "Über"
    assert certificate_facts(cert(end=(0x18, b"20511231235959Z")))["valid_to"] == utc(2051, 12, 31, 23, 59, 59)


def test_times():
    assert der_time(0x17, b"500101000000Z") == utc(1950, 1, 1) and der_time(0x17, b"491231235959Z") == utc(2049, 12, 31, 23, 59, 59)
    assert der_time(0x17, b"2401010000Z") == utc(2024, 1, 1) and der_time(0x17, b"240101020000+0200") == utc(2024, 1, 1)
    for bad in (b"", b"24010100000", b"240101000000", b"249901000000Z"):
        with pytest.raises(ValueError):
            der_time(0x17, bad)


def test_bytes_that_are_no_certificate(spark):
    whole = cert()
    rows = [("ok", whole), ("cut", whole[:-9]), ("junk", b"hello"), ("empty", b""), ("none", None), ("long", b"\x30\x84\xff\xff\xff\xff"), ("flat", der(0x30, der(0x02, b"\x01")))]
    df = spark.createDataFrame([(o, bytearray(b) if b is not None else None, "h2") for o, b in rows], "origin string, cert_der binary, protocol string")
    got = {r.origin: r for r in with_certificates(df).collect()}
    assert got["ok"].cert_issuer == "Let us Trust" and got["ok"].cert_valid_to is not None and got["ok"].protocol == "h2"
    assert all(got[o].cert_valid_to is None for o, _ in rows[1:])


def test_days_left_reach_the_transport_check(spark):
    from webgauge.plans import report

    probes = with_certificates(spark.createDataFrame([(bytearray(cert()), "http/1.1", "TLSv1.3")], "cert_der binary, protocol string, tls_version string"))
    pages = probes.withColumns({"page_id": F.lit(1), "url": F.lit("https://a.example/"), "html": F.lit("<p>x"), "as_of": F.lit("2024-02-25 12:00:00").cast("timestamp")})
    found = {(r.check, r.find_pos): r.status for r in report.findings(report.audited(pages)).collect() if r.check == "Protocol & transport"}
    assert "warn" in found.values()  # five days left


def q(host):
    return b"".join(bytes([len(x)]) + x for x in host.encode().split(b".")) + b"\0"


def message(host, *records, flags=0x8180):
    return struct.pack(">6H", 1, flags, 1, len(records), 0, 0) + q(host) + struct.pack(">2H", 1, 1) + b"".join(records)


def record(owner, kind, data):
    return owner + struct.pack(">2HIH", kind, 1, 60, len(data)) + data


POINTER = b"\xc0\x0c"


def test_name_answers():
    got = dns_answer(message("a.example", record(POINTER, 1, bytes([93, 184, 216, 34])), record(POINTER, 28, bytes.fromhex("26064700" + "0" * 23 + "1")), record(POINTER, 16, b"\x04text")))
    assert got == {"name": "a.example", "rcode": 0, "addresses": ["93.184.216.34", "2606:4700::1"], "error": None}
    chain = dns_answer(message("A.Example", record(q("a.example"), 5, b"\x03www" + POINTER), record(b"\x03WWW" + POINTER, 1, bytes(4)), record(q("other.example"), 1, bytes([1, 1, 1, 1]))))
    assert (chain["name"], chain["addresses"]) == ("a.example", ["0.0.0.0"])  # an address of a name nobody asked for doesn't count
    assert dns_answer(message("gone.example", flags=0x8183))["rcode"] == 3


@pytest.mark.parametrize(
    "data",
    [
        b"", b"\0" * 11, message("a.example", record(POINTER, 1, bytes(5))), message("a.example", record(POINTER, 1, bytes(4)))[:-2], struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1",
        struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\x80x\0\1\0\1", struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\x09short",
    ],
)
def test_bytes_that_are_no_answer(data):
    with pytest.raises((ValueError, IndexError)):
        dns_answer(data)


def test_names_end():
    loop = b"\0" * 12 + b"\x01a\xc0\x0c"
    with pytest.raises(ValueError):
        dns_name(loop, 12)
    assert dns_name(b"\x01a\0\x01b\xc0\x00", 3) == ("b.a", 7)


def test_any_bad_address_refuses(spark):
    answers = [message("good.example", record(POINTER, 1, bytes([8, 8, 8, 8]))), message("mixed.example", record(POINTER, 1, bytes([8, 8, 8, 8]))), message("mixed.example", record(POINTER, 1, bytes([10, 0, 0, 1]))), message("none.example"), b"junk"]
    hosts = host_addresses(spark.createDataFrame([(bytearray(a),) for a in answers], "message binary"))
    assert {r.host: (r.addresses, r.reasons) for r in hosts.collect()} == {
        "good.example": (["8.8.8.8"], [None]), "mixed.example": (["10.0.0.1", "8.8.8.8"], ["a private 10.0.0.0/8 address", None]), "none.example": ([], []),
    }
    cases = {
        "https://good.example/": None, "https://GOOD.example.:8443/x": None, "http://mixed.example/": "a private 10.0.0.0/8 address", "http://none.example/": "the host has no address", "http://unknown.example/": "the host has no address",
        "ftp://good.example/": "only http and https are fetched", "https://good.example:25/": "a reserved port", "http://127.0.0.1/": "a loopback address", "http://[::1]:8080/": "a loopback address", "http://u:p@[2606:4700::1]/": None,
    }
    got = {r.url: r.refusal for r in guarded(spark.createDataFrame([(u,) for u in cases], "url string"), hosts).collect()}
    for u, why in cases.items():
        assert (got[u] is None) == (why is None) and (why is None or why.split()[-1] in got[u]), (u, got[u])
