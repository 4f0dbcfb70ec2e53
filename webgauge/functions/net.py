"""Which addresses may be fetched: private, reserved and tunnelled ranges are refused."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: refused IPv4 ranges in the order that names them: (network, prefix length, reason).
IPV4_REFUSED = [
    ("0.0.0.0", 8, "in the unspecified 0.0.0.0/8 range"),
    ("10.0.0.0", 8, "a private 10.0.0.0/8 address"),
    ("127.0.0.0", 8, "a loopback address"),
    ("169.254.0.0", 16, "a link-local address (this is the cloud metadata range)"),
    ("172.16.0.0", 12, "a private 172.16.0.0/12 address"),
    ("192.168.0.0", 16, "a private 192.168.0.0/16 address"),
    ("100.64.0.0", 10, "a carrier-grade NAT address"),
    ("192.0.0.0", 24, "in the reserved 192.0.0.0/24 range"),
    ("198.18.0.0", 15, "in the benchmarking 198.18.0.0/15 range"),
    ("192.0.2.0", 24, "a documentation-only address"),
    ("198.51.100.0", 24, "a documentation-only address"),
    ("203.0.113.0", 24, "a documentation-only address"),
    ("224.0.0.0", 4, "a multicast address"),
    ("240.0.0.0", 4, "in the reserved 240.0.0.0/4 range"),
]


# Refused IPv6 ranges: (network, reason).
IPV6_REFUSED = [
    ("::/128", "the unspecified address"),
    ("::1/128", "a loopback address"),
    ("ff00::/8", "a multicast address"),
    ("fe80::/10", "a link-local address"),
    ("fc00::/7", "a unique-local address"),
    ("0:0:0:0:ffff::/80", "in the discard-only 100::/64 range"),
    ("2001::/32", "a Teredo tunnel address"),
]

# IPv6 ranges whose addresses carry an IPv4 address: (network, bits before it, name).
IPV6_CARRIERS = [
    ("::ffff:0:0/96", 96, "an IPv4-mapped"),
    ("64:ff9b::/96", 96, "a NAT64"),
    ("2002::/16", 16, "a 6to4"),
]

_V4 = [(ipaddress.IPv4Network((network, bits)), why) for network, bits, why in IPV4_REFUSED]
_V6 = [(ipaddress.IPv6Network(network), why) for network, why in IPV6_REFUSED]
_CARRIERS = [(ipaddress.IPv6Network(network), at, name) for network, at, name in IPV6_CARRIERS]


def ipv4_reason(ip: Column) -> Column:
    """Why an IPv4 address in text is refused; null if it isn't."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(F.regexp_like(p, F.lit(r"^[0-9]{1,3}$")), p.cast("int")))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    out = F.when(~F.coalesce(valid, F.lit(False)), "not a valid IPv4 address")
    for network, bits, why in IPV4_REFUSED:
        out = out.when(F.shiftright(number, 32 - bits) == (int(ipaddress.IPv4Address(network)) >> (32 - bits)), why)
    return out.otherwise(F.lit(None).cast("string"))


def _first(ranges: list, address) -> str | None:
    return next((why for network, why in ranges if address in network), None)


def ipv6_refusal(text: str) -> str | None:
    """Why an IPv6 address in any text form is refused; one that carries an IPv4 address is judged by that."""
    try:
        address = ipaddress.IPv6Address(text.strip("[]"))
    except ValueError:
        return "not a valid IPv6 address"
    address = ipaddress.IPv6Address(int(address))  # without a zone
    for network, at, name in _CARRIERS:
        if address in network:
            inner = ipaddress.IPv4Address(int(address) >> (96 - at) & 0xFFFFFFFF)
            why = _first(_V4, inner)
            return f"{name} address for {inner}, which is {why}" if why else None
    return _first(_V6, address)


@F.arrow_udf(T.StringType())
def _ipv6_reason(ip: pa.Array) -> pa.Array:
    return pa.array([None if x is None else ipv6_refusal(x) for x in ip.to_pylist()], pa.string())


def address_reason(ip: Column) -> Column:
    """Why an address is refused; only addresses with a colon go to Python."""
    return F.when(F.contains(ip, F.lit(":")), _ipv6_reason(ip)).otherwise(ipv4_reason(ip))


def url_refusal(scheme: Column, port: Column, reasons: Column) -> Column:
    """Why a URL may not be fetched, by its scheme, port (null: usual) and its addresses' reasons."""
    return (
        F.when(~scheme.isin("http", "https"), "only http and https are fetched")
        .when((port < 1024) & ~port.isin(80, 443), "a reserved port")
        .when(F.size(reasons) == 0, "the host has no address")
        .otherwise(F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0)))
    )
