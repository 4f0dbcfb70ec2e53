"""Facts from captured probes: certificates as DER bytes, and answers of name servers as messages."""

from __future__ import annotations

import datetime
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webgauge.functions import net, urls

# -- certificates ----------------------------------------------------------------------------------------------------------

ORGANIZATION = bytes((0x55, 0x04, 0x0A))  # 2.5.4.10
SEQUENCE, EXPLICIT_0, UTC_TIME, GENERALIZED_TIME, BMP_STRING = 0x30, 0xA0, 0x17, 0x18, 0x1E
CERTIFICATE = T.StructType([T.StructField("issuer", T.StringType()), T.StructField("valid_from", T.TimestampType()), T.StructField("valid_to", T.TimestampType()), T.StructField("error", T.StringType())])


def der_items(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that follow each other; ValueError where they don't fill the bytes."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            raise ValueError("an element ends early")
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                raise ValueError("a length that can't be")
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            raise ValueError("an element ends early")
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_time(tag: int, content: bytes) -> datetime.datetime:
    """A time of two-digit years from 1950 to 2049, or of four digits."""
    text = content.decode("ascii")
    if tag == UTC_TIME:
        text = ("19" if text[:2] >= "50" else "20") + text
    elif tag != GENERALIZED_TIME:
        raise ValueError("no time")
    m = re.fullmatch(r"(\d{12})(\d\d)?(?:\.\d+)?(Z|[+-]\d{4})", text)
    if not m:
        raise ValueError("no time")
    zone = "+0000" if m[3] == "Z" else m[3]
    return datetime.datetime.strptime(m[1] + (m[2] or "00") + zone, "%Y%m%d%H%M%S%z").astimezone(datetime.timezone.utc)


def certificate_facts(der: bytes) -> dict:
    """Issuer's organisation (null if it names none) and the time of validity of an X.509 certificate."""
    ((_, outer), *_) = der_items(der)
    body = der_items(der_items(outer)[0][1])
    if body and body[0][0] == EXPLICIT_0:  # the version, where one is given
        body = body[1:]
    _, _, (_, issuer), (_, validity), *_ = body
    organization = None
    for _, names in der_items(issuer):
        for _, pair in der_items(names):
            (_, kind), (tag, value) = der_items(pair)
            if kind == ORGANIZATION and organization is None:
                organization = value.decode("utf-16-be" if tag == BMP_STRING else "utf-8", "replace")
    begin, end = (der_time(*x) for x in der_items(validity))
    return {"issuer": organization, "valid_from": begin, "valid_to": end, "error": None}


@F.arrow_udf(CERTIFICATE)
def certificate(der: pa.Array) -> pa.Array:
    """Facts of captured certificates; null bytes give null, bytes that are none an error."""
    out = []
    for b in der.to_pylist():
        try:
            out.append(None if b is None else certificate_facts(b))
        except (ValueError, IndexError, UnicodeDecodeError) as e:
            out.append({"issuer": None, "valid_from": None, "valid_to": None, "error": f"not a certificate: {e}"})
    return pa.array(out, to_arrow_type(CERTIFICATE))


def with_certificates(probes: DataFrame) -> DataFrame:
    """Transport probes (origin, cert_der, ...) with cert_valid_to and cert_issuer, as the audit's context takes them."""
    facts = probes.withColumn("_c", certificate(F.col("cert_der")))
    return facts.withColumns({"cert_valid_to": F.col("_c.valid_to"), "cert_issuer": F.col("_c.issuer")}).drop("_c", "cert_der")


# -- name answers ------------------------------------------------------------------------------------------------------------

A, CNAME, AAAA = 1, 5, 28
ANSWER = T.StructType([T.StructField("name", T.StringType()), T.StructField("rcode", T.IntegerType()), T.StructField("addresses", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def dns_name(data: bytes, at: int) -> tuple[str, int]:
    """(name, place after it); a pointer leads to an earlier place only, so that names end."""
    labels, after, least = [], None, at
    while True:
        size = data[at]
        if size & 0xC0 == 0xC0:
            to = int.from_bytes(data[at : at + 2], "big") & 0x3FFF
            after = at + 2 if after is None else after
            if to >= least or at + 2 > len(data):
                raise ValueError("a pointer that doesn't lead back")
            at = least = to
        elif size & 0xC0:
            raise ValueError("an unknown kind of label")
        elif size == 0:
            return ".".join(labels).lower(), at + 1 if after is None else after
        else:
            if at + 1 + size > len(data):
                raise ValueError("a label ends early")
            labels.append(data[at + 1 : at + 1 + size].decode("latin-1"))
            at += 1 + size


def dns_answer(data: bytes) -> dict:
    """The name asked for and its addresses, those of the names it stands for among them, in the answer's order."""
    if len(data) < 12:
        raise ValueError("the header ends early")
    flags, questions, answers = (int.from_bytes(data[i : i + 2], "big") for i in (2, 4, 6))
    at, asked = 12, None
    for _ in range(questions):
        name, at = dns_name(data, at)
        asked = name if asked is None else asked
        at += 4
    same, found = {asked}, []
    for _ in range(answers):
        name, at = dns_name(data, at)
        kind, size = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 8 : at + 10], "big")
        at += 10
        if at + size > len(data):
            raise ValueError("a record ends early")
        if kind == CNAME and name in same:
            same.add(dns_name(data, at)[0])
        elif kind in (A, AAAA) and name in same:
            if size != (4 if kind == A else 16):
                raise ValueError("an address of another length")
            found.append(str(ipaddress.ip_address(data[at : at + size])))
        at += size
    return {"name": asked, "rcode": flags & 15, "addresses": found, "error": None}


@F.arrow_udf(ANSWER)
def name_answer(message: pa.Array) -> pa.Array:
    """What captured answers say; bytes that are none give an error and no addresses."""
    out = []
    for b in message.to_pylist():
        try:
            out.append(None if b is None else dns_answer(b))
        except (ValueError, IndexError) as e:
            out.append({"name": None, "rcode": None, "addresses": [], "error": f"not an answer: {e}"})
    return pa.array(out, to_arrow_type(ANSWER))


def host_addresses(answers: DataFrame) -> DataFrame:
    """(host, addresses, reasons) of captured answers (message): all of a host's, each with why it is refused, if it is."""
    read = answers.select(name_answer(F.col("message")).alias("a")).where("a.name IS NOT NULL")
    each = read.select(F.col("a.name").alias("host"), F.explode_outer("a.addresses").alias("address")).distinct()
    judged = each.withColumn("reason", net.address_reason(F.col("address")))
    pair = F.when(F.col("address").isNotNull(), F.struct("address", "reason"))
    listed = judged.groupBy("host").agg(F.array_sort(F.collect_list(pair)).alias("x"))
    return listed.select("host", F.transform("x", lambda p: p["address"]).alias("addresses"), F.transform("x", lambda p: p["reason"]).alias("reasons"))


#: Host and port of an address.
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?"


def guarded(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages (url, ...) with ``refusal``: why the address may not be fetched; null if it may.

    A host that is an address is judged as given, any other by all its addresses, of which one bad refuses; a host that
    nobody asked for has no address.
    """
    part = lambda k: F.regexp_extract("url", AUTHORITY, k)
    host = F.lower(F.regexp_replace(part(1), r"\.$", ""))
    literal = F.regexp_like(host, F.lit(r"^\[|^[0-9]+(\.[0-9]+){3}$"))
    named = pages.withColumns({"_host": host, "_own": F.when(literal, F.regexp_replace(host, r"^\[|\]$", "")), "_port": F.nullif(part(2), F.lit("")).try_cast("int")})
    joined = named.withColumn("_given", net.address_reason(F.col("_own"))).join(hosts.select(F.col("host").alias("_host"), F.col("reasons").alias("_reasons")), "_host", "left")
    reasons = F.when(F.col("_own").isNotNull(), F.array("_given")).otherwise(F.coalesce("_reasons", F.array().cast("array<string>")))
    refusal = net.url_refusal(F.lower(urls.scheme(F.col("url"))), F.col("_port"), reasons)
    return joined.withColumn("refusal", refusal).drop("_host", "_own", "_port", "_given", "_reasons")
