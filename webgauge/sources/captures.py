"""What was fetched, as tables: page captures, robots.txt, sitemaps, llms.txt, field data; and report sinks.

Fetching itself is outside the engine: a capture job writes (url, status, headers, body, ...) rows, and everything here
reads those.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.constants import MAX_CHILD_SITEMAPS, MAX_SITEMAP_URLS
from webgauge.functions import urls
from webgauge.operators.robots import blocks_all

#: Fixed value: encodings that browsers read as others.
READ_AS = {"utf8": "utf-8", "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "utf-8", "utf-16": "utf-16-le"}
LOOKS_LIKE_HTML = r"(?i)^\s*<(!doctype|html)"


def charset(content_type: Column, body: Column) -> Column:
    """Name of a body's encoding: header, else a declaration in its first 4096 bytes, else UTF-8."""
    head = F.decode(F.substring(body, 1, 4096), "iso-8859-1")
    sniffed = F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)
    named = F.lower(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=\"?([^\s;\"']+)", 1), F.lit("")), F.nullif(sniffed, F.lit("")), F.lit("utf-8")))
    read_as = F.create_map(*[F.lit(x) for pair in READ_AS.items() for x in pair])
    return F.coalesce(F.try_element_at(read_as, named), named)


@F.arrow_udf(T.StringType())
def _decode_other(body: pa.Array, name: pa.Array) -> pa.Array:
    out = []
    for b, n in zip(body.to_pylist(), name.to_pylist()):
        try:
            out.append(None if b is None else b.decode(n, "replace"))
        except LookupError:
            out.append(b.decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decode_body(content_type: Column, body: Column) -> Column:
    """The text of a body; valid UTF-8 under that name is decoded in the JVM, anything else in Python."""
    name = charset(content_type, body)
    text = F.try_validate_utf8(body.cast("string"))
    return F.when((name == "utf-8") & text.isNotNull(), text).otherwise(_decode_other(body, name))


def _unpacked(data: bytes, window: int) -> bytes:
    """What one or more deflate streams, one after the other, hold; bytes after the last that are none are left out."""
    out = []
    while data:
        d = zlib.decompressobj(window)
        out.append(d.decompress(data) + d.flush())
        if not d.eof:
            raise zlib.error("the stream ends early")
        data = d.unused_data if window == 31 and d.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


@F.arrow_udf(T.BinaryType())
def inflate(body: pa.Array, encoding: pa.Array) -> pa.Array:
    """gzip, deflate (with or without header) undone; other or broken bodies as they are."""
    out = []
    for b, e in zip(body.to_pylist(), encoding.to_pylist()):
        name = (e or "").lower()
        windows = [] if "br" in name else [31] if "gzip" in name else [15, -15] if "deflate" in name else []
        done = b
        for w in windows if b else []:
            try:
                done = _unpacked(b, w)
                break
            except zlib.error:
                continue
        out.append(done)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def deflate(body: pa.Array, encoding: pa.Array) -> pa.Array:
    """Bodies packed by gzip or deflate; other encodings leave them as they are."""
    out = []
    for b, e in zip(body.to_pylist(), encoding.to_pylist()):
        window = {"gzip": 31, "deflate": 15}.get(e or "")
        if b is not None and window:
            c = zlib.compressobj(wbits=window)
            b = c.compress(b) + c.flush()
        out.append(b)
    return pa.array(out, pa.binary())


def probe_ok(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def favicon_ok(status: Column, content_type: Column) -> Column:
    return probe_ok(status) & ~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def favicon_url(doc: Column, url: Column) -> Column:
    """The first declared icon with an address, else /favicon.ico."""
    declared = F.get(F.filter(doc["favicons"], lambda f: (f["href"] != "") & ~F.contains(F.lower(f["rel"]), F.lit("apple"))), F.lit(0))["href"]
    return F.coalesce(urls.resolve(declared, url), F.concat(urls.origin(url), F.lit("/favicon.ico")))


def read_robots(fetched: DataFrame) -> DataFrame:
    """Fetched robots.txt (origin, status, text) with found, html_instead, has_sitemap_line and blocks_all."""
    html = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(LOOKS_LIKE_HTML))
    found = (F.col("status") == 200) & ~html
    return fetched.withColumns(
        {"found": found, "html_instead": (F.col("status") == 200) & html, "has_sitemap_line": found & F.regexp_like(F.col("text"), F.lit(r"(?im)^\s*sitemap:\s*\S+")), "blocks_all": found & blocks_all(F.col("text"))}
    )


def decode_xml(text: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(url, is_index, pos, loc) of sitemap files (url, xml)."""
    locs = F.regexp_extract_all(F.col("xml"), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    is_index = F.regexp_like(F.col("xml"), F.lit("(?i)<sitemapindex"))
    return sitemaps.select("url", is_index.alias("is_index"), F.posexplode(locs).alias("pos", "loc")).withColumn("loc", decode_xml(F.col("loc")))


def sitemap_urls(roots: DataFrame, files: DataFrame, max_urls: int | None = MAX_SITEMAP_URLS, max_children: int | None = MAX_CHILD_SITEMAPS) -> DataFrame:
    """(origin, pos, url) of each origin's sitemap: its own, or those of its first children, up to a number (None: all).

    roots: (origin, url) of sitemap files; files: (url, xml) of all fetched ones; children that are missing are skipped.
    """
    locs = sitemap_locations(files)
    top = roots.join(locs, "url")
    own = top.where("not is_index").select("origin", F.lit(0).alias("child"), "pos", "loc")
    children = top.where("is_index")
    children = (children if max_children is None else children.where(F.col("pos") < max_children)).select("origin", F.col("pos").alias("child"), F.col("loc").alias("url"))
    nested = children.join(locs.where("not is_index"), "url").select("origin", "child", "pos", "loc")
    w = Window.partitionBy("origin").orderBy("child", "pos")
    every = own.unionByName(nested).withColumn("n", F.row_number().over(w))
    return (every if max_urls is None else every.where(F.col("n") <= max_urls)).select("origin", (F.col("n") - 1).alias("pos"), F.col("loc").alias("url"))


def read_llms(fetched: DataFrame) -> DataFrame:
    """Fetched llms.txt (origin, status, text) with found, bytes, links and its beginning."""
    found = (F.col("status") == 200) & ~F.regexp_like(F.coalesce("text", F.lit("")), F.lit(LOOKS_LIKE_HTML))
    return fetched.select("origin", found.alias("found"), F.when(found, F.octet_length("text")).alias("bytes"), F.when(found, F.regexp_count("text", F.lit(r"\]\("))).alias("links"), F.when(found, F.substring("text", 1, 4000)).alias("beginning"))


def with_site_context(captures: DataFrame, context: DataFrame) -> DataFrame:
    """Captures joined with their origin's facts; Spark broadcasts the context where its size allows."""
    return captures.join(context, "origin", "left")


def write_reports(reports: DataFrame, path: str, one_file: bool = False) -> None:
    """Reports as JSON, a line each."""
    (reports.coalesce(1) if one_file else reports).write.mode("overwrite").json(path)
