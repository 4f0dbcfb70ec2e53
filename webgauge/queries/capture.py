"""What captures are made of: repaired tables, HTTP messages, redirect chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.constants import MAX_REDIRECTS
from webgauge.operators import redirects
from webgauge.operators.extract import extract_documents
from webgauge.queries.registry import dealt, long, query, table
from webgauge.runtime import scratch_path
from webgauge.sources import messages
from webgauge.sources.captures import deflate

#: Pages with broken tables, by part number: {n}, {b} and {t} are a part's name, brand and type.
BROKEN_TABLES = [
    "<table>{n} <tr><td>{b} <td>{t}</table>",
    "<table><tr><td>{b} </td><td>{t} </td></tr>{n} </table>",
    "<table><tr><div>{n} </div><td>{b} <table><tbody>{t} <tr><td>x",
    "<p>{n} <table><caption>{b} <tr><td>x <tr>{t} <td>y</table>z",
    "<table><tr><td>{t} <table><caption>x</table></table><table><b>{n} <col></b>{b} <tr></table>",
]
#: What their bodies say once stray text stands before its table, and the cells that are left.
REPAIRED_TABLES = [("{n} {b} {t}", 2), ("{n} {b} {t}", 2), ("{n} {b} {t} x", 2), ("{n} {t} {b} x yz", 2), ("{t} x{n} {b}", 1)]


def _sql_text(pattern: str) -> str:
    for key, column in (("n", "p_name"), ("b", "p_brand"), ("t", "p_type")):
        pattern = pattern.replace(f"{{{key}}}", f"' || {column} || '")
    return f"'{pattern}'"


@query(
    "SELECT p_partkey AS page_id, " + ", ".join(
        f"CASE p_partkey % 5 {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END AS {name}"
        for name, values in (("body_text", [_sql_text(x) for x, _ in REPAIRED_TABLES]), ("cells", [f"CAST({n} AS BIGINT)" for _, n in REPAIRED_TABLES]), ("tables", [f"CAST({x.count('<table>')} AS BIGINT)" for x in BROKEN_TABLES]))
    ) + " FROM part"
)
def table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose tables hold stray text and elements, miss end tags and nest: text, cells and tables after repair."""
    part = dealt(table(spark, sf_dir, "part"))
    html = F.get(F.array(*[F.lit(x) for x in BROKEN_TABLES]), (F.col("p_partkey") % 5).cast("int"))
    for key, column in (("n", "p_name"), ("b", "p_brand"), ("t", "p_type")):
        html = F.replace(html, F.lit(f"{{{key}}}"), F.col(column))
    pages = part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/"), "p_partkey").alias("url"), F.concat(F.lit("<!doctype html>"), html).alias("html"))
    d = F.col("doc")
    return extract_documents(pages).select("page_id", d["body_text"].alias("body_text"), long(F.size(d["item_texts"])).alias("cells"), long(d["tables"]).alias("tables"))


# -- HTTP messages -------------------------------------------------------------------------------------------------------

ENCODINGS = ["identity", "gzip", "deflate"]


def messages_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as responses in three content encodings, two in chunks, with headers that repeat."""
    kind = (F.col("page_id") % 3).cast("int")
    encoding = F.get(F.array(*map(F.lit, ENCODINGS)), kind)
    latin = (kind == 0) & F.regexp_like("html", F.lit(r"^[\x00-\xff]*$"))
    plain = F.when(latin, F.encode("html", "iso-8859-1")).otherwise(F.encode("html", "utf-8"))
    body = deflate(plain, encoding)
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    lines = F.array(
        header("Content-Type", F.when(latin, F.lit("text/html; charset=ISO-8859-1")).otherwise(F.lit("text/html; charset=utf-8"))), header("X-Seen", F.lit("first")), header("Content-Encoding", encoding),
        header("x-seen", F.lit("again")), header("X-Page", F.col("page_id").cast("string")), header("Server", F.lit("one")), header("Server", F.lit("two")),
        F.when(kind == 0, header("Content-Length", F.octet_length(body).cast("string"))).otherwise(header("Transfer-Encoding", F.lit("chunked"))),
    )
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    status = F.when(F.col("page_id") % 10 == 9, 404).otherwise(200)
    reason = F.when(F.col("page_id") % 10 == 9, "Not Found").otherwise("OK")
    return pages.select("url", when.alias("fetched_at"), status.alias("status"), reason.alias("status_message"), F.lit("1.1").alias("http_version"), lines.alias("raw_headers"), body.alias("body"))


@query(
    f"""SELECT page_id, url, 1700000000 + page_id AS fetched, CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 10 = 9 THEN 'Not Found' ELSE 'OK' END AS reason, '1.1' AS version,
    {ENCODINGS!r}[page_id % 3 + 1] AS encoding, 'first, again' AS seen, 'one' AS server, CASE WHEN page_id % 3 = 0 THEN 'Content-Length' ELSE 'Transfer-Encoding' END AS last_header, CAST(8 AS BIGINT) AS header_lines,
    sha256(html) AS digest, CAST(length(html) AS BIGINT) AS chars, FALSE AS truncated FROM pages"""
)
def message_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as HTTP messages to an archive and read from byte ranges of 64 KiB give the same pages."""
    folder = scratch_path(spark, "archive")
    messages.write_messages(messages_of_pages(dealt(table(spark, sf_dir, "pages"))), folder)
    found = messages.captures_of_messages(messages.read_messages(spark, folder, split_bytes=64 << 10))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return found.select(
        header("x-page").cast("long").alias("page_id"), "url", F.unix_seconds("fetched_at").alias("fetched"), "status", F.col("status_message").alias("reason"), F.col("http_version").alias("version"),
        F.col("content_encoding").alias("encoding"), header("x-seen").alias("seen"), header("server").alias("server"), F.element_at("raw_headers", -1)["name"].alias("last_header"), long(F.size("raw_headers")).alias("header_lines"),
        F.sha2("html", 256).alias("digest"), long(F.char_length("html")).alias("chars"), "truncated",
    )


# -- redirects -------------------------------------------------------------------------------------------------------------


def hops_of_pages(pages: DataFrame) -> DataFrame:
    """Answers of made-up addresses, one for each page: rows of twelve that lead on, end, return and lead nowhere."""
    at, kind = F.col("page_id") % 12, F.floor(F.col("page_id") / 12) % 3
    address = lambda n: F.concat(F.lit("https://r.example/a/"), n.cast("string"))
    location = (
        F.when(at < 9, F.concat(F.when(at % 3 == 0, "../a/").when(at % 3 == 1, "/a/").otherwise("//r.example/a/"), (F.col("page_id") + 1).cast("string"), F.when(at % 4 == 0, "#top").otherwise("")))
        .when((at == 9) & (kind == 1), address(F.col("page_id") - 3))
        .when((at == 9) & (kind == 2), "https://gone.example/")
        .when(at == 10, address(F.col("page_id")))
    )
    return pages.select(address(F.col("page_id")).alias("url"), F.when(location.isNull(), 200).otherwise(F.lit(301) + F.col("page_id") % 2).cast("int").alias("status"), location.alias("location"))


@query(
    f"""WITH RECURSIVE h AS (
        SELECT 'https://r.example/a/' || page_id AS url, CASE WHEN page_id % 12 < 9 THEN 'https://r.example/a/' || (page_id + 1) WHEN page_id % 12 = 9 AND page_id // 12 % 3 = 1 THEN 'https://r.example/a/' || (page_id - 3)
            WHEN page_id % 12 = 9 AND page_id // 12 % 3 = 2 THEN 'https://gone.example/' WHEN page_id % 12 = 10 THEN 'https://r.example/a/' || page_id END AS location FROM pages
    ), w AS (
        SELECT url AS start, url AS cur, 0 AS n, [url] AS seen FROM h
        UNION ALL SELECT start, location, n + 1, list_append(seen, location) FROM w JOIN h ON h.url = w.cur WHERE location IS NOT NULL AND n <= {MAX_REDIRECTS}
    ), e AS (
        SELECT w.*, h.url IS NOT NULL AS captured, CASE WHEN len(list_distinct(seen)) < len(seen) THEN '{redirects.LOOP}' WHEN n > {MAX_REDIRECTS} THEN '{redirects.TOO_MANY}' WHEN h.url IS NULL THEN '{redirects.MISSING}' END AS error
        FROM w LEFT JOIN h ON h.url = w.cur QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC) = 1
    )
    SELECT start AS url, seen[least(n, {MAX_REDIRECTS}) + 1] AS final_url, CASE WHEN error IS NULL THEN 200 END AS final_status, CAST(least(n, {MAX_REDIRECTS}) AS INTEGER) AS hops, array_to_string(seen[1:least(n, {MAX_REDIRECTS})], ' ') AS followed, error FROM e"""
)
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of single hops: those that end, loop, go on beyond the limit or lead to an address nobody captured."""
    hops = redirects.hops_of(hops_of_pages(table(spark, sf_dir, "pages")))
    found = redirects.redirect_chains(hops)
    followed = F.array_join(F.transform("chain", lambda x: x["url"]), " ")
    return found.select("url", F.regexp_replace("final_url", "#.*$", "").alias("final_url"), "final_status", "hops", followed.alias("followed"), "error")
