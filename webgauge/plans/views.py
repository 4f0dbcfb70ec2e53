"""Derived views of audited pages (doc, x, g), keywords and crawler verdicts, as a report shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_histogram(headings: Column) -> Column:
    """How many headings of each of the six levels, zeros included."""
    return F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.size(F.filter(headings, lambda h: h["level"] == n)))


def element_counts(pages: DataFrame) -> DataFrame:
    """(page_id, ...): the element inventory of each page in numbers."""
    d, x = F.col("doc"), F.col("x")
    return pages.select(
        "page_id", heading_histogram(d["headings"]).alias("headings"), F.size(d["internal"]).alias("internal"), F.size(d["external"]).alias("external"), F.size(d["fragments"]).alias("fragments"), F.size(d["mailto_tel"]).alias("mailto_tel"),
        F.size(x["images"]).alias("images"), x["images_with_alt"].alias("images_with_alt"), (F.size(d["media"]) - F.size(x["images"])).alias("other_media"), d["inline_svg"].alias("inline_svg"), d["lists"].alias("lists"), d["tables"].alias("tables"),
        d["frames"].alias("frames"), F.size(d["meta_tags"]).alias("meta_tags"), F.size(F.array_distinct(d["json_ld"])).alias("json_ld_types"), d["microdata"].alias("microdata"), d["rdfa"].alias("rdfa"), d["microformats"].alias("microformats"),
    )


def evidence_verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, statistics, quotations, authoritative, strong): strong where a page has all three."""
    g = F.col("g")
    out = pages.select("page_id", (g["statistics"] > 0).alias("statistics"), (g["quotations"] > 0).alias("quotations"), (F.size(g["authoritative_citations"]) > 0).alias("authoritative"))
    return out.withColumn("strong", F.col("statistics") & F.col("quotations") & F.col("authoritative"))


def crawler_grid(verdicts: DataFrame) -> DataFrame:
    """(origin, path, role, allowed, blocked): agents by role and verdict."""
    return verdicts.groupBy("origin", "path", "role").agg(F.array_sort(F.collect_list(F.when(F.col("allowed"), F.col("agent")))).alias("allowed"), F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.col("agent")))).alias("blocked"))


def keyword_bars(keywords: DataFrame) -> DataFrame:
    """Keywords with body_only (no placement at all) and their share of the row's largest count."""
    most = F.max("count").over(Window.partitionBy("id"))
    placed = F.col("in_title") | F.col("in_description") | (F.col("in_headings") > 0) | F.col("in_url")
    return keywords.withColumns({"body_only": ~placed, "bar": F.col("count") / most})


def by_url(pages: DataFrame) -> DataFrame:
    """Pages with their place in the order that people sort URLs in, within a site."""
    order = Window.partitionBy("site_key").orderBy(F.collate(F.col("url"), "UNICODE"), "url")
    return pages.withColumn("place", F.row_number().over(order))


def health(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counters: admitted and rejected requests, jobs by state."""
    a = requests.agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))
    b = jobs.agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("errors"))
    return a.crossJoin(b)  # one row each
