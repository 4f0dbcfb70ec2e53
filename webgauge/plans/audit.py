"""Site audits end to end: what was fetched of origins and pages, to one report for each site.

Fetched tables: captures (url, html, ...), robots (origin, status, text), sitemaps (url, status, xml), llms (origin,
status, text), and, where there are any, probes (origin and columns of ``catalog.CAPTURE``), favicons (url, status,
content_type) and field data, read (target, scope, reason, data) or as answered (target, scope, status, body).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgauge.functions import urls
from webgauge.operators import robots, site, vitals
from webgauge.operators.frontier import crawl_frontier, crawl_progress, crawlable
from webgauge.operators.redirects import followed
from webgauge.plans import report
from webgauge.runtime import materialize
from webgauge.sources import captures as files
from webgauge.sources.messages import captures_of_messages

SITEMAP = r"(?i)<(urlset|sitemapindex)"


@dataclasses.dataclass
class Fetched:
    captures: DataFrame
    robots: DataFrame
    sitemaps: DataFrame
    llms: DataFrame
    probes: DataFrame | None = None
    favicons: DataFrame | None = None
    field: DataFrame | None = None

    @classmethod
    def of_messages(cls, messages: DataFrame, probes: DataFrame | None = None, field: DataFrame | None = None) -> "Fetched":
        """What captured HTTP messages hold: each address with what its redirects lead to, files by their address."""
        answers = materialize(followed(captures_of_messages(messages)), "answers")
        path, asked = urls.path(F.col("requested_url")), urls.origin(F.col("requested_url"))
        own = answers.withColumns({"_path": path, "_asked": asked})
        file = lambda name: own.where(F.col("_path") == name).groupBy(F.col("_asked").alias("origin")).agg(F.max_by(F.struct("status", F.col("html").alias("text")), "fetched_at").alias("a")).select("origin", "a.*")
        maps = own.where(F.regexp_like("html", F.lit(SITEMAP))).groupBy(F.col("requested_url").alias("url")).agg(F.max_by(F.struct("status", F.col("html").alias("xml")), "fetched_at").alias("a")).select("url", "a.*")
        page = ~F.col("_path").isin("/robots.txt", "/llms.txt") & ~F.regexp_like("html", F.lit(SITEMAP))
        pages = own.where(page).drop("_path", "_asked", "site_key", "origin").withColumns({"page_id": F.xxhash64("requested_url"), "as_of": F.col("fetched_at")})
        return cls(pages, file("/robots.txt"), maps, file("/llms.txt"), probes, None, field)

    def robots_texts(self) -> DataFrame:
        return files.read_robots(self.robots).where("found").select("origin", "text")

    def sitemap_roots(self) -> DataFrame:
        """(origin, url): the first sitemap that robots.txt names, else /sitemap.xml."""
        named = robots.robots_sitemaps(self.robots_texts()).groupBy("origin").agg(F.min_by("url", "pos").alias("url"))
        usual = F.concat("origin", F.lit("/sitemap.xml"))
        return self.robots.select("origin").distinct().join(named, "origin", "left").select("origin", F.coalesce("url", usual).alias("url"))

    def sitemap_files(self) -> DataFrame:
        return self.sitemaps.where((F.col("status") == 200) & F.regexp_like("xml", F.lit(SITEMAP))).select("url", "xml")


def site_context(fetched: Fetched) -> DataFrame:
    """A row of facts for each origin whose robots.txt was asked for."""
    texts = files.read_robots(fetched.robots)
    own = texts.select("origin", F.col("found").alias("robots_found"), F.when(F.col("found"), F.col("text")).alias("robots_text"), "has_sitemap_line", "blocks_all")
    there = fetched.sitemap_files().select("url").distinct().withColumn("sitemap_found", F.lit(True))
    sitemap = fetched.sitemap_roots().join(there, "url", "left").select("origin", F.coalesce("sitemap_found", F.lit(False)).alias("sitemap_found"))
    llms = files.read_llms(fetched.llms).select("origin", F.col("found").alias("llms_found"))
    out = own.join(sitemap, "origin").join(llms, "origin", "left")
    return out if fetched.probes is None else out.join(fetched.probes, "origin", "left")


def with_context(fetched: Fetched) -> DataFrame:
    """Captures with what their origin's files, probes and field data say of them."""
    pages = fetched.captures.withColumns({"origin": urls.origin(F.col("url")), "path": urls.path_and_query(F.col("url"))})
    rules = robots.robots_rules(fetched.robots_texts())
    paths = pages.select("origin", "path").distinct()
    closed = lambda role: F.count_if(~F.col("allowed") & (F.col("role") == role)).cast("int")
    access = robots.crawler_access(rules, paths).groupBy("origin", "path").agg(closed("retrieval").alias("blocked_retrieval"), closed("user-triggered").alias("blocked_user_triggered"))
    decisions = robots.search_blocked(rules, paths).join(access, ["origin", "path"])
    out = files.with_site_context(pages, site_context(fetched)).join(decisions, ["origin", "path"], "left")
    if fetched.field is not None:
        field = fetched.field
        if "body" in field.columns:  # as the service answered
            field = vitals.field_data(field)
        known = vitals.with_fallback(out, field.select("target", "scope", "reason", "data"))
        out = known.withColumnsRenamed({"data": "vitals", "reason": "vitals_reason"}).drop("fell_back_from_url")
    return out


def audited_pages(fetched: Fetched) -> DataFrame:
    """``report.audited`` of captures in their context, favicons probed once for each address."""
    pages = report.audited(with_context(fetched))
    if fetched.favicons is None:
        return pages
    ok = fetched.favicons.select(F.col("url").alias("icon"), files.favicon_ok(F.col("status"), F.col("content_type")).alias("favicon_ok"))
    pages = pages.drop("favicon_ok").withColumn("icon", files.favicon_url(F.col("doc"), F.col("url")))
    return pages.join(ok, "icon", "left").withColumn("favicon_ok", F.coalesce("favicon_ok", F.lit(False))).drop("icon")


def _listed(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """(site_key, name): each site's rows as an array in the order of the columns; a report holds its whole site."""
    return rows.groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def site_reports(pages: DataFrame, links: DataFrame, sitemap: DataFrame, unreachable: DataFrame, mode: str = "seo") -> DataFrame:
    """(site_key, mode, score, categories, issues, todos, pages, failed): a nested report for each site.

    pages: summaries of the crawled pages with depth and source; links (site_key, src, dst) and sitemap (site_key, url)
    of them; unreachable (site_key, url): claimed but not captured.
    """
    pages, links = materialize(pages, "crawled"), materialize(links, "crawled_links")
    score = F.struct("pages", "score", "verdict", "lowest", "highest", "errors", "warnings", "good", "fair", "poor")
    out = site.site_summary(pages).select("site_key", score.alias("score"))
    parts = [_listed(site.category_averages(pages, mode), "categories", "cat_pos", "category", "score", "pages")]
    for name, value, label in (("titles", "title", None), ("descriptions", "description", None), ("h1s", "h1", None), ("content", "content_hash", F.coalesce(F.nullif("title", F.lit("")), "url"))):
        parts.append(_listed(site.duplicate_groups(pages, F.col(value), label), f"duplicate_{name}", "place", "label", "count", "urls"))
    lists = site.page_lists(pages).groupBy("site_key", "issue").agg(F.array_sort(F.collect_list(F.struct("place", "url", "value"))).alias("pages"))
    parts.append(lists.groupBy("site_key").agg(F.map_from_entries(F.collect_list(F.struct("issue", "pages"))).alias("lists")))
    parts.append(_listed(site.broken_pages(pages, links, None), "broken", "url", "status", "linked_from"))
    parts.append(_listed(site.redirect_pairs(pages), "redirects", "from", "to", "hops"))
    parts.append(_listed(site.orphans(pages, links, sitemap), "orphans", "url"))
    parts.append(_listed(unreachable, "unreachable", "url"))
    parts.append(_listed(site.site_todos(pages), "todos", "place", "check", "category", "rank", "action", "page_count", "pages"))
    order = F.row_number().over(Window.partitionBy("site_key").orderBy(F.collate("url", "UNICODE"), "url"))
    parts.append(_listed(pages.withColumn("place", order), "pages", "place", "url", "requested_url", "depth", "source", "status", "score", "errors", "warnings", "title", "word_count", "index", F.array_sort(F.map_entries("categories")).alias("categories")))
    for part in parts:
        out = out.join(part, "site_key", "left")
    names = ["duplicate_titles", "duplicate_descriptions", "duplicate_h1s", "duplicate_content", "lists", "broken", "redirects", "orphans", "unreachable"]
    return out.select("site_key", F.lit(mode).alias("mode"), "score", "categories", F.struct(*names).alias("issues"), "todos", "pages")


def crawl_counters(claimed: DataFrame, progress: DataFrame | None, unreachable: DataFrame, listed: DataFrame, context: DataFrame, max_depth: int | None, max_pages: int | None, time_budget_ms: float | None) -> DataFrame:
    """(site_key, crawl): what a crawl asked for, met and left out, in a struct; without ``progress`` all that was met is claimed."""
    late = F.max("elapsed_ms") > F.lit(time_budget_ms) if time_budget_ms is not None else F.lit(False)
    out = claimed.groupBy("site_key").agg(F.count("*").alias("claimed"), late.alias("stopped_early"))
    met = out.select("site_key", F.col("claimed").alias("discovered")) if progress is None else progress.groupBy("site_key").agg(F.max(F.col("crawled") + F.col("queued")).alias("discovered"))
    failed = unreachable.groupBy("site_key").agg(F.count("*").alias("failed"))
    entries = listed.groupBy("site_key").agg(F.count("*").alias("sitemap_urls"))
    files = context.groupBy(urls.host(F.col("origin")).alias("site_key")).agg(F.bool_or("robots_found").alias("robots_found"), F.bool_or("sitemap_found").alias("sitemap_found"))
    for part in (met, failed, entries, files):
        out = out.join(part, "site_key", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    fields = [
        F.lit(max_pages).cast("int").alias("requested"), (F.col("claimed") - none("failed")).alias("crawled"), none("failed").alias("failed"), "discovered", F.greatest(F.col("discovered") - F.col("claimed"), F.lit(0)).alias("not_visited"),
        F.lit(max_depth).cast("int").alias("max_depth"), "stopped_early", none("sitemap_urls").alias("sitemap_urls"), F.coalesce("robots_found", F.lit(False)).alias("robots_found"), F.coalesce("sitemap_found", F.lit(False)).alias("sitemap_found"),
    ]
    return out.select("site_key", F.struct(*fields).alias("crawl"))


def audit_sites(fetched: Fetched, mode: str = "seo", max_depth: int | None = None, max_pages: int | None = None, time_budget_ms: float | None = None, max_sitemap_urls: int | None = None, max_child_sitemaps: int | None = None) -> DataFrame:
    """Crawl every captured site from its shortest address, in link order, and report on it.

    The whole site and its whole sitemap are taken where no budget is given.  ``time_budget_ms`` is held against the pages' response times, one after the other.
    """
    pages = materialize(report.with_findings(audited_pages(fetched), mode), "audited")
    summaries = materialize(report.page_summaries(pages, report.findings(pages, mode), mode), "summaries")
    rules = robots.robots_rules(fetched.robots_texts())
    links = materialize(crawlable(report.page_links(pages), rules), "links")
    seeds = summaries.groupBy("site_key").agg(F.min_by("url", F.struct(F.length("url"), "url")).alias("url"))
    listed = files.sitemap_urls(fetched.sitemap_roots(), fetched.sitemap_files(), max_sitemap_urls, max_child_sitemaps).select(urls.host(F.col("origin")).alias("site_key"), "pos", urls.canonical(F.col("url")).alias("url"))
    listed = materialize(listed.where(urls.host(F.col("url")) == F.col("site_key")), "sitemap")
    moved = summaries.select("site_key", urls.canonical(F.col("requested_url")).alias("asked"), F.col("url").alias("identity")).where("asked <> identity").groupBy("site_key", F.col("asked").alias("url")).agg(F.min("identity").alias("identity"))
    open_pages = crawlable(listed.withColumns({"src": F.col("url"), "dst": F.col("url")}), rules).select("site_key", "pos", "url")
    durations = None if time_budget_ms is None else summaries.select("site_key", urls.canonical(F.col("requested_url")).alias("url"), F.col("response_ms").alias("ms"))
    claimed = crawl_frontier(seeds, links, max_depth, max_pages, open_pages, moved, durations, time_budget_ms)
    progress = None if max_pages is None and time_budget_ms is None else crawl_progress(claimed, links, max_depth, max_pages, open_pages, moved)
    counted = claimed
    claimed = claimed.join(moved, ["site_key", "url"], "left").select("site_key", F.coalesce("identity", "url").alias("url"), F.col("url").alias("asked"), "depth", "source", "place")
    claimed = materialize(claimed, "claimed")
    # of several captures that end at one address the one that the crawl asked for
    first = Window.partitionBy("site_key", "url").orderBy(urls.canonical(F.col("requested_url")) != F.col("asked"), "page_id")
    crawled = summaries.join(claimed.drop("place"), ["site_key", "url"]).withColumn("again", F.row_number().over(first)).where("again = 1").drop("again", "asked")
    unreachable = claimed.join(summaries, ["site_key", "url"], "left_anti").select("site_key", "url")
    between = links.join(claimed.select("site_key", F.col("url").alias("src")), ["site_key", "src"], "left_semi")
    counters = crawl_counters(counted, progress, unreachable, listed, site_context(fetched), max_depth, max_pages, time_budget_ms)
    return site_reports(crawled, between, listed, unreachable, mode).join(counters, "site_key", "left")
