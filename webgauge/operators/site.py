"""Cross-page analysis of crawled sites.  Everything is keyed by site_key, so one job covers many sites.

Pages: (site_key, url, requested_url, final_url, depth, source, status, score, errors, warnings, title, description, h1,
word_count, response_ms, index, canonical, redirect_hops, content_hash, categories map<string,int>, todos array<struct
<check,category,action,importance>>); not every operator needs every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgauge.constants import CATEGORIES
from webgauge.functions import urls
from webgauge.functions.numbers import round_half_up, verdict
from webgauge.functions.text import truncated
from webgauge.operators.scoring import importance_rank

ISSUES = {
    "broken": lambda: F.col("status") >= 400,
    "not_indexable": lambda: ~F.col("index"),
    "thin": lambda: F.col("word_count") < 300,
    "deep": lambda: F.col("depth") > 3,
    "slow": lambda: F.col("response_ms") > 800,
    "redirected": lambda: F.col("redirect_hops") > 0,
    "no_title": lambda: F.coalesce(F.trim("title"), F.lit("")) == "",
    "no_description": lambda: F.coalesce(F.trim("description"), F.lit("")) == "",
    "no_h1": lambda: F.coalesce(F.trim("h1"), F.lit("")) == "",
}


def dedupe_identity(pages: DataFrame, identity: Column, order: list[Column]) -> DataFrame:
    """One page of each identity in a site: the first by ``order``."""
    w = Window.partitionBy("site_key", "_identity").orderBy(*order)
    return pages.withColumn("_identity", identity).withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_identity", "_first")


def site_summary(pages: DataFrame) -> DataFrame:
    """A row for each site: rounded mean score and verdict, range, sums, and pages in three score bands."""
    s = F.col("score")
    out = pages.groupBy("site_key").agg(
        F.count("*").alias("pages"), round_half_up(F.avg("score")).cast("int").alias("score"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"), F.count_if(s >= 80).alias("good"), F.count_if((s >= 60) & (s < 80)).alias("fair"), F.count_if(s < 60).alias("poor"),
    )
    return out.withColumn("verdict", verdict(F.col("score")))


def category_averages(pages: DataFrame, mode: str = "seo") -> DataFrame:
    """(site_key, cat_pos, category, score, pages): the mean over pages with a score, every category of the ruleset."""
    spark = pages.sparkSession
    constants = spark.createDataFrame([(i, k) for i, (k, _, _) in enumerate(CATEGORIES[mode])], "cat_pos int, category string")
    scores = pages.select("site_key", F.explode("categories").alias("category", "value")).where("value is not null").groupBy("site_key", "category").agg(round_half_up(F.avg("value")).cast("int").alias("score"), F.count("*").alias("pages"))
    frame = pages.select("site_key").distinct().crossJoin(F.broadcast(constants))
    return frame.join(scores, ["site_key", "category"], "left").select("site_key", "cat_pos", "category", "score", F.coalesce("pages", F.lit(0)).alias("pages"))


def duplicate_groups(pages: DataFrame, value: Column, label: Column | None = None) -> DataFrame:
    """(site_key, place, key, label, count, urls): values that several pages share, by their trimmed lower-case form.

    place: most pages first, then the group that a page list by URL meets first.
    """
    key = F.lower(F.trim(value))
    rows = pages.withColumn("_key", key).withColumn("_label", F.trim(value) if label is None else label).where("_key <> ''")
    grouped = rows.groupBy("site_key", F.col("_key").alias("key")).agg(F.min_by("_label", "url").alias("label"), F.count("*").alias("count"), F.array_sort(F.collect_list("url")).alias("urls"))
    order = Window.partitionBy("site_key").orderBy(F.desc("count"), F.get("urls", F.lit(0)), "key")
    return grouped.where("count > 1").withColumn("place", F.row_number().over(order))


def inbound_links(links: DataFrame) -> DataFrame:
    """(site_key, dst, sources): distinct pages that link to each target."""
    return links.select("site_key", "src", "dst").distinct().groupBy("site_key", "dst").agg(F.count("*").alias("sources"))


def broken_pages(pages: DataFrame, links: DataFrame, examples: int | None = 5) -> DataFrame:
    """(site_key, url, status, linked_from): pages that fail, with the first sources that link to them (None: all)."""
    broken = pages.where(F.col("status") >= 400).select("site_key", "url", "status")
    edges = links.select("site_key", F.col("dst").alias("url"), "src").distinct()
    w = Window.partitionBy("site_key", "url").orderBy("src")
    first = broken.select("site_key", "url").join(edges, ["site_key", "url"])
    if examples is not None:
        first = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= examples)
    sources = first.groupBy("site_key", "url").agg(F.array_sort(F.collect_list("src")).alias("linked_from"))
    return broken.join(sources, ["site_key", "url"], "left").withColumn("linked_from", F.coalesce("linked_from", F.array().cast("array<string>")))


def orphans(pages: DataFrame, links: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(site_key, url): sitemap URLs that were crawled but that no page links to."""
    urls = sitemap.select("site_key", "url").distinct()
    linked = links.select("site_key", F.col("dst").alias("url"))
    return urls.join(linked, ["site_key", "url"], "left_anti").join(pages.select("site_key", "url"), ["site_key", "url"], "left_semi")


def issue_lists(pages: DataFrame) -> DataFrame:
    """(site_key, issue, url): a row for each page and issue that it has."""
    flags = F.array(*[F.when(test(), F.lit(name)) for name, test in ISSUES.items()])
    return pages.select("site_key", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("issue"), "url")


#: What a list says of its pages beside the URL, and whether it goes by it: least first (1) or most first (-1).
LISTED = {"broken": ("status", 0), "thin": ("word_count", 1), "deep": ("depth", 0), "slow": ("response_ms", -1), "redirected": ("redirect_hops", 0)}


def page_lists(pages: DataFrame) -> DataFrame:
    """(site_key, issue, place, url, value): pages of each issue in the order that a report lists them."""
    numbers = {name: F.col(column).cast("double") for name, (column, _) in LISTED.items()}
    flags = F.array(*[F.when(test(), F.struct(F.lit(name).alias("issue"), numbers.get(name, F.lit(None).cast("double")).alias("value"), (numbers.get(name, F.lit(0.0)) * LISTED.get(name, ("", 0))[1]).alias("rank"))) for name, test in ISSUES.items()])
    rows = pages.select("site_key", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("f"), "url").select("site_key", "f.*", "url")
    place = F.row_number().over(Window.partitionBy("site_key", "issue").orderBy("rank", "url"))
    return rows.select("site_key", "issue", place.alias("place"), "url", "value")


def redirect_pairs(pages: DataFrame) -> DataFrame:
    """(site_key, from, to, hops) of pages that were reached through redirects."""
    return pages.where("redirect_hops > 0").select("site_key", F.col("redirect_from").alias("from"), F.col("final_url").alias("to"), F.col("redirect_hops").alias("hops"))


def issue_counts(pages: DataFrame) -> DataFrame:
    return issue_lists(pages).groupBy("site_key", "issue").agg(F.count("*").alias("pages"))


def site_todos(pages: DataFrame) -> DataFrame:
    """(site_key, place, category, check, importance, action, page_count, pages): what to do site-wide.

    A page counts once for each check, with its first action; the action most pages share stands for the check (the
    first seen among equals), and pages show their own only where it differs.
    """
    rows = pages.select("site_key", "url", F.posexplode("todos").alias("pos", "t")).select("site_key", "url", "pos", "t.*")
    first = rows.groupBy("site_key", "url", "category", "check").agg(F.min_by("action", "pos").alias("action"), F.min(importance_rank(F.col("importance"))).alias("rank"), F.min("pos").alias("pos"))
    seen = F.struct("url", "pos")
    counted = first.groupBy("site_key", "category", "check", "action").agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    best = Window.partitionBy("site_key", "category", "check").orderBy(F.desc("n"), "seen")
    modal = counted.withColumn("r", F.row_number().over(best)).where("r = 1").select("site_key", "category", "check", F.col("action").alias("modal"))
    joined = first.join(modal, ["site_key", "category", "check"])
    own = F.struct(F.col("url").alias("url"), F.when(F.col("action") != F.col("modal"), F.col("action")).alias("action"))
    grouped = joined.groupBy("site_key", "category", "check", "modal").agg(F.min("rank").alias("rank"), F.count("*").alias("page_count"), F.array_sort(F.collect_list(own)).alias("pages"), F.min(seen).alias("seen"))
    place = F.row_number().over(Window.partitionBy("site_key").orderBy("rank", F.desc("page_count"), "seen"))
    return grouped.select("site_key", place.alias("place"), "category", "check", "rank", F.col("modal").alias("action"), "page_count", "pages")


def todo_pages(todos: DataFrame, pages: DataFrame, title_chars: int = 70) -> DataFrame:
    """(site_key, place, url, shown, target, title, action): the pages of each site-wide to-do with what a list shows of them.

    target: where the page ended, for a new audit; title: its beginning; action: the page's own, where it differs.
    """
    each = todos.select("site_key", "place", F.explode("pages").alias("p")).select("site_key", "place", "p.*")
    about = pages.groupBy("site_key", "url").agg(F.min(F.struct("final_url", "title")).alias("a")).select("site_key", "url", "a.*")
    joined = each.join(about, ["site_key", "url"], "left")
    target = F.coalesce("final_url", "url")
    return joined.select("site_key", "place", "url", urls.shown(F.col("url"), urls.origin(target)).alias("shown"), target.alias("target"), truncated(F.trim("title"), title_chars).alias("title"), "action")


def worst_first(pages: DataFrame) -> DataFrame:
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("site_key").orderBy("score", "url")))
