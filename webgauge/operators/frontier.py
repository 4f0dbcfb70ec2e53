"""Breadth-first crawl order over a captured link graph, with depth, page and time budgets.

A crawl of a site is a queue, but what it needs to know is bounded by its page budget: the links of the pages it claims,
of each page no more than the budget, since earlier ones are claimed before later ones.  So every site's queue is run
over the links known so far, pages whose links aren't known leading nowhere; the links of all pages claimed in that run
are fetched with one join for all sites, and the queues are run again, until a run claims only pages whose links are known.
Each round settles at least the next level of every branch, those of sitemap pages too: rounds grow with the depth limit,
not with the pages.

A crawl without budgets is worked off for all pages at once instead: every page belongs to the first root (the seeds, then
sitemap pages in their order) that it can be reached from, as deep as it is from there.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from webgauge.constants import MAX_DEPTH, MAX_PAGES
from webgauge.functions import urls
from webgauge.operators.robots import search_blocked
from webgauge.runtime import discard, materialize


def crawlable(links: DataFrame, rules: DataFrame) -> DataFrame:
    """The links (site_key, src, dst, ...) whose target a crawl of the site may visit: on the same site with or without
    www, not the address of a file, and not kept from search crawlers by robots rules of the target's origin."""
    paths = links.select(urls.origin(F.col("dst")).alias("origin"), urls.path_and_query(F.col("dst")).alias("path")).distinct()
    closed = search_blocked(rules, paths).where("blocking_rule is not null").select("origin", "path")
    plain = links.where(urls.same_site(F.col("src"), F.col("dst")) & urls.is_page(F.col("dst")))
    keyed = plain.withColumns({"_origin": urls.origin(F.col("dst")), "_path": urls.path_and_query(F.col("dst"))})
    return keyed.join(closed.select(F.col("origin").alias("_origin"), F.col("path").alias("_path")), ["_origin", "_path"], "left_anti").drop("_origin", "_path")


class _Levels:
    """What is claimed so far: at most max_pages rows a site, each step written once so that plans stay short."""

    def __init__(self, edges: DataFrame, identities: DataFrame | None, max_pages: int):
        self.edges, self.identities, self.max_pages = edges, identities, max_pages
        self.claimed: DataFrame | None = None

    def unseen(self, pages: DataFrame) -> DataFrame:
        """``pages`` with their identity, without those whose URL or identity is claimed."""
        if self.identities is not None:
            pages = pages.join(self.identities.select("site_key", "url", "identity"), ["site_key", "url"], "left").withColumn("identity", F.coalesce("identity", "url"))
        else:
            pages = pages.withColumn("identity", F.col("url"))
        if self.claimed is None:
            return pages
        seen = self.seen("identity")
        return pages.join(seen, ["site_key", "identity"], "left_anti").join(seen.withColumnRenamed("identity", "url"), ["site_key", "url"], "left_anti")

    def seen(self, name: str) -> DataFrame:
        return self.claimed.select("site_key", F.explode(F.array_distinct(F.array("url", "identity"))).alias(name))

    def claim(self, new: DataFrame, order: list[str], depth: Column, source: str) -> DataFrame | None:
        """Of the pages ``new`` (site_key, url and the columns of ``order``) those that the budget allows, if any."""
        order = [*order, "url"]
        new = self.unseen(new)
        if self.claimed is not None:
            new = new.join(self.claimed.groupBy("site_key").agg(F.count("*").alias("used")), "site_key", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        else:
            new = new.withColumn("used", F.lit(0).cast("long"))
        again = F.row_number().over(Window.partitionBy("site_key", "identity").orderBy(*order))
        new = new.withColumn("again", again).where("again = 1")
        place = F.col("used") + F.row_number().over(Window.partitionBy("site_key").orderBy(*order))
        found = new.withColumn("place", place).where(F.col("place") <= self.max_pages)
        found = materialize(found.select("site_key", "url", depth.cast("int").alias("depth"), "place", F.lit(source).alias("source"), "identity"), "level")
        if found.isEmpty():
            return None
        self.claimed = found if self.claimed is None else self.claimed.unionByName(found)
        return found

    def follow(self, front: DataFrame, depths: range) -> None:
        """Claim what the pages of ``front`` link to, level by level."""
        for depth in depths:
            named = front.select("site_key", F.explode(F.array_distinct(F.array("url", "identity"))).alias("src"), "place")
            step = named.join(self.edges, ["site_key", "src"]).groupBy("site_key", F.col("dst").alias("url")).agg(F.min(F.struct("place", "pos")).alias("by"))
            front = self.claim(step, ["by"], F.lit(depth), "link")
            if front is None:
                return

    def next_of_sitemap(self, pending: DataFrame) -> DataFrame:
        """Each site's first pending pages, up to and with the first that links to a page not yet seen."""
        left = self.unseen(pending)
        new = self.edges.join(self.seen("dst"), ["site_key", "dst"], "left_anti")
        leads = left.select("site_key", "url").join(new.select("site_key", F.col("src").alias("url")), ["site_key", "url"], "left_semi").withColumn("leads", F.lit(True))
        before = F.max(F.coalesce("leads", F.lit(False))).over(Window.partitionBy("site_key").orderBy("pos", "url").rowsBetween(Window.unboundedPreceding, -1))
        return left.join(leads, ["site_key", "url"], "left").withColumn("before", F.coalesce(before, F.lit(False))).where("not before").select("site_key", "url", "pos")


def _by_levels(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int, sitemap: DataFrame | None, identities: DataFrame | None) -> DataFrame:
    """The claims of ``crawl_frontier`` under a budget beyond ``QUEUE_PAGES``: level by level over the whole graph, so that
    no site is a group; sitemap pages that lead on take levels of their own."""
    pos = F.min("pos") if "pos" in links.columns else F.lit(0)
    edges = materialize(links.where("src <> dst").groupBy("site_key", "src", "dst").agg(pos.alias("pos")), "edges")
    crawl = _Levels(edges, identities, max_pages)
    first = crawl.claim(seeds.select("site_key", "url").distinct(), [], F.lit(0), "seed")
    if first is None:
        return seeds.select("site_key", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), F.lit("seed").alias("source")).limit(0)
    crawl.follow(first, range(1, max_depth + 1))
    if sitemap is not None:
        pending = materialize(sitemap.groupBy("site_key", "url").agg(F.min("pos").alias("pos")), "pending")
        while (found := crawl.claim(crawl.next_of_sitemap(pending), ["pos"], F.lit(None), "sitemap")) is not None:
            crawl.follow(found, range(1, max_depth + 1))
        discard(pending)
    discard(edges)
    return crawl.claimed.drop("identity")


def _whole(seeds: DataFrame, links: DataFrame, sitemap: DataFrame | None, identities: DataFrame | None) -> DataFrame:
    """The claims of ``crawl_frontier`` without limits of depth, under a budget beyond ``QUEUE_PAGES``; no site is a group.

    A page that a root reaches is never met from a later one, nor is a way to it through pages met before.  So (root, depth)
    of a page is the least over the ways to it, found by handing on what is known along all links at once, in as many rounds
    as the deepest page has levels; the order within a root's level follows from that of the level before.  Addresses of one
    identity are one page with the links of them all.
    """
    node = ["site_key", "identity"]
    pos = F.min("pos") if "pos" in links.columns else F.lit(0)
    edges = links.where("src <> dst").groupBy("site_key", "src", "dst").agg(pos.alias("pos"))
    edges = _with_identity(edges, identities, "src").withColumnsRenamed({"identity": "parent"})
    edges = materialize(_with_identity(edges, identities, "dst").where("parent <> identity"), "edges")
    steps = edges.select("site_key", "parent", "identity").distinct()

    root = lambda kind, pos, url: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), url.alias("url")).alias("root")
    roots = _with_identity(seeds.select("site_key", "url").distinct(), identities, "url").select(*node, root(SEED, F.lit(0), F.lit("")), "url")
    if sitemap is not None:
        crawled = seeds.select("site_key").distinct()  # a site without a seed isn't crawled
        pending = sitemap.groupBy("site_key", "url").agg(F.min("pos").alias("pos")).join(crawled, "site_key", "left_semi")
        roots = roots.unionByName(_with_identity(pending, identities, "url").select(*node, root(SITEMAP, F.col("pos"), F.col("url")), "url"))
    roots = materialize(roots.groupBy(*node).agg(F.min(F.struct("root", "url")).alias("r")).select(*node, "r.*"), "roots")
    known = materialize(roots.select(*node, F.struct("root", F.lit(0).alias("depth")).alias("at"), F.lit(True).alias("new")), "reached")
    while not known.where("new").isEmpty():
        front = known.where("new").select("site_key", F.col("identity").alias("parent"), F.struct(F.col("at.root").alias("root"), (F.col("at.depth") + 1).alias("depth")).alias("at"))
        told = front.join(steps, ["site_key", "parent"]).select(*node, "at", F.lit(True).alias("new"))
        every = known.select(*node, "at", F.lit(False).alias("new")).unionByName(told)
        # of equal ones what was known before
        later = materialize(every.groupBy(*node).agg(F.min(F.struct("at", "new")).alias("b")).select(*node, "b.*"), "reached")
        discard(known)
        known = later
    reached = materialize(known.select(*node, "at.*"), "reached")
    discard(known)

    order = F.row_number().over(Window.partitionBy("site_key", "root").orderBy("by", "url")).cast("long").alias("order")
    columns = [*node, "url", "root", "depth", "order"]
    level = reached.where("depth = 0").join(roots.select(*node, "url"), node).withColumn("by", F.col("url"))
    levels = [materialize(level.select(*columns[:-1], order), "level")]
    deepest = reached.agg(F.max("depth")).first()[0] or 0
    for depth in range(1, deepest + 1):
        before = levels[-1].select("site_key", F.col("identity").alias("parent"), "root", "order", F.col("url").alias("asked"))
        here = reached.where(F.col("depth") == depth)
        # a page's links are those of its identity, then those of the address it was met by, then those of its other addresses
        turn = F.when(F.col("src") == F.col("parent"), 0).when(F.col("src") == F.col("asked"), 1).otherwise(2)
        by = F.struct("order", turn.alias("turn"), "pos", F.col("dst").alias("url"))
        met = before.join(edges, ["site_key", "parent"]).join(here, [*node, "root"]).groupBy(*node, "root", "depth").agg(F.min(by).alias("by"))
        levels.append(materialize(met.withColumn("url", F.col("by.url")).select(*columns[:-1], order), "level"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    place = F.row_number().over(Window.partitionBy("site_key").orderBy("root", "depth", "order")).cast("long")
    of_sitemap = F.col("root.kind") == SITEMAP
    source = F.when(F.col("depth") > 0, "link").when(of_sitemap, "sitemap").otherwise("seed")
    own = F.when((F.col("depth") > 0) | ~of_sitemap, F.col("depth"))
    claimed = materialize(out.select("site_key", "url", own.alias("depth"), place.alias("place"), source.alias("source")), "claims")
    for scratch in (edges, roots, reached, *levels):
        discard(scratch)
    return claimed


def _timed(claimed: DataFrame, durations: DataFrame, time_budget_ms: float | None) -> DataFrame:
    """Claims with elapsed_ms, up to the one that goes beyond the budget."""
    ms = durations.groupBy("site_key", "url").agg(F.coalesce(F.max("ms").cast("double"), F.lit(0.0)).alias("ms"))
    until = F.sum("ms").over(Window.partitionBy("site_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    out = claimed.join(ms, ["site_key", "url"], "left").withColumn("ms", F.coalesce("ms", F.lit(0.0))).withColumn("elapsed_ms", until)
    before = F.lag("elapsed_ms", 1, 0.0).over(Window.partitionBy("site_key").orderBy("place"))
    out = out.withColumn("before", before)
    return (out if time_budget_ms is None else out.where(F.col("before") <= time_budget_ms)).drop("ms", "before")


#: Budgets up to this are queues in a task for each site.
QUEUE_PAGES = 2000
#: What no limit counts as.
NO_LIMIT = 2**31 - 1
SEED, SITEMAP, LINK, PAGE = range(4)
#: What is known of a site: seeds, sitemap pages and links by their place, and pages whose links are all here.
KNOWN = "site_key string, kind int, src string, dst string, identity string, place long, ms double"
CLAIMED = "site_key string, url string, identity string, depth int, place long, source string, elapsed_ms double, known boolean"


def run_queue(known: pd.DataFrame, max_depth: int, max_pages: int, budget_ms: float | None) -> list[tuple]:
    """The claims of one site's queue: (url, identity, depth, place, source, elapsed_ms, known)."""
    links: dict[str, list[tuple[str, str]]] = {}
    ms: dict[str, float] = {}
    start, pending = [], deque()
    known = known.sort_values(["kind", "src", "place", "dst"], na_position="first")
    for kind, src, dst, identity, took in zip(known["kind"], known["src"], known["dst"], known["identity"], known["ms"]):
        if kind == SEED:
            start.append((dst, identity))
        elif kind == SITEMAP:
            pending.append((dst, identity))
        elif kind == LINK:
            links.setdefault(src, []).append((dst, identity))
        else:
            ms[dst] = 0.0 if pd.isna(took) else took
    seen: set[str] = set()
    queue: deque = deque()
    out: list[tuple] = []
    clock = 0.0

    def meet(url: str, identity: str) -> bool:
        if url in seen or identity in seen:
            return False
        seen.update((url, identity))
        return True

    for url, identity in start:
        if meet(url, identity):
            queue.append((url, identity, 0, "seed"))
    while len(out) < max_pages and not (budget_ms is not None and clock > budget_ms):
        while not queue and pending:
            url, identity = pending.popleft()
            if meet(url, identity):
                queue.append((url, identity, None, "sitemap"))
        if not queue:
            break
        url, identity, depth, source = queue.popleft()
        clock += ms.get(url, 0.0)
        out.append((url, identity, depth, len(out) + 1, source, clock, url in ms))
        deeper = 1 if depth is None else depth + 1
        if deeper <= max_depth:
            for name in dict.fromkeys((identity, url)):
                for dst, dst_identity in links.get(name, ()):
                    if meet(dst, dst_identity):
                        queue.append((dst, dst_identity, deeper, "link"))
    return out


def _with_identity(pages: DataFrame, identities: DataFrame | None, column: str) -> DataFrame:
    """Pages with the identity of the address in a column: where it leads to, else itself."""
    if identities is None:
        return pages.withColumn("identity", F.col(column))
    named = identities.select("site_key", F.col("url").alias(column), F.col("identity").alias("_identity")).groupBy("site_key", column).agg(F.min("_identity").alias("_identity"))
    return pages.join(named, ["site_key", column], "left").withColumn("identity", F.coalesce("_identity", column)).drop("_identity")


def _first_ones(rows: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Of each group the first rows of different identity, ``limit`` at most, with their place."""
    once = F.row_number().over(Window.partitionBy(*by, "identity").orderBy(*order))
    rows = rows.withColumn("_once", once).where("_once = 1").drop("_once")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("place") <= limit)


def crawl_frontier(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int | None = MAX_DEPTH,
    max_pages: int | None = MAX_PAGES,
    sitemap: DataFrame | None = None,
    identities: DataFrame | None = None,
    durations: DataFrame | None = None,
    time_budget_ms: float | None = None,
    on_progress: Callable[[dict], None] | None = None,
) -> DataFrame:
    """(site_key, url, depth, place, source): pages in the order that a crawl claims them.

    seeds: (site_key, url); links: (site_key, src, dst, and pos, the link's place on its page), already ``crawlable``.
    Pages come in the order in which a queue meets them: by the page that links to them first, then by the link's place
    there (without pos, by target).  Sitemap pages (site_key, pos, url) come when no link is left; their depth is null
    and links on them lead to depth 1.  identities: (site_key, url, identity) of pages that end at another address: of
    several pages of one identity the first is claimed, the others take nothing of the budget, and a page's links are
    those of its identity.  A page that can't be fetched is claimed like any other.

    durations: (site_key, url, ms) of pages; with them there is a column elapsed_ms, the site's time after each page, and
    no page is claimed once that is beyond ``time_budget_ms``.  ``on_progress`` gets the counts of each round: its number,
    sites, pages claimed, and those of them whose links weren't known yet.

    A site's group holds its first ``max_pages`` sitemap pages and as many links of each page fetched, whatever the site's
    size.  Budgets beyond ``QUEUE_PAGES``, without limits of time, are worked off level by level instead, with the same
    claims.  None stands for no limit; without one of depth, claims beyond ``QUEUE_PAGES`` are found for all pages at once,
    the same ones where no identity is itself an address that ends at another.
    """
    if max_depth is None and (max_pages is None or max_pages > QUEUE_PAGES):
        claimed = _whole(seeds, links, sitemap, identities)
        claimed = claimed if max_pages is None else claimed.where(F.col("place") <= max_pages)
        return claimed if durations is None else _timed(claimed, durations, time_budget_ms)
    max_depth, max_pages = NO_LIMIT if max_depth is None else max_depth, NO_LIMIT if max_pages is None else max_pages
    if max_pages > QUEUE_PAGES and durations is None:
        return _by_levels(seeds, links, max_depth, max_pages, sitemap, identities)
    pos = F.min("pos") if "pos" in links.columns else F.lit(0)
    edges = links.where("src <> dst").groupBy("site_key", "src", "dst").agg(pos.alias("pos"))
    edges = materialize(_first_ones(_with_identity(edges, identities, "dst"), ["site_key", "src"], ["pos", "dst"], max_pages), "edges")
    none = lambda kind: F.lit(None).cast(kind)

    def roots(pages: DataFrame, kind: int, order: list[str]) -> DataFrame:
        found = _first_ones(_with_identity(pages, identities, "url"), ["site_key"], order, max_pages)
        return found.select("site_key", F.lit(kind).alias("kind"), none("string").alias("src"), F.col("url").alias("dst"), "identity", "place", none("double").alias("ms"))

    known = roots(seeds.select("site_key", "url").distinct(), SEED, ["url"])
    if sitemap is not None:
        crawled = seeds.select("site_key").distinct()  # a site without a seed isn't crawled
        pending = sitemap.groupBy("site_key", "url").agg(F.min("pos").alias("pos")).join(crawled, "site_key", "left_semi")
        known = known.unionByName(roots(pending, SITEMAP, ["pos", "url"]))
    known = materialize(known, "known")
    parts = [known]

    def claims(rows: pd.DataFrame) -> pd.DataFrame:
        out = run_queue(rows, max_depth, max_pages, time_budget_ms)
        frame = pd.DataFrame(out, columns=["url", "identity", "depth", "place", "source", "elapsed_ms", "known"])
        return frame.assign(site_key=rows["site_key"].iloc[0], depth=frame["depth"].astype("Int32"))[[c.split()[0] for c in CLAIMED.split(", ")]]

    rounds = 0
    while True:
        rounds += 1
        counts = Observation()
        run = known.groupBy("site_key").applyInPandas(claims, CLAIMED)
        run = run.observe(counts, F.count_if(F.col("place") == 1).alias("sites"), F.count("*").alias("claimed"), F.count_if(~F.col("known")).alias("open"))
        claimed = materialize(run, "claims")
        now = counts.get
        if on_progress is not None:
            on_progress({"round": rounds, **now})
        if not now["open"]:
            break
        asked = claimed.where("not known").select("site_key", "url", "identity")
        timed = asked.withColumn("ms", F.lit(0.0)) if durations is None else asked.join(durations.groupBy("site_key", "url").agg(F.max("ms").cast("double").alias("ms")), ["site_key", "url"], "left")
        here = timed.select("site_key", F.lit(PAGE).alias("kind"), none("string").alias("src"), F.col("url").alias("dst"), "identity", none("long").alias("place"), "ms")
        names = asked.select("site_key", F.explode(F.array_distinct(F.array("url", "identity"))).alias("src")).distinct()
        have = known.where(F.col("kind") == LINK).select("site_key", "src").distinct()
        more = edges.join(names.join(have, ["site_key", "src"], "left_anti"), ["site_key", "src"]).select("site_key", F.lit(LINK).alias("kind"), "src", "dst", "identity", "place", none("double").alias("ms"))
        parts.append(materialize(here.unionByName(more), "known"))
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        discard(claimed)
    for scratch in (edges, *parts):
        discard(scratch)
    columns = ["site_key", "url", "depth", "place", "source"]
    return claimed.select(*columns, *(["elapsed_ms"] if durations is not None else []))


def crawl_progress(claimed: DataFrame, links: DataFrame, max_depth: int | None = MAX_DEPTH, max_pages: int | None = MAX_PAGES, sitemap: DataFrame | None = None, identities: DataFrame | None = None) -> DataFrame:
    """(site_key, crawled, discovered, queued, target): what a crawl reports after each page that ``crawl_frontier`` claimed.

    discovered: addresses met so far, by their identity, and sitemap entries not yet taken; queued: those met and not yet
    visited; target: the page budget.  Links beyond the depth limit aren't met.
    """
    max_depth = NO_LIMIT if max_depth is None else max_depth
    own = _with_identity(claimed, identities, "url")
    place = F.col("place")
    deeper = F.coalesce(F.col("depth"), F.lit(0)) + 1
    opens = own.where(deeper <= max_depth).select("site_key", F.explode(F.array_distinct(F.array("url", "identity"))).alias("src"), "place")
    met = _with_identity(links.where("src <> dst").select("site_key", "src", "dst").distinct().join(opens, ["site_key", "src"]), identities, "dst").select("site_key", "identity", "place")
    start = own.where("source <> 'link'").select("site_key", "identity", F.when(F.col("source") == "seed", F.lit(0).cast("long")).otherwise(place).alias("place"))
    first = met.unionByName(start).groupBy("site_key", "identity").agg(F.min("place").alias("place"))
    steps = first.groupBy("site_key", "place").agg(F.count("*").alias("new")).unionByName(own.select("site_key", "place", F.lit(0).cast("long").alias("new")))
    so_far = Window.partitionBy("site_key").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    steps = steps.groupBy("site_key", "place").agg(F.sum("new").alias("new")).withColumn("met", F.sum("new").over(so_far))
    out = own.select("site_key", "place", "url", "source").join(steps.select("site_key", "place", "met"), ["site_key", "place"])
    if sitemap is None:
        out = out.withColumn("left", F.lit(0).cast("long"))
    else:
        listed = sitemap.groupBy("site_key", "url").agg(F.min("pos").alias("pos"))
        listed = listed.withColumn("entry", F.row_number().over(Window.partitionBy("site_key").orderBy("pos", "url")).cast("long"))
        total = listed.groupBy("site_key").agg(F.max("entry").alias("entries"))
        out = out.join(listed.select("site_key", "url", "entry"), ["site_key", "url"], "left").join(total, "site_key", "left")
        taken = F.max(F.when(F.col("source") == "sitemap", F.col("entry"))).over(so_far)
        out = out.withColumn("left", F.coalesce(F.col("entries") - F.coalesce(taken, F.lit(0)), F.lit(0)))
    return out.select("site_key", place.alias("crawled"), (F.col("met") + F.col("left")).alias("discovered"), (F.col("met") - place).alias("queued"), F.lit(max_pages).cast("int").alias("target"))
