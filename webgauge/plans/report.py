"""From captures to reports: document model, findings, scores, to-dos, keywords, as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.functions import urls
from webgauge.operators import scoring
from webgauge.operators.extract import extract_documents, with_derived
from webgauge.operators.keywords import keywords
from webgauge.plans import geo, seo
from webgauge.plans.catalog import complete, explode_findings, findings_column
from webgauge.runtime import built_once, materialize


def audited(captures: DataFrame) -> DataFrame:
    """Captures (page_id, url, html, ...) with doc, x, s and g; absent capture columns are assumed.

    Row by row: the partitions are those of the captures, which ``spark.sql.files.maxPartitionBytes`` sets for files.
    """
    out = with_derived(extract_documents(complete(captures)))
    own = {name: built_once(captures.sparkSession, f"signals {name}", made) for name, made in (("s", seo.signals), ("g", geo.signals))}
    return out.withColumns(own)


def _listed(pages: DataFrame, mode: str, fields: tuple[str, ...] | None = None) -> Column:
    rules = seo.checks if mode == "seo" else geo.checks
    return built_once(pages.sparkSession, f"findings {mode} {fields}", lambda: findings_column(mode, rules(), fields))


def with_findings(pages: DataFrame, mode: str = "seo") -> DataFrame:
    """Adds ``findings``, for pages that are written: rules over what was written would run in the few parts that files
    which shrink so much are read in."""
    return pages.withColumn("findings", _listed(pages, mode))


def findings(pages: DataFrame, mode: str = "seo", fields: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each finding of each page; of pages ``with_findings`` those that they have.  ``fields``: the columns wanted,
    status among them, if not all: Spark doesn't leave out fields of what it explodes."""
    return explode_findings(pages, F.col("findings") if "findings" in pages.columns else _listed(pages, mode, fields))


def _unmeasured(mode: str) -> Column | None:
    return F.col("category").isin("external") | ((F.col("category") == "vitals") & (F.col("max") == 0)) if mode == "seo" else None


def scores(found: DataFrame, mode: str = "seo") -> tuple[DataFrame, DataFrame]:
    """(category scores, page scores) of findings."""
    categories = scoring.category_scores(scoring.check_points(found), mode, _unmeasured(mode))
    return categories, scoring.page_scores(categories)


def by_page(rows: DataFrame) -> DataFrame:
    """Rows of a page for a join with others of it, by sorting: findings and models shrink so much in their files that Spark
    takes what is made of them for small, and would send it all through the driver."""
    return rows.hint("merge")


def page_reports(captures: DataFrame, mode: str = "seo") -> DataFrame:
    """A nested report for each page: page facts, score, categories with checks and findings, to-dos, keywords."""
    pages = materialize(with_findings(audited(captures), mode), "audited")  # read for findings, facts and keywords
    found = materialize(findings(pages, mode), "findings")
    checks = scoring.check_points(found)
    categories = scoring.category_scores(checks, mode, _unmeasured(mode))
    texts = found.groupBy("page_id", "cat_pos", "check_pos").agg(F.array_sort(F.collect_list(F.struct("find_pos", "status", "text", "todo"))).alias("findings"))
    check = F.struct("check_pos", "check", "importance", "status", "earned", F.col("max").alias("of"), "findings")
    nested = checks.join(by_page(texts), ["page_id", "cat_pos", "check_pos"]).groupBy("page_id", "cat_pos").agg(F.array_sort(F.collect_list(check)).alias("checks"))
    category = F.struct("cat_pos", "category", "score", "measured", "ok", "warn", "fail", "checks")
    tree = categories.join(by_page(nested), ["page_id", "cat_pos"]).groupBy("page_id").agg(F.array_sort(F.collect_list(category)).alias("categories"))
    actions = scoring.todos(found).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "check", "category", "action", "importance", "status"))).alias("todos"))
    words = keywords(keyword_rows(pages)).groupBy(F.col("id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "count", "density", "score"))).alias("keywords"))
    facts = pages.select("page_id", "url", F.struct(F.col("doc.title").alias("title"), F.col("doc.description").alias("description"), F.col("x.word_count").alias("word_count"), F.col("x.language").alias("language"), F.size("doc.internal").alias("internal_links"), F.size("doc.external").alias("external_links"), F.size("x.images").alias("images")).alias("page"))
    out = facts.join(by_page(scoring.page_scores(categories)), "page_id").join(by_page(scoring.page_totals(found)), "page_id").join(by_page(tree), "page_id")
    return out.join(by_page(actions), "page_id", "left").join(by_page(words), "page_id", "left").withColumn("mode", F.lit(mode))


def keyword_rows(pages: DataFrame) -> DataFrame:
    d = F.col("doc")
    return pages.select(F.col("page_id").alias("id"), d["body_text"].alias("text"), d["title"].alias("title"), d["description"].alias("description"), F.transform(d["headings"], lambda h: h["text"]).alias("headings"), F.col("url").alias("url"))


def page_summaries(pages: DataFrame, found: DataFrame, mode: str = "seo") -> DataFrame:
    """The flat page rows that site analysis works on."""
    found = materialize(found, "findings")
    categories, overall = scores(found, mode)
    by_key = categories.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("categories"))
    actions = scoring.todos(found).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "check", "category", "action", "importance"))), lambda t: F.struct(t["check"].alias("check"), t["category"].alias("category"), t["action"].alias("action"), t["importance"].alias("importance"))).alias("todos"))
    d, x = F.col("doc"), F.col("x")
    flat = pages.select(
        "page_id", urls.host(F.col("url")).alias("site_key"), urls.canonical(F.col("url")).alias("url"), F.coalesce("requested_url", "url").alias("requested_url"), "status", d["title"].alias("title"), d["description"].alias("description"),
        F.get(x["h1s"], F.lit(0))["text"].alias("h1"), x["word_count"].alias("word_count"), F.col("total_ms").alias("response_ms"), (~F.regexp_like(d["robots_meta"], F.lit(r"\bnoindex\b"))).alias("index"),
        d["canonical"].alias("canonical"), F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("redirect_hops"), F.coalesce(F.get("redirect_chain", F.lit(0))["url"], "requested_url", "url").alias("redirect_from"), F.col("url").alias("final_url"), F.size(d["internal"]).alias("internal_links"), F.size(d["external"]).alias("external_links"), x["content_hash"].alias("content_hash"),
    )
    out = flat.join(by_page(overall), "page_id").join(by_page(scoring.page_totals(found).select("page_id", "errors", "warnings")), "page_id").join(by_page(by_key), "page_id")
    return out.join(by_page(actions), "page_id", "left")


def page_links(pages: DataFrame) -> DataFrame:
    """(site_key, src, dst, pos, nofollow) of links between pages of a site, in canonical form; pos: the first's place."""
    links = pages.select(urls.host(F.col("url")).alias("site_key"), urls.canonical(F.col("url")).alias("src"), F.posexplode("doc.internal").alias("pos", "a"))
    links = links.select("site_key", "src", urls.canonical(F.col("a.href")).alias("dst"), "pos", F.col("a.nofollow").alias("nofollow")).where("dst is not null").where(urls.is_page(F.col("dst")))
    return links.groupBy("site_key", "src", "dst").agg(F.min("pos").alias("pos"), F.bool_and("nofollow").alias("nofollow"))
