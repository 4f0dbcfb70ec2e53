"""Cross-page analysis over a link graph and page rows made of the star schema, and over captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.constants import CATEGORIES, MAX_DEPTH, MAX_PAGES
from webgauge.functions.numbers import status_band
from webgauge.operators import frontier, site
from webgauge.plans import views
from webgauge.queries.registry import ORACLE, long, query, sql_values, table

SEO = [k for k, _, _ in CATEGORIES["seo"]]
ACTIONS = ["add it", "fix it", "drop it"]


def pages_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: its site is the brand."""
    p = table(spark, sf_dir, "part")
    item = lambda k: F.struct(F.concat(F.lit(f"check {k} "), F.expr(f"(p_partkey + {k}) % 3").cast("string")).alias("check"), F.lit("meta").alias("category"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.expr(f"cast((p_partkey div 7 + {k}) % 3 + 1 as int)")).alias("action"), F.lit("high" if k else "low").alias("importance"))
    return p.select(
        F.col("p_brand").alias("site_key"), F.concat(F.lit("/p"), F.col("p_partkey").cast("string")).alias("url"), F.expr("if(p_partkey % 11 = 0, 404, 200)").alias("status"), F.expr("cast(p_partkey * 37 % 101 as int)").alias("score"),
        F.expr("p_partkey % 5").alias("errors"), F.expr("p_partkey % 7").alias("warnings"), F.concat(F.lit(" "), F.upper(F.substring("p_name", 1, 6))).alias("title"), F.expr("if(p_partkey % 13 = 0, '', p_type)").alias("description"),
        F.col("p_name").alias("h1"), F.expr("if(p_partkey % 9 = 0, null, concat(p_type, p_size))").alias("content_hash"), F.expr("p_partkey * 7 % 900").alias("word_count"), F.expr("p_partkey * 3 % 1700").alias("response_ms"), F.expr("p_partkey % 17 <> 0").alias("index"), F.expr("p_partkey % 6").alias("depth"),
        F.expr("if(p_partkey % 10 = 0, 1, 0)").alias("redirect_hops"), F.map_from_arrays(F.array(F.lit("meta"), F.lit("links")), F.array(F.expr("cast(p_size as int)"), F.expr("if(p_partkey % 4 = 0, null, cast(p_partkey % 90 as int))"))).alias("categories"),
        F.array(item(0), item(1)).alias("todos"),
    )


P = """p AS (SELECT p_brand AS site_key, '/p' || p_partkey AS url, CASE WHEN p_partkey % 11 = 0 THEN 404 ELSE 200 END AS status, p_partkey * 37 % 101 AS score, p_partkey % 5 AS errors, p_partkey % 7 AS warnings,
    ' ' || upper(left(p_name, 6)) AS title, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS description, p_name AS h1, CASE WHEN p_partkey % 9 <> 0 THEN p_type || p_size END AS content_hash, p_partkey * 7 % 900 AS word_count, p_partkey * 3 % 1700 AS response_ms, p_partkey % 17 <> 0 AS index,
    p_partkey % 6 AS depth, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS redirect_hops, p_partkey, p_size FROM part)"""


def links_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for each line item, within the part's brand: from its part to any number of the parts' whole key range."""
    part = table(spark, sf_dir, "part")
    pages = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("site_key"))
    i = table(spark, sf_dir, "lineitem").join(pages, "l_partkey").crossJoin(part.agg(F.max("p_partkey").alias("keys")))  # one row
    return i.select(
        "site_key", F.concat(F.lit("/p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("/p"), F.expr("(l_orderkey * 7 + l_suppkey * 11) % keys + 1").cast("string")).alias("dst"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("pos"),
    )


L = "l AS (SELECT p_brand AS site_key, '/p' || l_partkey AS src, '/p' || ((l_orderkey * 7 + l_suppkey * 11) % (SELECT max(p_partkey) FROM part) + 1) AS dst, l_orderkey * 8 + l_linenumber AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(
    f"""WITH {P}, s AS (SELECT site_key, count(*) AS pages, CAST(floor(avg(score) + 0.5) AS BIGINT) AS score, CAST(min(score) AS BIGINT) AS lowest, CAST(max(score) AS BIGINT) AS highest, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings,
    count(*) FILTER (score >= 80) AS good, count(*) FILTER (score >= 60 AND score < 80) AS fair, count(*) FILTER (score < 60) AS poor FROM p GROUP BY site_key)
    SELECT *, CASE WHEN score >= 90 THEN 'Very good' WHEN score >= 80 THEN 'Good' WHEN score >= 60 THEN 'Warning' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS verdict FROM s"""
)
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = site.site_summary(pages_of_parts(spark, sf_dir))
    return s.withColumns({c: long(c) for c in ("score", "lowest", "highest")})


@query(
    f"""WITH {P}, c AS (SELECT * FROM {sql_values(list(enumerate(SEO)))} AS c(cat_pos, category)),
    v AS (SELECT site_key, 'meta' AS category, p_size AS v FROM p UNION ALL SELECT site_key, 'links', CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 90 END FROM p),
    a AS (SELECT site_key, category, CAST(floor(avg(v) + 0.5) AS BIGINT) AS score, count(*) AS pages FROM v WHERE v IS NOT NULL GROUP BY 1, 2)
    SELECT s.site_key, CAST(cat_pos AS BIGINT) AS cat_pos, category, a.score, coalesce(a.pages, 0) AS pages FROM (SELECT DISTINCT site_key FROM p) s CROSS JOIN c LEFT JOIN a USING (site_key, category)"""
)
def site_category_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.category_averages(pages_of_parts(spark, sf_dir)).withColumns({"cat_pos": long("cat_pos"), "score": long("score")})


def _duplicates(column: str) -> str:
    return f"""WITH {P}, g AS (SELECT site_key, lower(trim({column})) AS key, arg_min(trim({column}), url) AS label, count(*) AS count, list_sort(list(url)) AS urls FROM p WHERE trim({column}) <> '' GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT site_key, row_number() OVER (PARTITION BY site_key ORDER BY count DESC, urls[1], key) AS place, key, label, count, array_to_string(urls, ' ') AS urls FROM g"""


def _duplicate_query(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return site.duplicate_groups(pages_of_parts(spark, sf_dir), F.col(column)).withColumns({"urls": F.array_join("urls", " "), "place": long("place")})


@query(_duplicates("title"))
def site_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicate_query(spark, sf_dir, "title")


@query(_duplicates("description"))
def site_duplicate_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicate_query(spark, sf_dir, "description")


@query(_duplicates("h1"))
def site_duplicate_h1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicate_query(spark, sf_dir, "h1")


@query(_duplicates("content_hash"))
def site_duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicate_query(spark, sf_dir, "content_hash")


@query(
    f"""WITH {P}, i AS (SELECT site_key, url, unnest([CASE WHEN status >= 400 THEN ('broken', status, 0) END, CASE WHEN NOT index THEN ('not_indexable', NULL, 0) END, CASE WHEN word_count < 300 THEN ('thin', word_count, word_count) END,
    CASE WHEN depth > 3 THEN ('deep', depth, 0) END, CASE WHEN response_ms > 800 THEN ('slow', response_ms, -response_ms) END, CASE WHEN redirect_hops > 0 THEN ('redirected', redirect_hops, 0) END,
    CASE WHEN trim(title) = '' THEN ('no_title', NULL, 0) END, CASE WHEN trim(description) = '' THEN ('no_description', NULL, 0) END, CASE WHEN trim(h1) = '' THEN ('no_h1', NULL, 0) END]) AS x FROM p)
    SELECT site_key, x[1] AS issue, row_number() OVER (PARTITION BY site_key, x[1] ORDER BY x[3], url) AS place, url, CAST(x[2] AS DOUBLE) AS value FROM i WHERE x IS NOT NULL"""
)
def site_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.page_lists(pages_of_parts(spark, sf_dir)).withColumn("place", long("place"))


@query("SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s >= 400 THEN 'fail' ELSE 'warn' END AS band FROM (SELECT event_id, event_id * 7 % 600 AS s FROM events)")
def status_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", status_band(F.expr("event_id * 7 % 600")).alias("band"))


@query(f"WITH {L} SELECT site_key, dst, count(DISTINCT src) AS sources FROM l GROUP BY 1, 2")
def site_inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.inbound_links(links_of_lineitem(spark, sf_dir))


@query(
    f"""WITH {P}, {L}, d AS (SELECT DISTINCT site_key, src, dst FROM l), r AS (SELECT site_key, dst, src, row_number() OVER (PARTITION BY site_key, dst ORDER BY src) AS n FROM d),
    s AS (SELECT site_key, dst AS url, string_agg(src, ' ' ORDER BY src) AS linked_from FROM r WHERE n <= 5 GROUP BY 1, 2)
    SELECT site_key, url, CAST(status AS BIGINT) AS status, coalesce(linked_from, '') AS linked_from FROM p LEFT JOIN s USING (site_key, url) WHERE status >= 400"""
)
def site_broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = site.broken_pages(pages_of_parts(spark, sf_dir), links_of_lineitem(spark, sf_dir))
    return b.select("site_key", "url", long("status").alias("status"), F.array_join("linked_from", " ").alias("linked_from"))


@query(f"WITH {P}, {L} SELECT site_key, url FROM p WHERE (site_key, url) NOT IN (SELECT site_key, dst FROM l)")
def site_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap of every part."""
    sitemap = table(spark, sf_dir, "part").select(F.col("p_brand").alias("site_key"), F.concat(F.lit("/p"), F.col("p_partkey").cast("string")).alias("url"))
    return site.orphans(pages_of_parts(spark, sf_dir), links_of_lineitem(spark, sf_dir), sitemap)


@query(
    f"""WITH {P}, i AS (SELECT site_key, unnest(list_filter([CASE WHEN status >= 400 THEN 'broken' END, CASE WHEN NOT index THEN 'not_indexable' END, CASE WHEN word_count < 300 THEN 'thin' END, CASE WHEN depth > 3 THEN 'deep' END,
    CASE WHEN response_ms > 800 THEN 'slow' END, CASE WHEN redirect_hops > 0 THEN 'redirected' END, CASE WHEN trim(title) = '' THEN 'no_title' END, CASE WHEN trim(description) = '' THEN 'no_description' END, CASE WHEN trim(h1) = '' THEN 'no_h1' END], lambda x: x IS NOT NULL)) AS issue FROM p)
    SELECT site_key, issue, count(*) AS pages FROM i GROUP BY 1, 2"""
)
def site_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.issue_counts(pages_of_parts(spark, sf_dir))


@query(
    f"""WITH {P}, k AS (SELECT * FROM (VALUES (0), (1)) AS k(k)),
    t AS (SELECT site_key, url, k AS pos, 'check ' || k || ' ' || ((p_partkey + k) % 3) AS "check", {ACTIONS!r}[(p_partkey // 7 + k) % 3 + 1] AS action, CASE WHEN k = 1 THEN 1 ELSE 2 END AS rank FROM p, k),
    c AS (SELECT site_key, "check", action, count(*) AS n, min((url, pos)) AS seen FROM t GROUP BY 1, 2, 3),
    m AS (SELECT *, row_number() OVER (PARTITION BY site_key, "check" ORDER BY n DESC, seen) AS r FROM c),
    g AS (SELECT t.site_key, t."check", m.action, min(rank) AS rank, count(*) AS page_count, count(*) FILTER (t.action <> m.action) AS differing, min((t.url, t.pos)) AS seen FROM t JOIN m ON m.site_key = t.site_key AND m."check" = t."check" AND m.r = 1 GROUP BY 1, 2, 3)
    SELECT site_key, row_number() OVER (PARTITION BY site_key ORDER BY rank, page_count DESC, seen) AS place, "check", action, page_count, differing FROM g"""
)
def site_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = site.site_todos(pages_of_parts(spark, sf_dir))
    return t.select("site_key", long("place").alias("place"), "check", "action", "page_count", long(F.size(F.filter("pages", lambda p: p["action"].isNotNull()))).alias("differing"))


TODO_SITE = "'https://' || lower(replace(site_key, '#', '-')) || '.example'"


@query(
    f"""WITH {P}, k AS (SELECT * FROM (VALUES (0), (1)) AS k(k)),
    q AS (SELECT site_key, {TODO_SITE} || url || CASE WHEN p_partkey % 3 = 0 THEN '?a=1#x' ELSE '' END AS url, CASE WHEN p_partkey % 10 = 0 THEN 'https://moved.example' || url ELSE {TODO_SITE} || url END AS target, repeat(trim(title) || ' ', 8) AS title, p_partkey FROM p),
    t AS (SELECT site_key, url, target, title, k AS pos, 'check ' || k || ' ' || ((p_partkey + k) % 3) AS "check", {ACTIONS!r}[(p_partkey // 7 + k) % 3 + 1] AS action, CASE WHEN k = 1 THEN 1 ELSE 2 END AS rank FROM q, k),
    c AS (SELECT site_key, "check", action, count(*) AS n, min((url, pos)) AS seen FROM t GROUP BY 1, 2, 3),
    m AS (SELECT site_key, "check", action AS modal FROM c QUALIFY row_number() OVER (PARTITION BY site_key, "check" ORDER BY n DESC, seen) = 1),
    g AS (SELECT site_key, "check", row_number() OVER (PARTITION BY site_key ORDER BY min(rank), count(*) DESC, min((url, pos))) AS place FROM t GROUP BY 1, 2),
    r AS (SELECT t.*, m.modal, g.place, regexp_extract(t.url, '^(https://[^/]*)', 1) = regexp_extract(target, '^(https://[^/]*)', 1) AS same FROM t JOIN m USING (site_key, "check") JOIN g USING (site_key, "check"))
    SELECT site_key, place, url, CASE WHEN same THEN regexp_replace(url, '^https://[^/]*', '') ELSE regexp_replace(regexp_replace(url, '^https://', ''), '#.*$', '') END AS shown, target,
        CASE WHEN length(trim(title)) > 40 THEN left(trim(title), 39) || '…' ELSE trim(title) END AS title, CASE WHEN action <> modal THEN action END AS action FROM r"""
)
def site_todo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each site-wide to-do with their summaries, some of them moved to another site."""
    pages = pages_of_parts(spark, sf_dir)
    own = F.concat(F.lit("https://"), F.lower(F.replace("site_key", F.lit("#"), F.lit("-"))), F.lit(".example"), F.col("url"))
    number = F.substring("url", 3, 20).cast("long")
    final = F.when(number % 10 == 0, F.concat(F.lit("https://moved.example"), F.col("url"))).otherwise(own)
    pages = pages.withColumns({"final_url": final, "url": F.concat(own, F.when(number % 3 == 0, "?a=1#x").otherwise("")), "title": F.repeat(F.concat(F.trim("title"), F.lit(" ")), F.lit(8))})
    found = site.todo_pages(site.site_todos(pages), pages, 40)
    return found.withColumn("place", long("place"))


@query(f"WITH {P} SELECT site_key, url, score, row_number() OVER (PARTITION BY site_key ORDER BY score, url) AS place FROM p")
def site_worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.worst_first(pages_of_parts(spark, sf_dir)).select("site_key", "url", long("score").alias("score"), long("place").alias("place"))


@query(
    f"""WITH RECURSIVE {L}, e AS (SELECT DISTINCT site_key, src, dst FROM l WHERE src <> dst), seeds AS (SELECT site_key, min(src) AS url FROM l GROUP BY 1),
    b(site_key, url, depth) AS (SELECT site_key, url, 0 FROM seeds UNION SELECT e.site_key, e.dst, depth + 1 FROM b JOIN e ON e.site_key = b.site_key AND e.src = b.url WHERE depth < 4)
    SELECT site_key, url, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY 1, 2"""
)
def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier without a page budget: every page within reach and its depth."""
    links = links_of_lineitem(spark, sf_dir)
    seeds = links.groupBy("site_key").agg(F.min("src").alias("url"))
    return frontier.crawl_frontier(seeds, links, 4, 1 << 40).select("site_key", "url", long("depth").alias("depth"))


@query(f"WITH {P} SELECT site_key, url, row_number() OVER (PARTITION BY site_key ORDER BY lower(url), url) AS place FROM p")
def site_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order that people sort URLs in; for these URLs that is plain lower case order."""
    return views.by_url(pages_of_parts(spark, sf_dir)).select("site_key", "url", long("place").alias("place"))


def _levels(depth: int, budget: int) -> str:
    """The frontier's levels as SQL: a page's place follows from the first page that links to it and the link's place."""
    out = ["c0 AS (SELECT site_key, min(src) AS url, 0 AS depth, CAST(1 AS BIGINT) AS place FROM l GROUP BY 1)", "s0 AS (SELECT * FROM c0)"]
    for d in range(1, depth + 1):
        out.append(
            f"""n{d} AS (SELECT e.site_key, e.dst AS url, min((c.place, e.pos)) AS by FROM c{d - 1} c JOIN e ON e.site_key = c.site_key AND e.src = c.url WHERE (e.site_key, e.dst) NOT IN (SELECT site_key, url FROM s{d - 1}) GROUP BY 1, 2),
    c{d} AS (SELECT n.site_key, n.url, {d} AS depth, u.used + row_number() OVER (PARTITION BY n.site_key ORDER BY n.by, n.url) AS place FROM n{d} n JOIN (SELECT site_key, count(*) AS used FROM s{d - 1} GROUP BY 1) u USING (site_key) QUALIFY place <= {budget}),
    s{d} AS (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM c{d})"""
        )
    return ", ".join(out)


@query(f"WITH {L}, e AS (SELECT site_key, src, dst, min(pos) AS pos FROM l WHERE src <> dst GROUP BY 1, 2, 3), {_levels(MAX_DEPTH, MAX_PAGES)} SELECT site_key, url, CAST(depth AS BIGINT) AS depth, place, CASE WHEN depth = 0 THEN 'seed' ELSE 'link' END AS source FROM s{MAX_DEPTH}")
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier under its budgets; tests hold it against a queue."""
    links = links_of_lineitem(spark, sf_dir)
    seeds = links.groupBy("site_key").agg(F.min("src").alias("url"))
    return frontier.crawl_frontier(seeds, links).withColumn("depth", long("depth"))


@query(
    f"""WITH {L}, e AS (SELECT site_key, src, dst, min(pos) AS pos FROM l WHERE src <> dst GROUP BY 1, 2, 3), {_levels(MAX_DEPTH, MAX_PAGES)},
    m AS (SELECT e.site_key, e.dst AS url, c.place FROM s{MAX_DEPTH} c JOIN e ON e.site_key = c.site_key AND e.src = c.url WHERE c.depth < {MAX_DEPTH} UNION ALL SELECT site_key, url, 0 FROM c0),
    f AS (SELECT site_key, url, min(place) AS place FROM m GROUP BY 1, 2)
    SELECT c.site_key, c.place AS crawled, count(*) FILTER (f.place <= c.place) AS discovered, count(*) FILTER (f.place <= c.place) - c.place AS queued, {MAX_PAGES} AS target FROM s{MAX_DEPTH} c JOIN f USING (site_key) GROUP BY 1, 2"""
)
def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl reports after each page."""
    links = links_of_lineitem(spark, sf_dir)
    claimed = frontier.crawl_frontier(links.groupBy("site_key").agg(F.min("src").alias("url")), links)
    return frontier.crawl_progress(claimed, links)
