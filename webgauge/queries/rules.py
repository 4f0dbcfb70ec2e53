"""Pages made of parts, whose markup varies what the rules look at; SQL gives the rules' outcomes from the same switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.plans import report
from webgauge.queries.registry import dealt, long, query, table

#: Switches by name: (divisor, number of values) of the part's number, so that they vary by themselves.
ANSWER_SWITCHES = {
    "robots": (1, 2), "closed": (2, 2), "closed_to_users": (4, 2), "noindex": (8, 2), "status": (3, 3), "scripts": (5, 2), "llms": (7, 3), "paragraph": (11, 4), "on_topic": (13, 2), "sections": (17, 4),
    "section_words": (19, 3), "question": (23, 2), "list": (29, 3), "figures": (31, 5), "quote": (37, 2), "source": (41, 3), "date": (43, 4), "publisher": (47, 5), "article": (53, 2), "author": (59, 2),
    "about": (61, 2), "contact": (67, 2), "main": (71, 2), "h1": (73, 3), "skip": (79, 2), "image": (83, 3),
}
PARAGRAPH_WORDS, SECTION_WORDS = [0, 10, 60, 130], [20, 60, 360]
DATES = [None, "2024-05-01", "2020-01-01", "soon"]
PUBLISHERS = [
    "", '{"@type":"Organization","name":"Org","sameAs":["https://x.example/","https://y.example/"]}', '{"@type":"Organization","sameAs":"https://x.example/"}', '{"@type":"Person","name":"P"}', "{broken",
]


#: What the SQL says of a finding, by the page it is of.
HELD = ("check", "find_pos", "status")


def switch(switches: dict, name: str) -> Column:
    by, values = switches[name]
    return (F.floor(F.col("p_partkey") / by) % values).cast("int")


def sql_switches(switches: dict) -> str:
    return ", ".join(f"p_partkey // {by} % {values} AS {name}" for name, (by, values) in switches.items())


def pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda name: switch(ANSWER_SWITCHES, name)
    when = lambda name, text, value=1: F.when(s(name) == value, text).otherwise("")
    times = lambda text, n: F.repeat(F.lit(text) if isinstance(text, str) else text, n)
    script = lambda text: F.concat(F.lit('<script type="application/ld+json">'), text, F.lit("</script>"))
    date = pick(DATES, s("date"))
    head = F.concat(
        F.lit("<!doctype html><html lang=en><head><title>Solar panels</title>"), when("noindex", "<meta name=robots content=noindex>"), when("author", "<meta name=author content=Ann>"),
        F.when(date.isNotNull(), F.concat(F.lit('<meta property="article:modified_time" content="'), date, F.lit('">'))).otherwise(""),
        F.when(s("publisher") > 0, script(pick(PUBLISHERS, s("publisher")))).otherwise(""), when("article", script(F.lit('{"@type":"Article"}'))), times("<script>1</script>", s("scripts") * 5), F.lit("</head><body>"),
    )
    words = pick(PARAGRAPH_WORDS, s("paragraph"))
    paragraph = F.when(s("paragraph") > 0, F.concat(F.lit("<p>"), times("alpha ", words - 1), F.when(s("on_topic") == 1, "panels").otherwise("beta"), F.lit(" </p>"))).otherwise("")
    section = F.concat(F.lit("<h2>"), F.when(s("question") == 1, "What is alpha").otherwise("Alpha beta"), F.lit(" </h2><span>"), times("alpha ", pick(SECTION_WORDS, s("section_words"))), F.lit("</span>"))
    body = F.concat(
        when("main", "<main>"), times("<h1>Solar heading </h1>", s("h1")), paragraph, when("skip", "<h5>Deep </h5>"), when("list", "<ul><li>alpha item </li></ul>"), when("list", "<table><tr><td>alpha cell </td></tr></table>", 2),
        F.when(s("figures") > 0, F.concat(F.lit("<ul>"), times("<li>grew 45% alpha </li>", s("figures")), F.lit("</ul>"))).otherwise(""), when("quote", "<blockquote>alpha quote </blockquote>"),
        when("source", '<a href="https://news.example.org/a">source</a> '), when("source", '<a href="https://www.cdc.gov/a">source</a> ', 2), when("about", '<a href="/about-us">about</a> '), when("contact", '<a href="/contact">contact</a> '),
        when("image", "<img src=/i.png alt=described>"), when("image", "<img src=/i.png>", 2), times(section, s("sections")), when("main", "</main>"),
    )
    parts = dealt(table(spark, sf_dir, "part"))
    return parts.select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/"), "p_partkey").alias("url"), F.concat(head, body).alias("html"), F.when(s("status") == 2, 404).otherwise(200).alias("status"),
        (s("robots") == 1).alias("robots_found"), (s("closed") * 5).alias("blocked_retrieval"), s("closed_to_users").alias("blocked_user_triggered"), F.when(s("llms") < 2, s("llms") == 1).alias("llms_found"),
        F.lit("2024-06-01").cast("timestamp").alias("as_of"),
    )


def _outcomes(rules: dict[str, list[str | None]]) -> str:
    """A row of each finding whose SQL gives a status."""
    return "\n    UNION ALL ".join(f"SELECT page_id, '{check}' AS \"check\", CAST({k} AS BIGINT) AS find_pos, {status} AS status FROM w" for check, found in rules.items() for k, status in enumerate(found) if status)


def _ok(test: str, otherwise: str = "warn", where: str | None = None) -> str:
    out = f"CASE WHEN {test} THEN 'ok' ELSE '{otherwise}' END"
    return f"CASE WHEN {where} THEN {out} END" if where else out


ANSWER_RULES = {
    "Retrieval crawler access": ["CASE WHEN robots = 0 THEN 'info' END", _ok("robots = 0 OR closed = 0", "fail"), _ok("closed_to_users = 0", where="robots = 1"), "'info'"],
    "Page availability": [_ok("status <> 2", "fail"), _ok("noindex = 0", "fail")],
    "Server-rendered content": [_ok("NOT (words < 200 AND scripts = 1)", "fail")],
    "llms.txt": [_ok("llms = 1")],
    "Opening answer": ["CASE WHEN paragraph = 0 THEN 'fail' END", _ok("paragraph > 1", where="paragraph > 0"), _ok("paragraph < 3", where="paragraph > 0"), _ok("on_topic = 1", where="paragraph > 0")],
    "Passage structure": [_ok("sections >= 2"), _ok("sections = 0 OR section_words > 0"), _ok("sections = 0 OR section_words < 2")],
    "Extractable formatting": [_ok("list > 0 OR figures > 0"), _ok("sections > 0 AND question = 1")],
    "Answer depth": ["CASE WHEN words < 300 THEN 'fail' WHEN words < 700 THEN 'warn' ELSE 'ok' END"],
    "Statistics": ["CASE WHEN figures = 0 THEN 'fail' WHEN figures < 3 THEN 'warn' ELSE 'ok' END"],
    "Quotations": [_ok("quote = 1", "fail")],
    "Source citations": [_ok("source > 0", "fail"), _ok("source = 2", where="source > 0")],
    "Freshness": ["CASE WHEN date IN (0, 2) THEN 'warn' ELSE 'ok' END"],
    "Publisher entity": [_ok("publisher BETWEEN 1 AND 3", "fail"), _ok("publisher IN (1, 3)", where="publisher BETWEEN 1 AND 3"), _ok("publisher = 1")],
    "Authorship": [_ok("author = 1")],
    "Verifiability": [_ok("about = 1"), _ok("contact = 1")],
    "Structured data": [_ok("publisher BETWEEN 1 AND 3 OR article = 1", "fail"), _ok("article = 1", where="publisher BETWEEN 1 AND 3 OR article = 1"), "CASE WHEN publisher = 4 THEN 'fail' END"],
    "Semantic HTML": [_ok("main = 1"), _ok("h1 = 1"), _ok("skip = 0 OR h1 = 0")],
    "Described media": ["CASE WHEN image = 0 THEN 'info' END", _ok("image = 1", where="image > 0")],
}


@query(
    f"""WITH s AS (SELECT p_partkey AS page_id, {sql_switches(ANSWER_SWITCHES)} FROM part),
    w AS (SELECT *, h1 * 2 + {PARAGRAPH_WORDS}[paragraph + 1] + skip + CASE WHEN list > 0 THEN 2 ELSE 0 END + figures * 3 + quote * 2 + CASE WHEN source > 0 THEN 1 ELSE 0 END + about + contact + sections * ({SECTION_WORDS}[section_words + 1] + 2 + question) AS words FROM s)
    SELECT * FROM ({_outcomes(ANSWER_RULES)}) WHERE status IS NOT NULL"""
)
def geo_rules_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the answer ruleset over pages that vary what they look at (but for the length of sentences)."""
    found = report.findings(report.audited(answer_pages(spark, sf_dir)), "geo", HELD)
    found = found.where((F.col("check") != "Extractable formatting") | (F.col("find_pos") < 2))
    return found.select("page_id", "check", long("find_pos").alias("find_pos"), "status")


SEARCH_SWITCHES = {
    "description": (1, 5), "noindex": (2, 2), "refresh": (3, 2), "canonical": (5, 5), "lang": (4, 2), "hreflang": (7, 4), "keywords": (6, 2), "next": (8, 2), "prev": (9, 2), "charset": (11, 4), "doctype": (10, 3), "favicon": (12, 2),
    "iframes": (13, 3), "viewport": (14, 4), "icon": (15, 2), "og": (16, 2), "card": (17, 2), "ld": (18, 4), "microdata": (19, 2), "insecure": (20, 2), "tls": (21, 3), "length": (22, 3), "many": (23, 2), "topic": (24, 2),
    "h1": (25, 3), "h1_topic": (26, 2), "list": (27, 2), "placeholder": (28, 2), "author": (29, 2), "bold": (30, 3), "image": (31, 6), "social": (32, 3), "internal": (33, 3), "empty_link": (34, 2), "same_text": (35, 2), "long_text": (36, 2),
    "dynamic": (37, 2), "fragment": (38, 2), "unsafe": (39, 2), "h2": (40, 2), "empty_heading": (41, 2), "hop": (42, 2), "variant": (43, 4), "upgrade": (44, 3), "clock": (45, 3), "powered": (46, 2), "compressed": (47, 2),
    "version": (48, 2), "hsts": (49, 2), "nosniff": (50, 2), "framing": (51, 3), "referrer": (52, 2), "ttfb": (53, 4), "transfer": (54, 3), "protocol": (55, 3), "cert": (56, 4), "robots": (57, 2), "sitemap_line": (58, 2),
    "sitemap": (59, 2), "blocks_all": (60, 2), "rule": (61, 2), "status": (62, 3), "vitals": (63, 6),
}
DESCRIPTIONS = ["", "short words", "a description of the page that has about one hundred letters so that it fills the space it is given", "many words in a very long text " * 12, "solar panels explained"]
WORDS_A_PARAGRAPH, BOLD, INTERNAL, IFRAMES = [20, 60, 200], [0, 2, 30], [0, 3, 6], [0, 3, 4]
VIEWPORTS = ["", "width=device-width", "width=500", "width=device-width, user-scalable=no"]
LD = ["", '{"@type":"Organization","name":"Org"}', "{broken", '{"@type":"Article"}']
IMAGES = [
    "", "<img src=/panel-roof.png alt=described width=1 height=1>", "<img src=/panel-roof.png width=1 height=1>", "<img src=/IMG_0001.jpg alt=described>", "<img src=/panel-roof.png alt=described width=1 height=1>" * 4,
    "<img src=/panel-roof.png alt=described width=1 height=1 loading=lazy>" * 4,
]
SOCIAL = ["", '<a href="https://www.facebook.com/sharer/sharer.php?u=x">share</a> ', '<a href="https://www.facebook.com/org">one</a> <a href="https://www.linkedin.com/company/org">two</a> ']
DOCTYPES = ["<!doctype html>", "", '<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd">']
VITAL_MAPS = [None, None, None, {"lcp": 1000.0, "inp": 100.0, "cls": 0.05}, {"lcp": 3000.0, "cls": 0.3}, {"fcp": 1000.0, "ttfb": 3000.0}]
VITAL_REASONS = [None, "no-data", "quota", None, None, None]


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda name: switch(SEARCH_SWITCHES, name)
    when = lambda name, text, value=1: F.when(s(name) == value, text).otherwise("")
    own = F.concat(F.lit("https://shop.example/"), "p_partkey")
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    meta = lambda values, at, name: F.when(pick(values, s(at)) != "", join(f'<meta name={name} content="', pick(values, s(at)), '">')).otherwise("")
    canonical = F.when(s("canonical") == 0, "").otherwise(
        join('<link rel=canonical href="', F.when(s("canonical") == 1, own).when(s("canonical") == 2, join(own, "#x")).when(s("canonical") == 3, join("/", F.col("p_partkey").cast("string"))).otherwise(F.lit("https://shop.example/other")), '">')
    )
    alternate = lambda lang, to: join(f'<link rel=alternate hreflang={lang} href="', to, '">')
    og = '<meta property="og:title" content=t><meta property="og:description" content=d><meta property="og:image" content=/i.png>'
    head = join(
        pick(DOCTYPES, s("doctype")), F.when(s("lang") == 1, "<html lang=en>").otherwise("<html>"), "<head><title>Solar panels explained</title>", meta(DESCRIPTIONS, "description", "description"), when("noindex", "<meta name=robots content=noindex>"),
        when("refresh", '<meta http-equiv=refresh content="5">'), canonical, F.when(s("hreflang") % 2 == 1, alternate("x-default", "https://shop.example/all")).otherwise(""), F.when(s("hreflang") > 1, alternate("en", own)).otherwise(""),
        when("keywords", "<meta name=keywords content=a>"), when("next", "<link rel=next href=/n>"), when("prev", "<link rel=prev href=/n>"), when("charset", "<meta charset=utf-8>"), when("charset", "<meta charset=ISO-8859-1>", 2),
        meta(VIEWPORTS, "viewport", "viewport"), when("icon", "<link rel=apple-touch-icon href=/a.png>"), when("og", og), when("card", "<meta name=twitter:card content=summary>"),
        F.when(s("ld") > 0, join('<script type="application/ld+json">', pick(LD, s("ld")), "</script>")).otherwise(""), when("insecure", "<script src=http://cdn.example/x.js></script>"), when("author", "<meta name=author content=Ann>"), "</head><body>",
    )
    paragraph = lambda k: join(f"<p>unique{'abcde'[k]} ", F.repeat(F.lit("alpha "), pick(WORDS_A_PARAGRAPH, s("length")) - 1), "</p>")
    anchors = join(*[F.when(pick(INTERNAL, s("internal")) > k, f'<a href="/p{k}">page{"abcdef"[k]}</a> ').otherwise("") for k in range(6)])
    body = join(
        F.repeat(F.when(s("h1_topic") == 1, "<h1>Solar panels explained here </h1>").otherwise("<h1>Something else entirely different </h1>"), s("h1")), when("h2", "<h2>Alpha beta </h2>"), when("empty_heading", "<h3></h3>"),
        paragraph(0), F.when(s("many") == 1, join(*[paragraph(k) for k in range(1, 5)])).otherwise(""), when("topic", "<i>solar panels </i>"), when("placeholder", "<i>lorem ipsum </i>"), when("list", "<ul><li>alpha item </li></ul>"),
        F.repeat(F.lit("<b>alpha </b>"), pick(BOLD, s("bold"))), F.repeat(F.lit("<iframe src=/f></iframe>"), pick(IFRAMES, s("iframes"))), when("microdata", "<span itemscope></span>"), pick(IMAGES, s("image")), pick(SOCIAL, s("social")), anchors,
        when("empty_link", '<a href="/e"></a> '), when("same_text", '<a href="/s1">same</a> <a href="/s2">same</a> '), when("long_text", f'<a href="/l">{"alpha " * 20}</a> '), when("dynamic", '<a href="/x?id=1">dynamic</a> '),
        when("fragment", '<a href="#top">top</a> '), when("unsafe", '<a href="https://other.example/" target=_blank>out</a> '),
    )
    pairs = [
        ("content-type", F.when(s("charset") == 3, "text/html; charset=utf-8").otherwise("text/html")), ("date", F.when(s("clock") == 1, "Sat, 01 Jun 2024 00:00:30 GMT").when(s("clock") == 2, "Sat, 01 Jun 2024 00:10:00 GMT").otherwise("")),
        ("x-powered-by", when("powered", "x")), ("content-encoding", when("compressed", "gzip")), ("server", F.when(s("version") == 1, "nginx/1.25").otherwise("nginx")), ("strict-transport-security", when("hsts", "max-age=1")),
        ("x-content-type-options", when("nosniff", "nosniff")), ("x-frame-options", when("framing", "DENY")), ("content-security-policy", when("framing", "default-src 'self'", 2)), ("referrer-policy", when("referrer", "origin")),
    ]
    hop = F.array(F.struct(F.lit("https://shop.example/old").alias("url"), F.lit(301).alias("status"), F.lit("/").alias("location")))
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    maybe = lambda name: F.when(s(name) > 0, s(name) == 1)
    vitals = F.get(F.array(*[F.lit(None).cast("map<string,double>") if m is None else F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in VITAL_MAPS]), s("vitals"))
    return dealt(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("page_id"), own.alias("url"), F.concat(head, body).alias("html"), F.when(s("status") == 2, 404).otherwise(200).alias("status"), F.when(s("rule") == 1, "/x").alias("blocking_rule"), (s("favicon") == 1).alias("favicon_ok"),
        pick([None, "TLSv1.3", "TLSv1.0"], s("tls")).alias("tls_version"), F.when(s("hop") == 1, hop).otherwise(F.array().cast(hop_type())).alias("redirect_chain"), (s("variant") > 0).alias("variant_tested"), (s("variant") == 1).alias("variant_canonical"),
        (s("variant") == 2).alias("variant_reachable"), maybe("upgrade").alias("https_upgrade"), F.create_map(*[x for name, v in pairs for x in (F.lit(name), v)]).alias("headers"), pick([None, 100.0, 700.0, 2000.0], s("ttfb")).alias("ttfb_ms"),
        pick([None, 1000, 300 * 1024], s("transfer")).cast("long").alias("transfer_bytes"), pick([None, "h2", "http/1.1"], s("protocol")).alias("protocol"), F.when(s("cert") > 0, F.timestamp_seconds(F.unix_seconds(as_of) + pick([0, 30, 5, -1], s("cert")) * 86400)).alias("cert_valid_to"),
        (s("robots") == 1).alias("robots_found"), (s("sitemap_line") == 1).alias("has_sitemap_line"), (s("sitemap") == 1).alias("sitemap_found"), (s("blocks_all") == 1).alias("blocks_all"), vitals.alias("vitals"), pick(VITAL_REASONS, s("vitals")).alias("vitals_reason"), as_of.alias("as_of"),
    )


def hop_type() -> str:
    return "array<struct<url:string,status:int,location:string>>"


def _vital(good: str, middling: str, bad: str) -> list[str]:
    where = f"{good} OR {middling} OR {bad}"
    return [f"CASE WHEN {good} THEN 'ok' WHEN {middling} THEN 'warn' WHEN {bad} THEN 'fail' END", f"CASE WHEN {where} THEN 'info' END"]


NO, HEADINGS = "FALSE", "(h1 + h2 + empty_heading)"
SEARCH_RULES = {
    "Meta description": ["CASE description WHEN 0 THEN 'fail' WHEN 2 THEN 'ok' ELSE 'warn' END", _ok("description <> 4", where="description > 0")],
    "Crawlability": [_ok("status <> 2", "fail"), _ok("noindex = 0", "fail"), _ok("rule = 0", "fail"), "CASE WHEN refresh = 1 THEN 'warn' END"],
    "Canonical link": [_ok("canonical > 0"), _ok("canonical <> 3", where="canonical > 0"), _ok("canonical < 4", where="canonical > 0")],
    "Language": [None, _ok("lang = 1"), None, "'info'"],
    "Alternate links": ["'ok'", _ok("hreflang % 2 = 1", where="hreflang > 0"), _ok("hreflang > 1", where="hreflang > 0")],
    "Other meta tags": [_ok("next = 0"), _ok("prev = 0"), _ok("keywords = 0")],
    "Charset encoding": [_ok("charset > 0"), _ok("charset <> 2", where="charset > 0"), _ok("charset IN (1, 2)", where="charset > 0")],
    "Doctype": [_ok("doctype = 0"), _ok("doctype <> 1")],
    "Favicon": [_ok("favicon = 1")],
    "Content": [
        "CASE WHEN words < 250 THEN 'fail' WHEN words < 800 THEN 'warn' ELSE 'ok' END", None, _ok("topic = 1 OR h1 > 0 AND h1_topic = 1"), _ok("h1 > 0 AND h1_topic = 1"), _ok("list = 1"), _ok("many = 1"), _ok("placeholder = 0", "fail"), "'ok'", None, None,
        _ok("author = 1"),
    ],
    "Frames": ["'ok'", _ok("iframes < 2")],
    "Mobile optimization": ["'ok'", "CASE viewport WHEN 0 THEN 'fail' WHEN 1 THEN 'ok' ELSE 'warn' END", _ok("icon = 1")],
    "Strong and bold tags": [_ok("bold = 1")],
    "Image SEO": ["CASE WHEN image = 0 THEN 'info' END", _ok("image <> 2", where="image > 0"), _ok("image <> 3", where="image > 0"), _ok("image <> 3", where="image > 0"), _ok("image = 5", where="image > 3")],
    "Social media": [_ok("social > 0"), _ok("og = 1"), _ok("card = 1")],
    "Additional markup": [_ok("ld IN (1, 3) OR microdata = 1 OR og = 1"), "CASE WHEN ld = 2 THEN 'fail' END"],
    "HTTPS": ["'ok'", _ok("insecure = 0"), _ok("tls = 1", where="tls > 0")],
    "Headings": [
        f"CASE WHEN {HEADINGS} = 0 THEN 'fail' END", _ok("h2 = 1", where=f"{HEADINGS} > 0"), _ok("empty_heading = 0 OR h2 = 1 OR h1 = 0", where=f"{HEADINGS} > 0"), _ok("empty_heading = 0", where=f"{HEADINGS} > 0"),
        _ok(f"floor(words / CAST({HEADINGS} AS DOUBLE) + 0.5) <= 200", where=f"{HEADINGS} > 0 AND words > 300"),
    ],
    "Internal links": [
        "CASE WHEN links = 0 THEN 'fail' WHEN links < 5 THEN 'warn' ELSE 'ok' END", _ok("empty_link = 0"), _ok("same_text = 0"), _ok("long_text = 0"), _ok("dynamic = 0"), "CASE WHEN fragment = 1 THEN 'info' END",
    ],
    "External links": ["'ok'", _ok("unsafe = 0"), "'info'"],
    "HTTP redirects": [_ok("hop = 0"), "CASE WHEN variant = 1 THEN 'ok' WHEN variant = 2 THEN 'fail' WHEN variant = 3 THEN 'warn' END", _ok("upgrade = 1", where="upgrade > 0")],
    "HTTP header": [_ok("clock = 1"), _ok("powered = 0"), _ok("compressed = 1"), "CASE WHEN version = 1 THEN 'warn' END"],
    "Security headers": [_ok("hsts = 1"), _ok("nosniff = 1"), _ok("framing > 0"), _ok("referrer = 1")],
    "Performance": ["'ok'", "CASE ttfb WHEN 1 THEN 'ok' WHEN 2 THEN 'warn' WHEN 3 THEN 'fail' END", _ok("transfer = 1", where="transfer > 0")],
    "Protocol & transport": [_ok("protocol = 1", where="protocol > 0"), "CASE cert WHEN 1 THEN 'ok' WHEN 2 THEN 'warn' WHEN 3 THEN 'fail' END"],
    "robots.txt & sitemap": [_ok("robots = 1"), _ok("sitemap_line = 1"), _ok("sitemap = 1"), "CASE WHEN blocks_all = 1 THEN 'fail' END"],
    "Field data": ["CASE WHEN vitals < 3 THEN 'info' END", "CASE WHEN vitals < 2 THEN 'info' END"],
    "Largest Contentful Paint": _vital("vitals = 3", "vitals = 4", NO),
    "Interaction to Next Paint": _vital("vitals = 3", NO, NO),
    "Cumulative Layout Shift": _vital("vitals = 3", NO, "vitals = 4"),
    "First Contentful Paint": _vital("vitals = 5", NO, NO),
    "Time to First Byte": _vital(NO, NO, "vitals = 5"),
    "Core Web Vitals assessment": [_ok("vitals <> 4", where="vitals > 2"), "CASE WHEN vitals > 2 THEN 'info' END"],
    "Backlinks": ["'info'", "'info'"],
    "Entity signals": [_ok("ld = 1"), _ok("social = 2")],
}


@query(
    f"""WITH s AS (SELECT p_partkey AS page_id, {sql_switches(SEARCH_SWITCHES)} FROM part),
    w AS (SELECT *, {INTERNAL}[internal + 1] + empty_link + same_text * 2 + long_text + dynamic AS links,
        h1 * 4 + h2 * 2 + (1 + many * 4) * {WORDS_A_PARAGRAPH}[length + 1] + topic * 2 + placeholder * 2 + list * 2 + {BOLD}[bold + 1] + social + {INTERNAL}[internal + 1] + same_text * 2 + long_text * 20 + dynamic + fragment + unsafe AS words FROM s)
    SELECT * FROM ({_outcomes(SEARCH_RULES)}) WHERE status IS NOT NULL"""
)
def seo_rules_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of the search ruleset over pages that vary what they look at; but for the language of the text, shares of
    stop words, lengths of sentences and mechanical mistakes, and for the checks that ``seo_rule_sample`` holds."""
    found = report.findings(report.audited(search_pages(spark, sf_dir)), "seo", HELD)
    held = [(check, k) for check, found_here in SEARCH_RULES.items() for k, status in enumerate(found_here) if status]
    at = F.concat_ws("#", "check", "find_pos")
    return found.where(at.isin([f"{check}#{k}" for check, k in held])).select("page_id", "check", long("find_pos").alias("find_pos"), "status")
