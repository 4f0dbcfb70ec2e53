"""The search ruleset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.constants import DESCRIPTION_FONT_PX, DESCRIPTION_MAX_PX, SESSION_PARAMS, STOP_WORDS, TITLE_FONT_PX, TITLE_MAX_PX, TRACKING_ANALYSIS, VITALS
from webgauge.functions import text as tx
from webgauge.functions import urls
from webgauge.functions.numbers import clock_drift_ok, days_between, kilobytes, round_half_up
from webgauge.operators.vitals import display, rate
from webgauge.plans.catalog import Check, cases, holds, info

# Fixed value: image names that say nothing.
GENERIC_IMAGE = r"(?i)/(img|image|photo|pic|dsc|dcim|screen ?shot|screenshot|untitled|final|copy|asset|download)[-_ ]?\d*\.(jpe?g|png|webp|gif|avif)$"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def signals() -> Column:
    """What several rules look at, worked out once for each page."""
    d = F.col("doc")
    return F.struct(
        tx.pixel_width(d["title"], TITLE_FONT_PX).alias("title_px"), tx.pixel_width(d["description"], DESCRIPTION_FONT_PX).alias("description_px"), tx.tokens(d["title"]).alias("title_tokens"), F.lower(d["body_text"]).alias("body")
    )


def checks() -> list[Check]:
    """Over doc, x, the ``signals`` s and the columns of a capture."""
    d, x, s, url = F.col("doc"), F.col("x"), F.col("s"), F.col("url")
    title, description = d["title"], d["description"]
    title_px, description_px = s["title_px"], s["description_px"]
    title_tokens = s["title_tokens"]
    content_tokens = F.filter(title_tokens, lambda w: ~w.isin(STOP_WORDS))
    has_title, has_description = ~_empty(title), ~_empty(description)
    words = x["word_count"]
    keys = urls.params(url)
    path, labels = urls.path(url), urls.labels(url)
    header = lambda name: F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))
    indexable = ~F.regexp_like(d["robots_meta"], F.lit(r"\bnoindex\b")) & ~F.regexp_like(F.lower(header("x-robots-tag")), F.lit(r"\bnoindex\b"))
    header_charset = F.regexp_extract(header("content-type"), r"(?i)charset=([^\s;\"']+)", 1)
    charset = F.upper(F.when(~_empty(d["charset_meta"]), d["charset_meta"]).otherwise(header_charset))
    canonical, canonical_raw = d["canonical"], d["canonical_raw"]
    code, html_lang = x["language"]["code"], d["html_lang"]
    hreflang = d["hreflang"]
    https = urls.scheme(url) == "https"
    hops = F.coalesce(F.size("redirect_chain"), F.lit(0))
    as_of = F.coalesce("as_of", F.current_timestamp())

    meta = [
        Check("meta", "Title", "critical", [
            cases([(~has_title, "fail"), (title_px > TITLE_MAX_PX, "warn"), (title_px < TITLE_MAX_PX // 2, "warn")], "ok", F.concat(F.lit("Title width "), title_px.cast("string"), F.lit(" px")), "Give the page a title that fills, but fits, the space of a search result."),
            holds(F.size(F.array_distinct(content_tokens)) == F.size(content_tokens), "No word of the title repeats", "Use each word of the title once.", where=has_title),
            holds(F.size(content_tokens) >= 3, "The title has three words that carry meaning", "Describe the page in at least three words of the title.", where=has_title),
            cases([((F.upper(title) == title) & (F.char_length(title) > 12), "warn")], None, "The title is in capitals", "Write the title in normal case.", where=has_title),
            info(F.concat(F.lit("Title length "), F.char_length(title).cast("string"))),
        ]),
        Check("meta", "Meta description", "critical", [
            cases([(~has_description, "fail"), (description_px > DESCRIPTION_MAX_PX, "warn"), (description_px < 400, "warn")], "ok", F.concat(F.lit("Description width "), description_px.cast("string"), F.lit(" px")), "Write a description of between 400 and 1000 pixels."),
            holds(F.lower(description) != F.lower(title), "The description differs from the title", "Don't repeat the title as description.", where=has_description),
        ]),
        Check("meta", "Crawlability", "critical", [
            holds((F.col("status") >= 200) & (F.col("status") < 300), "The page answers with success", "Make the page answer with a 2xx status.", "fail"),
            holds(indexable, "Indexing is allowed", "Remove noindex from the page.", "fail"),
            holds(F.col("blocking_rule").isNull(), "robots.txt lets search engines in", "Unblock the page in robots.txt.", "fail"),
            cases([(~_empty(d["refresh"]), "warn")], None, "The page refreshes itself", "Replace the meta refresh by a redirect."),
        ]),
        Check("meta", "Canonical link", "high", [
            holds(canonical_raw.isNotNull(), "There is a canonical link", "Name the canonical URL."),
            holds(F.regexp_like(canonical_raw, F.lit(r"(?i)^\s*https?://")), "The canonical link is absolute", "Make the canonical link absolute.", where=canonical_raw.isNotNull()),
            holds(urls.strip_hash(canonical) == urls.strip_hash(url), "The canonical link is the page itself", "Check whether the canonical link should point elsewhere.", where=canonical_raw.isNotNull()),
        ]),
        Check("meta", "Language", "low", [
            holds(code.isNotNull(), "The language of the text is recognisable", "Write the main text in one language."),
            holds(~_empty(html_lang), "The page declares its language", "Set the lang attribute of html."),
            holds(F.substring(F.lower(html_lang), 1, 2) == code, "The declared language is that of the text", "Declare the language that the text is in.", where=~_empty(html_lang) & code.isNotNull()),
            info(F.concat_ws(" ", F.lit("Served over"), F.coalesce("protocol", F.lit("an unknown protocol")))),
        ]),
        Check("meta", "Alternate links", "low", [
            holds(F.lit(True), "Alternate languages"),
            holds(F.exists(hreflang, lambda h: F.lower(h["lang"]) == "x-default"), "There is a default language", "Add an x-default alternate.", where=F.size(hreflang) > 0),
            holds(F.exists(hreflang, lambda h: urls.strip_hash(urls.resolve(h["href"], F.col("url"))) == urls.strip_hash(F.col("url"))), "The page lists itself", "Add the page itself to its alternates.", where=F.size(hreflang) > 0),
        ]),
        Check("meta", "Other meta tags", "low", [
            holds(_empty(d["rel_next"]), "No next link"),
            holds(_empty(d["rel_prev"]), "No previous link"),
            holds(~F.exists(d["meta_tags"], lambda m: F.lower(m["name"]) == "keywords"), "No keywords tag", "Remove the keywords meta tag."),
        ]),
        Check("meta", "Domain", "low", [
            holds((F.size(labels) <= 2) | (F.element_at(labels, 1) == "www"), "Not a subdomain"),
            holds(F.char_length(F.try_element_at(labels, F.lit(-2))) <= 20, "The domain name is short"),
            holds(~F.contains(urls.full_host(url), F.lit("xn--")) & F.regexp_like(urls.full_host(url), F.lit(r"^[\x00-\x7f]*$")), "The domain is in Latin letters"),
        ]),
        Check("meta", "Page URL", "low", [
            holds(~F.exists(keys, lambda k: ~F.regexp_like(k, F.lit(TRACKING_ANALYSIS))), "No parameters in the URL", "Use a URL without parameters."),
            holds(~F.exists(keys, lambda k: F.regexp_like(k, F.lit(SESSION_PARAMS))), "No session in the URL", "Take the session out of the URL.", "fail"),
            holds(urls.depth(url) <= 4, "At most four folders"),
            holds(F.char_length(path) <= 100, "A short path"),
            holds(~F.regexp_like(path, F.lit("[A-Z_]")), "Lower case and hyphens only"),
        ]),
        Check("meta", "Charset encoding", "low", [
            holds(charset != "", "The encoding is declared", "Declare the encoding."),
            holds(charset.isin("UTF-8", "UTF8"), "The encoding is UTF-8", "Use UTF-8.", where=charset != ""),
            holds(~_empty(d["charset_meta"]), "The encoding is declared in the page", "Declare the encoding in the page itself.", where=charset != ""),
        ]),
        Check("meta", "Doctype", "nice", [
            holds(d["doctype"]["html5"], "HTML5 doctype", "Use the HTML5 doctype."),
            holds(d["doctype"]["first"], "The doctype comes first", "Begin the page with the doctype."),
        ]),
        Check("meta", "Favicon", "nice", [holds(F.col("favicon_ok"), "The favicon loads", "Provide a favicon.")]),
    ]

    stop_percent = round_half_up(x["stop_percent"], 1)
    terms = F.filter(title_tokens, lambda w: ~w.isin(STOP_WORDS) & (F.char_length(w) > 2))
    body, h1_text = s["body"], F.lower(F.concat_ws(" ", F.transform(x["h1s"], lambda h: h["text"])))
    lists = d["lists"]["ul"] + d["lists"]["ol"] + d["lists"]["dl"]
    size_kb, images = kilobytes(F.octet_length(F.coalesce("html", F.lit("")))), x["images"]
    viewport = F.lower(d["viewport"])
    bold = F.size(d["bold"])
    og, card = d["open_graph"], d["twitter"]["card"]
    quality = [
        Check("quality", "Content", "critical", [
            cases([(words < 250, "fail"), (words < 800, "warn")], "ok", F.concat(words.cast("string"), F.lit(" words")), "Write at least 800 words."),
            cases([((stop_percent > 45) | (stop_percent < 12), "warn")], "ok", "Share of stop words", "Bring the share of stop words between 12 and 45 percent.", where=words >= 50),
            holds(F.size(F.filter(terms, lambda t: F.contains(body, t))) >= F.ceil(F.size(terms) / 2), "The title's words occur in the text", "Use the title's words in the text.", where=F.size(terms) > 0),
            holds(F.forall(terms, lambda t: F.contains(h1_text, t)), "The title's words occur in the main heading", "Use the title's words in the main heading.", where=F.size(terms) > 0),
            holds(lists > 0, "There is a list", "Arrange some of the content as a list."),
            holds(F.size(d["paragraphs"]) >= 5, "Five paragraphs or more", "Divide the text into paragraphs."),
            holds(~x["has_placeholder_text"] & (x["placeholder_images"] == 0), "No placeholders", "Replace placeholder content.", "fail"),
            holds(x["duplicate_paragraphs"] == 0, "No paragraph repeats", "Remove repeated paragraphs."),
            cases([(x["sentence_count"] == 0, "warn"), (x["sentence_words"] <= 25, "ok")], "warn", "Sentence length", "Write sentences of 25 words or less."),
            holds(F.size(d["text_issues"]) == 0, "No mechanical mistakes", "Correct mechanical mistakes in the text."),
            holds(d["has_author_markup"] | d["has_date_markup"], "Author or date is marked up", "Mark up author or date."),
        ]),
        Check("quality", "Frames", "critical", [
            holds(d["frames"]["frameset"] == 0, "No frameset", "Remove the frameset.", "fail"),
            holds(d["frames"]["iframe"] <= 3, "Few inline frames", "Reduce the number of inline frames."),
        ]),
        Check("quality", "Mobile optimization", "low", [
            cases([(size_kb > 150, "warn")], "ok", F.concat(round_half_up(size_kb).cast("string"), F.lit(" KB of HTML")), "Reduce the HTML below 150 KB."),
            cases([(_empty(viewport), "fail"), (~F.regexp_like(viewport, F.lit(r"width\s*=\s*device-width")), "warn"), (F.regexp_like(viewport, F.lit(r"user-scalable\s*=\s*no|maximum-scale\s*=\s*1(\.0)?\b")), "warn")], "ok", "Viewport", "Declare a viewport of device width that can be zoomed."),
            holds(F.exists(d["favicons"], lambda f: F.contains(F.lower(f["rel"]), F.lit("apple-touch-icon"))), "There is an icon for home screens", "Add an apple-touch-icon."),
        ]),
        Check("quality", "Strong and bold tags", "low", [
            cases([(bold == 0, "warn"), (bold > F.greatest(F.lit(6), round_half_up(words / F.lit(100.0))), "warn")], "ok", F.concat(bold.cast("string"), F.lit(" strong passages")), "Stress a few important passages."),
        ]),
        Check("quality", "Image SEO", "low", [
            info("No images", F.size(images) == 0),
            holds(x["images_missing_alt"] == 0, "All images are described", "Describe all images in alt attributes.", where=F.size(images) > 0),
            holds(~F.exists(images, lambda m: F.regexp_like(m["src"], F.lit(GENERIC_IMAGE))), "Image files have names", "Name image files by what they show.", where=F.size(images) > 0),
            holds(x["sized_images"] == F.size(images), "All images have sizes", "Set width and height of images.", where=F.size(images) > 0),
            holds(x["lazy_images"] > 0, "Some images load late", "Load images below the fold lazily.", where=F.size(images) > 3),
        ]),
        Check("quality", "Social media", "nice", [
            holds((F.size(x["share_links"]) + d["share_widgets"] > 0) | (F.size(x["social_profiles"]) >= 2), "The page can be shared", "Add share links or profiles."),
            holds(~_empty(og["title"]) & ~_empty(og["description"]) & ~_empty(og["image"]), "Open Graph is complete", "Add Open Graph title, description and image."),
            holds(~_empty(card), "There is a Twitter card", "Add a Twitter card."),
        ]),
        Check("quality", "Additional markup", "nice", [
            cases([(F.size(d["json_ld"]) > 0, "ok"), ((d["microdata"] > 0) | (d["rdfa"] > 0), "ok")], "warn", "Structured data", "Add structured data."),
            cases([(F.size(d["json_ld_errors"]) > 0, "fail")], None, "Structured data can't be read", "Correct the JSON-LD."),
        ]),
        Check("quality", "HTTPS", "low", [
            holds(https, "The page uses HTTPS", "Serve the page over HTTPS.", "fail"),
            holds(F.size(d["insecure"]) == 0, "Nothing is loaded without HTTPS", "Load everything over HTTPS.", where=https),
            holds(F.regexp_like(F.col("tls_version"), F.lit(r"1\.[23]")), "TLS is current", "Use TLS 1.2 or 1.3.", where=https & F.col("tls_version").isNotNull()),
        ]),
    ]

    h1s, first_h1 = F.size(x["h1s"]), F.char_length(F.coalesce(F.get(x["h1s"], F.lit(0))["text"], F.lit("")))
    headings = F.size(d["headings"])
    structure = [
        Check("structure", "H1 heading", "critical", [
            cases([(h1s == 0, "fail"), (h1s > 1, "warn")], "ok", F.concat(h1s.cast("string"), F.lit(" main headings")), "Use exactly one main heading."),
            cases([(first_h1 == 0, "fail"), ((first_h1 < 15) | (first_h1 > 110), "warn")], "ok", "Length of the main heading", "Write a main heading of 15 to 110 characters.", where=h1s > 0),
        ]),
        Check("structure", "Headings", "high", [
            cases([(headings == 0, "fail")], None, "No headings", "Structure the page with headings."),
            holds(F.exists(d["headings"], lambda h: h["level"] == 2), "There are second-level headings", "Add second-level headings.", where=headings > 0),
            holds(F.size(x["skipped_levels"]) == 0, "No level is skipped", "Don't skip heading levels.", where=headings > 0),
            holds(x["empty_headings"] == 0, "No heading is empty", "Fill or remove empty headings.", where=headings > 0),
            holds(round_half_up(words / F.greatest(headings, F.lit(1)).cast("double")) <= 200, "Headings come often enough", "Add headings: one for each 200 words.", where=(headings > 0) & (words > 300)),
        ]),
    ]

    internal = F.size(d["internal"])
    links = [
        Check("links", "Internal links", "high", [
            cases([(internal == 0, "fail"), ((internal < 5) | (internal > 300), "warn")], "ok", F.concat(internal.cast("string"), F.lit(" internal links")), "Link to between 5 and 300 pages of the site."),
            holds(~F.exists(d["internal"], lambda a: ~a["has_anchor_text"]), "All links have a text", "Give every link a text."),
            holds(F.size(x["duplicate_anchors"]) == 0, "No text leads to several pages", "Use different texts for links to different pages."),
            holds(x["long_anchors"] == 0, "No link text is long", "Shorten link texts."),
            holds(x["dynamic_internal"] == 0, "No parameters in links", "Link to URLs without parameters."),
            info("Links within the page", F.size(d["fragments"]) > 0),
        ]),
        Check("links", "External links", "nice", [
            holds(F.lit(True), F.concat(F.size(d["external"]).cast("string"), F.lit(" external links"))),
            holds(x["unsafe_targets"] == 0, "New windows are isolated", "Add noopener to links that open windows."),
            info(F.concat(F.size(F.filter(d["external"], lambda a: ~a["nofollow"])).cast("string"), F.lit(" followed external links"))),
        ]),
    ]

    cert_days = days_between(F.col("cert_valid_to"), as_of)
    kb = round_half_up(size_kb)
    server = [
        Check("server", "HTTP redirects", "critical", [
            holds(hops == 0, "No redirect", "Link to the final URL."),
            holds(F.col("variant_canonical"), "Both spellings of the host lead to one", "Redirect one spelling of the host to the other.", F.when(F.coalesce("variant_reachable", F.lit(False)), "fail").otherwise("warn"), where=F.coalesce("variant_tested", F.lit(False))),
            holds(F.col("https_upgrade"), "HTTP leads to HTTPS", "Redirect HTTP to HTTPS.", where=F.col("https_upgrade").isNotNull()),
        ]),
        Check("server", "HTTP header", "high", [
            holds((header("date") != "") & clock_drift_ok(as_of, header("date")), "The server's clock is right", "Set the server's clock and send a Date header."),
            holds(header("x-powered-by") == "", "No X-Powered-By", "Don't send X-Powered-By."),
            holds(header("content-encoding") != "", "The answer is compressed", "Compress the answer."),
            cases([(F.regexp_like(header("server"), F.lit(r"\d+\.\d+")), "warn")], None, "The server tells its version", "Hide the server's version."),
        ]),
        Check("server", "Security headers", "low", [
            holds(header("strict-transport-security") != "", "HSTS", "Send Strict-Transport-Security."),
            holds(F.lower(header("x-content-type-options")) == "nosniff", "nosniff", "Send X-Content-Type-Options: nosniff."),
            holds((header("content-security-policy") != "") | (header("x-frame-options") != ""), "Framing is restricted", "Send a Content-Security-Policy or X-Frame-Options."),
            holds(header("referrer-policy") != "", "Referrer policy", "Send a Referrer-Policy."),
        ]),
        Check("server", "Performance", "low", [
            holds(kb <= 250, "The HTML is small", "Reduce the HTML below 250 KB."),
            cases([(F.col("ttfb_ms") <= 400, "ok"), (F.col("ttfb_ms") <= 1000, "warn")], "fail", "Time to the first byte", "Answer within 400 ms.", where=F.col("ttfb_ms").isNotNull()),
            holds(kilobytes(F.col("transfer_bytes")) <= 200, "Little is transferred", "Transfer less than 200 KB.", where=F.col("transfer_bytes").isNotNull()),
        ]),
        Check("server", "Protocol & transport", "low", [
            holds(F.col("protocol").isin("h2", "h3"), "HTTP/2", "Use HTTP/2.", where=F.col("protocol").isNotNull()),
            holds(cert_days > 14, "The certificate is valid for long enough", "Renew the certificate.", F.when(cert_days > 0, "warn").otherwise("fail"), where=cert_days.isNotNull()),
        ]),
        Check("server", "robots.txt & sitemap", "high", [
            holds(F.col("robots_found"), "There is a robots.txt", "Add a robots.txt."),
            holds(F.col("has_sitemap_line"), "robots.txt names the sitemap", "Name the sitemap in robots.txt."),
            holds(F.col("sitemap_found"), "There is a sitemap", "Add a sitemap."),
            cases([(F.coalesce("blocks_all", F.lit(False)), "fail")], None, "robots.txt keeps everyone out", "Let crawlers in."),
        ]),
    ]

    measured = F.col("vitals").isNotNull()
    value = lambda m: F.try_element_at("vitals", F.lit(m))
    vitals = [Check("vitals", "Field data", "critical", [info("No field data", ~measured), info(F.coalesce("vitals_reason", F.lit("no-data")), ~measured & F.coalesce(F.col("vitals_reason").isin("no-key", "no-data"), F.lit(True)))])]
    for m, (_, _, _, label, core) in VITALS.items():
        rating = rate(F.lit(m), value(m))
        has = measured & value(m).isNotNull()
        vitals.append(Check("vitals", label, "critical" if core else "low", [
            cases([(rating == "good", "ok"), (rating == "needs-improvement", "warn")], "fail", F.concat(F.lit(f"{label} "), display(F.lit(m), value(m))), f"Improve {label}.", where=has),
            info("Distribution", has),
        ]))
    passed = None
    for m, v in VITALS.items():
        if v[4]:
            good = F.coalesce(rate(F.lit(m), value(m)), F.lit("good")) == "good"
            passed = good if passed is None else passed & good
    vitals.append(Check("vitals", "Core Web Vitals assessment", "high", [holds(passed, "The assessment is passed", "Pass the Core Web Vitals assessment.", where=measured), info("Assessment", measured)]))

    entity = F.exists(d["json_ld"], lambda t: F.regexp_like(t, F.lit("(?i)Organization|LocalBusiness|Person|WebSite")))
    external = [
        Check("external", "Backlinks", "critical", [info("Backlinks aren't measured"), info("They need a link index")]),
        Check("external", "Entity signals", "low", [
            holds(entity, "The publisher is described", "Describe the publisher in structured data."),
            holds(F.size(x["social_profiles"]) >= 2, "Two profiles or more are linked", "Link to the publisher's profiles."),
        ]),
    ]
    return [*meta, *quality, *structure, *links, *server, *vitals, *external]
