"""The ruleset for answer engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgauge.constants import QUESTION_START, STATISTICS, STOP_WORDS
from webgauge.functions import text as tx
from webgauge.functions import urls
from webgauge.functions.numbers import days_between
from webgauge.plans.catalog import Check, cases, holds, info

# Fixed value: types of publishers.
ORGANIZATION = "(?i)Organization|LocalBusiness|Corporation|MedicalOrganization"


# All of STATISTICS begin with one of these: elsewhere none is tried.
FIGURE = "(?=[0-9$£€¥])"


def _statistic_patterns() -> list[str]:
    return [p.replace(r"\b", tx.ASCII_BOUNDARY) for p in STATISTICS]


def signals() -> Column:
    """What answer engines look for, as a struct: over doc and x."""
    d = F.col("doc")
    opening = F.concat_ws(" ", F.slice(d["paragraphs"], 1, 3))
    terms = F.filter(tx.tokens(d["title"]), lambda w: ~w.isin(STOP_WORDS) & (F.char_length(w) > 3))
    deep = F.filter(d["headings"], lambda h: h["level"] >= 2)
    questions = F.filter(deep, lambda h: F.endswith(F.trim(h["text"]), F.lit("?")) | F.regexp_like(F.trim(h["text"]), F.lit(QUESTION_START)))
    blocks = F.concat(d["paragraphs"], F.transform(deep, lambda h: h["text"]), d["item_texts"])
    any_pattern = FIGURE + "(?:%s)" % "|".join(f"(?:{p.replace('(?i)', '(?i:') + ')' if p.startswith('(?i)') else p})" for p in _statistic_patterns())
    statistics = F.filter(blocks, lambda b: F.regexp_like(b, F.lit(any_pattern)))
    sample = lambda b: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(b, FIGURE + p, 0)), F.lit("")) for p in _statistic_patterns()])
    unmarked = F.aggregate(d["blockquotes"], d["body_text"], lambda text, q: F.when(q == "", text).otherwise(F.replace(text, q, F.lit(" "))))
    quoted = F.regexp_count(unmarked, F.lit('[“"][^”"]{40,400}[”"]'))
    citations = F.transform(d["external"], lambda a: F.struct(a["href"].alias("href"), urls.full_host(a["href"]).alias("host"), a["anchor"].alias("anchor"), urls.is_authoritative(urls.full_host(a["href"])).alias("authoritative")))
    dates = F.concat(F.array(d["markup_date"]), F.array(F.array_max(F.transform(d["ld_nodes"], lambda n: n["modified"]))), F.array(F.array_max(F.transform(d["ld_nodes"], lambda n: n["published"]))))
    freshest = F.array_max(F.filter(dates, lambda s: s.isNotNull() & (s != "")))
    organization = F.get(F.filter(d["ld_nodes"], lambda n: F.regexp_like(n["type"], F.lit(ORGANIZATION))), F.lit(0))
    person = F.get(F.filter(d["ld_nodes"], lambda n: F.lower(n["type"]) == "person"), F.lit(0))
    types = F.array_distinct(F.filter(F.transform(d["ld_nodes"], lambda n: n["type"]), lambda t: t != ""))
    return F.struct(
        F.filter(d["sections"], lambda s: (s["words"] > 0) & (s["words"] < 40)).alias("thin_sections"),
        F.filter(d["sections"], lambda s: s["words"] > 350).alias("long_sections"),
        F.filter(d["sections"], lambda s: s["words"] == 0).alias("empty_sections"),
        questions.alias("question_headings"),
        tx.word_count(opening).alias("opening_words"),
        F.when(F.size(d["paragraphs"]) > 0, tx.word_count(F.get(d["paragraphs"], F.lit(0)))).otherwise(0).alias("first_paragraph_words"),
        F.size(terms).alias("title_terms"),
        F.size(F.filter(terms, lambda t: F.contains(F.lower(opening), t))).alias("title_terms_in_opening"),
        F.size(statistics).alias("statistics"),
        F.slice(F.array_distinct(F.filter(F.transform(statistics, sample), lambda s: s.isNotNull())), 1, 12).alias("statistic_samples"),
        (F.size(d["blockquotes"]) + d["inline_quotes"] + quoted).alias("quotations"),
        citations.alias("citations"),
        F.filter(citations, lambda c: c["authoritative"]).alias("authoritative_citations"),
        ((F.col("x")["word_count"] < 200) & (d["script_count"] >= 5)).alias("client_rendered"),
        freshest.alias("freshest"),
        F.coalesce(organization, person).alias("entity"),
        types.alias("schema_types"),
        F.exists(types, lambda t: F.regexp_like(t, F.lit("(?i)FAQPage|QAPage|HowTo|Question"))).alias("answer_schema"),
        F.exists(types, lambda t: F.regexp_like(t, F.lit("(?i)Article|BlogPosting|NewsArticle|Report"))).alias("article_schema"),
    )


def checks() -> list[Check]:
    """Over doc, x, and g (``signals``)."""
    d, x, g = F.col("doc"), F.col("x"), F.col("g")
    header = lambda name: F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))
    indexable = ~F.regexp_like(d["robots_meta"], F.lit(r"\bnoindex\b")) & ~F.regexp_like(F.lower(header("x-robots-tag")), F.lit(r"\bnoindex\b"))
    robots = F.coalesce("robots_found", F.lit(False))
    words = x["word_count"]
    as_of = F.coalesce("as_of", F.current_timestamp())
    age = days_between(as_of, F.coalesce(F.try_to_timestamp(g["freshest"]), F.try_to_timestamp(F.regexp_replace(g["freshest"], r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))))
    linked = lambda pattern: F.exists(d["internal"], lambda a: F.regexp_like(urls.path(a["href"]), F.lit(pattern)))
    paragraphs, images = F.size(d["paragraphs"]), x["images"]
    deep = F.size(F.filter(d["headings"], lambda h: h["level"] == 2))
    statistics, cited = g["statistics"], F.size(g["citations"])
    return [
        Check("access", "Retrieval crawler access", "critical", [
            info("No robots.txt: nothing is blocked", ~robots),
            holds(~robots | (F.col("blocked_retrieval") == 0), "Retrieval crawlers may read the page", "Unblock retrieval crawlers in robots.txt.", "fail"),
            holds(F.col("blocked_user_triggered") == 0, "Fetches for users are allowed", "Unblock fetches made for users.", where=robots),
            info("Blocking training crawlers is a licensing choice"),
        ]),
        Check("access", "Page availability", "critical", [
            holds((F.col("status") >= 200) & (F.col("status") < 300), "The page answers with success", "Make the page answer with a 2xx status.", "fail"),
            holds(indexable, "Indexing is allowed", "Remove noindex from the page.", "fail"),
        ]),
        Check("access", "Server-rendered content", "critical", [holds(~g["client_rendered"], "The content is in the HTML", "Render the content on the server.", "fail")]),
        Check("access", "llms.txt", "nice", [holds(F.col("llms_found"), "There is an llms.txt", "Add an llms.txt.")]),
        Check("answers", "Opening answer", "critical", [
            cases([(paragraphs == 0, "fail")], None, "No paragraphs", "Open the page with an answer."),
            holds(g["first_paragraph_words"] >= 15, "The first paragraph says something", "Write at least 15 words in the first paragraph.", where=paragraphs > 0),
            holds(g["first_paragraph_words"] <= 120, "The first paragraph is short", "Keep the first paragraph under 120 words.", where=paragraphs > 0),
            holds((g["title_terms"] == 0) | (g["title_terms_in_opening"] > 0), "The opening is about the title", "Take up the title's words in the opening.", where=paragraphs > 0),
        ]),
        Check("answers", "Passage structure", "critical", [
            holds(deep >= 2, "Two sections or more", "Divide the page into sections."),
            holds(F.size(g["thin_sections"]) == 0, "No section is thin", "Write at least 40 words in each section."),
            holds(F.size(g["long_sections"]) == 0, "No section is long", "Split sections over 350 words."),
        ]),
        Check("answers", "Extractable formatting", "high", [
            holds((d["lists"]["ul"] + d["lists"]["ol"] + d["lists"]["dl"] > 0) | (d["tables"] > 0), "There are lists or tables", "Use lists or tables."),
            holds(F.size(g["question_headings"]) > 0, "Some headings are questions", "Phrase headings as questions."),
            holds(x["sentence_words"] <= 25, "Sentences are short", "Write shorter sentences."),
        ]),
        Check("answers", "Answer depth", "high", [cases([(words < 300, "fail"), (words < 700, "warn")], "ok", F.concat(words.cast("string"), F.lit(" words")), "Treat the topic in at least 700 words.")]),
        Check("evidence", "Statistics", "critical", [cases([(statistics == 0, "fail"), (statistics < 3, "warn")], "ok", F.concat(statistics.cast("string"), F.lit(" passages with figures")), "Support statements with figures.")]),
        Check("evidence", "Quotations", "critical", [holds(g["quotations"] > 0, "There are quotations", "Quote experts.", "fail")]),
        Check("evidence", "Source citations", "critical", [
            cases([(cited == 0, "fail")], "ok", F.concat(cited.cast("string"), F.lit(" sources")), "Link to sources."),
            holds(F.size(g["authoritative_citations"]) > 0, "Some sources are authoritative", "Link to authoritative sources.", where=cited > 0),
        ]),
        Check("evidence", "Freshness", "high", [cases([(g["freshest"].isNull(), "warn"), (age > 730, "warn")], "ok", "Date of the last change", "Date the page, and keep it current.")]),
        Check("authority", "Publisher entity", "critical", [
            cases([(g["entity"].isNull(), "fail")], "ok", "The publisher is described", "Describe the publisher in structured data."),
            holds(g["entity"]["name"].isNotNull(), "The publisher has a name", "Name the publisher.", where=g["entity"].isNotNull()),
            holds(F.coalesce(F.size(g["entity"]["same_as"]), F.lit(0)) >= 2, "The publisher is linked to profiles", "Add sameAs links."),
        ]),
        Check("authority", "Authorship", "high", [holds(d["has_author_markup"], "The author is marked up", "Mark up the author.")]),
        Check("authority", "Verifiability", "low", [
            holds(linked("(?i)(about|who-we-are|company|team)"), "There is a page about the publisher", "Link to a page about the publisher."),
            holds(linked("(?i)(contact|support|get-started|demo)"), "There is a contact page", "Link to a contact page."),
        ]),
        Check("structure", "Structured data", "critical", [
            cases([(F.size(g["schema_types"]) == 0, "fail")], "ok", F.array_join(F.slice(g["schema_types"], 1, 8), ", "), "Add structured data."),
            holds(g["answer_schema"] | g["article_schema"], "It describes an answer or article", "Describe the article or its answers.", where=F.size(g["schema_types"]) > 0),
            cases([(F.size(d["json_ld_errors"]) > 0, "fail")], None, "Structured data can't be read", "Correct the JSON-LD."),
        ]),
        Check("structure", "Semantic HTML", "high", [
            holds(d["main_or_article"], "There is a main or article element", "Put the content in main or article."),
            holds(F.size(x["h1s"]) == 1, "Exactly one main heading", "Use exactly one main heading."),
            holds(F.size(x["skipped_levels"]) == 0, "No level is skipped", "Don't skip heading levels."),
        ]),
        Check("structure", "Described media", "low", [
            info("No images", F.size(images) == 0),
            holds(x["images_missing_alt"] == 0, "All images are described", "Describe all images in alt attributes.", where=F.size(images) > 0),
        ]),
    ]
