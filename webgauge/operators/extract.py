"""Page captures to document models: one pass over the HTML in Arrow batches, the rest as column expressions."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice, takewhile
from typing import NamedTuple
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webgauge.constants import PLACEHOLDER_IMAGE, PLACEHOLDER_TEXT, SESSION_PARAMS, SHARE_LINKS, SOCIAL_HOSTS, TRACKING_LINKS
from webgauge.functions import text as tx
from webgauge.operators.dom import Node, parse
from webgauge.runtime import built_once

WORD, ASCII_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"), re.compile("[a-z0-9][a-z0-9'-]*")
NOT_KEY = regex.compile(r"[^\p{L}\p{N} ]")
#: Characters that a URL holds percent-encoded.
UNSAFE = re.compile(r'[^\x21-\x7e]|["<>`]')
#: Fixed value: elements whose text a reader doesn't see.
UNSEEN = frozenset("script style noscript template svg iframe object canvas".split())
PARAGRAPHS = frozenset("p blockquote dd figcaption".split())
LEAF_BLOCKS = frozenset("div section td".split())
LOADED = frozenset("img script link iframe video audio source embed".split())
SPA_IDS = frozenset("root app __next".split())
#: A piece of models ends at so many pages, or after so many characters of their sources.
PIECE_PAGES, PIECE_CHARACTERS = 64, 1_000_000

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = _struct(href=S, anchor=S, has_anchor_text=B, nofollow=B, rel=S, target=S, params=T.ArrayType(S))
DOC = _struct(
    title=S, meta_tags=T.ArrayType(_struct(name=S, content=S, kind=S)), description=S, robots_meta=S, viewport=S, author=S, generator=S, refresh=S, rel_next=S, rel_prev=S,
    canonical_raw=S, canonical=S, hreflang=T.ArrayType(_struct(lang=S, href=S)), html_lang=S, charset_meta=S, favicons=T.ArrayType(_struct(rel=S, href=S, sizes=S)),
    doctype=_struct(present=B, raw=S, html5=B, first=B), headings=T.ArrayType(_struct(level=I, text=S)), body_text=S, main_text=S, paragraphs=T.ArrayType(S), bold=T.ArrayType(S),
    lists=_struct(ul=I, ol=I, dl=I), tables=I, media=T.ArrayType(_struct(tag=S, src=S, alt=S, title=S, width=S, height=S, loading=S, decorative=B)), inline_svg=I,
    internal=T.ArrayType(LINK), external=T.ArrayType(LINK), fragments=T.ArrayType(S), mailto_tel=T.ArrayType(S), json_ld=T.ArrayType(S), json_ld_errors=T.ArrayType(S),
    microdata=I, rdfa=I, microformats=I, share_widgets=I, insecure=T.ArrayType(_struct(tag=S, url=S)), frames=_struct(frameset=I, frame=I, iframe=I),
    open_graph=_struct(title=S, description=S, image=S, url=S, type=S, site_name=S), twitter=_struct(card=S, title=S, description=S, image=S), has_author_markup=B, has_date_markup=B,
    text_issues=T.ArrayType(_struct(type=S, excerpt=S, note=S)), sections=T.ArrayType(_struct(heading=S, words=I)), item_texts=T.ArrayType(S), blockquotes=T.ArrayType(S), inline_quotes=I,
    script_count=I, spa_root=B, markup_date=S, ld_nodes=T.ArrayType(_struct(type=S, name=S, same_as=T.ArrayType(S), published=S, modified=S)), main_or_article=B,
)


def clean(text: str) -> str:
    return " ".join(text.replace("\ufeff", " ").split())


def word_count(text: str) -> int:
    text = text.lower()
    return len((ASCII_WORD if text.isascii() else WORD).findall(text))


def has_words(text: str, least: int) -> bool:
    """Whether a text has so many words; the rest isn't counted."""
    text = text.lower()
    return next(islice((ASCII_WORD if text.isascii() else WORD).finditer(text), least - 1, None), None) is not None


# -- text issues -----------------------------------------------------------------------------------------------------

EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"  # word boundary between ASCII letters
#: Fixed value: abbreviations before which a missing space is fine.
ABBREVIATIONS = "mr mrs ms dr prof inc ltd llc co vs etc e.g i.e no fig approx dept est jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k".split()
#: Characters shown on either side of an issue.
MARGIN = 34


class Issue(NamedTuple):
    """A kind of mechanical mistake: where it shows, which groups of a match excuse it, and what is noted of it."""

    kind: str
    shows: str
    note: str  # with groups of the match, and its size
    likely: Callable[[str], bool]  # false only where nothing can show, and quicker to tell
    excuses: dict[str, str] = {}  # text made of groups -> pattern that excuses it


#: Letters that are equal to i where case doesn't count.
TURKIC = str.maketrans("İı", "ii")


def _meets(text: str) -> bool:
    """Whether a piece between white space ends in two letters or more with which the next begins."""
    pieces = (text.casefold() if text.isascii() else text.translate(TURKIC).casefold()).split()
    return any(b[:2] in a and any(a.endswith(b[:n]) for n in range(2, len(b) + 1)) for a, b in zip(pieces, pieces[1:]))


def _any_of(*parts: str) -> Callable[[str], bool]:
    return lambda text: any(part in text for part in parts)


MARK_BEFORE_LETTER, SPACE_BEFORE_MARK = re.compile(r"[.!?][^\W\d_]"), re.compile(r"\s[,;:!?]")
#: Kinds, patterns, exceptions and notes, in the order in which issues are listed.
ISSUES = [
    Issue("Repeated word", rf"(?i){EDGE}(\p{{L}}{{2,}})\s+\1{EDGE}", '"{1} {1}"', _meets, {"{1}": "(?i)^(that|had|very|no|so|out|blah)$"}),
    Issue(
        "Missing space",
        r"(\p{Ll}{2,})([.!?])(\p{Lu}\p{Ll}{2,})",
        'after "{2}"',
        lambda text: bool(MARK_BEFORE_LETTER.search(text)),
        {"{1}{2}": rf"(?i){EDGE}(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.$", "{1}": r"(?i)https?|www|\.(com|org|net|io|co|health|ai)$"},
    ),
    Issue("Spacing before punctuation", r"\p{L}\s+([,;:!?])(?:\s|$)", 'stray space before "{1}"', lambda text: bool(SPACE_BEFORE_MARK.search(text))),
    Issue("Duplicate punctuation", r"([,;:])\1+|\?{3,}|!{3,}", "{0}", _any_of(",,", ";;", "::", "???", "!!!")),
    Issue("Suspiciously long word", rf"{EDGE}\p{{L}}{{31,}}{EDGE}", "{size} characters", lambda text: max(map(len, text.split()), default=0) > 30),
    Issue("Unrendered placeholder", r"\{\{[^}]{1,60}\}\}|%[A-Z_]{3,}%|\$\{[^}]{1,60}\}", "{0}", _any_of("{{", "%", "${")),
]
_issues = [(issue, regex.compile(issue.shows), [(made, regex.compile(pattern)) for made, pattern in issue.excuses.items()]) for issue in ISSUES]


def _told(template: str, match) -> str:
    return template.format(match[0], *match.groups(), size=len(match[0]))


def _shown(text: str, match) -> str:
    """The match amid its surroundings, dots where these go on."""
    start, end = match.span()
    middle = text[max(0, start - MARGIN) : end + MARGIN].strip()
    return "…" * (start > MARGIN) + middle + "…" * (len(text) - end > MARGIN)


def _issues_of(text: str) -> dict[tuple[str, str], str]:
    """The notes of a paragraph's mistakes by their kind and surroundings."""
    found: dict[tuple[str, str], str] = {}
    judged: set[tuple] = set()
    for issue, shows, excuses in _issues:
        for match in shows.finditer(text) if issue.likely(text) else ():
            start, end = match.span()
            around = issue.kind, text[max(0, start - MARGIN) : end + MARGIN], min(start, MARGIN + 1), end - start, len(text) - end > MARGIN
            if around in judged:
                continue
            judged.add(around)
            key = issue.kind, _shown(text, match)
            if key not in found and not any(excuse.search(_told(made, match)) for made, excuse in excuses):
                found[key] = _told(issue.note, match)
    return found


#: Pages of a site share paragraphs: those of up to so many characters are remembered.
REMEMBERED = 2000
_remembered_issues = lru_cache(1024)(_issues_of)


def text_issues(paragraphs: list[str]) -> list[dict[str, str]]:
    """Mechanical mistakes of a text, each kind and surroundings once."""
    found: dict[tuple[str, str], str] = {}
    for text in paragraphs:
        for key, note in (_remembered_issues if len(text) <= REMEMBERED else _issues_of)(text).items():
            found.setdefault(key, note)
    return [{"type": kind, "excerpt": excerpt, "note": note} for (kind, excerpt), note in found.items()]


def issue_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The mechanical mistakes of texts, their lines taken as paragraphs; some texts at a time, as ``models``."""
    arrow = to_arrow_type(DOC["text_issues"].dataType)
    for texts in batches:
        for at in range(0, len(texts), PIECE_PAGES):
            yield pa.array([text_issues(t.split("\n")) for t in texts.slice(at, PIECE_PAGES).to_pylist()], arrow)


def text_issue_column(text: Column) -> Column:
    return F.arrow_udf(issue_lists, DOC["text_issues"].dataType)(text)


# -- links and structured data ---------------------------------------------------------------------------------------


@lru_cache(4096)
def _host(url: str) -> str:
    try:
        return re.sub(r"^www\.", "", (urlsplit(url).hostname or "").lower())
    except ValueError:
        return ""


@lru_cache(256)
def _root(base: str) -> str | None:
    """The root of a page's origin."""
    try:
        parts = urlsplit(base)
        return f"{parts.scheme}://{parts.netloc}/" if parts.scheme in ("http", "https") and parts.netloc else None
    except ValueError:
        return None


def _absolute(href: str, base: str) -> str | None:
    """An address on a page made absolute; one with a path from the root or a scheme is the same on all pages of an origin."""
    href = href.strip()
    root = _root(base) if href.startswith(("/", "http://", "https://")) else None
    return _resolved(href, root or base)


@lru_cache(4096)
def _resolved(href: str, base: str) -> str | None:
    try:
        url = UNSAFE.sub(lambda m: quote(m[0]), urljoin(base, href))
        parts = urlsplit(url)
        if parts.scheme in ("http", "https") and parts.hostname:
            return url if parts.path else url.replace(parts.netloc, parts.netloc + "/", 1)
        return url if parts.scheme else None
    except ValueError:
        return None


def _ld_nodes(value) -> list[dict]:
    out, todo = [], [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            todo = v + todo
        elif isinstance(v, dict):
            out.append(v)
            if isinstance(v.get("@graph"), list):
                todo = v["@graph"] + todo
    return out


def _type(node: dict, joiner: str) -> str:
    t = node.get("@type")
    return joiner.join(map(str, t)) if isinstance(t, list) else "" if t is None else str(t)


def _text_or_none(value) -> str | None:
    return value if isinstance(value, str) and value else None


class _Elements:
    """The elements of a page in document order, by tag."""

    def __init__(self, root: Node):
        self.all = list(root.walk())
        self.by_tag: dict[str, list[Node]] = {}
        for n in self.all:
            self.by_tag.setdefault(n.tag, []).append(n)

    def tags(self, *names: str) -> list[Node]:
        if len(names) == 1:
            return self.by_tag.get(names[0], [])
        there = set(names) & self.by_tag.keys()
        return [n for n in self.all if n.tag in there] if there else []


def _unseen(n: Node) -> bool:
    return n.tag in UNSEEN or bool(n.attrs) and (n.attrs.get("aria-hidden") == "true" or "hidden" in n.attrs)


def extract(source: str, url: str) -> dict:
    """The document model of one page (fields of ``DOC``)."""
    document = parse(source)
    e = _Elements(document)
    doc: dict = {}
    head = e.tags("head")[0]
    title = next((n for n in head.walk() if n.tag == "title"), None) or next(iter(e.tags("title")), None)
    doc["title"] = clean(title.text()) if title else ""

    metas = e.tags("meta")
    meta = lambda key, value: clean(next((n.attrs.get("content", "") for n in metas if n.attrs.get(key) == value), ""))
    doc["meta_tags"] = [
        {
            "name": m.attrs.get("name") or m.attrs.get("property") or m.attrs.get("http-equiv") or ("charset" if "charset" in m.attrs else m.attrs.get("itemprop") or "(unnamed)"),
            "content": clean(m.attrs.get("content", m.attrs.get("charset", ""))),
            "kind": "property" if "property" in m.attrs else "http-equiv" if "http-equiv" in m.attrs else "name",
        }
        for m in metas
    ]
    fallback = next((m.attrs.get("content", "") for m in metas if m.attrs.get("property") == "og:description" and "data-fallback" in m.attrs), "")
    doc["description"] = clean(meta("name", "description") or fallback)
    doc["robots_meta"] = (meta("name", "robots") or meta("name", "googlebot")).lower()
    for field in ("viewport", "author", "generator"):
        doc[field] = meta("name", field)
    doc["refresh"] = meta("http-equiv", "refresh")

    links = [n for n in e.tags("link") if "rel" in n.attrs]
    rel = lambda r: next((n for n in links if n.attrs["rel"] == r), None)
    for field, r in (("rel_next", "next"), ("rel_prev", "prev")):
        n = rel(r)
        doc[field] = n.attrs.get("href") if n else None
    n = rel("canonical")
    raw = n.attrs.get("href") if n else None
    doc["canonical_raw"], doc["canonical"] = raw or None, (_absolute(raw, url) or raw) if raw else None
    doc["hreflang"] = [{"lang": n.attrs["hreflang"], "href": n.attrs.get("href", "")} for n in links if n.attrs["rel"] == "alternate" and "hreflang" in n.attrs]
    html_node = e.tags("html")[0]
    doc["html_lang"] = clean(html_node.attrs.get("lang", ""))
    doc["charset_meta"] = next((m.attrs["charset"] for m in metas if "charset" in m.attrs), "")
    doc["favicons"] = [{"rel": n.attrs["rel"], "href": n.attrs.get("href", ""), "sizes": n.attrs.get("sizes", "")} for n in links if "icon" in n.attrs["rel"].lower()]

    m = re.search(r"<!doctype[^>]*>", source, re.I)
    declared = clean(m[0]) if m else ""
    doc["doctype"] = {
        "present": bool(m),
        "raw": declared or None,
        "html5": bool(re.fullmatch(r"<!doctype\s+html\s*>", declared, re.I)),
        "first": bool(m and not re.sub(r"<!--.*?-->", "", source[: m.start()], flags=re.S).strip("﻿ \t\r\n\f")),
    }
    doc["headings"] = [{"level": int(n.tag[1]), "text": clean(n.text())} for n in e.tags("h1", "h2", "h3", "h4", "h5", "h6")]

    body = e.tags("body")[0]
    doc["body_text"] = clean(body.text(_unseen))
    hidden: set[int] = set()
    for n in e.all:
        if id(n) in hidden or _unseen(n):
            hidden.add(id(n))
            hidden.update(id(c) for c in n.children if isinstance(c, Node))
    seen = [n for n in e.all if id(n) not in hidden]
    mains = [n for n in seen if n.tag == "main"] or [n for n in seen if n.tag == "article"]
    doc["main_text"] = clean("".join(n.text(_unseen) for n in mains)) if mains else doc["body_text"]
    paragraphs = [t for n in seen if n.tag in PARAGRAPHS and has_words(t := clean(n.text(_unseen)), 3)]
    for n in seen:
        if n.tag in LEAF_BLOCKS and not any(isinstance(c, Node) and not _unseen(c) for c in n.children):
            t = clean(n.text(_unseen))
            if len(t) >= 60 and has_words(t, 10):
                paragraphs.append(t)
    doc["paragraphs"] = paragraphs
    doc["bold"] = [t for n in seen if n.tag in ("strong", "b") and (t := clean(n.text(_unseen)))]
    count = Counter(n.tag for n in seen)
    doc["lists"] = {"ul": count["ul"], "ol": count["ol"], "dl": count["dl"]}
    doc["tables"] = count["table"]

    media = []
    for n in [*e.tags("img"), *e.tags("video", "audio", "embed", "object", "source", "track")]:
        a = n.attrs
        src = a.get("src") or (a.get("data-src") or a.get("srcset", "").split(",")[0].strip().split(" ")[0] if n.tag == "img" else a.get("data", "") if n.tag == "object" else "")
        media.append({"tag": n.tag, "src": (_absolute(src, url) or src) if src else None, "alt": clean(a["alt"]) if "alt" in a else None, "title": clean(a.get("title", "")) or None, "width": a.get("width") or None, "height": a.get("height") or None, "loading": a.get("loading") or None, "decorative": n.tag == "img" and (a.get("alt") == "" or a.get("role") == "presentation")})
    doc["media"], doc["inline_svg"] = media, len(e.tags("svg"))

    own = _host(url)
    doc["internal"], doc["external"], doc["fragments"], doc["mailto_tel"] = [], [], [], []
    for n in e.tags("a"):
        href = n.attrs.get("href", "").strip()
        if not href:
            continue
        if re.match(r"(mailto|tel|sms|callto):", href, re.I):
            doc["mailto_tel"].append(href)
        elif href.startswith("#"):
            doc["fragments"].append(href)
        elif not re.match(r"(javascript|data):", href, re.I):
            full = _absolute(href, url)
            if not full or not full.lower().startswith(("http://", "https://")):
                continue
            image = next((c for c in n.walk() if c.tag == "img" and "alt" in c.attrs), None)
            text = clean(n.text())
            anchor = text or clean(image.attrs["alt"] if image else "") or clean(n.attrs.get("aria-label", "")) or clean(n.attrs.get("title", ""))
            relation = n.attrs.get("rel", "").lower()
            keys = [p.split("=", 1)[0] for p in urlsplit(full).query.split("&") if p]
            link = {"href": full, "anchor": anchor, "has_anchor_text": bool(anchor), "nofollow": bool(re.search(r"\bnofollow\b", relation)), "rel": relation, "target": n.attrs.get("target", ""), "params": keys}
            doc["internal" if _host(full) == own else "external"].append(link)

    types, errors, nodes = [], [], []
    for n in e.tags("script"):
        if n.attrs.get("type") == "application/ld+json":
            content = n.text()
            try:
                found = _ld_nodes(json.loads(content))
            except ValueError:
                errors.append(content.strip()[:120])
                continue
            types += [t for x in found if (t := _type(x, " / "))]
            nodes += found
    doc["json_ld"], doc["json_ld_errors"] = types, errors
    doc["ld_nodes"] = [
        {
            "type": _type(x, "/"),
            "name": _text_or_none(x.get("name")),
            "same_as": [str(v) for v in (x["sameAs"] if isinstance(x["sameAs"], list) else [x["sameAs"]])] if x.get("sameAs") else [],
            "published": _text_or_none(x.get("datePublished")),
            "modified": _text_or_none(x.get("dateModified")),
        }
        for x in nodes
    ]
    marked = [n for n in e.all if n.attrs]
    attr = lambda *names: sum(any(k in n.attrs for k in names) for n in marked)
    doc["microdata"], doc["rdfa"] = attr("itemscope"), attr("vocab", "typeof", "property")
    classes = [(n, n.attrs.get("class", "")) for n in marked]
    doc["microformats"] = sum("h-card" in c or "h-entry" in c for _, c in classes)
    doc["share_widgets"] = sum("share" in c or "sharing" in c or "share" in n.attrs.get("id", "") or "data-share" in n.attrs for n, c in classes)
    doc["insecure"] = [{"tag": n.tag, "url": u} for n in marked if n.tag in LOADED and (u := n.attrs.get("src") or n.attrs.get("href", "")).lower().startswith("http://")] if url.lower().startswith("https:") else []
    doc["frames"] = {k: len(e.tags(k)) for k in ("frameset", "frame", "iframe")}
    doc["open_graph"] = {k.replace(":", "_"): meta("property", f"og:{k}") for k in ("title", "description", "image", "url", "type", "site_name")}
    doc["twitter"] = {k: meta("name", f"twitter:{k}") or meta("property", f"twitter:{k}") for k in ("card", "title", "description", "image")}
    doc["has_author_markup"] = bool(doc["author"]) or any(n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "author" or "author" in c.lower() for n, c in classes)
    doc["has_date_markup"] = any(n.tag == "time" and "datetime" in n.attrs or n.attrs.get("itemprop") == "datePublished" or n.tag == "meta" and n.attrs.get("property") == "article:published_time" for n in marked)
    doc["text_issues"] = text_issues(paragraphs)

    sections = []
    for n in e.tags("h2"):
        own = takewhile(lambda after: after.tag not in ("h1", "h2"), n.next_elements())
        sections.append({"heading": clean(n.text()), "words": sum(word_count(after.text()) for after in own)})
    doc["sections"] = sections
    doc["item_texts"] = [t for n in e.tags("li", "td", "th", "dd", "figcaption") if 0 < len(t := clean(n.text())) <= 400]
    doc["blockquotes"] = [clean(n.text()) for n in e.tags("blockquote")]
    doc["inline_quotes"] = sum(not any(p.tag == "blockquote" for p in n.ancestors()) for n in e.tags("q"))
    doc["script_count"] = len(e.tags("script"))
    doc["spa_root"] = any(n.attrs.get("id") in SPA_IDS or {"data-reactroot", "ng-app", "data-server-rendered"} & n.attrs.keys() for n in marked)
    item_date = next((n.attrs.get("content", "") for n in marked if n.attrs.get("itemprop") == "dateModified"), "")
    doc["markup_date"] = meta("property", "article:modified_time") or item_date or next((n.attrs["datetime"] for n in e.tags("time") if "datetime" in n.attrs), "") or None
    doc["main_or_article"] = bool(e.tags("main") or e.tags("article"))
    return doc


def models(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The models of batches of (html, url), some pages at a time, so that memory doesn't grow with the rows of a batch."""
    arrow = to_arrow_type(DOC)
    for html, url in batches:
        rows, held = [], 0
        for h, u in zip(html, url):
            source = h.as_py() or ""
            rows.append(extract(source, u.as_py() or ""))
            held += len(source)
            if len(rows) == PIECE_PAGES or held > PIECE_CHARACTERS:
                yield pa.array(rows, arrow)
                rows, held = [], 0
        if rows:
            yield pa.array(rows, arrow)


def extract_documents(captures: DataFrame) -> DataFrame:
    """Adds ``doc`` (fields of ``DOC``) to captures (url, html, ...): row-wise, only url and html go to Python.

    A null html counts as empty; a null url as one that resolves nothing.
    """
    model = F.arrow_udf(models, DOC)
    return captures.withColumn("doc", model(F.col("html").cast("string"), F.col("url").cast("string")))


# -- derived fields: native expressions over the model ---------------------------------------------------------------


def skipped_levels(headings: Column) -> Column:
    """Headings more than one level below the one before: struct(from, to, text)."""
    pairs = F.transform(headings, lambda h, i: F.struct(F.when(i > 0, F.element_at(headings, i)["level"]).alias("from"), h["level"].alias("to"), h["text"].alias("text")))
    return F.filter(pairs, lambda p: p["to"] > p["from"] + 1)


def duplicate_anchors(internal: Column) -> Column:
    """Anchor texts that lead to several pages: struct(anchor, count, targets), most used first."""
    named = F.filter(internal, lambda x: x["anchor"] != "")
    keys = F.array_distinct(F.transform(named, lambda x: F.lower(x["anchor"])))
    groups = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("anchor"),
            F.size(F.filter(named, lambda x: F.lower(x["anchor"]) == k)).alias("count"),
            F.size(F.array_distinct(F.transform(F.filter(named, lambda x: F.lower(x["anchor"]) == k), lambda x: F.regexp_replace(F.split_part(x["href"], F.lit("#"), F.lit(1)), "/$", "")))).alias("targets"),
        ),
    )
    return F.array_sort(F.filter(groups, lambda g: (g["count"] > 1) & (g["targets"] > 1)), lambda a, b: b["count"] - a["count"])


def with_derived(docs: DataFrame) -> DataFrame:
    """Adds ``x``: what follows from the model ``doc``, for rules and views."""
    body, main = F.col("doc.body_text"), F.col("doc.main_text")
    first = docs.withColumn("tokens", tx.tokens(body)).withColumn("main_tokens", F.when(main == body, F.col("tokens")).otherwise(tx.tokens(main)))
    return first.withColumn("x", built_once(docs.sparkSession, "derived", _derived)).drop("tokens", "main_tokens")


def _derived() -> Column:
    """Over doc, and tokens of its body text and main text."""
    d = F.col("doc")
    main = d["main_text"]
    images = F.filter(d["media"], lambda m: m["tag"] == "img")
    content = F.filter(images, lambda m: ~m["decorative"])
    has_alt = lambda m: F.coalesce(F.trim(m["alt"]), F.lit("")) != ""
    links = F.concat(d["internal"], d["external"])
    paragraph_keys = F.filter(F.transform(d["paragraphs"], tx.paragraph_key), lambda k: k != "")
    t, sentence_count = F.col("tokens"), F.size(tx.sentences_of_clean(main))
    return F.struct(
        F.size(t).alias("word_count"),
        tx.stop_word_percent(t).alias("stop_percent"),
        tx.language_of(F.col("main_tokens")).alias("language"),
        sentence_count.alias("sentence_count"),
        (F.size("main_tokens") / F.greatest(F.lit(1), sentence_count)).alias("sentence_words"),
        F.size(tx.repeated(paragraph_keys)).alias("duplicate_paragraphs"),
        F.filter(d["headings"], lambda h: h["level"] == 1).alias("h1s"),
        skipped_levels(d["headings"]).alias("skipped_levels"),
        F.size(F.filter(d["headings"], lambda h: h["text"] == "")).alias("empty_headings"),
        images.alias("images"),
        content.alias("content_images"),
        F.size(F.filter(images, lambda m: m["alt"].isNull())).alias("images_missing_alt"),
        F.size(F.filter(images, has_alt)).alias("images_with_alt"),
        F.size(F.filter(images, lambda m: m["loading"] == "lazy")).alias("lazy_images"),
        F.size(F.filter(images, lambda m: m["width"].isNotNull() & m["height"].isNotNull())).alias("sized_images"),
        F.size(F.filter(links, lambda a: ~a["has_anchor_text"])).alias("anchorless"),
        duplicate_anchors(d["internal"]).alias("duplicate_anchors"),
        F.size(F.filter(links, lambda a: F.char_length(a["anchor"]) > 100)).alias("long_anchors"),
        F.size(F.filter(d["internal"], lambda a: F.exists(a["params"], lambda p: ~F.regexp_like(p, F.lit(TRACKING_LINKS))))).alias("dynamic_internal"),
        F.size(F.filter(d["internal"], lambda a: F.exists(a["params"], lambda p: F.regexp_like(p, F.lit(SESSION_PARAMS))))).alias("session_links"),
        F.size(F.filter(d["external"], lambda a: (a["target"] == "_blank") & ~F.regexp_like(a["rel"], F.lit("noopener|noreferrer")))).alias("unsafe_targets"),
        F.array_distinct(F.filter(F.transform(d["external"], lambda a: a["href"]), lambda h: _social(h))).alias("social_profiles"),
        F.array_distinct(F.filter(F.transform(d["external"], lambda a: a["href"]), lambda h: F.regexp_like(h, F.lit(SHARE_LINKS)))).alias("share_links"),
        F.regexp_like(d["body_text"], F.lit(PLACEHOLDER_TEXT)).alias("has_placeholder_text"),
        F.size(F.filter(d["media"], lambda m: F.regexp_like(m["src"], F.lit(PLACEHOLDER_IMAGE)))).alias("placeholder_images"),
        tx.content_hash(F.size(t), d["paragraphs"]).alias("content_hash"),
    )


def _social(href: Column) -> Column:
    h = F.regexp_extract(F.lower(href), r"^https?://(?:www\.)?([^/?#:]+)", 1)
    social = F.array(*[F.lit(s) for s in SOCIAL_HOSTS])
    return F.exists(social, lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s)))
