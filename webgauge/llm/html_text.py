"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted for the share of linked characters; a node's density sum is that
of its children.  The node with the largest sum holds the article; the least density on its path to body is the
threshold by which subtrees off that path belong to it.  Where the page itself marks an article around that node, all of
that element is taken.

Parts that markup names as something else (navigation, adverts, forms, comments, ...) are left out beforehand.  Headings
and running text never go by a name; a container goes by a class that only such parts have, by one that may also tell what
a part is about (menu, tags, related, ...) or by an id only where it holds no prose of its own or stands outside a marked
article, and not by an id made of its own heading.  A name alone never empties a page: of parts that would take all prose
with them, the one that holds most is opened again.
"""

from __future__ import annotations

import bisect
import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img"
    " math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements whose start ends an open paragraph, by the HTML standard.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: start tag -> (open elements that it ends, elements beyond which it doesn't look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
}
CELLS = frozenset(("td", "th"))
TABLE_ENDS = frozenset("td th tr table tbody thead tfoot".split())
IN_HEAD = frozenset("head base link meta noscript script style template title".split())
SCOPE = frozenset("table td th caption button object template".split())
#: Never text of an article.
NO_TEXT = frozenset("annotation annotation-xml script style noscript template head title svg iframe frame noframes noembed object applet embed canvas audio video map textarea select option button input datalist".split())
#: Parts that say by their tag that they are something else; only those in WRAPPERS may also hold a whole page.
ASIDE = frozenset("nav aside footer menu dialog search".split())
WRAPPERS = frozenset("form fieldset legend label".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
COMMENT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|responses|reactions|talkback|guestbook"
    r"|(?:user|reader|visitor|member|guest)s?[_-]?(?:responses?|comments?|posts?|feedback|reviews?|opinions?|voices|reactions?|remarks?|thoughts|discussions?))(?=$|[\s_-])",
    re.I,
)
#: Names of comments that headings of articles give, too.
MAYBE_COMMENTS = re.compile(r"(?:^|[\s_-])(?:reply|respond|discussions?|feedback)(?=$|[\s_-])", re.I)
COMMENT_HEADING = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:reader|user|visitor)s?['’]?s?\s+)?(?:comments?|responses?|replies)\W*\d*\W*|(?:leave|post|add|write) a (?:comment|reply|response)\b.*|join the (?:discussion|conversation)\b.*", re.I
)
#: Names that only parts beside the article have.
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|container|wrapper)|adverts?|advertis\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|disclaimer|popup|modal|overlay|newsletter|subscri\w*|signup|login|paywall"
    r"|sidebar|(?:left|right)(?:bar|rail)|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|pagination|pager|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
#: Names that also tell what a part of an article is about.
TOPIC_NAMES = re.compile(r"(?:^|[\s_-])(?:side|menu|shar(?:e|ing)|social|follow|related|recommend\w*|widgets?|skip|copyright|tags)(?=$|[\s_-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?=$|[\s_-])", re.I)
#: Names that tell of a part elsewhere or of a state, as has-sidebar or comments-closed on a page's wrapper.
ABOUT_OTHERS = re.compile(r"(?<!\S)(?:(?:has|with|no|without|is)[_-]\S+|\S+[_-](?:open|opened|closed|on|off|enabled|disabled|none))(?!\S)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: none of them is an article by itself, and beside an article they belong to it.
TEXT = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr hr".split())
#: Fewer words than these outside of all left-out parts, or fewer characters than this share of one, are little prose.
PROSE_WORDS, PROSE_SHARE = 8, 0.1
#: Of the characters of a part: from this share of linked ones on it is a list of links.
LINKED = 0.5
#: Characters of a block of unlinked text from which on it is prose.
PROSE_RUN = 80
#: Elements that go by name only as lists of links.
LISTS = frozenset("ul ol dl table".split())

TAKEN, ASIDE_PART, WRAPPER_PART, COMMENTS = range(4)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "part", "chars", "tags", "link_chars", "link_tags", "article_chars", "paragraphs", "titles", "longest", "run", "density", "total", "depth")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.attrs)} if self.attrs else {}

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


class Stack:
    """Open elements, with the places of each tag and of the elements that end tags don't look beyond."""

    def __init__(self) -> None:
        self.nodes = [Node("#body", "", None)]
        self.open: dict[str, list[int]] = {}
        self.blocks, self.cells, self.scopes = [0], [0], [0]

    def add(self, child: Node | str) -> None:
        self.nodes[-1].children.append(child)

    def push(self, node: Node) -> None:
        self.add(node)
        at = len(self.nodes)
        self.nodes.append(node)
        self.open.setdefault(node.tag, []).append(at)
        for places in self._bounds(node.tag):
            places.append(at)

    def _bounds(self, tag: str):
        if tag not in INLINE:
            yield self.blocks
        if tag in CELLS:
            yield self.cells
        if tag in SCOPE:
            yield self.scopes

    def cut(self, at: int) -> None:
        """Close the element at this place and all in it."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.open[tag].pop()
            for places in self._bounds(tag):
                places.pop()

    def last(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at and not (tag in INLINE and self.blocks[-1] > at) and not (tag not in TABLE_ENDS and self.cells[-1] > at):
            self.cut(at)

    def imply_ends(self, tag: str) -> None:
        """Close what the start of this tag ends."""
        if tag not in IN_HEAD and self.last("head"):
            self.cut(self.last("head"))
        if tag in ENDS_P:
            if self.last("p") > self.scopes[-1]:
                self.cut(self.last("p"))
            if tag in HEADINGS and self.nodes[-1].tag in HEADINGS:
                self.cut(len(self.nodes) - 1)
        elif tag in IMPLIED:
            ended, bound = IMPLIED[tag]
            beyond = max(map(self.last, bound))
            places = [self.open[t][k] for t in ended if t in self.open and (k := bisect.bisect(self.open[t], beyond)) < len(self.open[t])]
            if places:
                self.cut(min(places))
        elif tag == "a" and self.last("a") > self.blocks[-1]:
            self.cut(self.last("a"))


def parse(source: str) -> Node:
    """A lenient tree below one body: void and raw-text elements, implied end tags, stray end tags ignored."""
    stack, at, n = Stack(), 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = source[at:lt]
            if stack.nodes[-1].tag == "head" and not text.isspace():
                stack.cut(stack.last("head"))
            stack.add(text)
        if lt == n:
            break
        m = TAG.match(source, lt) or LOOSE_TAG.match(source, lt)
        if not m:
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif source[lt + 1 : lt + 2] in ("!", "?") or source.startswith("</", lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            elif source[lt + 1 : lt + 2].isalpha():
                break  # the page ends inside a tag
            else:
                stack.add("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if tag in ("html", "body", "frameset"):  # whatever is in a page is in its body
            if not m[1] and tag != "html":
                stack.imply_ends(tag)
            continue
        if m[1] and tag != "br":
            stack.end(tag)
            continue
        stack.imply_ends(tag)
        node = Node(tag, m[3], stack.nodes[-1])
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "circle", "rect", "use"):
            stack.add(node)
        elif tag in RAW:
            stack.add(node)
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else n
            node.children.append(source[at:stop])
            close = source.find(">", stop)
            at = n if close < 0 else close + 1
        else:
            stack.push(node)
    return stack.nodes[0]


def in_order(root: Node) -> list[Node]:
    """Every node of the subtree, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.elements())
    return order


def heading_in(node: Node) -> str | None:
    """The text of the heading that a part begins with."""
    for _ in range(4):
        first = next((c for c in node.children if not isinstance(c, str) or c.strip()), None)
        if first is None or isinstance(first, str):
            return None
        if first.tag in HEADINGS:
            return " ".join(html.unescape("".join(_texts(first))).split())
        node = first
    return None


def _texts(node: Node) -> Iterator[str]:
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += reversed(x.children)


def made_of_heading(ident: str, heading: str | None) -> bool:
    """Whether an id is that of a heading, as generators of pages write it, perhaps numbered."""
    slug = lambda t: re.sub(r"[\W_]+", "-", t.lower()).strip("-")
    return heading is not None and slug(heading) in (slug(ident), re.sub(r"-\d+$", "", slug(ident)))


def named_part(node: Node, in_article: bool) -> int:
    """What markup says a node is; counts of its text must be known."""
    if node.tag in ASIDE or node.tag == "header" and not in_article:
        return ASIDE_PART
    part = WRAPPER_PART if node.tag in WRAPPERS else TAKEN
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
        return WRAPPER_PART
    if a.get("role", "").strip().lower() in ASIDE_ROLES:
        return WRAPPER_PART
    if node.tag in INLINE or node.tag in TEXT and node.tag not in LISTS:
        return part
    names, ident = ABOUT_OTHERS.sub(" ", a.get("class", "")), ABOUT_OTHERS.sub(" ", a.get("id", ""))
    heading = heading_in(node)
    if COMMENT_NAMES.search(names) or COMMENT_NAMES.search(ident) or "comment" in f"{a.get('itemprop', '')} {a.get('itemtype', '')}".lower().replace("/", " ").split():
        return COMMENTS
    if MAYBE_COMMENTS.search(names) or MAYBE_COMMENTS.search(ident) and not made_of_heading(ident, heading):
        return COMMENTS
    if node.tag in ARTICLES:
        return part
    if heading is not None and COMMENT_HEADING.fullmatch(heading) and node.tag not in LISTS:
        return COMMENTS
    links = bool(node.chars) and _is_links(node)
    if node.tag in LISTS:
        return WRAPPER_PART if links and any(r.search(n) for r in (ASIDE_NAMES, TOPIC_NAMES) for n in (names, ident)) else part
    if ASIDE_NAMES.search(names) or not in_article and HEADER_NAMES.search(f"{names} {ident}"):
        return WRAPPER_PART
    own = made_of_heading(ident, heading)
    if ASIDE_NAMES.search(ident) and not own:
        return WRAPPER_PART
    prose = in_article and not links and node.longest >= PROSE_RUN
    if not prose and (TOPIC_NAMES.search(names) or TOPIC_NAMES.search(ident) and not own):
        return WRAPPER_PART
    return part


def prune(root: Node) -> None:
    """Take out what has no text, and the parts that markup names as other than the article.

    Where that leaves no marked article, a part that holds one with more text than is left is opened, and only what is
    named inside it goes.  Where it leaves no prose either, so is the part with most text (readers' comments last) if it is laid out as an article:
    in several paragraphs, or below a title where there is some text outside.
    """
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in NO_TEXT]
        todo += node.elements()
    order = in_order(root)
    _count(order)
    _longest(order)
    marked: list[tuple[Node, bool, Node | None]] = [(root, False, None)]
    while marked:
        node, inside, article_of = marked.pop()
        node.part = named_part(node, inside) if node is not root else TAKEN
        if node.tag == "article" and node.part == TAKEN:
            # an article within an article is a comment on it, unless it holds most of it
            if article_of is not None and 2 * node.chars < article_of.chars:
                node.part = COMMENTS
            article_of = node
        inside = inside or node.tag in ARTICLES
        marked += [(c, inside, article_of) for c in node.elements()]
    for node in reversed(order):
        inner = sum(c.article_chars for c in node.elements())
        node.article_chars = max(inner, node.chars - node.link_chars) if node.tag in ARTICLES and node.part != COMMENTS else inner
        node.paragraphs = sum(c.paragraphs for c in node.elements()) + (node.tag == "p" or node.tag in HEADINGS)
        node.titles = sum(c.titles for c in node.elements()) + (node.tag in ("h1", "h2"))
    words = chars = 0
    article = False
    parts: list[Node] = []

    def open_part(top: Node) -> None:
        nonlocal words, chars, article
        todo = [(top, False)]
        while todo:
            node, heading = todo.pop()
            if node.part != TAKEN and node is not top:
                parts.append(node)
                continue
            article = article or node.tag in ARTICLES
            if node.tag == "a":
                continue
            heading = heading or node.tag in HEADINGS
            for c in node.children:
                if not isinstance(c, str):
                    todo.append((c, heading))
                elif not heading:
                    own = c.split()
                    words += len(own)
                    chars += sum(map(len, own))

    def unlinked(node: Node) -> int:
        return node.chars - node.link_chars

    open_part(root)
    heap: list = []
    seen = 0  # numbers the parts, so that equal ones keep page order
    while not article:
        for node in parts[seen:]:
            if unlinked(node) and (node.part != ASIDE_PART or node.article_chars):
                heapq.heappush(heap, (-node.article_chars, node.part == COMMENTS, -unlinked(node), seen, node))
            seen += 1
        if not heap:
            break
        best = heap[0][-1]
        little = words < PROSE_WORDS or best.part != COMMENTS and chars < PROSE_SHARE * unlinked(best)
        heapq.heappop(heap)
        if not (best.article_chars > chars or not words and best.paragraphs > 1 or little and best.titles):
            continue
        best.part = TAKEN
        open_part(best)
    for node in order:
        node.children = [c for c in node.children if isinstance(c, str) or c.part == TAKEN]


def _longest(order: list[Node]) -> None:
    """Characters of the longest block of unlinked text in every subtree."""
    for node in reversed(order):
        run = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        longest = 0
        for c in node.elements():
            if c.tag in INLINE:
                run += 0 if c.tag == "a" else c.run
            longest = max(longest, c.longest)
        node.run, node.longest = run, 0 if node.tag == "a" else max(run, longest)


def _count(order: list[Node]) -> None:
    """Characters and tags of every subtree, in all and in links; white space isn't counted."""
    for node in reversed(order):
        chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        tags = link_chars = link_tags = 0
        for c in node.elements():
            chars += c.chars
            tags += c.tags + 1
            link_chars += c.chars if c.tag == "a" else c.link_chars
            link_tags += c.link_tags + (c.tag == "a")
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags


def measure(body: Node) -> list[Node]:
    """Density and density sum of every node; nodes with parents before children."""
    order = in_order(body)
    _count(order)
    linked = body.link_chars / max(1, body.chars)
    for node in order:
        node.depth = 0 if node is body else node.parent.depth + 1
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
            continue
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + linked * c + math.e)
        node.density = c / t * math.log(max(1.0, c / lc * t / lt), base) if base > 1 else c / t * math.log(max(1.0, c / lc * t / lt))
        if node.density <= 0 and c > node.link_chars:
            node.density = 1e-9
    for node in order:
        node.total = sum(c.density for c in node.elements())
    return order


def densest(body: Node) -> tuple[Node, float]:
    """(the node of largest density sum, the deepest of equals; the least density on its path to body), once measured."""
    order = measure(body)
    target = max(order, key=lambda n: (n.total, n.depth))
    return target, min(n.density for n in _path(target))


def _path(node: Node):
    while node is not None:
        yield node
        node = node.parent


def _is_links(node: Node) -> bool:
    return node.link_chars >= LINKED * node.chars


def titles_before(article: Node) -> list[Node]:
    """The headings, and the running text after them, that stand before an article in its ``main``."""
    path = list(_path(article))
    within = next((k for k, n in enumerate(path) if n.tag == "main"), 0)
    out: list[Node] = []
    for inner, outer in zip(path[:within], path[1:]):
        before: list[Node] = []
        for c in outer.elements():
            if c is inner:
                break
            if c.tag == "article":  # what stands before another article is that one's
                before.clear()
            elif c.tag in HEADINGS or before and c.tag == "p" and not _is_links(c):
                before.append(c)
            elif c.tag in ("header", "hgroup"):
                before += [n for n in in_order(c) if n.tag in HEADINGS]
        out = before + out
    return out


def select(body: Node) -> tuple[list[Node], bool]:
    """(subtrees of the article in page order, whether an article element beyond the densest node decided).

    Without such an element: the densest node, or the element that its list or table stands in; subtrees off its path
    to body whose density reaches the threshold; headings before it; and, below body, running text beside the path.
    """
    target, threshold = densest(body)
    if not body.chars:
        return [], False
    if target.total <= 0:
        return [body], False
    for node in _path(target):
        if node.tag in ARTICLES:
            return [*titles_before(node), node], node is not target
    while target is not body and (target.tag in TEXT or target.tag in INLINE):
        target = target.parent
    if target is body:
        return [c for c in body.children if isinstance(c, str) or not (c.link_tags > 1 and _is_links(c))], False
    on_path = {id(n) for n in _path(target)}
    chosen: list[Node] = []
    todo = [(body, False)]
    while todo:
        node, off = todo.pop()
        if node is target:
            chosen.append(node)
        elif off:
            chosen.append(node)
        else:
            before, rest = True, []
            for c in node.elements():
                if id(c) in on_path:
                    before = False
                    rest.append((c, False))
                elif c.density >= threshold or not _is_links(c) and (c.tag in HEADINGS and before or node is not body and c.tag in TEXT):
                    rest.append((c, True))
            todo += reversed(rest)
    return chosen, False


def blocks(nodes: list[Node | str]) -> list[str]:
    """Text blocks in page order: runs of text between block elements, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in ("br", "wbr", "img"):
            run.append(" " if x.tag == "br" else "")
        else:
            inline = x.tag in INLINE
            if not inline:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def main_text(source: str | None) -> str:
    """The article of a page: blocks joined by an empty line; empty if there is none."""
    if not source:
        return ""
    body = parse(source)
    prune(body)
    return "\n\n".join(blocks(select(body)[0]))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row.

    A null html counts as empty and gives an empty text; null ids and urls are kept; repeated rows give repeated
    results; other columns aren't read; an empty table gives an empty result.  A page of any length or nesting is read
    whole, in time in proportion to its length.  Row-wise: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
