"""HTML tree construction by the HTML standard's rules that matter for scoring.

Implied html, head and body; implied end tags; raw text; reconstruction of active formatting elements and the adoption
agency for misnested ones; the table modes, with implied sections and rows, and what doesn't belong in a table moved
before it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre listing search section summary table ul xmp plaintext h1 h2 h3 h4 h5 h6".split())
BLOCK_END = CLOSES_P - {"hr", "p", "table", "xmp", "plaintext"} | {"button"} - {"h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = CLOSES_P | VOID | SCOPE | frozenset("body button colgroup frame frameset head iframe li dd dt noembed noframes noscript script select style tbody textarea tfoot thead title tr".split())
SECTIONS, CELLS = frozenset({"tbody", "tfoot", "thead"}), frozenset({"td", "th"})
TABLE_PARTS = SECTIONS | CELLS | {"caption", "col", "colgroup", "tr"}
#: Where text and most elements don't belong; they go before the table.
NO_CONTENT = SECTIONS | {"table", "tr"}
#: The innermost of these that is open says which rules hold.
MODES = dict.fromkeys(SECTIONS, "section") | dict.fromkeys(CELLS, "cell") | {"tr": "row", "caption": "caption", "colgroup": "colgroup", "table": "table", "template": "template"}
WHITE = " \t\n\f\r"
#: Beginnings of public identifiers of document types under which a table doesn't end a paragraph.
OLD_DOCTYPE = re.compile(r"(?i)<!doctype\s+html\s+public\s+[\"'](-//w3c//dtd html (3|4\.0 )|-//ietf//|-//w3o//|-//netscape|-//microsoft|-//w3c//dtd html 4\.01 (frameset|transitional)//[^\"']*[\"']\s*>)")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None" = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def add(self, child: "Node | str") -> None:
        if isinstance(child, Node):
            if child.parent is not None:
                child.parent.children = [c for c in child.parent.children if c is not child]
            child.parent = self
            self.children.append(child)
        elif self.children and isinstance(self.children[-1], str):
            self.children[-1] += child
        else:
            self.children.append(child)

    def add_before(self, child: "Node | str", mark: "Node") -> None:
        """Put a child before another of this node; text joins the text that is there."""
        if isinstance(child, Node) and child.parent is not None:
            child.parent.children = [c for c in child.parent.children if c is not child]
        at = next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is mark)
        if isinstance(child, Node):
            child.parent = self
            self.children.insert(at, child)
        elif at and isinstance(self.children[at - 1], str):
            self.children[at - 1] += child
        else:
            self.children.insert(at, child)

    def walk(self):
        """Descendant elements in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, skip=None) -> str:
        """Text of the subtree without separators; ``skip(node)`` leaves subtrees out."""
        out: list[str] = []
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif skip is None or not skip(n):
                todo += reversed(n.children)
        return "".join(out)

    def next_elements(self) -> "Iterator[Node]":
        """The elements that follow among those of the same parent."""
        siblings = iter(self.parent.children if self.parent else [])
        next((c for c in siblings if c is self), None)
        return (c for c in siblings if isinstance(c, Node))

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        name = m[1].lower()
        if name not in out:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
            out[name] = html.unescape(value) if value and "&" in value else value or ""
    return out


class Builder:
    def __init__(self) -> None:
        self.document = Node("#document", {})
        self.html = Node("html", {})
        self.document.add(self.html)
        self.head = Node("head", {})
        self.body: Node | None = None
        self.html.add(self.head)
        self.stack: list[Node] = [self.html]
        self.active: list[Node | None] = []  # None marks a scope
        self.in_head = True
        self.quirks = False  # an old document type; a page without one is read like a current one
        self.tables = False  # whether a table or template was opened at all
        self.fostering = False
        self.form: Node | None = None

    def open_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.body = Node("body", attrs or {})
            self.html.add(self.body)
            self.stack = [self.html, self.body]
            self.in_head = False

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def in_scope(self, tags, more=frozenset()) -> bool:
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in SCOPE or n.tag in more:
                return False
        return False

    def implied_ends(self, but: str = "") -> None:
        while self.top.tag in IMPLIED_END and self.top.tag != but:
            self.stack.pop()

    def pop_to(self, tags) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope({"p"}, {"button"}):
            self.implied_ends("p")
            self.pop_to({"p"})

    def insert(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.place(node, self.top)
        self.tables = self.tables or tag in ("table", "template")
        if tag not in VOID:
            self.stack.append(node)
        return node

    def place(self, child: Node | str, parent: Node) -> None:
        """Add a child, or put it before the innermost table where ``parent`` may not hold it."""
        if not self.fostering or parent.tag not in NO_CONTENT:
            parent.add(child)
            return
        for k in range(len(self.stack) - 1, -1, -1):
            n = self.stack[k]
            if n.tag == "template":
                n.add(child)
                return
            if n.tag == "table":
                if n.parent is not None:
                    n.parent.add_before(child, n)
                else:
                    self.stack[k - 1].add(child)
                return
        self.html.add(child)

    def mode(self) -> str:
        if self.tables:
            for n in reversed(self.stack):
                if n.tag in MODES:
                    return MODES[n.tag]
        return "body"

    def in_table_scope(self, tags) -> bool:
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in ("html", "table", "template"):
                return False
        return False

    def back_to(self, *tags: str) -> None:
        """Close what is open in a part of a table."""
        while self.top.tag not in tags and self.top.tag not in ("template", "html", "body"):
            self.stack.pop()

    def end_part(self, *tags: str) -> None:
        self.back_to(*tags)
        if self.top.tag in tags:
            self.stack.pop()

    def end_cell(self, *tags: str) -> None:
        """Close a cell or caption and the formatting opened in it."""
        self.implied_ends()
        self.pop_to(set(tags))
        self.clear_to_marker()

    def table_start(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        """What the table modes do with a start tag; False leaves it to the rules of the body."""
        while True:
            mode = self.mode()
            if mode == "body":
                return False
            if mode == "template":
                if tag not in TABLE_PARTS or self.top.tag != "template":
                    return False
                self.insert(tag, attrs)
                if tag in CELLS or tag == "caption":
                    self.active.append(None)
                return True
            if mode in ("cell", "caption"):
                if tag not in TABLE_PARTS:
                    return False
                self.end_cell(*(CELLS if mode == "cell" else ("caption",)))
                continue
            if mode == "colgroup":
                if tag == "template":
                    return False
                if tag == "col":
                    self.insert(tag, attrs)
                    return True
                if self.top.tag != "colgroup":
                    return True
                self.stack.pop()
                continue
            if tag in TABLE_PARTS:
                if mode == "row":
                    if tag not in CELLS:
                        self.end_part("tr")
                        continue
                    self.back_to("tr")
                elif mode == "section":
                    if tag in CELLS:
                        self.back_to(*SECTIONS)
                        self.insert("tr", {})
                        continue
                    if tag != "tr":
                        self.end_part(*SECTIONS)
                        continue
                    self.back_to(*SECTIONS)
                else:
                    self.back_to("table")
                    if tag in CELLS or tag == "tr":
                        self.insert("tbody", {})
                        continue
                    if tag == "col":
                        self.insert("colgroup", {})
                        continue
                self.insert(tag, attrs)
                if tag in CELLS or tag == "caption":
                    self.active.append(None)
                return True
            if tag == "table":
                self.pop_to({"table"})
                continue
            if tag in ("script", "style", "template"):
                return False
            if tag == "input" and attrs.get("type", "").lower() == "hidden":
                self.insert(tag, attrs)
                return True
            if tag == "form":
                if self.form is None and not any(n.tag == "template" for n in self.stack):
                    self.form = self.insert(tag, attrs)
                    self.stack.pop()
                return True
            self.fostering = True
            self.body_start(tag, attrs, closed)
            self.fostering = False
            return True

    def table_end(self, tag: str) -> bool:
        """What the table modes do with an end tag; False leaves it to the rules of the body."""
        outer = SECTIONS | {"table", "tr"}
        while True:
            mode = self.mode()
            if mode in ("body", "template"):
                return False
            if mode in ("cell", "caption"):
                own = CELLS if mode == "cell" else {"caption"}
                if tag in own:
                    if self.in_table_scope({tag}):
                        self.end_cell(tag)
                    return True
                if tag in (outer if mode == "cell" else {"table"}):
                    if not self.in_table_scope({tag}):
                        return True
                    self.end_cell(*own)
                    continue
                return tag in TABLE_PARTS
            if mode == "colgroup":
                if tag == "template":
                    return False
                if tag == "col" or self.top.tag != "colgroup":
                    return True
                self.stack.pop()
                if tag == "colgroup":
                    return True
                continue
            if mode == "row" and tag in outer:
                if not self.in_table_scope({tag}):
                    return True
                self.end_part("tr")
                if tag == "tr":
                    return True
                continue
            if mode == "section" and tag in outer - {"tr"}:
                if tag != "table" and not self.in_table_scope({tag}):
                    return True
                self.end_part(*SECTIONS)
                if tag != "table":
                    return True
                continue
            if tag == "table":
                self.pop_to({"table"})
                return True
            if tag in TABLE_PARTS:
                return True
            if tag == "template":
                return False
            self.fostering = True
            self.body_end(tag)
            self.fostering = False
            return True

    def reconstruct(self) -> None:
        """Open again the formatting elements that a block end closed."""
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.insert(old.tag, dict(old.attrs))

    def push_active(self, node: Node) -> None:
        same = 0
        for k in range(len(self.active) - 1, -1, -1):
            n = self.active[k]
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[k]
                    break
        self.active.append(node)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency algorithm for the end tag of a formatting element."""
        if self.top.tag == tag and self.active and self.active[-1] is self.top:  # nothing else is open in it
            self.stack.pop()
            self.active.pop()
            return
        if self.top.tag == tag and self.top not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            element = next((n for n in reversed(self.active[self._after_marker() :]) if n.tag == tag), None)
            if element is None:
                self.other_end(tag)
                return
            if element not in self.stack:
                self.active.remove(element)
                return
            if not self._node_in_scope(element):
                return
            at = self.stack.index(element)
            furthest = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(element)
                return
            common = self.stack[at - 1]
            bookmark = self.active.index(element)
            node_at = self.stack.index(furthest)
            last = furthest
            inner = 0
            while True:
                inner += 1
                node_at -= 1
                node = self.stack[node_at]
                if node is element:
                    break
                if inner > 3 and node in self.active:
                    if self.active.index(node) < bookmark:
                        bookmark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                clone = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = clone
                self.stack[node_at] = clone
                if last is furthest:
                    bookmark = self.active.index(clone) + 1
                clone.add(last)
                last = clone
            self.place(last, common)
            clone = Node(element.tag, dict(element.attrs))
            for c in list(furthest.children):
                if isinstance(c, Node):
                    clone.add(c)
                else:
                    clone.children.append(c)
            furthest.children = []
            furthest.add(clone)
            if self.active.index(element) < bookmark:
                bookmark -= 1
            self.active.remove(element)
            self.active.insert(bookmark, clone)
            self.stack.remove(element)
            self.stack.insert(self.stack.index(furthest) + 1, clone)

    def _after_marker(self) -> int:
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                return k + 1
        return 0

    def _node_in_scope(self, node: Node) -> bool:
        for n in reversed(self.stack):
            if n is node:
                return True
            if n.tag in SCOPE:
                return False
        return False

    def other_end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 1, -1):
            n = self.stack[k]
            if n.tag == tag:
                self.implied_ends(tag)
                if n in self.stack:
                    del self.stack[self.stack.index(n) :]
                return
            if n.tag in SPECIAL:
                return

    def text(self, value: str) -> None:
        if self.body is None:
            if self.top.tag in RAW or self.top.tag in ("noscript", "template"):
                self.top.add(value)
                return
            if not value.strip(WHITE):
                return
            self.open_body()
            value = value.lstrip(WHITE)
        if self.top.tag == "colgroup":
            rest = value.lstrip(WHITE)
            if len(rest) < len(value):
                self.top.add(value[: len(value) - len(rest)])
            if not rest:
                return
            self.stack.pop()
            value = rest
        if self.top.tag in NO_CONTENT:
            if not value.strip(WHITE):
                self.top.add(value)
                return
            self.fostering = True
        self.reconstruct()
        self.place(value, self.top)
        self.fostering = False

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag == "head":
                self.head.attrs.update(attrs)
                return
            if tag == "body":
                self.open_body(attrs)
                return
            if tag == "frameset":
                self.open_body()
            elif tag in HEAD_ONLY or self.top.tag in ("noscript", "template"):
                if self.top is self.html:
                    self.head.add(node := Node(tag, attrs))
                    if tag not in VOID:
                        self.stack.append(node)
                else:
                    self.insert(tag, attrs)
                return
            else:
                self.open_body()
        if tag in ("head",):
            return
        if tag == "body":
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if not self.table_start(tag, attrs, closed):
            self.body_start(tag, attrs, closed)

    def body_start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in TABLE_PARTS or tag == "frame":
            return
        if tag == "form":
            templated = any(n.tag == "template" for n in self.stack)
            if self.form is not None and not templated:
                return
            self.close_p()
            node = self.insert(tag, attrs)
            if not templated:
                self.form = node
            return
        if tag in HEAD_ONLY and tag not in ("noscript",):
            self.insert(tag, attrs)
            if tag == "template":
                self.active.append(None)
            return
        if tag in CLOSES_P:
            if tag != "table" or not self.quirks:
                self.close_p()
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.stack.pop()
        elif tag == "li" or tag in ("dd", "dt"):
            for n in reversed(self.stack):
                if n.tag == tag or tag != "li" and n.tag in ("dd", "dt"):
                    self.implied_ends(n.tag)
                    self.pop_to({n.tag})
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag == "button" and self.in_scope({"button"}):
            self.implied_ends()
            self.pop_to({"button"})
        elif tag == "a":
            old = next((n for n in self.active[self._after_marker() :] if n.tag == "a"), None)
            if old is not None:
                self.adopt("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
        elif tag == "nobr" and self.in_scope({"nobr"}):
            self.reconstruct()
            self.adopt("nobr")
        elif tag in ("option", "optgroup") and self.top.tag == "option":
            self.stack.pop()
        if tag in FORMATTING:
            self.reconstruct()
            self.push_active(self.insert(tag, attrs))
            return
        if tag not in CLOSES_P and tag not in ("li", "dd", "dt", "hr", "param", "source", "track", "optgroup", "frameset", "frame"):
            self.reconstruct()
        node = self.insert("img" if tag == "image" else tag, attrs)
        if tag in ("applet", "marquee", "object"):
            self.active.append(None)
        if closed and tag in ("svg", "path", "circle", "rect", "use", "g", "line", "polygon", "polyline", "ellipse") and self.top is node:
            self.stack.pop()

    def end(self, tag: str) -> None:
        if self.body is None:
            if self.top is not self.html and self.top.tag == tag:
                self.stack.pop()
            elif tag in ("body", "html", "br"):
                self.open_body()
            return
        if tag in ("html", "body", "head"):
            return
        if not self.table_end(tag):
            self.body_end(tag)

    def body_end(self, tag: str) -> None:
        if tag == "form" and not any(n.tag == "template" for n in self.stack):
            node, self.form = self.form, None
            if node is not None and self._node_in_scope(node):
                self.implied_ends()
                self.stack.remove(node)
            return
        if tag == "br":
            self.reconstruct()
            self.insert("br", {})
        elif tag == "p":
            if not self.in_scope({"p"}, {"button"}):
                self.insert("p", {})
            self.close_p()
        elif tag == "li":
            if self.in_scope({"li"}, {"ol", "ul"}):
                self.implied_ends("li")
                self.pop_to({"li"})
        elif tag in ("dd", "dt"):
            if self.in_scope({tag}):
                self.implied_ends(tag)
                self.pop_to({tag})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied_ends()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope({tag}):
                self.implied_ends()
                self.pop_to({tag})
                self.clear_to_marker()
        elif tag in BLOCK_END:
            if self.in_scope({tag}):
                self.implied_ends()
                self.pop_to({tag})
        elif tag == "template":
            if any(n.tag == tag for n in self.stack):
                self.pop_to({tag})
                self.clear_to_marker()
        else:
            self.other_end(tag)


def parse(source: str) -> Node:
    """The document node of a page."""
    b = Builder()
    at, n = 0, len(source)
    held: list[str] = []  # characters up to the next tag or comment: a table takes them as one

    def flush() -> None:
        if held:
            b.text("".join(held))
            held.clear()

    while at < n:
        lt = source.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at:
            t = source[at:lt]
            held.append(html.unescape(t) if "&" in t else t)
        if lt == n:
            break
        m = TAG.match(source, lt) or LOOSE_TAG.match(source, lt)
        if m:
            flush()
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                b.end(tag)
                continue
            b.start(tag, attributes(m[3]) if m[3].strip() else {}, m[3].endswith("/"))
            if tag in RAW and b.top.tag == tag:
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                stop = close.start() if close else n
                raw = source[at:stop]
                if raw:
                    b.top.add(html.unescape(raw) if tag in ("textarea", "title") else raw)
                b.stack.pop()
                gt = source.find(">", stop)
                at = n if gt < 0 else gt + 1
        elif source.startswith("<!--", lt):
            flush()
            end = source.find("-->", lt + 2)
            at = n if end < 0 else end + 3
        elif source[lt + 1 : lt + 2] in ("!", "?") or source.startswith("</", lt) and source[lt + 2 : lt + 3]:
            flush()
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            if b.body is None and source[lt : lt + 9].lower() == "<!doctype":
                b.quirks = bool(OLD_DOCTYPE.match(source, lt))
        elif source[lt + 1 : lt + 2].isalpha():
            break
        else:
            held.append("<")
            at = lt + 1
    flush()
    b.open_body()
    return b.document
