"""Tables in tree construction: cases by hand, and table soups against the standard's insertion modes step by step."""

import random
import re

import pytest

from webgauge.operators.dom import parse

SECTIONS, CELLS = ("tbody", "tfoot", "thead"), ("td", "th")
PARTS = (*SECTIONS, *CELLS, "caption", "col", "colgroup", "tr")


def dump(node):
    if isinstance(node, str):
        return node
    inner = "".join(map(dump, node.children))
    return inner if node.tag == "#document" else f"<{node.tag}>{inner}</{node.tag}>"


def body_of(source):
    return dump(parse(source)).removeprefix("<html><head></head>").removesuffix("</html>")


class Element(list):
    """A tag and its children, for the plain version."""

    def __init__(self, tag):
        super().__init__()
        self.tag = tag

    def __eq__(self, other):
        return self is other

    __hash__ = None


class Steps:
    """The standard's rules for tables, div, p and span, with its insertion mode kept as a variable."""

    def __init__(self):
        self.body = Element("body")
        self.stack = [Element("html"), self.body]
        self.mode = "in body"
        self.foster = False

    top = property(lambda self: self.stack[-1])

    def scope(self, *tags, stops=("html", "table", "template")):
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in stops:
                return False

    def body_scope(self, *tags):
        return self.scope(*tags, stops=("html", "table", "td", "th", "caption", "button"))

    def insert_at(self, child):
        parent = self.top
        if self.foster and parent.tag in ("table", *SECTIONS, "tr"):
            table = next(e for e in reversed(self.stack) if e.tag == "table")
            parent = self.parent_of(table, self.body)
            place = next(i for i, c in enumerate(parent) if c is table)
        else:
            place = len(parent)
        if isinstance(child, str) and place and isinstance(parent[place - 1], str):
            parent[place - 1] += child
        else:
            parent.insert(place, child)

    def parent_of(self, wanted, at):
        for c in at:
            if c is wanted:
                return at
            if isinstance(c, Element) and (found := self.parent_of(wanted, c)) is not None:
                return found
        return None

    def element(self, tag):
        e = Element(tag)
        self.insert_at(e)
        self.stack.append(e)

    def pop_until(self, *tags):
        while self.stack.pop().tag not in tags:
            pass

    def clear_to(self, *tags):
        while self.top.tag not in (*tags, "html"):
            self.stack.pop()

    def implied(self, but=None):
        while self.top.tag == "p" and but != "p":
            self.stack.pop()

    def reset(self):
        modes = dict.fromkeys(SECTIONS, "in table body") | dict.fromkeys(CELLS, "in cell") | {"tr": "in row", "caption": "in caption", "colgroup": "in column group", "table": "in table", "body": "in body"}
        self.mode = next(modes[e.tag] for e in reversed(self.stack) if e.tag in modes)

    def token(self, kind, name):
        getattr(self, self.mode.replace(" ", "_"))(kind, name)

    def in_body(self, kind, name):
        if kind == "text":
            self.insert_at(name)
        elif kind == "start":
            if name in PARTS:
                return
            if name in ("div", "p", "table") and self.body_scope("p"):
                self.implied("p")
                self.pop_until("p")
            self.element(name)
            if name == "table":
                self.mode = "in table"
        elif name == "p":
            if not self.body_scope("p"):
                self.element("p")
            self.implied("p")
            self.pop_until("p")
        elif name == "div":
            if self.body_scope("div"):
                self.implied()
                self.pop_until("div")
        else:
            for e in reversed(self.stack):
                if e.tag == name:
                    self.implied(name)
                    while self.stack.pop() is not e:
                        pass
                    return
                if e.tag != "span":
                    return

    def in_table(self, kind, name):
        if kind == "text" and self.top.tag in ("table", *SECTIONS, "tr"):
            if name.strip():
                self.anything_else(kind, name)
            else:
                self.insert_at(name)
        elif kind == "start" and name == "caption":
            self.clear_to("table")
            self.element(name)
            self.mode = "in caption"
        elif kind == "start" and name == "colgroup":
            self.clear_to("table")
            self.element(name)
            self.mode = "in column group"
        elif kind == "start" and name == "col":
            self.token("start", "colgroup")
            self.token(kind, name)
        elif kind == "start" and name in SECTIONS:
            self.clear_to("table")
            self.element(name)
            self.mode = "in table body"
        elif kind == "start" and name in (*CELLS, "tr"):
            self.token("start", "tbody")
            self.token(kind, name)
        elif kind == "start" and name == "table":
            self.pop_until("table")
            self.reset()
            self.token(kind, name)
        elif kind == "end" and name == "table":
            self.pop_until("table")
            self.reset()
        elif kind == "end" and name in PARTS:
            pass
        else:
            self.anything_else(kind, name)

    def anything_else(self, kind, name):
        self.foster = True
        self.in_body(kind, name)
        self.foster = False

    def in_caption(self, kind, name):
        if kind == "end" and name == "caption" or (kind, name) == ("end", "table") or kind == "start" and name in PARTS:
            if not self.scope("caption"):
                return
            self.implied()
            self.pop_until("caption")
            self.mode = "in table"
            if (kind, name) != ("end", "caption"):
                self.token(kind, name)
        elif kind == "end" and name in PARTS:
            pass
        else:
            self.in_body(kind, name)

    def in_column_group(self, kind, name):
        if kind == "text" and name[:1].isspace():
            white = re.match(r"\s+", name)[0]
            self.insert_at(white)
            if name[len(white) :]:
                self.token(kind, name[len(white) :])
        elif (kind, name) == ("start", "col"):
            self.element("col")
            self.stack.pop()
        elif (kind, name) == ("end", "col"):
            pass
        elif self.top.tag == "colgroup":
            self.stack.pop()
            self.mode = "in table"
            if (kind, name) != ("end", "colgroup"):
                self.token(kind, name)

    def in_table_body(self, kind, name):
        if (kind, name) == ("start", "tr"):
            self.clear_to(*SECTIONS)
            self.element("tr")
            self.mode = "in row"
        elif kind == "start" and name in CELLS:
            self.token("start", "tr")
            self.token(kind, name)
        elif kind == "end" and name in SECTIONS:
            if self.scope(name):
                self.clear_to(*SECTIONS)
                self.stack.pop()
                self.mode = "in table"
        elif kind == "start" and name in PARTS or (kind, name) == ("end", "table"):
            if self.scope(*SECTIONS):
                self.clear_to(*SECTIONS)
                self.stack.pop()
                self.mode = "in table"
                self.token(kind, name)
        elif kind == "end" and name in PARTS:
            pass
        else:
            self.in_table(kind, name)

    def in_row(self, kind, name):
        if kind == "start" and name in CELLS:
            self.clear_to("tr")
            self.element(name)
            self.mode = "in cell"
        elif (kind, name) == ("end", "tr"):
            if self.scope("tr"):
                self.clear_to("tr")
                self.stack.pop()
                self.mode = "in table body"
        elif kind == "start" and name in PARTS or kind == "end" and name in ("table", *SECTIONS):
            if kind == "end" and name != "table" and not self.scope(name):
                return
            if self.scope("tr"):
                self.token("end", "tr")
                self.token(kind, name)
        elif kind == "end" and name in PARTS:
            pass
        else:
            self.in_table(kind, name)

    def in_cell(self, kind, name):
        if kind == "end" and name in CELLS:
            if self.scope(name):
                self.implied()
                self.pop_until(name)
                self.mode = "in row"
        elif kind == "start" and name in PARTS or kind == "end" and name in ("table", "tr", *SECTIONS):
            if kind == "end" and not self.scope(name):
                return
            self.implied()
            self.pop_until(*CELLS)
            self.mode = "in row"
            self.token(kind, name)
        elif kind == "end" and name in PARTS:
            pass
        else:
            self.in_body(kind, name)


def soup(rng):
    names = ["table", "table", *PARTS, "tr", "td", "td", "div", "p", "span"]
    out = ["<div>"]
    for _ in range(rng.randint(3, 60)):
        r = rng.random()
        if r < 0.3:
            out.append(rng.choice(["a", "b c", " ", "\n ", " d", "e "]))
        else:
            name = rng.choice(names)
            out.append(f"</{name}>" if r < 0.55 and name != "col" else f"<{name}>")
    return "".join(out)


def by_steps(source):
    steps = Steps()
    for end, name, text in re.findall(r"<(/?)(\w+)>|([^<]+)", source):
        steps.token("text" if text else "end" if end else "start", text or name)
    return dump_plain(steps.body)


def dump_plain(e):
    return e if isinstance(e, str) else f"<{e.tag}>{''.join(map(dump_plain, e))}</{e.tag}>"


def test_table_soups_are_built_as_by_the_standards_steps():
    rng = random.Random(11)
    fostered = 0
    for _ in range(3000):
        source = soup(rng)
        expected = by_steps(source)
        assert body_of("<!doctype html>" + source) == expected, source
        fostered += expected != body_of("<!doctype html>" + re.sub(r"</?(?:table|tbody|thead|tfoot|tr|td|th|caption|colgroup|col)>", "", source))
    assert fostered > 1000


@pytest.mark.parametrize(
    "source, built",
    [
        ("stray<tr>a<td>1<td>2", "straya<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
        ("<tr><p>x</p><td>1", "<p>x</p><table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<td>a<table><td>b</table>c", "<table><tbody><tr><td>a<table><tbody><tr><td>b</td></tr></tbody></table>c</td></tr></tbody></table>"),
        ("<td>a<table>", "<table><tbody><tr><td>a<table></table></td></tr></tbody></table>"),
        ("<tr><table><td>b", "<table><tbody><tr></tr></tbody></table><table><tbody><tr><td>b</td></tr></tbody></table>"),
        ("<b>x<tr><td>y</b>z</table>w", "<b>x</b><table><tbody><tr><td>yz</td></tr></tbody></table><b>w</b>"),
        ("<a>1<p>2</a>3</p>", "<a>1</a><p><a>2</a>3</p><table></table>"),
        ("a < b<tbody>", "a < b<table><tbody></tbody></table>"),
        ("<input type=hidden><input><script>s</script>", "<input></input><table><input></input><script>s</script></table>"),
        ("<form><td>x</form>y", "<table><form></form><tbody><tr><td>xy</td></tr></tbody></table>"),
        ("<tr><td><select><option>a</table>b", "<table><tbody><tr><td><select><option>a</option></select></td></tr></tbody></table>b"),
        ("<caption><b>c<tr><td>d", "<table><caption><b>c</b></caption><tbody><tr><td>d</td></tr></tbody></table>"),
    ],
)
def test_tables(source, built):
    assert body_of("<table>" + source) == f"<body>{built}</body>"


@pytest.mark.parametrize(
    "doctype, within",
    [("<!doctype html>", False), ("", False), ('<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 3.2 Final//EN">', True), ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd">', False)],
)
def test_a_table_ends_a_paragraph_unless_the_document_type_is_old(doctype, within):
    assert ("<p>a<table>" in body_of(doctype + "<p>a<table>")) == within


def test_words_and_keywords_follow_the_repaired_order():
    """Text before the table follows the paragraph's; white space between cells parts words, adjacent cells do not."""
    from webgauge.operators.extract import extract
    from webgauge.operators.keywords import phrases

    rows = "".join(f"<tr><td>green tea</td> <td>{i} </td></tr>" for i in range(9))
    doc = extract(f"<!doctype html><title>t</title><p>first </p><table>{rows}stray words <td>black</td><td>tea</table><p> last</p>", "https://a.example/")
    assert doc["body_text"] == "first stray words " + " ".join(f"green tea {i}" for i in range(9)) + " blacktea last"
    found = phrases(doc["body_text"].split())
    assert found["green tea"][1] == 9 and "tea black" not in found
