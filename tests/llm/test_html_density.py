"""HTML extraction: density against a plain implementation, parts that names would take away, hostile pages."""

import math
import random
import time

import pytest

from webgauge.llm.html_text import INLINE, TEXT, densest, main_text, measure, parse, prune, select

SENTENCE = "The quick brown fox jumps over the lazy dog, and then it rests for a while. "
FULL = "<h1>A title of it</h1>" + "".join(f"<p>{k} {SENTENCE * 3}</p>" for k in range(4))
AROUND = "<html><head><title>t</title></head><body><nav><a href=a>Menu</a> <a href=b>Shop</a></nav><div class=ad>Buy this now</div>{}<div class=comments><p>nice post, really</p><p>and one more reader here</p></div><footer>© me</footer></body></html>"


def want(page=FULL):
    return "\n\n".join(" ".join(b.split()) for b in page.replace("</h1>", "<p>").replace("</p>", "<p>").replace("<h1>", "<p>").split("<p>") if b.strip())


@pytest.mark.parametrize(
    "part",
    [
        "<article class='post comments-closed'>{}</article>", "<article class='comment-open post'>{}</article>", "<div class='discussion'><article>{}</article></div>", "<div class='content side'>{}</div>",
        "<div class='tags-page related'>{}</div>", "<form action=x>{}<input name=y><select><option>1</select></form>", "<div id='alert'>{}</div>", "<div hidden>{}</div>", "<div class=sidebar><div class=menu>{}</div></div>",
        "<aside><article>{}</article></aside>", "<div role=search><main>{}</main></div>",
    ],
)
def test_a_name_never_takes_the_article(part):
    assert main_text(AROUND.format(part.format(FULL))) == want()


@pytest.mark.parametrize(
    "other",
    [
        "<div class=sidebar>{}</div>", "<aside>{}</aside>", "<div class='cookie-notice'>{}</div>", "<form>{}</form>", "<section id=comments>{}</section>", "<div class='related'><article>{}</article></div>", "<div hidden>{}</div>",
        "<footer>{}</footer>", "<div role=dialog>{}</div>",
    ],
)
def test_named_parts_go_however_long_they_are(other):
    for article in (f"<article>{FULL}</article>", f"<div class=text>{FULL}</div>")[: 1 if "article" in other else 2]:
        long = "".join(f"<p>Other {SENTENCE * 5}</p>" for _ in range(9))
        assert main_text(f"<body>{article}{other.format(long)}</body>") == want()


def test_a_short_article_beside_long_comments():
    comments = "<div class=comments>" + "".join(f"<article class=comment><p>{SENTENCE * 4}</p></article>" for _ in range(20)) + "</div>"
    assert main_text(f"<body><article><p>Only this.</p></article>{comments}") == "Only this."
    assert main_text(f"<body><div><p>{SENTENCE}</p></div>{comments}") == SENTENCE.strip()
    assert main_text(f"<body><article></article><div class=ad>{SENTENCE * 9}</div>") == ""


def test_density_picks_one_of_several_articles():
    teasers = "".join(f"<article><h3><a href=x>Teaser {k}</a></h3><p>short {k}</p></article>" for k in range(5))
    assert main_text(f"<body>{teasers}<article>{FULL}</article>{teasers}") == want()
    assert main_text(f"<body><div>{''.join(f'<a href={k}>link {k}</a> ' for k in range(30))}</div><div>{FULL}</div>") == want()


def test_lists_and_short_paragraphs_of_an_unmarked_article_stay():
    page = "<div><h1>T</h1><p>short</p><ul>" + "".join(f"<li>{SENTENCE * 4}</li>" for _ in range(6)) + "</ul><p>end</p></div>"
    got = main_text(f"<body>{page}<div><a href=1>one</a><a href=2>two</a></div>")
    assert got.split("\n\n")[:2] == ["T", "short"] and got.split("\n\n")[-1] == "end" and len(got.split("\n\n")) == 9


def test_text_after_the_body_and_in_an_unclosed_head():
    assert main_text("<head><title>x</title><p>one two</p><p>three") == "one two\n\nthree"
    assert main_text("<body><p>one</p></body></html><p>two") == "one\n\ntwo"
    assert main_text("<p>a<table><tr><td>b</td></tr></table>c") == "a\n\nb\n\nc"


def random_page(rng: random.Random) -> str:
    def element(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.35:
            return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30)))
        if kind < 0.5:
            return f"<a href=x>{element(5)}</a>"
        tag = rng.choice(["div", "div", "section", "span", "p", "b", "article" if rng.random() < 0.1 else "div"])
        return f"<{tag}>" + " ".join(element(depth + 1) for _ in range(rng.randint(0, 6))) + f"</{tag}>"

    return "<html><body>" + "".join(element(0) for _ in range(rng.randint(1, 6))) + "</body></html>"


def plain_densest(body):
    """Every number counted anew for every node by walking its subtree."""

    def walk(node):
        yield node
        for c in node.elements():
            yield from walk(c)

    def letters(node, linked=False, only_links=False):
        linked = linked or node.tag == "a"
        out = 0
        for c in node.children:
            if isinstance(c, str):
                out += (linked or not only_links) * sum(not x.isspace() for x in c)
            else:
                out += letters(c, linked, only_links)
        return out

    def linked_letters(node):  # a link's own text belongs to the node that holds the link
        return sum(letters(c, False, True) for c in node.elements())

    def density(node):
        c, t, lc, lt = letters(node), sum(1 for _ in walk(node)) - 1, linked_letters(node), sum(n.tag == "a" for n in walk(node)) - (node.tag == "a")
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + linked_letters(body) / max(1, letters(body)) * c + math.e)
        x = math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))
        d = c / max(1, t) * (x / math.log(base) if base > 1 else x)
        return 1e-9 if d <= 0 and c > lc else d

    def depth(node):
        return 0 if node is body else 1 + depth(node.parent)

    sums = [(sum(density(c) for c in n.elements()), depth(n), n) for n in walk(body)]
    most = max(s for s, _, _ in sums)
    path = []
    near = [n for s, d, n in sums if math.isclose(s, most, rel_tol=1e-9)]
    target = max(near, key=depth)
    node = target
    while node is not None:
        path.append(density(node))
        node = node.parent
    return target, min(path), density


def test_density_sum_and_threshold_equal_a_plain_implementation():
    rng, marked, seen = random.Random(8), 0, 0
    for _ in range(300):
        body = parse(random_page(rng))
        prune(body)
        target, threshold = densest(body)
        plain, least, density = plain_densest(body)
        if not body.chars:
            continue
        seen += 1
        for node in measure(body):
            assert math.isclose(node.density, density(node), rel_tol=1e-6, abs_tol=1e-9)
        assert plain is target and math.isclose(threshold, least, rel_tol=1e-6)
        chosen, by_tag = select(body)
        marked += by_tag
        container = target
        while container is not body and container.tag in TEXT | INLINE:
            container = container.parent
        if not any(n.tag == "article" for n in [target, *ancestors(target)]) and target.total > 0 and container is not body:
            kept = set()
            for c in chosen:
                kept |= {id(n) for n in measured(c)}
            assert id(target) in kept
            for node in body.elements():  # off the path, what reaches the threshold is taken
                if node.density >= threshold and id(node) not in kept:
                    assert node in ancestors(target)
    assert seen > 200 and marked < 0.2 * seen


def ancestors(node):
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def measured(node):
    out = []
    todo = [node] if not isinstance(node, str) else []
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n.elements()
    return out


@pytest.mark.parametrize("page", ["<div>", "<div class=side>", "<div></b></p></li>", "<b><div><span></i>", "<p><button><div>", "<ul><li>", "<div class=side><p>x y</p>", "<a href=x>"])
def test_hostile_pages_take_linear_time(page):
    n = 25_000 // max(1, page.count("<") // 2)

    def seconds(k):
        begun = time.process_time()
        main_text(page * k + "x y")
        return time.process_time() - begun

    few = min(seconds(n) for _ in range(3))
    assert seconds(4 * n) < 9 * max(few, 0.05)  # quadratic climbs take sixteen times as long


def test_a_very_long_page():
    assert main_text("<article>" + f"<p>{SENTENCE}</p>" * 30_000 + "</article>").count("\n\n") == 29_999
