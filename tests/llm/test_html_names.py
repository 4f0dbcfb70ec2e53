"""What names may and may not take out of an article."""

import pytest

from webgauge.llm.html_text import main_text, made_of_heading

LONG = "Long running prose about the topic at hand, with several clauses, so that nobody would take it for anything but text of the article itself. "
NAMES = """alert menu related tags social cookies copyright notices widgets follow sharing share sidebar banner nav navigation footer toolbar pagination skip recommended
    newsletter subscribe sponsors promo ads advert comments replies discussion disclaimer consent popup overlay modal login signup breadcrumbs masthead notification feedback""".split()


def page(inside="", after="", before=""):
    return (
        f"<html><body><nav><a href=/>Home</a> <a href=/b>B</a></nav><div class=sidebar><a href=x>side link</a></div>{before}<article><h1>Title here</h1><p>{LONG * 2}</p>{inside}<p>{LONG}END</p></article>{after}"
        "<footer>Copyright foot</footer></body></html>"
    )


@pytest.mark.parametrize("name", NAMES)
def test_headings_and_running_text_never_go_by_name(name):
    text = main_text(page(f'<h2 id="{name}">{name.title()}</h2><p class="{name}" id="{name}-1">Kept {name}</p><p>A <span class="{name}">word</span></p><section><h3 class="{name}">Sub</h3></section>'))
    for kept in (name.title(), f"Kept {name}", "A word", "Sub", "END"):
        assert kept in text
    assert "side link" not in text and "Copyright foot" not in text


@pytest.mark.parametrize("name", ["cookies", "notices", "widgets", "tags", "discussion", "related", "copyright"])
def test_sections_named_by_their_heading_stay(name):
    assert f"About {name}" in main_text(page(f'<section id="{name}"><h2>{name.title()}</h2><p>About {name}. {LONG}</p></section>'))


@pytest.mark.parametrize("inside, kept", [('<section id="widgets"><p>KEEP ' + LONG + "</p></section>", "KEEP"), ("<p>a <math><mi>x</mi><mo>=</mo><mn>42</mn></math> b</p>", "x=42"), ('<ul class="menu"><li>Soup of the day<li>Bread</ul>', "Soup")])
def test_parts_of_the_article_stay(inside, kept):
    assert kept in main_text(page(inside))


@pytest.mark.parametrize(
    "part",
    [
        f'<section class="user-responses"><h2>Responses</h2><div><p>BAD {LONG}</p></div><div><p>BAD {LONG}</p></div></section>',
        f'<section class="xyz"><h3>12 Comments</h3><p>BAD {LONG}</p></section>',
        f"<div id=q><h4>Leave a reply</h4><p>BAD {LONG}</p></div>",
        '<div itemprop="comment" class="x1"><p>BAD comment</p></div>',
        '<div class="notice">BAD notice ' + LONG + "</div>",
        '<div class="menu"><a href=1>BAD</a> <a href=2>b</a></div>',
        '<ul class="tags"><li><a href=1>BAD</a><li><a href=2>b</a></ul>',
        "<div class=social>BAD follow us</div>",
        '<div id="cookie-notice">BAD We use cookies to improve your experience on this site. By continuing you accept our policy and more.</div>',
    ],
)
@pytest.mark.parametrize("place", ["inside", "after", "before"])
def test_parts_beside_the_article_go(part, place):
    text = main_text(page(**{place: part}))
    assert "BAD" not in text and "END" in text


def test_articles_within_an_article_are_comments_unless_they_are_most_of_it():
    assert "BAD" not in main_text(page("<article><p>BAD nice one</p></article>"))
    assert "END" in main_text(f"<article class=wrap><p>Lead</p><article><h1>T</h1><p>{LONG * 3}END</p></article></article>")


def test_headings_before_an_article_in_main_belong_to_it():
    prose = f"<p>{LONG * 3}</p>" * 4
    text = main_text(f"<body><main><header><a href=/>Site</a><h1>Head of page</h1></header><p>Standfirst</p><article>{prose}</article><article><h2>Next</h2><p>Short</p></article></main>")
    assert text.startswith("Head of page\n\nStandfirst\n\nLong") and "Site" not in text and "Next" not in text


def test_ids_made_of_headings():
    assert made_of_heading("cookies", "Cookies") and made_of_heading("our-cookies-2", "Our cookies!") and made_of_heading("part-2", "Part 2")
    assert not made_of_heading("cookie-notice", "Cookies") and not made_of_heading("x", None)
