"""Main text on layouts that the training pages do not spell out, and time on pages with many tags."""

import re
import time
from functools import lru_cache

import duckdb
import pytest

from lodestrand.llm import html_text

WORDS = "the river ran high that spring and people of both towns came down to look at it every evening after work until the rain had stopped for good"
PARAGRAPH = " ".join([WORDS] * 2 + ["so it was told."])
PARAGRAPHS = "".join(f"<p>{k} {PARAGRAPH}</p>" for k in range(6))
TEXT = [f"{k} {PARAGRAPH}" for k in range(6)]
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul></nav>"
FOOT = "<footer><p>Copyright by the publisher</p><a href=/x>Terms</a></footer>"


@lru_cache(1)
def model():
    return html_text.train(html_text.labelled_pages())


def lines(body, opening="<body>"):
    return html_text.main_text(f"<html>{opening}{NAV}{body}{FOOT}</body></html>", model()).split("\n")


@pytest.mark.parametrize("opening,closing", [("<div>", "</div>"), ("<section>", "</section>"), ('<div class="content ad-free">', "</div>"), ("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div id=page><div class=wrap><div>", "</div></div></div>"), ('<div class="c-42 no-sidebar">', "</div>")])
def test_articles_in_plain_containers(opening, closing):
    assert lines(opening + PARAGRAPHS + closing) == TEXT


@pytest.mark.parametrize("head", ['<header class="entry-header"><h1>Floods</h1></header>', "<header><h1>Floods</h1></header>", '<div class="entry-header"><h1>Floods</h1></div>'])
def test_the_head_of_an_article_is_part_of_it(head):
    assert lines(f"<article>{head}{PARAGRAPHS}</article>") == ["Floods", *TEXT]


def test_classes_that_state_something_are_no_clutter():
    body = '<article class="post has-comments"><p>It rained again all through the night.</p><p>Roads were closed in the morning.</p></article>'
    assert lines(body, '<body class="single comments-open">') == ["It rained again all through the night.", "Roads were closed in the morning."]


def test_paragraphs_of_links_in_an_article():
    body = "<article><h1>Where to read on</h1>" + "".join(f"<p><a href=/{k}>The first volume {k}</a>, <a href=/x{k}>the second one</a> and <a href=/y{k}>a third</a>.</p>" for k in range(6)) + "</article>"
    assert lines(body) == ["Where to read on", *(f"The first volume {k}, the second one and a third." for k in range(6))]


def test_clutter_in_and_after_an_article_goes():
    inside = '<div class="c-newsletter-box"><p>Get our letter every week</p></div>'
    assert lines(f"<article>{PARAGRAPHS}{inside}</article>") == TEXT
    assert lines(f"<article>{PARAGRAPHS}</article><div>Cheap flights to the south from today</div>") == TEXT


def test_a_dominant_block_is_never_lost():
    for tag in ("div", "td", "center", "x-article"):
        body = f"<{tag} class=promo-free>" + PARAGRAPHS + f"</{tag}>"
        assert set(TEXT) <= set(lines(body)), tag
    assert html_text.main_text("<p>one paragraph that stands alone on its page, without any container at all</p>", model()) != ""
    assert html_text.main_text("<nav><a href=x>only</a> <a href=y>links</a></nav>", model()) == ""


@pytest.mark.parametrize("source", ["<div>" * 80_000 + "</span2>" * 80_000, "<div>" * 40_000 + "</section>" * 80_000, "<dt><dl>" + "<foo>" * 40_000 + "<dt></dt>" * 40_000, "<li>" * 80_000, "<b><p>" * 60_000])
def test_tags_take_linear_time(source):
    began = time.time()
    html_text.parse(source)
    assert time.time() - began < 5


def test_given_pages_keep_their_articles():
    for (source,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall():
        page = html_text.parse(source)
        inside = set()
        for k in range(len(page.tag)):
            if page.tag[k] == "article" or page.parent[k] in inside:
                inside.add(k)
        whole = [" ".join("".join(pieces).split()) for element, pieces in page.blocks if element in inside]
        if inside and not re.search("<article[^>]*>.*<(aside|form|nav|section|div)", source, re.S):
            assert html_text.main_text(source, model()) == "\n".join(t for t in whole if t)
