"""Main text: hints of the markup never cut the content, scores choose, time is linear."""

from __future__ import annotations

import html
import re
import time

import pytest

from quarry.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(PAGES).select("html").collect()]


def template(page: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def plain(page: str) -> str:
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def test_pages_without_article_tags(pages):
    assert all(html_text.extract(plain(p)) == template(p) for p in pages)


@pytest.mark.parametrize("name", ["has-sidebar", "header-fixed", "tags-on", "content-with-widget", "header", "widget"])
def test_wrappers_are_no_hints(pages, name):
    for p in pages:
        assert html_text.extract(p.replace("<body>", f'<body><div class="{name}">')) == template(p)
        if name not in ("header", "widget"):
            assert html_text.extract(p.replace("<article>", f'<div class="{name}">').replace("</article>", "</div>")) == template(p)


def test_scores_choose(pages, monkeypatch):
    """Adverts without a class: the scores leave nearly all of them out, and constant scores none."""
    bare = [(plain(p).replace(' class="ad"', ""), template(p)) for p in pages]
    share = lambda: sum(html_text.extract(p) == t for p, t in bare) / len(bare)
    assert share() > 0.9
    monkeypatch.setattr(html_text, "path_scores", lambda found: {b.node.path: 1.0 for b in found})
    assert share() < 0.1


def test_classes_of_content():
    p = "<p>A price, of shares, rose; nobody, so far, knows why.</p>"
    for name in ("share-price", "ad-hoc", "comment-free", "headerless"):
        assert html_text.extract(f"<article><h1>T</h1>{p.replace('<p>', f'<p class={name}>')}{p}</article>").count("rose") == 2
    assert html_text.extract('<p title="the hidden river"><a href="/hidden-river">Text</a> of a river, long, and winding.</p>') == "Text of a river, long, and winding."
    assert html_text.extract("<p>Text here, <span class=share-buttons>Share</span> and more, <span hidden>no</span> and more.</p>") == "Text here, and more, and more."
    assert html_text.extract("<form><h1>A</h1><p>The whole page, in a form.</p><p>More text, of it.</p></form>").startswith("A\n\nThe whole")
    assert html_text.extract('<div class="ad">Buy, now, cheap.</div>') == ""


def test_comments_of_readers_and_notices():
    body = "<p>One sentence, of many, that the page is about; it goes on.</p>" * 3
    notes = '<div class="cookie-banner"><p>We use cookies, all of us, and ask you, politely, to agree.</p></div>'
    reader = '<div id="comments"><p>I disagree, strongly, with all of this, and say so here, at length.</p></div>'
    assert html_text.extract(f"<div>{notes}<div class=text><h2>Title</h2>{body}</div>{reader}</div>") == "\n\n".join(["Title"] + ["One sentence, of many, that the page is about; it goes on."] * 3)


@pytest.mark.parametrize("page", ["<span>" * 50_000 + "<p>x</p>" * 50_000, "<div>" * 100_000 + "deep", "<b><p>" * 50_000, "<ul><li>a" * 50_000, "<table><tr><td>x" * 30_000, "<span class=ad>x" * 50_000, "<" + "a" * 500_000, "<a href='" * 100_000, "<!--" * 100_000])
def test_linear_time(page):
    begin = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - begin < 3
