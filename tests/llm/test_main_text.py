"""Pages with ordinary markup around an article: wrappers' names, forms, hidden attributes, comments, related boxes."""

import time

import pytest

from driftwatch.llm.main_text import blocks_of, main_text, named

FIRST = "The council met on Tuesday to discuss the new bridge, which has been closed since the spring floods."
SECOND = "Engineers said that repairs would take at least another four months, weather permitting."
ARTICLE = f"<p>{FIRST}</p><p>{SECOND}</p>"
WANTED = f"{FIRST}\n{SECOND}"
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a></nav>'
FOOT = "<footer><p>© 2024 The Town Paper. All rights reserved, and so on.</p></footer>"


@pytest.mark.parametrize("page", [
    '<div class="layout has-sidebar"><article>{}</article></div>',
    '<div class="content with-sidebar">{}</div>',
    '<div id="page" class="no-sidebar"><div class="entry-content">{}</div></div>',
    '<div class="page nav-open"><main>{}</main></div>',
    '<article><section class="related-work">{}</section></article>',
    '<form id="aspnetForm"><div id="content"><article>{}</article></div></form>',
    '<form id="aspnetForm" action="/"><div>{}</div></form>',
    '<div class="text hidden sm">{}</div>',
    '<div class="sidebar-layout"><div class="inner">{}</div></div>',
    '<body class="menu header-fixed">{}</body>',
    '<article><header class="entry-header"></header>{}</article>',
    '<div class="siteHeader isOpen"><main>{}</main></div>',
    '<main data-note="hidden" title="aria-hidden=true">{}</main>',
    "<div class='widget'><article itemprop=articleBody>{}</article></div>",
    '<div role="main" class="banner-page">{}</div>',
])
def test_wrappers_leave_the_article(page):
    assert main_text(f"<html>{NAV}{page.format(ARTICLE)}{FOOT}</html>") == WANTED


@pytest.mark.parametrize("part", [
    '<article class="comment"><p>I crossed that bridge every day, and I will miss it very much indeed.</p></article>',
    '<section id="comments"><article class="hentry"><p>What a shame it is, says one reader who was there on Monday.</p></article></section>',
    '<div class="commentList"><p>Someone else agrees with all of it, and says so at some length here.</p></div>',
    '<div id="disqus_thread"><p>Join the discussion about the bridge, which is open to all the readers.</p></div>',
    '<aside class="sidebar"><p>Most read this week are stories on the weather and the coming election.</p></aside>',
    '<div class="sidebar"><p>Most read this week are stories on the weather and the coming election.</p></div>',
    '<form><label>Your name</label><p>Please fill in all of the fields, and then send the form to us.</p></form>',
    '<div hidden><p>This text is for another day, and it is not shown to the readers of this page.</p></div>',
    '<div style="color:red; display: none"><p>This text is not shown to the readers of this page either.</p></div>',
    '<div aria-hidden="true"><p>This text is not shown to the readers of this page either, we hope.</p></div>',
    '<div class="cookie-banner"><p>We use cookies to make this site work, and we ask for your consent.</p></div>',
    '<div class="related-posts"><a href="/1">The old bridge in pictures</a> <a href="/2">Floods of the century</a></div>',
    '<div class="ad-slot"><p>Buy our excellent umbrellas, which never turn inside out in any wind.</p></div>',
    '<p class="notice">This site will be down for maintenance on Sunday, from two until four.</p>',
])
def test_parts_that_are_no_article_go(part):
    page = f'<html>{NAV}<div class="page has-sidebar"><article><h1>Bridge stays closed</h1>{ARTICLE}{part}</article></div>{FOOT}</html>'
    assert main_text(page) == f"Bridge stays closed\n{WANTED}"
    if not part.startswith("<p"):
        assert main_text(f"<html>{NAV}<main>{ARTICLE}</main>{part}{FOOT}</html>") == WANTED


def test_names_are_whole_words():
    for name, said in (("ad", "part"), ("ads-top", "part"), ("addition", ""), ("shadow", ""), ("header", "open"), ("post-header", "content"), ("has-header", ""), ("navOpen", ""), ("mainNav", "layout"), ("sharebar", ""), ("x9", "")):
        assert named(name) == said, name


def test_attributes_cost_their_length():
    start = time.perf_counter()
    for value in ('class="' + "has-sidebar " * 80_000 + '"', "x=" * 400_000, "'" * 3 + "a " * 300_000, 'a="' + "b" * 900_000):
        blocks_of(f"<div {value}>text</div>")
    assert time.perf_counter() - start < 10
