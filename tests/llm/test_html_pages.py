"""HTML extraction on pages written by hand, unlike the generator's, and the tokenizer on bad markup."""

from __future__ import annotations

import time

import pytest

from ridgeline.llm import html_extract

PAGES = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Rivers - The Daily Map</title><link rel=stylesheet href=/a.css></head><body>
<header class="site-header"><a href="/">The Daily Map</a><nav class="main-nav"><ul><li><a href=/news>News</a><li><a href=/maps>Maps</a><li><a href=/about>About</a></ul></nav></header>
<main><article><h1>How rivers move their beds</h1>
<p>A river is never quite still in its bed, even where the banks look firm. Each flood moves some gravel, and each dry summer lets the willows hold a little more.</p>
<h2>The outer bend</h2><p>Water runs faster on the outside of a bend, so the bank there is cut away, while sand settles on the inside.</p>
<ul><li>The outer bank retreats, year by year.</li><li>The inner bank grows, and plants follow.</li></ul>
<p>After some centuries the loop is cut off, and a lake remains.</p></article></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Ten maps of rain</a></li><li><a href=/2>Where snow goes</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Great read, I live near such a bend.</p></div><div class="comment"><p>The lake near us was a loop once, thanks.</p></div></section>
<footer><p>&copy; 2024 The Daily Map. All rights reserved.</p></footer></body></html>""",
        ["How rivers move their beds", "A river is never quite still in its bed, even where the banks look firm. Each flood moves some gravel, and each dry summer lets the willows hold a little more.", "The outer bend", "Water runs faster on the outside of a bend, so the bank there is cut away, while sand settles on the inside.", "The outer bank retreats, year by year.", "The inner bank grows, and plants follow.", "After some centuries the loop is cut off, and a lake remains."],
    ),
    (
        """<html><body><div id=cookie-banner class="cookie consent"><p>We use cookies to improve this site, for statistics and for adverts.</p><button>Accept</button></div>
<div class="navbar"><a href=a>Home</a> | <a href=b>Recipes</a> | <a href=c>Contact</a></div>
<div class="post-content"><h1>Bread with rye &amp; seeds</h1><p>Mix the flours, the salt and the seeds; then add the water, and wait for half an hour.<p>Fold the dough every thirty minutes, four times in all.<p>Bake it hot, with steam, for forty minutes; let it cool before you cut it.</div>
<div class="advert"><p>Buy the best oven, only today, with free delivery!</p></div>
<form class="newsletter"><label>Your address</label><input name=e><button>Subscribe</button></form>
<div class="footer">Imprint, privacy, contact.</div></body></html>""",
        ["Bread with rye & seeds", "Mix the flours, the salt and the seeds; then add the water, and wait for half an hour.", "Fold the dough every thirty minutes, four times in all.", "Bake it hot, with steam, for forty minutes; let it cool before you cut it."],
    ),
    (
        "<article><h1>Title here now</h1><p class=it's>The first paragraph is long enough, I say, and it stays.</p><p>It's the second one, also long enough, and it stays as well.</p></article>",
        ["Title here now", "The first paragraph is long enough, I say, and it stays.", "It's the second one, also long enough, and it stays as well."],
    ),
    (
        '<article><h1>Another title</h1><p title="x>Second one is here, long enough to stay on.</p><p>The third one is here, and it stays too, all of it.</p></article>',
        ["Another title", "Second one is here, long enough to stay on.", "The third one is here, and it stays too, all of it."],
    ),
    (
        "<article><h1>A deep page</h1>" + "<font color=red>" * 450 + "<p>One two three four, five six seven eight, nine ten.</p><p>Eleven twelve thirteen, fourteen and fifteen.</p></article><aside class=sidebar><p>Side text stands here, more side text.</p></aside><div class=comments><p>Nice one, thanks a lot for it!</p></div>",
        ["A deep page", "One two three four, five six seven eight, nine ten.", "Eleven twelve thirteen, fourteen and fifteen."],
    ),
]


@pytest.fixture(scope="module")
def trees():
    return html_extract.train()


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_pages_written_by_hand(trees, number):
    source, blocks = PAGES[number]
    assert html_extract.main_text([source], trees)[0].split("\n") == blocks


def runs(source):
    return [t for _, t in html_extract.parse(source).runs]


def test_markup_is_read_by_the_states_of_the_standard():
    assert runs("<p>a < b and c <5> d") == ["a < b and c <5> d"]
    assert runs("<p>x</p attr=\"y>z\"><p>w <!-- c > --!> v <!--> u <!---> t <!bogus -> s <?php x ?> r </3> q") == ["x", "w v u t s r q"]
    assert runs("<p a = 'x>y' b=z>c</p>") == runs("<p/a='x>y'/b>c") == runs("<P A=b'c\"d>c") == runs("<p =a=b>c") == ["c"]
    assert runs("<p>kept <b title='cut off at the end of the page") == runs("<p>kept </b") == ["kept"]
    assert runs("<p>a<script>'</scripty>' </script x>b") == ["ab"]
    tags = html_extract.parse("<div data-x='class=sidebar' title='id=\"nav\"' CLASS='a>b main-content' id=\"ad\"><p aria-hidden=TRUE>x")
    assert tags.words[1] == html_extract._tokens('class="main content" id=ad')[0] and tags.hidden == [False, False, True]


def test_depth_changes_nothing():
    flat, deep = (html_extract.parse(f"<article>{'<i>' * k}<p>text</p></article><aside class=sidebar><p>more") for k in (1, 5_000))
    assert (flat.kind, flat.words, flat.parent, flat.depth, flat.runs) == (deep.kind, deep.words, deep.parent, deep.depth, deep.runs)
    assert max(html_extract.parse("<div>" * 5_000 + "x").depth) == 5_000


def test_bad_markup_takes_time_in_proportion():
    for part in ("<b ", "<b x=\"", "<p><b>", "</div><section>", "<title>", "<b x='y \" ", "<!--", "<a<"):
        began = time.time()
        html_extract.parse(part * 50_000)
        assert time.time() - began < 10, part
