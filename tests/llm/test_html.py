"""Broken markup in time that grows with its length, and the density rule against a plain restatement."""

from __future__ import annotations

import math
import random
import time

import pytest

from lapframe.llm import html_text

SHAPES = {
    "tags without an end": "<a " * 350_000,
    "open inline elements": "<b>" * 300_000,
    "end tags that match nothing": "<i>" * 120_000 + "</b>" * 150_000,
    "quotes around every end": '<a ">" ' * 150_000,
    "quotes that don't close": '<a title="x>y ' * 80_000,
    "blocks under inline elements": "<p>" + "<b>" * 100_000 + "<div></div>" * 60_000,
    "items under inline elements": "<li><ul>" + "<b>" * 100_000 + "<li></li>" * 70_000,
    "depth": "<article>" + "<div>x" * 150_000,
    "cells": "<table><tr>" + "<td>x" * 200_000,
    "signs": "<" * 1_000_000,
    "open scripts": "<script" * 140_000,
    "comments": "<!-" * 300_000,
    "one tag": "<p " + "a= " * 300_000 + ">x",
}


def seconds(html: str) -> float:
    began = time.process_time()
    html_text.main_text(html)
    return time.process_time() - began


@pytest.mark.parametrize("shape", SHAPES)
def test_time_grows_with_length(shape):
    html = SHAPES[shape]
    took = seconds(html[: len(html) // 8])
    # Eight times the length: a quadratic rule would take 64 times as long.
    assert seconds(html) < 24 * max(took, 0.05)


def plain_main(root: html_text.Node) -> html_text.Node:
    """The part by the definition, counting every node's subtree anew."""
    kids = lambda x: [c for c in x.children if isinstance(c, html_text.Node) and not c.cut]
    body = html_text._find(root, "body") or root
    parent, linked, order = {id(body): None}, {id(body): False}, [body]
    for node in order:
        for k in kids(node):
            parent[id(k)], linked[id(k)] = node, linked[id(node)] or k.tag == "a"
            order.append(k)

    def below(node):
        return [node] + [x for k in kids(node) for x in below(k)]

    def chars(node, only_links):
        return sum(len("".join(c.split())) for x in below(node) if not only_links or linked[id(x)] for c in x.children if isinstance(c, str))

    def density(node):
        c, lc, t = chars(node, False), chars(node, True), len(below(node)) - 1
        lt = sum(linked[id(x)] for x in below(node)[1:])
        if not c:
            return 0.0
        share = chars(body, True) / max(chars(body, False), 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        own = c / max(t, 1) * math.log(max(c * max(t, 1) / (max(lc, 1) * max(lt, 1)), 1.0000001))
        return own / max(math.log(base), 1e-6) if base > 1.0001 else own

    d = {id(x): density(x) for x in order}
    score = {id(x): sum(d[id(k)] for k in kids(x)) or (d[id(x)] if any(isinstance(c, str) and c.strip() for c in x.children) else 0.0) for x in order}
    top = max(order, key=lambda x: score[id(x)])
    path = []
    while top is not None:
        path.append(d[id(top)])
        top = parent[id(top)]
    return max(score[id(x)] for x in order if d[id(x)] >= min(path))


def test_densities_against_the_definition():
    rng = random.Random(4)

    def part(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(5)
            text = " ".join(rng.choice(("word", "of", "text")) for _ in range(rng.randrange(1, 30)))
            out.append(text if kind == 0 else f'<a href="x">{text}</a>' if kind == 1 else f"<p>{text}</p>" if kind == 2 or not depth else f"<div>{part(depth - 1)}</div>")
        return "".join(out)

    for _ in range(150):
        root = html_text.parse(f"<html><body>{part(3)}</body></html>")
        main = html_text.main_part(root)
        assert main.score == pytest.approx(plain_main(root))


def test_markup_that_does_not_close_is_kept_out_of_the_text():
    assert html_text.main_text('a <b title="oops>bold c') == "a bold c"
    assert html_text.main_text("x < y <b>q</b> & 2<3") == "x < y q & 2<3"


ARTICLE = "<h1>Title of it</h1><p>First paragraph of the article, long enough.</p><p>Second paragraph, with more words to it.</p>"
TALK = "".join(f"<p>Reader {i} says a great many words about all of this, more than the article has in all.</p>" for i in range(12))
KEPT = "Title of it\nFirst paragraph of the article, long enough.\nSecond paragraph, with more words to it."


@pytest.mark.parametrize(
    "part",
    [
        f'<div class="comments">{TALK}</div>',
        f'<section class="comments">{TALK}</section>',
        f'<section id="comments-area">{TALK}</section>',
        f'<div class="reader-comments">{TALK}</div>',
        f'<div id="disqus_thread">{TALK}</div>',
        f'<ol class="commentlist"><li class="comment even">{TALK}</li></ol>',
        f'<article class="comment">{TALK}</article>',
        f'<div itemprop="comment">{TALK}</div>',
        f'<div aria-label="Reader comments">{TALK}</div>',
        '<p class="advert">Buy this, buy that, buy all of it today.</p>',
        '<span class="ad">Buy this, buy that.</span>',
        '<div class="top_ad-17">Buy this, buy that.</div>',
        "<label>Your name</label>",
        "<fieldset><legend>Vote</legend>Yes or no</fieldset>",
        "<p class=cookie>We use cookies to make this site work.</p>",
        '<div class="cookie-consent-2"><p>We use cookies.</p></div>',
        '<div class="newsletter">Subscribe to our letters.</div>',
        '<div class="sidebar"><p>Other things to read, of which there are many.</p></div>',
    ],
)
def test_comments_adverts_and_notices_go_at_any_size(part):
    for page in (f"<body><article>{ARTICLE}</article>{part}</body>", f"<body><article>{ARTICLE}{part}</article></body>", f"<body><div>{ARTICLE}{part}</div></body>"):
        assert html_text.main_text(page) == KEPT, page


@pytest.mark.parametrize("wrapper", ['<div class="page banner">', '<div class="sidebar right">', '<div class="post comments-open">', '<section class="widget">', '<div class="has-ads">', '<div class="ad-free">', '<article class="post comments-closed">', '<div id="overlay">'])
def test_wrappers_of_the_article_stay(wrapper):
    end = "</" + wrapper[1 : wrapper.index(" ")] + ">"
    assert html_text.main_text(f"<body>{wrapper}<article>{ARTICLE}</article>{end}</body>") == KEPT
    assert html_text.main_text(f"<body>{wrapper}{ARTICLE}{end}</body>") == KEPT


def test_a_page_of_nothing_but_a_named_part_keeps_it():
    assert html_text.main_text('<body><div class="widget"><p>All the text there is.</p></div></body>') == "All the text there is."
    assert html_text.main_text('<body><h2 id="comments">Comments</h2><p>On the law.</p></body>') == "Comments\nOn the law."


def test_whole_pages_against_what_they_were_made_of():
    """Pages made of an article and parts around and in it: the text is the article's blocks, in order."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["law", "sea", "of", "the", "a", "r&amp;d", "\n", "&eacute;t&eacute;"]) for _ in range(n))
    noise = ['<nav><a href="/">Home</a></nav>', '<div class="ad">{}</div>', "<form><label>{}</label></form>", '<aside>{}</aside>', "<script>var a = '<p>{}</p>'</script>", '<div class="comments"><p>{}</p></div>', "<!-- {} -->", '<p class="cookie">{}</p>', '<ul class="menu"><li>{}</li></ul>']
    from html import unescape

    for _ in range(200):
        parts = [words(rng.randrange(5, 60)) for _ in range(rng.randrange(2, 9))]
        inside = "".join(rng.choice(noise).format(words(rng.randrange(1, 90))) * rng.randrange(0, 2) + f"<p>{p}</p>" for p in parts)
        around = [rng.choice(noise).format(words(rng.randrange(1, 200))) for _ in range(rng.randrange(0, 6))]
        k = rng.randrange(len(around) + 1)
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body><div>{''.join(around[:k])}<article>{inside}</article>{''.join(around[k:])}</div><footer>{words(30)}</footer></body></html>"
        want = [" ".join(unescape(p).split()) for p in parts]
        assert html_text.main_text(page) == "\n".join(w for w in want if w), page
