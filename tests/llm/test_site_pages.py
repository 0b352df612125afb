"""Main texts: what classes must not take, malformed pages, random pages against their known texts."""

import random
import time

import pytest

from corvane.llm.site_templates import extract, main_text, templates
from tests.llm import brute


def test_classes_take_no_paragraphs():
    assert main_text('<article><p class="share-price">The price rose</p><p>b</p></article>') == "The price rose\n\nb"
    assert main_text('<article><div class="notice-of-motion">kept</div><p>He is a <span class="social">worker</span> and <label>so</label> on</p></article>') == "kept\n\nHe is a worker and so on"
    assert main_text('<article><div class="cookie-notice">no</div><div id="adBox">no</div><div class="x ad">no</div><p class="comment">x</p><section id="comments"><article><p>r</p></article></section></article>') == "x"


def test_headers_by_class():
    page = '<div class="site-header">no</div><article><div class="header">no</div><div class="entry header">a</div><div class="header-image">b</div><div class="articleHeader">c</div></article>'
    assert main_text(page) == "a\n\nb\n\nc"


def test_tags_with_odd_ends():
    assert main_text("<p>1 < 2 <b class='>'>x</b> <a href=\"a>b\">y</a> <") == "1 < 2 x y <"
    assert main_text("a<b c=\"d>e</b>f") == 'a<b c="d>ef'
    assert main_text("<p>a</p><![CDATA[b]]><!x><?y><p>c<!-- d") == "a\n\nb\n\nc"
    assert main_text("<script>x<p>y</script ><p>z<style>q") == "z"
    assert main_text("<table><tr><td>a<td>b<table><tr><td>c</table><td>d</table>e</td></x>f") == "a\n\nb\n\nc\n\nd\n\nef"


HARD = {"open": "<a ", "quotes": "<a \"'", "values": '<a x="', "stray": "<b></x>", "cdata": "<![CDATA[", "declarations": "<!x", "cells": "<b><td></td>", "articles": "<article>", "paragraphs": "<p>x", "ends": "<script></script ", "less": "<"}


@pytest.mark.parametrize("name", HARD)
def test_malformed_pages_take_linear_time(name):
    """A quarter of a megabyte each, in a few seconds on a slow machine; quadratic work would take minutes."""
    part = HARD[name]
    page = part * (250_000 // len(part))
    if name in ("stray", "cells"):
        half = len(part.split(">")[0]) + 1
        page = part[:half] * (125_000 // half) + part[half:] * (125_000 // (len(part) - half))
    began = time.process_time()
    main_text(page, frozenset([1]))
    templates(page)
    assert time.process_time() - began < 8


def test_random_pages(spark):
    """Whole texts of well-formed pages, nested boxes and class words included, from their makers; boxes with neutral
    classes go by their counts alone."""
    r = random.Random(6)
    boxes = {h: [f"box {h} {i}" for i in range(4)] for h in range(4)}
    pages, html = [], []
    for i in range(90):
        host = r.choice([0, 0, 1, 2, 3])
        h, blocks = brute.random_page(r, boxes[host] + ([f"own {i}"] if host else []))
        pages.append((i, host, blocks))
        html.append((i, f"https://h{host}.example/{i}", h))
    got = {x["page_id"]: x["text"] for x in extract(spark.createDataFrame(html, "page_id long, url string, html string")).collect()}
    assert got == brute.page_texts(pages)
    assert sum(got[i] != main_text(h) for i, _, h in html) > 40  # changed by counts
