"""Mangled pages: none may raise, lose the article behind an open control, or cost more than linear time."""

import random
import time

import numpy as np
import pytest

from sward.llm.dom import Page, decoded
from sward.llm.extraction import contents, decode, joined

PARTS = [
    "<p>", "</p>", "<div class='post", "'>", "<a href=", "</a>", "<![foo[bar]]>", "<![CDATA[x]]>", "<!doctype html>", "<!--", "-->", "<!", "<?php", "?>",
    "<", ">", "</", "/>", "&amp", "&#", "&#x110000;", "&#99999999999;", "\x00", "<script>", "</script", "<style>", "</style>", "<textarea>", "<button>",
    "</button>", "<select><option>", "<svg/>", "<table><tr><td>", "</table>", "<li>", "<ul>", "\"", "'", "=", " word. ", "é ", "<title>", "<b>", "</b>", "<iframe>",
    "<body>", "</body>", "<html>", "<head>", "<math><mi>", "</math>", "<form>", "<a b=\"", "<!ELEMENT", "<!>", "<p/", "\n", "\t",
]


def text_of(html):
    page = Page(html)
    x = page.measure()
    assert len(x) == len(page.nodes) and np.isfinite(x).all()
    return joined(page, decode(page, np.ones(len(page.nodes))))


def test_ten_thousand_mangled_pages():
    rng = random.Random(5)
    for i in range(10_000):
        html = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))
        text_of(html)
        if i % 10 == 0:
            contents(html)


@pytest.mark.parametrize("part", [
    "<blockquote>", "<div>", "<b>", "<ul><li>", "<!--", "<", "<![foo[", "<!doctype ", "&#", "<p>", "<a href='x'>", "<div a='", "</div", "<script>",
    "<script></scrip", "<table><tr><td>", "<title>", "<?", "<a ", "&amp", "<svg>", "<button>x", "<p a=", "</b>", "<a b=\"c' ", "&#9",
])
def test_time_grows_with_the_page(part):
    def seconds(size):
        html = part * (size // len(part))
        start = time.process_time()
        text_of(html)
        return time.process_time() - start

    small, large = seconds(50_000), seconds(400_000)
    assert large < max(24 * small, 1.0)


def test_a_megabyte_of_open_elements():
    start = time.process_time()
    text_of("<blockquote>" * (1_000_000 // 12))
    assert time.process_time() - start < 5


def test_declarations_and_marked_sections_are_skipped():
    assert text_of("<p>a</p><![foo[bar]]><p>b</p><!doctype x><?xml y?><!>c<!-- d -->e<!-->f") == "a b cef"
    assert text_of("1 < 2 <3 </ 4><p>x") == "1 < 2 <3 x"
    assert decoded("&#" + "9" * 6000 + "; &lt;b&gt; &eacute") == "� <b> é"


def test_text_behind_an_open_control_stays():
    assert text_of("<article>a<button>x<p>b</p></article>") == "a x b"
    assert text_of("<article>a<textarea>x<p>b</p></article>c") == "a x b c"
    assert text_of("<article>a<iframe src=x><p>b</p></article>") == "a b"
    assert text_of("<article>a <svg><p>b</p></article>") == "a b"
    assert text_of("<article>a<button>x</button>b<select><option>1<option>2</select>c<svg><text>q</text></svg>d</article>") == "a b c d"


def test_attributes():
    page = Page("<div class=post-content id='a b' hidden data-x=\"1>2\">x</div><p style='display: none'>y")
    marks = {node.tag: node.marks for node in page.nodes}
    assert marks["div"] == ("post", "content", "a", "b", "hidden") and marks["p"] == ("hidden",)
