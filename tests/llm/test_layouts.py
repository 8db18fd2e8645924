"""The article of a page whatever holds it: the given pages in other layouts, short articles, unclosed elements."""

import html
import re

import pyarrow.parquet as pq
import pytest

from peakfold.llm import htmltext

PAGES = [p for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if p and "<article>" in p]
WORDS = "Some plain sentence with quite a few words in it that goes on for a while until it is about done now."
MENU = '<ul class="menu"><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About</a></li></ul>'


def inside(page, change):
    a, b = page.find("<article>"), page.find("</article>")
    return page[:a] + change(page[a:b]) + page[b:]


def paragraphs(text, wrap, count=0):
    return re.sub(r"<p>(.*?)(?=<p>|</article>|$)", lambda m: wrap("<p>" + m[1].replace("</p>", "") + "</p>"), text, count=count, flags=re.S)


def shell(start, stop):
    return lambda page: page.replace("<article>", start).replace("</article>", stop)


CHANGES = {
    "as it is": lambda page: page,
    "boxed paragraphs": lambda page: inside(page, lambda t: paragraphs(t, lambda p: f"<div>{p}</div>")),
    "no article element": shell("", ""),
    "an unknown class": shell('<div class="k3">', "</div>"),
    "a bare div": shell("<div>", "</div>"),
    "main": shell("<main>", "</main>"),
    "a note": lambda page: inside(page, lambda t: paragraphs(t, lambda p: f'<div class="note">{p}</div>', 1)),
    "a callout": lambda page: inside(page, lambda t: paragraphs(t, lambda p: f'<section class="callout">{p}</section>', 1)),
}


def plain_article(page):
    """The blocks of the article element of the given pages: headings and paragraphs, tags dropped."""
    text = page[page.find("<article>") : page.find("</article>")]
    text = re.sub(r'<(aside|div|form|nav|section|ul|footer)\b.*?</\1>', "", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", text, flags=re.S), flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|article)\b[^>]*>", text)
    return "\n".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in blocks) if b)


@pytest.mark.parametrize("name", CHANGES)
def test_layouts(name):
    model = htmltext.default_model()
    same = sum(htmltext.extract(CHANGES[name](p), model) == plain_article(p) for p in PAGES)
    assert same >= 0.99 * len(PAGES)


@pytest.mark.parametrize("body", [f"<article><p>{WORDS}</p></article>", f"<main><p>{WORDS}</p></main>", f"<main><p>{WORDS}</p><p>{WORDS}</p></main>", *(f'<div class="qx">{f"<p>{WORDS}</p>" * k}</div>' for k in (2, 3, 6)), f"<p>{WORDS}</p>"])
def test_short_articles(body):
    page = f"<html><head><title>t</title></head><body>{MENU}{body}<footer>&copy; example.net all rights reserved</footer></body></html>"
    assert htmltext.extract(page, htmltext.default_model()) == "\n".join([WORDS] * body.count(WORDS))


@pytest.mark.parametrize("page,blocks", [
    ("<p>a b<button>Go</p><p>rest of it</p>", ["a b Go", "rest of it"]),
    ("<p>one <button>Go</button> two</p>", ["one two"]),
    ("<p>x <canvas>no</p><p>y</p><select><option>1<p>z</p>", ["x no", "y", "1", "z"]),
    ("<p>let <math><mi>x</mi></math> be</p>", ["let x be"]),
    ("<svg><title>t</title></svg><p>k</p>", ["k"]),
    ("<select><option>1<option>2</select><p>k</p>", ["k"]),
    ("<p>a<noscript><p>b</p></noscript>c</p>", ["a c"]),
    ("<template><template>x</template>y</template>z", ["z"]),
    ("<template><template>x</template>y<p>z</p>", ["y", "z"]),
    ("<svg><svg>x</svg>y</svg><p>z</p>", ["z"]),
])
def test_elements_that_hide_their_text_end_somewhere(page, blocks):
    assert [b for _, b in htmltext.parse(page)[1]] == blocks


@pytest.mark.parametrize("tag", sorted(htmltext.SILENT - set(htmltext.RAW)))
def test_no_unclosed_element_takes_the_rest(tag):
    page = f"<article><p>{WORDS}</p><{tag}><p>{WORDS}</p></article>"
    assert [b for _, b in htmltext.parse(page)[1]].count(WORDS) == 2
    assert len(htmltext.parse(f"<{tag}>x" * 2000 + f"<p>{WORDS}</p>")[1]) >= 1
