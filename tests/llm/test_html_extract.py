import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from graphloom.llm import html_extract

SCHEMA = "page_id long, url string, html string, text string, row string, n_chars long"
NOISE = "Log in now. Buy this, buy that. More text here, and more; and even more of it than the article has itself."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, expected",
    [
        (f"<nav><a>{NOISE}</a></nav><article><h1>Head</h1><p>One &amp; two\n three.<p>x<br>y</article><footer>{NOISE}</footer>", "Head\nOne & two three.\nx y"),
        (f"<header>{NOISE}</header><div class='content'><h1>Head</h1><p>First line, long enough. Yes.</p><ul><li>a</li><li>b</li></ul></div><div class='side-bar sidebar'>{NOISE}</div>", "Head\nFirst line, long enough. Yes.\na\nb"),
        (f"<main><article><p>Text one.</p><p>Text <a href='#'>two</a>.</p></article><section id=comments><p>{NOISE}</p></section></main>", "Text one.\nText two."),
        (f"<article><p>A.</p><aside>{NOISE}</aside><form>{NOISE}</form><div class='cookie-notice'>{NOISE}</div><p>B.</p></article>", "A.\nB."),
        (f"<article><header class='entry-header'><h1>Head</h1></header><p>Body.</p><div class='adBox'>{NOISE}</div></article><div role=alert>{NOISE}</div>", "Head\nBody."),
        ("<p>only</p>", "only"),
        ("<article><p><b>Open one.<br><p>&#233;&copy;&am", "Open one.\né©&am"),
        ("<article><p>1 < 2 and a<b c</p><!-- <p>no</p> --><p>end", "1 < 2 and a\nend"),
        (f"<div class='ad'>{NOISE}</div>", ""),
        ("<div><div><h2>H</h2><p>para one, and so on.</p></div><div><p>para two, and so on, and on.</p></div></div>", "H\npara one, and so on.\npara two, and so on, and on."),
    ],
)
def test_article_only(body, expected):
    assert html_extract.extract(page(body)) == expected


LINES = [f"Line {i}, of some length. " + "w " * 140 + "end." for i in range(12)]


@pytest.mark.parametrize(
    "before, after",
    [
        (f"<div class='intro'><p>{LINES[10]}</p></div>", ""),
        ("", f"<div class='more'><h2>More</h2><p>{LINES[10]}</p></div>"),
        (f"<div class='left'><p>{LINES[10]}</p><p>Short.</p></div>", f"<section><p>{LINES[11]}</p></section>"),
        (LINES[10], ""),
    ],
)
def test_nothing_beside_the_weightiest_element_is_lost(before, after):
    text = "".join(f"<p>{x}</p>" for x in LINES[:10])
    body = f"<div>{before}<div class='text'>{text}</div>{after}</div>"
    plain = re.sub("<[^>]*>", "\n", before + text + after).split("\n")
    assert html_extract.extract(page(f"{body}<footer>{NOISE}</footer>")).split("\n") == [x for x in plain if x]


def test_long_page_stays_whole():
    body = "<article>" + "".join(f"<p>Line {i}, of many. " + "w " * 40 + "</p>" for i in range(5000)) + "</article>"
    assert len(html_extract.extract(page(body)).split("\n")) == 5000
    assert html_extract.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


class Brute(HTMLParser):
    """Leaves of a well-formed page with their tag paths, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.leaves, self.blocks = [], [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK:
            self.blocks.append([])
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.blocks.append([])
        assert self.open.pop() == tag

    def handle_data(self, data):
        if data.strip():
            self.blocks[-1].append(("/".join(self.open), data.strip()))


def well_formed(rng, plain=False):
    words = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    text = lambda n: words(n) if plain or rng.random() < 0.5 else f"{words(n)} <b>{words(2)}</b> {words(3)} <a href='x'>{words(2)}</a>"
    body = "".join(f"<p>{text(rng.randrange(25, 80))}</p>" for _ in range(rng.randrange(4, 9)))
    menu = "".join(f"<li><a href='/{i}'>{words(1)}</a></li>" for i in range(8))
    return f"<html><body><div><ul>{menu}</ul></div><div>{words(7)}</div><div><h1>{words(6)}</h1>{body}</div><div>{words(8)}</div></body></html>"


def test_path_ratios_by_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        source = well_formed(rng)
        parser = Brute()
        parser.feed(source)
        lines = [b for b in parser.blocks if b]
        total = defaultdict(lambda: [0, 0, 0])
        for line in lines:
            held = defaultdict(list)
            for path, text in line:
                held[path].append(text)
            for path, texts in held.items():  # a path's texts in a block are one leaf
                own = total[path]
                own[0] += sum(map(len, texts))
                own[1] += sum(c in ".,;:!?" for t in texts for c in t)
                own[2] += 1
        page_ = html_extract.blocks(source)
        length, stops = html_extract.path_ratios(page_)
        assert [t.split() for t in page_.texts] == [" ".join(t for _, t in line).split() for line in lines]
        for k, line in enumerate(lines):
            size = sum(len(t) for _, t in line)
            for found, j in ((length, 0), (stops, 1)):
                assert found[k] == pytest.approx(sum(len(t) / size * total[p][j] / total[p][2] for p, t in line))


def main_text(source):
    return re.search(r"<div>(<h1>.*?</p>)</div>", source).group(1)


def test_pages_without_names_are_told_by_their_ratios(monkeypatch):
    rng = random.Random(6)
    pages = [well_formed(rng, plain=True) for _ in range(60)]
    expected = [re.sub(r"<[^>]*>", "", main_text(p).replace("</h1>", "\n").replace("</p>", "\n")).strip() for p in pages]
    got = [html_extract.extract(p) for p in pages]
    assert sum(a == b for a, b in zip(got, expected)) >= 57
    scores = html_extract.path_scores
    monkeypatch.setattr(html_extract, "path_scores", lambda p, *_: np.ones(len(p.texts)))
    assert sum(html_extract.extract(p) != e for p, e in zip(pages, got)) >= 57
    monkeypatch.setattr(html_extract, "path_scores", lambda *a: scores(*a)[::-1])
    assert sum(html_extract.extract(p) != e for p, e in zip(pages, got)) >= 50


def test_links_in_an_article_are_told_by_their_ratios(monkeypatch):
    links = "".join(f"<li><a href='{i}'>to page {i}</a></li>" for i in range(30))
    lines = "".join(f"<p>{x}</p>" for x in LINES)
    source = page(f"<div>{lines}<div><ul>{links}</ul></div></div>")
    assert html_extract.extract(source) == "\n".join(LINES)
    monkeypatch.setattr(html_extract, "path_scores", lambda p, *_: np.ones(len(p.texts)))
    assert "to page 7" in html_extract.extract(source)


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<p it's>First…</p><p>…don't > stop.", "First…\n…don't > stop."),
        ('<p>z <a title="x>y</p><p>more', "z y\nmore"),
        ("<p title='a > b' x=\"'\">in", "in"),
        ("<p>a <!-- b --> c <!--> d <?php e ?> f </ g> h", "a c d f h"),
        ("<p>2 <3 and 4<5, a & b &amp; c &#x41;&nosuch;", "2 <3 and 4<5, a & b & c A&nosuch;"),
        (f"<article><div>{LINES[0]}</div><div><p>Tags: x</p></div><div><ul><li><a>l</a></li></ul></div></article>", f"{LINES[0]}\nTags: x"),
        (f"<form><main><p>{LINES[0]}</p></main></form>", LINES[0]),
        ("<div title='class=ad'><p>kept, as it is no class.</p></div>", "kept, as it is no class."),
    ],
)
def test_tags_by_the_rules_of_html(body, expected):
    assert html_extract.extract(page(body)) == expected


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "deep text", "<ul><li>" * 100_000 + "x", "<p it's>hello " * 100_000, '<a title="x>y ' * 100_000, "<a " * 200_000, "<b>" * 200_000 + "x" + "</b>" * 200_000, "<!--" * 100_000, "<div><p>a b." * 50_000, "<p a='>" * 100_000 + ">z"])
def test_time_grows_in_proportion(source):
    def run(n):
        start = time.process_time()
        html_extract.extract(source[:n])
        return time.process_time() - start

    small, large = run(len(source) // 8), run(len(source))
    assert large < 5 and large < 24 * small + 0.3


def test_rows(spark):
    rows = [(1, "u", page("<p>a</p>"), "t", "r", 5), (1, "u", page("<p>a</p>"), "t", "r", 5), (None, None, None, None, None, None), (2, "", "", "", "", 0)]
    got = sorted(tuple(r) for r in html_extract.query(spark.createDataFrame(rows, SCHEMA)).fillna({"page_id": 0, "url": ""}).collect())
    assert got == [(0, "", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0)]
    assert html_extract.query(spark.createDataFrame([], SCHEMA)).count() == 0
