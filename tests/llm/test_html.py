import html as entities
import re
import time

import numpy as np
import pytest

from tidemark.llm import html
from tidemark.llm.queries import op2_html


def brute(page):
    """The text of the test pages' article element, cut at its block tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"</?b>", "", body).replace("<br>", " ")
    blocks = [" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages(spark, sf):
    path = f"/root/testdata/{sf}"
    got = {r.page_id: r for r in op2_html(spark, path).collect()}
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == brute(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


LONG = "This is a sentence of the article, with some commas, and it goes on. " * 4
AROUND = [
    ("<nav><a href=x>Home</a></nav>", "<footer>All rights. Reserved, of course.</footer>"),
    ('<header><h2>Site</h2></header><div class="cookie-notice">We use cookies, really. Accept them all, please.</div>', '<div id="comments"><p>' + LONG + "</p></div>"),
    ('<div class="sidebar"><p>Related story, which is long. ' + LONG + "</p></div>", "<form><p>Write to us. Name, please.</p><input></form>"),
    ("<!-- <p>no</p> --><script>if (a<b) document.write('<p>x</p>')</script><style>p>a{}</style>", '<div role="contentinfo">x. y. z.</div><aside>' + LONG + "</aside>"),
]


@pytest.mark.parametrize("before,after", AROUND)
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_what_stands_around(before, after, outer):
    page = f"<html><head><title>T</title></head><body>{before}<{outer}><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p><p>{LONG}<br>more&nbsp;&lt;b&gt;</p><ul><li>one<li>two</ul></{outer}>{after}</body></html>"
    assert html.main_text(page).split("\n\n") == ["Head & line", LONG.strip(), "Short.", LONG.strip() + " more <b>", "one", "two"]


def test_classes_that_speak_of_others():
    page = f'<body class="x"><div class="wrap has-sidebar"><div class="site-header"><p>{LONG}</p></div><article class="post no-comments"><div class="post-header"><h1>Title</h1></div><p>{LONG}</p><div class="cookiebar"><p>We use cookies, yes.</p></div></article></div>'
    assert html.main_text(page).split("\n\n") == ["Title", LONG.strip()]


def test_ratios_choose(monkeypatch):
    """Without article elements or telling names only the ratios know the article; flattened, they lose it."""
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><p>All rights</p></div></body>"
    want = ["Title", LONG.strip(), "Short.", LONG.strip()]
    assert html.main_text(page).split("\n\n") == want
    monkeypatch.setattr(html, "fused", lambda blocks: np.ones(len(blocks)))
    assert html.main_text(page).split("\n\n") != want


def test_names_of_sections_stay_where_the_ratios_pass():
    page = f'<body><div class="related-work"><ul><li><a href=x>More</a></li><li><a href=y>Still more</a></li></ul></div><article><h1>T</h1><p>{LONG}</p><section class="related-work"><h2>Related work</h2><p>{LONG}</p></section><div class="side-note"><p>{LONG}</p></div><section id="search-methods"><p>{LONG}</p></section><section class="discussion"><p>{LONG}</p></section></article></body>'
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip(), "Related work", *[LONG.strip()] * 4]


@pytest.mark.parametrize(
    "inner,text",
    [
        ('<p>a, b.<svg class="i"/> c</p><p>d</p>', "a, b. c\n\nd"),
        ("<p>a <svg><title>x</title><path/></svg>b</p>", "a b"),
        ("<p>a <svg>b</p><p>c</p>", "a b\n\nc"),
        ("<p><a title=it's href=x>one</a> two</p><p>it's</p>", "one two\n\nit's"),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> be</p>", "let x=1 be"),
        ("<p>a</p><noscript><p>b</p>", "a\n\nb"),
        ("<p>a</p><noscript>no</noscript><p>b</p>", "a\n\nb"),
        ("<p>&<b>lt;</b> &lt;b&gt;</p>", "&lt; <b>"),
        ("<p title=\"x>y\" data-a='z>\"'>a<br class=x/>b</p>", "a b"),
    ],
)
def test_markup(inner, text):
    assert html.main_text(f"<html><body>{inner}</body></html>") == text
    assert html.main_text(f"<html><body><nav><a href=x>Home</a></nav><article><p>{LONG}</p>{inner}</article></body></html>") == LONG.strip() + "\n\n" + text


@pytest.mark.parametrize("page,text", [("", ""), ("plain", "plain"), ("<", "<"), ("<p", ""), ("<p>a<p>b", "a\n\nb"), ("<article></article>", ""), ("a < b", "a < b"), ("<p>&#x41;&bogus;</p>", "A&bogus;"), ("<script>x", ""), ("<!-- x", ""), ('<div title="a>b">x. y</div>', "x. y"), ("</p></div>x", "x")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_long_pages_end():
    html.main_text("<div>" * 3000 + "x")
    html.main_text('<a "' * 3000)
    html.main_text("<p>word, " * 50_000)


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<p>a</p>", "t"), (2, "u", "", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in html.extract(df).collect()), key=repr) == sorted([(1, "u", "", 0), (None, None, "a", 1), (2, "u", "", 0), (2, "u", "", 0)], key=repr)
    assert html.extract(df.limit(0)).count() == 0


NAMES = "promoters menu copyright social consent navigation comments-on-method sponsor-history newsletter footer".split()


@pytest.mark.parametrize("name", NAMES)
def test_sections_of_an_article_are_not_judged_by_name(name):
    page = f'<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p><section id="{name}"><h2>Second</h2><p>{LONG}</p><p>{LONG}</p></section></article></body>'
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip(), "Second", LONG.strip(), LONG.strip()]


@pytest.mark.parametrize("name", ["comments", "comment-list", "user-comments", "commentlist", "disqus_thread", "post x comments-area"])
def test_what_readers_write_goes_wherever_it_stands(name):
    page = f'<body><article><h1>T</h1><p>{LONG}</p><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div></article></body>'
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip()]


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- a -- b -->", "<!-- <p>no</p> -->"])
def test_comments_end_where_they_end(comment):
    page = f"<article><p>{LONG}</p>{comment}<p>{LONG}</p><!-- x --></article>"
    assert html.main_text(page) == "\n\n".join([LONG.strip()] * 2)


def plain_ratios(blocks):
    """The fused ratios by plain loops over the blocks' texts and whole paths."""
    text, marks = [], []
    for _, path, *_ in blocks:
        own = [b for b in blocks if b[1] == path]
        text.append(sum(len(b[0]) - b[3] for b in own) / len(own))
        marks.append(sum(ch in ".,;:!?。，！？¿¡" for b in own for ch in b[0]) / len(own))
    near = lambda x, i: sum(w * x[min(max(i + k, 0), len(x) - 1)] for k, w in zip(range(-2, 3), (0.1, 0.2, 0.4, 0.2, 0.1), strict=True))
    return [near(text, i) * (1 + near(marks, i)) for i in range(len(blocks))]


def test_ratios_against_plain_loops_and_their_weight(spark, monkeypatch):
    """The ratios are those of plain loops; where links stand in the articles of the given pages, they take these out."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages[:80]:
        blocks = html._Page(page).blocks
        assert html.fused(blocks) == pytest.approx(plain_ratios(blocks))
    links = '<div class="promo"><ul>' + "".join(f"<li><a href=/{i}>More {i}</a></li>" for i in range(6)) + "</ul></div>"
    wide = [p for p in pages if len(brute(p)) > 300 and "</p>" in re.search(r"<article>(.*?)</article>", p, re.S)[1]]
    made = [re.sub(r"(<article>.*?</p>)", lambda m: m[1] + links, p, count=1, flags=re.S) for p in wide]
    assert len(made) > 100
    right = sum(html.main_text(m) == brute(p) for m, p in zip(made, wide, strict=True))
    monkeypatch.setattr(html, "fused", lambda blocks: np.ones(len(blocks)))
    flat = sum(html.main_text(m) == brute(p) for m, p in zip(made, wide, strict=True))
    assert (right, flat) == (len(made), 0)


def test_deep_pages_with_many_blocks():
    began = time.time()
    html.main_text("<div>a" * 100_000)
    assert time.time() - began < 20
