import time
import html
import itertools
import random
import re

from pricelattice.llm.html_mincut import blocks, extract, main_text, min_cut


def test_min_cut_matches_enumeration():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 8)
        scores = [rng.choice([0, 1, -1]) * rng.randrange(0, 9) + rng.random() for _ in range(n)]
        edges = [(a, b, rng.random() * 4) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(x):
            own = sum(max(s, 0) if not v else max(-s, 0) for s, v in zip(scores, x, strict=True))
            return own + sum(w for a, b, w in edges if x[a] != x[b])

        assert abs(cost(min_cut(scores, edges)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home-page">
<header><div class=logo>Site name</div></header><div id="cookie-notice"><p>We use cookies. Please accept all of them now.</p></div>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<main><article><header><h1>Big &amp; bold</h1></header><p>First <b>para</b>graph&nbsp;here<br>goes on.<p>Is.
<div class="advert"><p>Buy this wonderful thing today for only nine pounds.</p></div>
<script>var x = "<p>no</p>";</script><p>Last one, with a <a href=x>link</a> inside.</p><!-- gone --></article>
<form><p>Enter your name to go on with all of this.</p><input></form></main>
<aside><p>Other stories that you may want to read on this site.</p></aside>
<section class="comments"><p>I really liked this article, it is the best one of all.</p></section>
<footer>&copy; us</footer></body>"""


def test_page_parts():
    assert main_text(PAGE) == "Big & bold First paragraph here goes on. Is. Last one, with a link inside."


def test_plain_page_without_article():
    text = " ".join(f"word{k}," for k in range(40))
    page = f'<body><div class="menu"><a href=x>One</a> <a href=y>Two</a></div><div><p>{text}</p><p>{text}</p></div><div id=footer>c</div>'
    assert main_text(page) == f"{text} {text}"


def test_edges(spark):
    schema = "page_id long, html string, text string, n_chars int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (3, "<", None, None), (None, "<article><p>a<p>b", "", 0)]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "a b", 3), (1, "", 0), (2, "", 0), (2, "", 0), (3, "<", 1)]
    assert extract(spark.createDataFrame([], schema)).collect() == []
    assert len(main_text("<article>" + "<p>word and word" * 20_000)) > 200_000


def test_pages_table(spark):
    """Against the plain reading of these pages: the article element, block by block."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.sub(r"<!--.*?-->", "", r.html.split("<article>", 1)[1].split("</article>")[0], flags=re.S)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<b>", ""))]
        assert main_text(r.html) == " ".join(x for x in want if x)


def test_unclosed_tags_take_linear_time():
    for page in ("<a " * 100_000, "<p>x" + "<a href=" * 50_000, "<a title='" * 50_001, "<!--" * 50_000, "<script>" * 50_000, "<" * 200_000):
        began = time.time()
        main_text("<article><p>kept</p></article>" + page)
        assert time.time() - began < 5
    assert main_text("<article><p>kept <a title='>' x=\">\">b</a></p></article><a ") == "kept b"


def test_names_that_hold_a_listed_word():
    p = "<p>Taken with food this rarely does any harm to adults at all.</p>"
    assert main_text(f'<article><div class="side-effects">{p}</div></article>').startswith("Taken")
    assert main_text('<article><p class="notice-board-topic">Boards were hung in every hall.</p></article>').startswith("Boards")
    assert main_text("<div>Hello world</div>") == "Hello world"
    for name in ("sidebar", "comments", "comment-list", "ad", "footer-links", "notice"):
        assert main_text(f'<article><p>Kept words of the main article text here.</p></article><div class="{name}">{p}</div>').startswith("Kept")
        assert "Taken" not in main_text(f'<article><p>Kept words of the main article text here.</p></article><div class="{name}">{p}</div>')


def test_no_name_outweighs_an_article_alone():
    p = "<p>The town has had clubs and unions since the war, and their halls still stand today.</p>"
    assert main_text('<article><p class="social-history">Clubs and unions met in the halls of the town since the war.</p></article>').startswith("Clubs")
    assert main_text(f'<article><div class="related">{p}</div></article>').startswith("The town")
    assert main_text(f'<main><section id="share-prices">{p}</section></main>').startswith("The town")
    assert main_text(f'<article><div class="adHoc comment-culture">{p}</div></article>').startswith("The town")
    links = '<h3>Related</h3><ul><li><a href=x>One story</a></li><li><a href=y>Two stories here</a></li></ul>'
    for name, inside in (("related", links), ("share", "<span>Share this</span>"), ("post-comments", p), ("ad-slot", p), ("commentList", p), ("site-footer", p)):
        assert main_text(f'<article>{p}<div class="{name}">{inside}</div></article>') == main_text(f"<article>{p}</article>")


def test_deep_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 30_000 + "x" + "</section>" * 30_000, "<div>" * 30_000 + "<li>x</li>" * 30_000, "<ul><li>" * 20_000 + "</b>" * 20_000):
        blocks(page)
    assert time.time() - began < 20
    assert [b.text for b in blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<th>f<tr><td>g</table>")] == list("abcdefg")
