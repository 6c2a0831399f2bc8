"""Main text against the standard library's parser, broken markup in linear time, templates inside articles."""

import random
import time
from html.parser import HTMLParser

import pytest

from lodestone.llm import html_text

BLOCKS = {"article", "body", "div", "footer", "h1", "h2", "html", "li", "nav", "p", "section", "ul"}


class Plain(HTMLParser):
    """Text of the article element: blocks joined by spaces, scripts, styles and adverts left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.parts = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.skip or tag in ("script", "style") or dict(attrs).get("class") == "ad":
            self.skip.append(tag)
        if tag in BLOCKS or tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        self.inside -= tag == "article"
        if tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def test_pages_equal_the_standard_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        p = Plain()
        p.feed(source[r.page_id])
        p.close()
        assert r.text == " ".join("".join(p.parts).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "html",
    [
        "<div " + 'a="b" ' * 200,
        "<div " + 'a="b ' * 201,
        "<p>x</p><div " + "a='b\" " * 200,
        "<b>" * 8000 + "</i>" * 8000,
        "<a " * 300_000,
        '<a href="' * 100_000,
        "<b>" * 300_000,
        "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
        "<title>" * 140_000,
        "<!--" * 250_000,
        "<svg>" * 100_000,
        "< " * 500_000,
        "<li><p>" * 100_000 + "</ul>" * 100_000,
    ],
)
def test_broken_markup_takes_linear_time(html):
    start = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - start < 10  # a quadratic scan takes minutes


def test_truncated_pages():
    assert html_text.main_text("<p>kept</p><div " + 'a="b" ' * 20) == "kept"
    assert html_text.main_text("<p>kept</p><!-- never ends <p>x") == "kept"
    assert html_text.main_text("<p>kept</p><script>x<p>y") == "kept"
    assert html_text.main_text("<textarea>a <p>b") == "a b"
    assert html_text.main_text("x < y and y <z") == "x < y and y <z"


def test_names_that_are_topics():
    stays = "<main><div class='related-work'>a</div><section id=discussion><h2>Discussion</h2><p>b</p></section><div class='search-algorithms'>c</div><section id=privacy><h2>P</h2><p>d</p></section></main>"
    assert html_text.main_text(stays) == "a Discussion b c P d"
    assert html_text.main_text("<p>x <em class=ad>a</em> <a class=share-price href=x>b</a> <span id=form>c</span>") == "x a b c"
    goes = "<article>t<div class='privacy'>We use cookies</div><div id=search>s</div><div class='related-posts'><h3>More</h3><p>m</p></div><section id=comments><h2>C</h2><p>c</p></section><div class='cookieBanner'>k</div></article>"
    assert html_text.main_text(goes) == "t"
    assert html_text.main_text("<div class='entry-header'><h1>T</h1></div><div class='site-header'>s</div><p>x") == "T x"


def test_words_are_not_split():
    assert html_text.main_text("<p>foo<img src=x>bar f<wbr>o <svg/>b<svg><g/></svg>c e<br>f</p>") == "foobar fo bc e f"


def test_unclosed_boilerplate_keeps_the_article():
    assert html_text.main_text("<body><div class=ad>Buy<article><p>one</p></article></body>") == "one"
    assert html_text.main_text("<article>a</article><footer>b") == "a"
    assert html_text.main_text("<p>a</p><footer>b") == "a"


def test_notices_inside_articles_go_by_their_count(spark):
    notice = "<div><p>Subscribe now to our newsletter today</p></div>"
    body = lambda i: f"<p>Story {i} tells of number {i * 7} and of {i * 11} more.</p>"
    rows = [(i, "http://n.com/", f"<article><h1>Same head</h1>{body(i)}{notice}</article>") for i in range(10)]
    copied = "<p>A paragraph that all copies share, quite long.</p><p>Another shared one, long too.</p>"
    rows += [(100 + i, "http://c.com/", f"<article>{copied}<p>Copy {i}</p></article>") for i in range(10)]
    rows += [(200 + i, "http://few.com/", f"<article>{body(i)}{notice if i < 3 else ''}</article>") for i in range(10)]
    clash = [(*r, "a", ["b"], "c", 1, "d") for r in rows]
    df = spark.createDataFrame(clash, "page_id long, url string, html string, host string, templates array<string>, __host string, __in0 int, everywhere string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[3].text == "Same head Story 3 tells of number 21 and of 33 more."
    assert got[104].text == "A paragraph that all copies share, quite long. Another shared one, long too. Copy 4"
    assert got[201].text.endswith("Subscribe now to our newsletter today")
    assert (got[3].host, got[3].templates, got[3]["__host"], got[3]["__in0"], got[3].everywhere) == ("a", ["b"], "c", 1, "d")


def test_templates_equal_brute_force(spark):
    """Pages of blocks without article: a block (tag and words) on 4 pages and 20 % of its host's goes."""
    rng = random.Random(3)
    pages = []
    for i in range(200):
        own = [f"<div><p>Own text {i} {j} of some length</p></div>" for j in range(6)]
        common = [f"<div><p>{rng.choice('abcdefgh')}</p></div>" for _ in range(2)]
        blocks = own + common
        rng.shuffle(blocks)
        pages.append((i, f"h{rng.randrange(4)}", blocks))
    df = spark.createDataFrame([(i, f"http://{h}/x", "<body>" + "".join(b) + "</body>") for i, h, b in pages], "page_id long, url string, html string")
    size, seen = {}, {}
    for _, h, blocks in pages:
        size[h] = size.get(h, 0) + 1
        for b in set(blocks):
            seen[h, b] = seen.get((h, b), 0) + 1
    gone = {k for k, n in seen.items() if n >= 4 and n >= 0.2 * size[k[0]]}
    assert gone and len(gone) < len({k for k in seen if len(k[1]) < 30})
    want = {i: " ".join(b.replace("<div><p>", "").replace("</p></div>", "") for b in blocks if (h, b) not in gone) for i, h, blocks in pages}
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == want
