"""Main text of pages: the parser, the cut against brute force, and what the cut changes against the hints alone."""

import re
import time

import numpy as np
import pytest

from tesserae.llm import html

LONG = "Some long paragraph of ordinary text, with several words in it, that reads as any article does; and goes on. "
PAGE = """<html><head><title>t</title><script>if (a<b) "</p>"</script><body><header><p>Site</p></header><nav><ul><li><a href=x>Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First <b>bold<br>text.<p>Second&nbsp;one, &copy; here.</p><div class="ad">Buy</div></article>
<div id="comments"><p>Nice post!</p></div><form><p>Mail</p></form><footer>&copy; x"""


def test_html():
    w = html.fit(*html.labelled([PAGE]))
    assert html.main_text(PAGE, w) == "A & B\n\nFirst bold text.\n\nSecond one, © here."
    assert html.main_text(None, w) == html.main_text("", w) == ""


@pytest.mark.parametrize(
    "page",
    ['<body class="single has-sidebar"><article><p>%s</p></article>', '<body class="menu-open"><main><p>%s</p></main>', '<div class="page with-comments"><article><p>%s</p></article></div>', "<p title=it's>%s</p>",
     '<div data-id="ad 3"><p>%s</p></div>', "<div><p>%s</p></div>", "<nav><a href=x>Home</a></nav><p>%s</p><form><p>Mail</p></form>", "<noscript><p>%s</p></noscript>", '<article><object data="x">%s</object></article>'],
)
def test_pages_keep_their_text(page):
    for w in (html.fit(*html.labelled([PAGE])), html.fit(*html.labelled([]))):
        assert html.main_text(page % LONG, w) == LONG.strip()


def test_text_of_controls_in_an_article_stays():
    assert html.main_text("<article><p>a<button>b</button>c", html.fit(*html.labelled([]))) == "abc"


def test_the_cut_overrules_hints():
    """A zone that a name calls boilerplate but that reads as the article between its parts comes in; adverts and comments do not."""
    page = "<article>" + f"<p>{LONG * 3}</p>" * 3 + '<div class="related-story">' + f"<p>{LONG * 3}</p>" * 8 + "</div>" + f"<p>{LONG * 3}</p>" * 3 + '<div class="ad">Buy this now, it is a cheap thing.</div><p>The end, yes.</p></article><div class="comments"><p>I like it, thanks.</p><p>Me too.</p></div><footer>&copy; x'
    pages = [PAGE, page] + [f'<nav><ul><li><a href=a>Home</a><li><a href=b>Work</a></ul></nav><div class="ad">Cheap things {i}.</div><article><h1>Title {i}</h1>{f"<p>{LONG}</p>" * 5}</article><footer>x {i}</footer>' for i in range(20)]
    w = html.fit(*html.labelled(pages[2:]))
    text = html.main_text(page, w)
    hinted = [b.text for b in html.blocks(page) if b.hint > 0]
    assert text.count("Some long") == 14 * 3 and len(hinted) == 7 and "Buy" not in text and "thanks" not in text
    assert all(html.main_text(p, w) == "\n\n".join(b.text for b in html.blocks(p) if b.hint > 0) for p in pages[2:])


def test_pages_without_names_are_told_apart():
    page = "<div><ul><li><a href=a>Home</a><li><a href=b>Work</a></ul></div><div>" + f"<p>{LONG}</p>" * 5 + "</div><div>x</div>"
    assert html.main_text(page, html.fit(*html.labelled([]))) == "\n\n".join([LONG.strip()] * 5)


def test_text_matches_a_plain_reading(spark):
    """Against a plain reading of the driver's pages: the article's markup taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from __spark_entry__ import queries

    got = {r.page_id: r for r in queries()["op7_mincut_html"](spark, "/root/testdata/sf0.001").collect()}
    squeeze = lambda t: re.sub(r"\s+", "", t)
    import html as entities

    for r in pages.collect():
        plain = entities.unescape(re.sub(r"<[^>]*>", "", re.search("<article>(.*)</article>", r.html, re.S)[1]))
        assert squeeze(got[r.page_id].text) == squeeze(plain) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_edges(spark):
    rows = [(1, None, None, "k"), (1, None, None, "k"), (2, "u", "", "k"), (3, "v", "<article>" + f"<p>{LONG}</p>" * 4000, "k"), (4, "w", "<p>" + "x" * 400_000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.url, len(r.text)) for r in html.extract(df).orderBy("page_id").collect()]
    assert got == [(1, None, 0), (1, None, 0), (2, "u", 0), (3, "v", 4000 * (len(LONG) - 1) + 3999 * 2), (4, "w", 400_000)]
    assert html.extract(df.limit(0)).count() == 0


def test_least_cut_is_least():
    r = np.random.default_rng(0)
    for _ in range(60):
        n = 7
        gain = r.normal(size=n).tolist()
        edges = {(i, j): float(r.random()) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        cost = lambda s: sum((g < 0) * -g if x else (g > 0) * g for g, x in zip(gain, s, strict=True)) + sum(c for (i, j), c in edges.items() if s[i] != s[j])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html.least_cut(gain, edges)) == pytest.approx(best)




def test_cut_of_many_weak_blocks_is_quick():
    r, n = np.random.default_rng(0), 20_000
    gain, edges = (r.normal(size=n) * 0.3).tolist(), {(i, i + 1): float(r.random()) for i in range(n - 1)}
    start = time.time()
    html.least_cut(gain, edges | {(i, i + 7): 0.4 for i in range(0, n - 7, 3)})
    assert time.time() - start < 30
