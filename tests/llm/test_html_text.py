import html
import re

import numpy as np
import pytest

from plumbline.llm import html_text, registry

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><div class="logo">My site</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-notice"><p>This site uses cookies. <button>OK</button></p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph,
 with <b>bold</b> and <a href="/y">a link</a> in it, and enough words to read.<br>Next line.</p><!-- no <p>comment</p> --><div class="ad">Buy this thing now</div>
<p>Second paragraph &lt;here&gt;, which is also quite long, as paragraphs of articles are.<script>var x="</p>";</script></p><ul><li>One point of the list<li>Another point of the list</ul></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I like this article very much, thank you.</p></div></section>
<aside><p>Related things to read</p></aside><form><label>Name</label><input><select><option>A<option>B</select></form>
<footer>&copy; example.com</footer></body></html>"""
TEXT = "Title & more\n\nFirst paragraph, with bold and a link in it, and enough words to read. Next line.\n\nSecond paragraph <here>, which is also quite long, as paragraphs of articles are.\n\nOne point of the list\n\nAnother point of the list"


def reference(page):
    """The article element's text of the tables' own pages, by plain string work."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"<script>.*?</script>|<!--.*?-->", "", body, flags=re.S)
    parts = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", body)
    return "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<br>", " ", x) if "<" not in re.sub(r"<br>|</?b>|</?a[^>]*>", "", x) else x).replace("<b>", "").split()) for x in parts) if t)


def test_query_on_the_tables_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.op4_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    right = sum(r.text == reference(pages[r.page_id].html) for r in got)
    assert right / len(got) > 0.98
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_page_with_everything(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "plain words only"), (4, "w", "plain words only"), (5, "x", "<p" * 3000), (6, "y", "<div>" * 2000 + "deep"), (7, "z", "<script>never closed <p>x</p>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=str)
    assert (1, TEXT) in got and (2, "") in got and (None, "") in got and (7, "") in got
    assert len(got) == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0


def test_held_out_accuracy_on_generated_pages():
    rng = np.random.default_rng(2024)
    model, right, total = html_text.train(), 0, 0
    for _ in range(150):
        b, y = html_text.labelled(html_text.generated(rng))
        if b:
            right += int((model.label([b])[0] == (y > 0)).sum())
            total += len(y)
    assert right / total > 0.97


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = html_text.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.standard_normal((2, 3, html_text.INPUT)), np.array([[1, 1, 1], [1, 1, 0]], float)
    y = np.array([[1, 0, 1], [0, 1, 0]], float)
    _, g = model.gradients(x, mask, y)
    for k in ("Wf", "Ub", "V", "bf"):
        at = tuple(0 for _ in model.p[k].shape)
        old, eps = model.p[k][at], 1e-3
        model.p[k][at] = old + eps
        up, _ = model.gradients(x, mask, y)
        model.p[k][at] = old - eps
        down, _ = model.gradients(x, mask, y)
        model.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=1e-5)


LONG = "A paragraph of the article that is long enough to be read, with more than a few words in it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # quotes of another kind, stray and open ones
        (f"<p><img alt='15\" screen'>{LONG}</p><p class=\"b\">Next</p>", [LONG, "Next"]),
        (f'<p><a href="x"">link</a> {LONG}</p><p class="b">Next</p>', [f"link {LONG}", "Next"]),
        (f'<p><a href="x>link</a> {LONG}</p><p>He said "yes" to it</p><p class="b">Next</p>', [f"link {LONG}", 'He said "yes" to it', "Next"]),
        (f'<p><a href="x>link</a> {LONG}</p><p class="b">Next</p>', [f"link {LONG}", "Next"]),
        (f"<p><a href=x?y='z>link</a> {LONG}</p><p class='b'>Next</p>", [f"link {LONG}", "Next"]),
        (f'<p><a href="x>link</a> {LONG}</p><p>Next</p>', [f"link {LONG}", "Next"]),
        # a > in a value is the value's
        ("<p title=\"a > b\" class='c > \"d'>One</p><p data-x='{\"k\": \"<b>\"}'>Two</p><img alt=\"x > y\"/>Three", ["One", "Two", "Three"]),
        ('<!DOCTYPE html PUBLIC "-//W3C//DTD>One<p class="x">Two</p>', ["One", "Two"]),
        # drawings and formulas
        (f'<p>Icon <svg class="i"/> {LONG}</p><p>Next</p>', [f"Icon {LONG}", "Next"]),
        (f"<p>Sum <math/> {LONG}</p><p>Next</p><svg></svg>", [f"Sum {LONG}", "Next"]),
        (f'<p>Icon <svg><g><path d="M0"/><title/><text>no</text></g></svg> {LONG}</p>', [f"Icon {LONG}"]),
        (f"<div>One<svg><path d=x></div><p>{LONG}</p>", ["One", LONG]),
        (f"<div>One<svg><path d=x><p>{LONG}</p></div>", ["One", LONG]),
        ("<div>One<svg><foreignObject><p>no</p></foreignObject><svg/>no</svg>Two</div>", ["OneTwo"]),
        # a head that is not closed
        (f"<html><head><title>no</title><meta charset=x><link rel=y><p>{LONG}</p><p>Next</p>", [LONG, "Next"]),
        (f"<head><title>no</title><style>no</style>\n{LONG}<p>Next</p>", [LONG, "Next"]),
        (f"<head><title>no</title>{LONG}", [LONG]),
        ("<head><title>no</title></head><body><p>One</p></body>", ["One"]),
        ("<head><script>no</script><body>One", ["One"]),
    ],
)
def test_malformed_markup_swallows_no_text(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_open_quotes_take_linear_time():
    from time import perf_counter

    def took(n):
        t = perf_counter()
        assert len(html_text.blocks("<p a='x>y" * n + "<p a=\"x>y" * n)) >= n
        return perf_counter() - t

    took(1000)
    assert took(40_000) < 20


def test_odd_pages_keep_their_article(spark):
    odd = [PAGE.replace("<article>", "<article><img alt='15\" screen'>"), PAGE.replace('<a href="/y">', '<a href="/y"">'), PAGE.replace("<h1>", "<h1><svg/>"), PAGE.replace("</head><body>", "")]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(odd)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == dict.fromkeys(range(4), TEXT)
