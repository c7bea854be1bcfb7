"""Main text of pages whose text is known: by hand, or because the page is made around it."""

from __future__ import annotations

import html
import random

import pytest
from millrace.llm import html_text, queries
from millrace.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class=ad>Buy now<p>really</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text.<p>Second&nbsp;one<br>third</p><aside>Side</aside><div class="advert">Ad</div><form>Name <input></form><p>Last &lt;p&gt;.</p>
</article><section id="comments"><p>A comment that is long enough to look like text.</p></section><footer>&copy; me</footer></body></html>"""
LONG = "A paragraph of the article, long enough for the windowed sum to surge without any help from an element. "


def test_a_page():
    assert main_text(PAGE) == "Head & line\nFirst bold text.\nSecond one\nthird\nLast <p>."
    plain = PAGE.replace("<article>", "<div class='post'>").replace("</article>", "</div>")
    assert main_text(plain) == main_text(PAGE)
    assert main_text("") == main_text("<div></div>") == "" and main_text("just text") == "just text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One.</p><h2 id='related-work'>Related work</h2><p class='market-share'>Share.</p></article>", "One.\nRelated work\nShare."),
        ("<article><p>One.</p><div class='note notice'>A note.</div></article>", "One.\nA note."),
        ("<div class='content with-sidebar'><p>Body.</p></div>", "Body."),
        ("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>", "We have x=2 here."),
        ("<article><p>One <script>x</script>and <button>Go</button>two.</p></article>", "One and two."),
        ("<article><p>Body.</p><div class='user-feedback'><p>I disagree.</p></div></article>", "Body."),
        ("<article><p>Body.</p><article><p>A reader's comment.</p></article></article>", "Body."),
        (f"<main><article><h1>T</h1><p>{LONG}</p></article><article class='card'><h3><a href='x'>Another story</a></h3><p>Short.</p></article></main>", f"T\n{LONG.strip()}"),
        ("<aside><article>A teaser.</article></aside><article><p>Body.</p></article>", "Body."),
        ("<nav><ul><li>Menu<article><p>Body.</p></article><footer>f</footer>", "Body."),
        (f"<main><h1>Title</h1><article><p>{LONG}</p></article><p>After.</p></main>", f"Title\n{LONG.strip()}"),
        ("<article><p>One.</p><ul><li><a href='a'>x</a></li><li><a href='b'>y</a></li><li><a>z</a></li><li><a>v</a></li></ul><p>Two.</p></article>", "One.\nx\ny\nz\nv\nTwo."),
    ],
)
def test_kinds(page, text):
    assert main_text(page) == text


def made(rng: random.Random, article: bool) -> tuple[str, str]:
    """A page around a known text."""
    words = lambda n: " ".join("".join(rng.choice("abcdeiou&<é") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    title, paragraphs = words(rng.randrange(2, 9)), [words(rng.randrange(20, 90)) for _ in range(rng.randrange(1, 9))]
    if article and rng.random() < 0.3:
        paragraphs = [words(rng.randrange(1, 3)) for _ in range(rng.randrange(0, 3))]
    body = [f"<h1>{html.escape(title)}</h1>"]
    for p in paragraphs:
        body.append(f"<p>{html.escape(p)}" + rng.choice(["</p>", "", "</p>\n\n"]))
        body.append(rng.choice(["", "<!-- x -->", "<div class='ad'>Buy me</div>", "<aside>See also this</aside>", "<form><input name=q> Find</form>"]))
    inner = "".join(body)
    menu = "<nav>" + "".join(f"<li><a href='/{i}'>{words(1)}</a>" for i in range(6)) + "</nav>"
    links = "".join(f"<div><a href='/{i}'>{html.escape(words(2))}</a></div>" for i in range(rng.randrange(4, 9)))
    inner = f"<article>{inner}</article>" if article else f"<div id=c>{inner}</div>"
    return f"<html><body>{menu}{links}{inner}{links}<div class='comments'><p>{html.escape(words(60))}</p></div><footer>{words(9)}</footer></body></html>", "\n".join([title, *paragraphs])


@pytest.mark.parametrize("article", [True, False])
def test_made_pages(article):
    rng = random.Random(5)
    pages = [made(rng, article) for _ in range(300)]
    assert sum(main_text(p) == t for p, t in pages) >= 297


def plain_runs(weight, window, surge):
    """runs() as the docstring says it, sum by sum."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    high = min(surge, (max(sums, default=0) + 1) // 2)
    out, at = [], 0
    while at < len(weight):
        if sums[at] and sums[at] >= high and weight[at]:
            first = at
            while first > 0 and first > at - window and weight[first - 1]:
                first -= 1
            dive = next((j for j in range(at, len(weight)) if not sums[j]), len(weight))
            out.append((first, max(j for j in range(at, dive) if weight[j])))
            at = dive
        else:
            at += 1
    return out


def test_runs():
    rng = random.Random(6)
    for _ in range(500):
        weight = [rng.choice([0, 0, 0, rng.randrange(40), rng.randrange(200)]) for _ in range(rng.randrange(0, 40))]
        assert html_text.runs(weight) == plain_runs(weight, html_text.WINDOW, html_text.SURGE)


def test_windows_decide_where_no_article_is_named(spark, small):
    """The pages of the smallest tables, without their article elements."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert sum(main_text(a) == main_text(b) for a, b in zip(pages, bare, strict=True)) >= 0.97 * len(pages)


def test_odd_pages(spark):
    rows = [(1, "u", None, "k"), (2, None, "", "k"), (None, "v", PAGE, "k"), (3, "w", "<" * 5000, "k"), (4, "x", "<div>" * 3000 + "deep", "k"), (4, "x", "<div>" * 3000 + "deep", "k"), (5, "y", f"<p>{LONG}" * 5000, "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, _g0 string")
    got = html_text.extract(frame).collect()
    assert [r["text"] for r in got if r["page_id"] == 4] == ["deep", "deep"] and len(got) == 7
    assert {r["_g0"] for r in got} == {"k"} and [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert [len(r["text"]) for r in got if r["page_id"] == 5] == [5000 * len(LONG) - 1]
    assert html_text.extract(frame.limit(0)).collect() == []
    clash = html_text.extract(frame.withColumnRenamed("_g0", "text"))
    assert clash.columns.count("text") == 1 and clash.where("page_id = 4").first()["text"] == "deep"


def test_query(spark, small):
    got = queries.op10_html(spark, small)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert got.count() == spark.read.parquet(f"{small}/pages.parquet").count() and got.where("n_chars <> length(text)").count() == 0
