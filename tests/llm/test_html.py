import html as entities
import re
import time

import duckdb
import pytest

from sardonyx.llm.html_extract import extract, main_text
from tests.conftest import SF_SMALL


def _by_pattern(page):
    """The pages of the test tables hold one article of headings and paragraphs."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [re.sub(r"</?\w+>", "", re.sub("<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inside)]
    texts = [" ".join(entities.unescape(p).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages(spark):
    path = f"{SF_SMALL}/pages.parquet"
    want = {i: _by_pattern(h) for i, h in duckdb.sql(f"SELECT page_id, html FROM '{path}'").fetchall()}
    got = extract(spark.read.parquet(path)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PARA = "This paragraph is long enough to earn points, with commas, and no links at all."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("x &amp;&lt;&#233;&nbsp;y", "x &<é y"),
    (f"<body><div id=sidebar><p>{PARA}</p></div><div><p>{PARA}</p><p>{PARA}</p></div></body>", f"{PARA}\n{PARA}"),
    (f"<div class='has-sidebar'><main><h1>T</h1><p>{PARA}</p></main><div class=sidebar>no</div></div>", f"T\n{PARA}"),
    (f"<article><p>{PARA}<form>a form</form><section class=comments><p>{PARA}</section></article>", PARA),
    (f"<article><header>by me</header><p>{PARA}</p><aside>x</aside><p>last</p><footer>f</footer></article>",
     f"{PARA}\nlast"),
    (f"<body><div><p>{PARA}</p><p>{PARA}</p></div><ul><li><a href=a>one</a><li><a href=b>two</a></ul></body>",
     f"{PARA}\n{PARA}"),
    ("<p>one<br>two <b>three</b>\n four", "one two three four"),
    ("<script>var t='</p>';</script><style>p{}</style><p>seen</p><!-- not seen -->", "seen"),
    (f"<div class='has-sidebar no-ads'><p>{PARA}</p><div class='leftSidebar'>x</div></div>", PARA),
    (f"<body><div><section><h2>a</h2><p>{PARA}</section><section><p>{PARA}</section></div><div>menu</div></body>",
     f"a\n{PARA}\n{PARA}"),
    (f"<body><div role=main><p>short<p>{PARA}</div><div><p>{PARA}</div></body>", f"short\n{PARA}"),
    (f"<main><h1>T</h1><article><p>{PARA}</article><p><a href=x>more</a></main>", f"T\n{PARA}"),
    ("<div role=navigation>menu</div><p hidden>h</p><p>body</p>", "body"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<![foo]]>x</unknown>", "x"),
    ("<div>" * 20_000 + "deep", "deep"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
])
def test_cases(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<article class='post category-social'><p>{PARA}</article>", PARA),
    (f"<body><article id='search-engines'><p>{PARA}</article><div class=related>x</div></body>", PARA),
    (f"<article><p>{PARA}<h2 id='related-work'>Related work</h2><p>last</article>", f"{PARA}\nRelated work\nlast"),
    (f"<body><div class='layout right-sidebar'><p>{PARA}<p>{PARA}</div><div>menu</div></body>", f"{PARA}\n{PARA}"),
    (f"<div class='right-sidebar'><p>{PARA}<p>{PARA}<div class='right-sidebar'>x</div></div>", f"{PARA}\n{PARA}"),
    (f"<div role=main class='social-post'><p>{PARA}</div><div class=related><p>{PARA}{PARA}</div>", PARA),
    (f"<div class='tag-search'><p>{PARA}</div><div class=search>x</div>", PARA),
    (f"<div id='cookies-recipe'><p>{PARA}<p>{PARA}</div><p>By someone who bakes a lot", f"{PARA}\n{PARA}\nBy someone who bakes a lot"),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</article>", "So x=2 holds"),
    # reader comments stay cut although they are longer than the text, or articles
    (f"<div><p>{PARA}</div><div class='comments'>{f'<p>{PARA}' * 9}</div>", PARA),
    (f"<article><p>{PARA}<article class='comment'><p>{PARA}{PARA}</article></article>", PARA),
    (f"<article><p>{PARA}</article><div id=comments>{f'<article class=comment><p>{PARA}</article>' * 9}</div>", PARA),
    (f"<h1>Thread</h1><div class='comments'><p>{PARA}</div>", f"Thread\n{PARA}"),
])
def test_names_do_not_cut_the_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    # a form around the page, and one beside the text
    (f"<body><form id='aspnetForm'><div class='content'><p>{PARA}</p><p>{PARA}</p></div><input><button>x</button></form>",
     f"{PARA}\n{PARA}"),
    (f"<body><div role=form><p>{PARA}</p><p>{PARA}</p></div>", f"{PARA}\n{PARA}"),
    (f"<body><form action=search>search here</form><div><p>{PARA}<p>{PARA}</div></body>", f"{PARA}\n{PARA}"),
    # an article's own title, and one above the text
    (f"<article><header><h1>Title</h1><p>by me</p></header><p>{PARA}</article>", f"Title\n{PARA}"),
    (f"<article><header class='entry-header'><div><h2>Title <b>two</b></h2></div>by me</header><p>{PARA}</article>",
     f"Title two\n{PARA}"),
    (f"<main><div class='entry-header'><h1>Title</h1><span>by me</span></div><p>{PARA}</main>", f"Title\n{PARA}"),
    (f"<body><div class='top'><h1>Head</h1></div><div class='body'><p>{PARA}<p>{PARA}</div></body>", f"Head\n{PARA}\n{PARA}"),
    (f"<body><header><h1>Site</h1></header><article><p>{PARA}</article>", PARA),
    # a name is what its last word says
    (f"<main><p class='social-contract'>{PARA}<p class='social-share'>share<p>{PARA}</main>", f"{PARA}\n{PARA}"),
    (f"<article><p>{PARA}<div class='ad-300x250'>buy</div><div class='post-comments'>{PARA}</div></article>", PARA),
    (f"<article><p>{PARA}</article><div class='discussion'><div class='reply'><p>{PARA}{PARA}</div></div>", PARA),
    (f"<div style='visibility: hidden'>x</div><div style='DISPLAY : none'>x</div><p>{PARA}", PARA),
])
def test_contract_parts(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>x" * 20_000, "<div>x" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "<p>y</p>" * 20_000,
    "<div>" * 20_000 + "<article></article>" * 20_000, "<p><div>" + "<b>" * 20_000 + "<h1>t</h1>" * 20_000,
    "<div><em>x" * 20_000 + "</section></em>" * 20_000, "<ul><li>" * 20_000, "<form>x<table><tr><td>" * 10_000,
    "<article>x" * 20_000, f"<p>{PARA}" * 5_000])
def test_work_grows_with_the_page(page):
    """Deep and broad pages of some 0.2 MB; by blocks times depth each would take minutes."""
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 12


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x"), (2, "v", "<p>" + "long words " * 100_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted((repr(r["page_id"]), r["n_chars"]) for r in extract(pages).collect())
    assert got == [("1", 0), ("1", 0), ("2", 1_099_999), ("None", 1)]
    assert extract(pages.limit(0)).count() == 0
