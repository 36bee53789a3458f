"""Main text against a plain reading of the test pages, and pages with everything that must be left out."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from panelkit.llm import maintext
from panelkit.llm.queries import QUERIES

LONG = "A sentence of the article that is long enough to look like running text, with commas. "


def plain(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S).group(1).replace("<b>", "").replace("</b>", "")
    blocks = (" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def page(inner, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><header><a href='/'>Site</a> {LONG}</header>"
        f"<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class='cookie-notice'>We use cookies. {LONG}</div>{inner}{extra}"
        f"<aside>{LONG * 3}</aside><form><label>Name</label><input><button>Send</button></form><footer>&copy; Site {LONG}</footer></body></html>"
    )


def test_extras_are_left_out():
    inner = f"<div class='content post-123'><h1>A &amp; B&nbsp;C</h1><p>One\n  <b>two</b><br>three {LONG}<p>Next <i>in</i>line &lt;x&gt; {LONG}<script>var a = '<p>no</p>';</script><div class='ad-box'>Buy {LONG}</div><ul><li>First item</li><li>Second</li></ul><!-- <p>gone</p> --></div>"
    extra = f"<div id='comments'><p>Reader says {LONG * 9}</p></div>"
    got = maintext.main_text(page(inner, extra), None)
    assert got == "\n\n".join(["A & B C", f"One two three {LONG}".strip(), f"Next inline <x> {LONG}".strip(), "First item", "Second"])


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("a < b and 3<4 <p>c", "a < b and 3<4\n\nc"),
        ("<article><p>cut off <a href='x", "cut off"), ("<p>x</p><!-- never closed <p>y</p>", "x"), ("<p>x</p><script>never closed <p>y</p>", "x"),
        ("</div></p><div>stray</div></div>", "stray"), ("<table><tr><td>one<td>two</table>", "one\n\ntwo"), ("<div class='sidebar'>only this</div>", "only this"),
        ("<P>UP<BR/>low</P>", "UP low"), ("<p>&#233;&eacute;&#x1F600;&bogus;</p>", "éé😀&bogus;"),
    ],
)
def test_odd_pages(source, text):
    assert maintext.main_text(source, None) == text


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert maintext.main_text(deep, None) == LONG.strip()
    many = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert maintext.main_text(many, None).count("\n\n") == 19_999


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_hosts_agree_on_a_path(spark, broadcast, monkeypatch):
    """A page whose extras outweigh its article follows the path of its host, however the two meet."""
    monkeypatch.setattr(maintext, "BROADCAST_CHARS", broadcast)
    usual = [(i, f"http://h.example/{i}", page(f"<div class='c{i}'><p>{LONG * 4}</p></div>")) for i in range(8)]
    odd = (50, "https://u@H.example:80/x", page(f"<div class='c9'><p>Short article.</p></div>", f"<div class='wide'><p>{LONG * 30}</p></div>"))
    rows = [*usual, odd, (51, None, page(f"<div class='wide'><p>{LONG}</p></div>")), (52, "nonsense", None), (None, "http://h.example/q", ""), (1, usual[1][1], usual[1][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("host", F.lit("clash")).withColumn("text", F.lit(1)).withColumn("paths", F.lit(2))
    got = maintext.main_texts(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[50] == "Short article." and by[51] == LONG.strip() and by[52] == by[None] == ""
    assert all(by[i] == (LONG * 4).strip() for i in range(8))
    assert all(r.n_chars == len(r.text) for r in got)
    assert maintext.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_on_a_table(spark):
    d = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    assert {r.page_id: (r.url, r.text) for r in QUERIES["op10_main_text"](spark, d).collect()} == want


def body(inner):
    return f"<html><body><nav><a href=x>Home</a></nav>{inner}<footer>Site</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "parts"),
    [
        (f"<article><h1>Title</h1><p>lead</p><div class=body><p>{LONG * 30}</p></div></article>", ["Title", "lead", LONG * 30]),
        (f"<main><h1><a href=x>Title</a></h1><div class=body><p>{LONG * 30}</p></div></main>", ["Title", LONG * 30]),
        (f"<article><section><p>{LONG * 30}</p></section><section><p>{LONG * 6}</p></section></article>", [LONG * 30, LONG * 6]),
        (f"<div class=post><h2><a href=x>Title</a></h2><div><div class=body><p>{LONG * 9}</p></div></div><div class=end><p>{LONG}</p></div></div>", ["Title", LONG * 9, LONG]),
        (f"<div class=wrap><div class=body><p>{LONG * 9}</p></div><div class=list><a href=x>{LONG}</a></div></div>", [LONG * 9]),
        (f"<div><div class=list><a href=x>{LONG * 9}</a></div><div class=part><p>{LONG * 5}</p></div><div class=list><a href=x>{LONG * 9}</a></div><div class=part><p>{LONG}</p></div></div>", [LONG * 5, LONG]),
    ],
)
def test_nested_bodies_and_unequal_sections(inner, parts):
    """Everything around the best container that is running text or a heading, and every container at the winning path."""
    source = body(inner)
    want = "\n\n".join(p.strip() for p in parts)
    path = max(maintext.page_votes(source), key=lambda v: v[1])[0]
    assert maintext.main_text(source, [path]) == want
    if "class=part" not in inner:
        assert maintext.main_text(source, None) == want


@pytest.mark.parametrize(
    ("inner", "parts"),
    [
        (f"<div class='layout has-sidebar'><article><p>{LONG * 9}</p></article></div><div>1 May</div>", [LONG * 9]),
        (f"<div class='widget'><article><p>{LONG * 9}</p></article></div><div class=date>1 May</div>", [LONG * 9]),
        (f"<div class='search'><div><p>{LONG * 9}</p></div></div><div class=list><a href=x>1 May</a></div>", [LONG * 9]),
        (f"<article><div class='post-header'><h1>Title</h1></div><div class=header><p>lead</p></div><p>{LONG * 9}</p></article>", ["Title", "lead", LONG * 9]),
        (f"<article><p>{LONG}<ul class='menu'><li>one<li><ul><li>two</ul></ul><p>{LONG * 2}<p class='advert'>Buy<p>{LONG * 3}<ol class='breadcrumb'><li>x</li></ol>{LONG}</article>", [LONG, LONG * 2, LONG * 3, LONG]),
        (f"<article><p>{LONG}<ul><li class=share>Share<li>kept</ul><h2 class='promo'>Buy</h2><p>{LONG}</p></article>", [LONG, "kept", LONG]),
        (f"<article><p>{LONG}</p></article><div id=comments><article class=comment><p>{LONG * 30}</p></article></div>", [LONG]),
        (f"<main class=comments-open><div class=banner><div><p>{LONG * 9}</p></div></div></main>", [LONG * 9]),
        (f"<article><p>{LONG * 9}</p></article><div class=related><article><p>{LONG}</p></article></div>", [LONG * 9]),
    ],
)
def test_hints_are_weighed(inner, parts):
    """A hint word drops an extra on any block tag, and neither the article around it nor its title."""
    assert maintext.main_text(body(inner), None) == "\n\n".join(p.strip() for p in parts)


BODY = f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article>"
WANT = "\n\n".join(["Title", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize("html", [
    f"<html><body><form id=aspnet><div>{BODY}</div></form></body></html>",
    f"<html><body><form><fieldset>{BODY}</fieldset></form></body></html>",
    f"<html><body><aside><a href=x>Links</a></aside><dialog>{BODY}</dialog></body></html>",
    f"<html><body>{BODY}<form><label>Your name</label><input></form><aside>More</aside></body></html>",
    f"<html><body><button class=x>{BODY}</body></html>",
    f"<html><body><select>{BODY}</body></html>",
    f"<html><body><object data=x>{BODY}</body></html>",
    f"<html><body><noscript>{BODY}</body></html>",
    f"<html><body><button>{BODY}<button>Send</button></body></html>",
    f"<html><body>{BODY}<script>var a = '<p>no</p>';</body></html>",
])
def test_forms_and_unclosed_tags(html):
    assert maintext.main_text(html, None) == WANT


def test_a_form_with_most_of_the_text_is_kept():
    assert LONG.strip() in maintext.main_text(f"<body><form><div><p>{LONG}</p></div><input></form></body>", None)


def test_formulas_are_text():
    assert maintext.main_text(f"<article><p>{LONG}</p><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then.</p></article>", None).endswith("If x=2 then.")


@pytest.mark.parametrize("html", ["<a t=\"x' " * 110_000, "<a t=\"x' " * 110_000 + ">", "<button>" * 120_000, "</button " * 110_000, "<div>" * 50_000 + "text", "<div class='nav x'>" * 50_000 + "text", "<!--" * 200_000, "<p" * 400_000, "<td>" * 100_000 + "x", "&amp" * 200_000])
def test_odd_megabytes_take_seconds(html):
    start = time.perf_counter()
    maintext.main_text(html, ["html/body"])
    maintext.page_votes(html)
    assert time.perf_counter() - start < 10


def test_paths_by_steps():
    page = maintext.parse(f"<div class='a b1'><section><p>{LONG}</p></section></div><div class='a b2'><section><p>x</p></section></div>")
    assert {maintext.path_text(page, p) for p in page.path} == {"", "div.a.b0", "div.a.b0/section"}
    assert maintext.main_text(f"<div class=a><section><p>{LONG}</p></section></div><div class=z><p>other</p></div>", ["none", "div.z"]) == "other"
