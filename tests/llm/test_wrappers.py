import html
import json
import re

import pytest
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F
from helpers import rows_of
from quarry.llm.registry import QUERIES
from quarry.llm.wrappers import align, expression, extract_main_text, infer_wrappers, main_text, parse, plan, skeleton

PAGE = "page_id long, url string, html string"


def wrapper_of(*pages):
    items = [skeleton(parse(p)[0]) for p in pages]
    out = items[0]
    for item in items[1:]:
        out = [out[0], False, False, align(out[3], item[3])]
    return out


def text_of(page, *others, constant=()):
    return main_text(page, json.dumps(plan(wrapper_of(page, *others), set(constant))))


def plain(page):
    """The supplied template by hand: the article's blocks end where a tag that is not inline begins."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    texts = [" ".join(html.unescape(re.sub(r"</?(?:b|br|i|a)\b[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_the_template_by_hand(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = sorted((r["page_id"], r["url"], plain(r["html"]), len(plain(r["html"]))) for r in pages)
    assert rows_of(QUERIES["op11_html_extraction"](spark, sf), "page_id", "url", "text", "n_chars") == sorted(want, key=repr)


def test_mismatches_become_options_repeats_and_slots():
    one = "<html><body><h1>A</h1><ul><li>x</li></ul><p>t</p></body></html>"
    two = "<html><body><h1>B</h1><hr><div>n</div><ul><li>x</li><li>y</li></ul></body></html>"
    assert expression(wrapper_of(one, two)).strip() == "(html(body(h1(#) div(#)? ul(li(#)+) p(#)?)))"
    groups = "<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"
    assert expression(wrapper_of(groups)).strip() == "(dl((dt(#) dd(#))+))"
    three = "<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>"
    assert expression(wrapper_of(three)).strip() == "((h2(#) p(#)+)+)"


def test_chrome_by_tag_and_word():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><div id="cookieNotice">We use cookies</div>
    <form action="/s"><input name=q><label>Find</label></form><nav><a href=/>Home</a></nav>
    <div class="layout with-sidebar"><main><article class="post"><header><h1>Title &amp; more</h1></header>
    <p>One <b>bold</b>\n  word<br>next&nbsp;line <span class="ad">buy</span>!<p>Two &#146;q&#8217; caf&eacute x
    <script>var t = "</p><p>no";</script><div class="related"><p>Other</p></div>
    <pre> a\n  b </pre><ul><li>i<li>j</ul><footer>by me</footer>
    <section class="comments"><p>first!</p></section></article></main>
    <aside>links</aside></div><section id="comments"><article><p>I agree</p></article></section>
    <article class="comment"><p>me too</p></article><footer>&copy; us</footer>"""
    want = "Title & more\nOne bold word next line\n!\nTwo ’q’ café x\na b\ni\nj"
    assert text_of(page) == want
    # A paragraph goes on after a marked inline element; both sides are blocks of their own.
    assert text_of("<article><p>a <!-- <p>no</p> --> b</article>") == "a b"


def test_without_article_the_wrapper_tells_template_from_text(spark):
    def page(k):
        return (
            f"<body><div class=x9>Welcome to our site</div><div class=x{k}><h2>Head {k}</h2><p>Text {k}</p></div>"
            "<ul><li><a href=/a>More</a></ul><div class=y>All rights kept</div></body>"
        )

    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(4)]
    rows += [(9, "http://alone.example/", "<div>only</div><p>text</p>")]
    got = rows_of(extract_main_text(spark.createDataFrame(rows, PAGE)), "page_id", "text")
    # The first box is constant, but shares its slot with nothing else: class digits do not count.
    assert [t for i, t in got if i < 4] == [f"Head {k}\nText {k}" for k in range(4)]
    assert dict(got)[9] == "only\ntext"


ODD_HTML = [
    None, "", "   ", "no tags & none", "<", "<p", "<p title='a>b'>x</p>", "<p title=\"it's>\">y", "<a href='q>r'>t</a> z",
    "<p>u\x01v</p>", "<p>unclosed <b>bold", "<script>never closed <p>x", "<!-- never closed <p>x", "</p></div>end",
    "<div>" * 5000 + "deep" + "</div>" * 5000, "<p>" + "long word " * 100_000, "<p>&#0;&#xD800;&#1114112;&bogus;&amp",
    "<article></article><p>beside</p>", "<head><p>body without a tag", "<table><tr><td>a<td>b<tr><td>c</table>",
    "<p>x</p>" * 2000, "<ARTICLE><P CLASS=Notice>n</P><P>Kept</P></ARTICLE>", "<p hidden>h</p><p>s</p>", "a < b > c",
]


def test_odd_pages(spark):
    urls = [None, "", "not a url", "HTTP://User@Host.example:80/x", "//host.example", "https://host.example?q"]
    rows = [(k, urls[k % 6] and urls[k % 6] + str(k), h) for k, h in enumerate(ODD_HTML)]
    rows += [rows[3], rows[3], (None, None, "<p>no id")]
    df = spark.createDataFrame(rows, PAGE).withColumns({c: F.lit("z") for c in ("host", "plan", "_page", "text", "n_chars")})
    out = extract_main_text(df.repartition(3))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r[0]: r[2] for r in out.collect()}
    assert out.count() == len(rows)
    some = {0: "", 1: "", 2: "", 6: "x", 7: "y", 9: "u\x01v", 10: "unclosed bold", 11: "", 12: "", 13: "end", 14: "deep",
            17: "beside", 18: "body without a tag", 19: "a\nb\nc", 21: "Kept", 22: "s", 23: "a < b > c", None: "no id"}
    assert {k: got[k] for k in some} == some
    assert got[15] == ("long word " * 100_000).strip()
    assert got[20] == "\n".join(["x"] * 2000)
    assert extract_main_text(df.limit(0)).count() == 0
    clash = df.select("host", F.col("page_id").alias("plan"), F.col("url").alias("text"), "html")
    assert extract_main_text(clash, "plan", "host").columns == ["plan", "host", "text", "n_chars"]


def test_wrappers_do_not_depend_on_the_layout(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    cols = ["host", "wrapper", "expression", "constant", "plan"]
    one = rows_of(infer_wrappers(pages.coalesce(1)), *cols)
    assert one == rows_of(infer_wrappers(pages.repartition(7)), *cols)
    shown = {r[2] for r in one}
    assert any(re.search(r"article\(h#?1\(#\) p\(#\)\+\)", x) or "article(h1(#) p(#)+)" in x for x in shown)
