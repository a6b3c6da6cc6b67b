"""Hand-worked cases for the string functions and reference quirks."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarry.functions import html, text as T
from quarry.operators import agg, evalset


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first().o


def test_word_count_null_is_nan(spark):
    assert one(spark, T.word_count("s"), None) == 1
    assert one(spark, T.word_count("s"), "a  b ") == 4


def test_py_strip_removes_newlines(spark):
    assert one(spark, T.py_strip("s"), "\n  x y \n") == "x y"


def test_wiki_clean(spark):
    s = "A\n== References ==\nISBN 12 tail\nsee https://x.org/a/b end\nkeep"
    assert one(spark, T.wiki_clean("s"), s) == "A\n\n\nsee \nkeep"


def test_format_question(spark):
    assert one(spark, T.format_question("s"), "What is the Thing? Is it") == "is the Thing it"
    # exact case only
    assert one(spark, T.format_question("s"), "what is") == "what is"


def test_strip_labels_and_faulty(spark):
    assert one(spark, T.strip_line_labels("s"), "A: x\nB: y: z") == "x y"
    assert one(spark, T.strip_line_labels("s"), "A: x\nbare") is None
    assert one(spark, T.abstract_is_faulty("s"), "A: x\nbare") is True


def test_site_name_no_dot(spark):
    assert one(spark, T.site_name("s"), "https://ai.stackexchange.com/q") == "ai"
    assert one(spark, T.site_name("s"), "https://localhost/q") == ""


def test_sentence_split(spark):
    assert one(spark, T.sentence_split("s"), "A b. C? D!  E") == ["A b.", "C?", "D!", "E"]


def test_remove_echo(spark):
    df = spark.createDataFrame([("Q? ", "Q?  answer \n")], "q string, o string")
    assert df.select(T.remove_echo("o", "q")).first()[0] == "answer"


def test_html_contract(spark):
    page = ('<script>var t="</p>";</script><!-- <p>no</p> --><p>one &amp; <b>two</b>'
            '<p class="c">three &lt;4&gt;</p>out<P>last')
    assert one(spark, html.paragraph_text("s"), page) == "one & twothree <4>last"
    assert one(spark, html.paragraph_text("s"), "no paragraphs") == ""


def test_best_answer_true_argmax_and_ties(spark):
    schema = "answers array<struct<text: string, pm_score: int>>"
    rows = [([("<p>a</p>", 3), ("<p>b</p>", 5), ("<p>c</p>", 1)],), ([("<p>a</p>", 0)],),
            ([("<p>x</p>", 2), ("<p>y</p>", 2)],)]
    df = spark.createDataFrame(rows, schema)
    got = [r.o for r in df.select(agg.best_answer().alias("o")).collect()]
    assert got == ["b", "", "x"]
    ok = [r.o for r in df.select(agg.distinct_scores().alias("o")).collect()]
    assert ok == [True, True, False]


def test_run_key_parse_and_domain_checks(spark):
    df = spark.createDataFrame([("wikipedia_formatted_qs_ans_128_nucleus_2493",)], "run string")
    r = df.select(*evalset.parse_run("run")).first()
    assert (r.dataset, r.formatted, r.rank, r.decoding, r.checkpoint) == (
        "wikipedia", True, "128", "nucleus", "2493")
    with pytest.raises(ValueError):
        evalset.select_run(df, dataset="wiki", decoding="greedy", formatted=False, checkpoint="831", rank="8")
    with pytest.raises(ValueError):
        evalset.select_run(df, dataset="pubmed", decoding="greedy", formatted=False, checkpoint="831", rank="8")


def test_request_json_roundtrip(spark):
    df = spark.createDataFrame([("q \"1\"", "ctx é")], "q string, c string")
    req = df.select(evalset.request_json(F.lit("task-x-0"), F.lit("sys\n"), F.col("q"), F.col("c")).alias("r"))
    back = req.select(*evalset.request_messages("r")).first()
    assert (back.custom_id, back.system_prompt, back.question, back.context) == (
        "task-x-0", "sys\n", 'q "1"', "ctx é")


def test_page_text_drops_sections_and_orders(spark):
    rows = [("P", 2, "External links", "x"), ("P", 1, "History", "b"), ("P", 0, "Intro", "a"),
            ("P", 3, "REFERENCES", "r")]
    df = spark.createDataFrame(rows, "title string, sec_no int, sec_title string, text string")
    assert agg.page_text(df).first().text == "a\nb\n"


class PlainParagraphs(HTMLParser):
    """Paragraph texts by the standard library's parser, with implicit close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = True if tag == "p" else self.inside

    def handle_startendtag(self, tag, attrs):
        # As browsers do: the slash of "<p/>" means nothing.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.inside = False if tag == "p" else self.inside

    def handle_data(self, data):
        # The parser hands over what scripts and styles hold as data, too.
        if self.inside and self.cdata_elem is None:
            self.out.append(data)


def plain_paragraphs(page):
    parser = PlainParagraphs()
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


HARD_PAGES = [
    '<p title="a>b">hi</p>', "<p>x<a href=\"u?p>q\">link</a> z</p>", "<p>&#146;&#8217;&#x80;</p>", "<p>caf&eacute x &amp y &ampz</p>",
    "<p>u\x01v</p>", "<p>a < b > c <3 <</p>", "<p>it's</p><p class='x\"y>z'>k</p>", "<P>Big</P><pre>no</pre><p/>self</p>",
    "<p>one<p>two<b>three</p>four", "<p>&notit; &notin; &amp;amp; &AMP &bogus; &; & &#; &#x;</p>", "<p>&#0;&#xD800;&#1114112;&#99999999999999999999;</p>",
    "<p>a<!-- </p> -->b</p>", "<script>'<p>no</p>'</script><p>yes</p>", "<style>p{}</style><p>y</p>", "<p>x</p\n><p\n>y", "no paragraph", "",
    "<p>&frac12;&frac14&sup2x&copy2024</p>", "<param><p>p</p><progress>q</progress>", "<p a=1 b=2>c</p>", "<p>t&#x1F600;&#128512</p>",
    "<p><?php x ?>y<!DOCTYPE z>w</p>", "<p>\n line\r\nend &nbsp;</p>", "<p>&#11;&#127;&#x1;&#xFFFE;ok</p>",
]


def test_paragraphs_equal_an_independent_parser(spark):
    df = spark.createDataFrame(list(enumerate(HARD_PAGES)), "k int, page string")
    got = {r.k: r.t for r in df.select("k", html.paragraph_text("page").alias("t")).collect()}
    assert got == {k: plain_paragraphs(page) for k, page in enumerate(HARD_PAGES)}


def test_unfinished_markup_runs_to_the_end(spark):
    pages = ["<p>a<!-- x <p>b", "<p>a<script>x</p><p>b", "<p>a <b title='x", "<p>a <b", "<p"]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, page string")
    got = [r.t for r in df.orderBy("k").select(html.paragraph_text("page").alias("t")).collect()]
    assert got == ["a", "a", "a ", "a ", ""]
