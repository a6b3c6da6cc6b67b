"""Web page queries (pages table): paragraph text, site names, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.html import paragraph_text, sql_paragraph_text
from quarry.functions.text import site_name
from quarry.operators.layout import spread
from quarry.plans.registry import query
from quarry.sources.tables import table


# A paragraph with all that a simple cut would get wrong, and its text.
HARD_PARAGRAPH = (
    "<p title=\"a>b\">hi <a href='u?p>q'>link</a> &#146;x&#8217; caf&eacute x &amp y &notit; &bogus; \u0001v"
    " 1 < 2 <!-- </p> --><script>'</p>'</script>&#x1F600;</p>"
)
HARD_TEXT = "hi link \u2019x\u2019 caf\u00e9 x & y \u00acit; &bogus; \u0001v 1 < 2 \U0001f600"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\u0001", "' || chr(1) || '") + "'"


@query(
    "html_paragraphs",
    f"""SELECT page_id, {sql_paragraph_text('html')} AS text FROM pages
UNION ALL SELECT -1 - page_id, {sql_paragraph_text('html')} || {_quoted(HARD_TEXT)} FROM pages WHERE page_id % 3 = 0""",
)
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """H1: text of all paragraphs of each page, joined without separator; a third of
    the pages once more, with a paragraph of quoted marks, odd references and lone signs."""
    pages = spread(table(spark, d, "pages").select("page_id", "html"))
    copies = F.array(F.struct("page_id", "html"), F.struct(
        (F.lit(-1) - F.col("page_id")).alias("page_id"), F.concat("html", F.lit(HARD_PARAGRAPH)).alias("html")))
    both = pages.select(F.explode(F.when(F.col("page_id") % 3 == 0, copies).otherwise(F.slice(copies, 1, 1))).alias("p"))
    return both.select("p.page_id", paragraph_text(F.col("p.html")).alias("text"))


# Fixed value: one link without a dot after ``//`` (the empty-site case).
NO_DOT_URL = "https://localhost/questions/1"


@query(
    "site_name",
    f"""SELECT page_id, regexp_extract(url, '//([^.]*)\\.', 1) AS site FROM pages
UNION ALL SELECT -1 AS page_id, regexp_extract('{NO_DOT_URL}', '//([^.]*)\\.', 1) AS site""",
)
def site_name_query(spark: SparkSession, d: str) -> DataFrame:
    """H2: site between ``//`` and the first dot; ``''`` without a dot."""
    pages = table(spark, d, "pages").select("page_id", "url")
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("page_id"), F.lit(NO_DOT_URL).alias("url"))
    return pages.unionByName(extra).select("page_id", site_name("url").alias("site"))


# Fixed value: the abstract URL format.
PUBMED_URL = "https://pubmed.ncbi.nlm.nih.gov/%d/"


@query(
    "url_build",
    "SELECT page_id, 'https://pubmed.ncbi.nlm.nih.gov/' || CAST(page_id AS VARCHAR) || '/' AS url FROM pages",
)
def url_build(spark: SparkSession, d: str) -> DataFrame:
    """Computed URL column from the record id."""
    return table(spark, d, "pages").select("page_id", F.format_string(PUBMED_URL, "page_id").alias("url"))
