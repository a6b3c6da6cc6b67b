"""Derived inputs: the supplied tables reshaped into the reference's inputs.

Each derivation exists twice, once as DataFrame code and once as a DuckDB
CTE, and both are the same expression of the supplied tables (see
FIXTURES.md section 3).  The test text lacks the patterns some operators look
for (no ``ISBN``, ``: `` or ``?``), so the derivations decorate it
deterministically by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

# ---- wiki pages with reference/ISBN/link tails (H3) ------------------------


def wiki_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tail = F.concat(
        F.lit("\n== References ==\nISBN "), F.col("doc_id").cast("string"),
        F.lit(" tail\nsee https://x.org/"), F.col("doc_id").cast("string"), F.lit(" end"),
    )
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", tail)).otherwise(F.col("text")).alias("text"),
    )


SQL_WIKI = """wiki AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '== References ==' || chr(10)
      || 'ISBN ' || CAST(doc_id AS VARCHAR) || ' tail' || chr(10) || 'see https://x.org/'
      || CAST(doc_id AS VARCHAR) || ' end' ELSE text END AS text
  FROM documents)"""

# ---- labelled abstracts (H7, B13) ------------------------------------------


def abstract_of(text: str, key: str) -> Column:
    lab = F.transform(
        F.split(text, "\n", -1),
        lambda ln, i: F.when((F.col(key) % 7 == 0) & (i == 0), ln).otherwise(F.concat(F.lit("BACKGROUND: "), ln)),
    )
    return F.array_join(lab, "\n")


def abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", abstract_of("text", "doc_id").alias("abstract"))


SQL_ABSTRACTS = """abstracts AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
      lambda ln, i: CASE WHEN doc_id % 7 = 0 AND i = 1 THEN ln ELSE 'BACKGROUND: ' || ln END),
      chr(10)) AS abstract
  FROM documents)"""

# ---- questions: user turns, phrased as questions for even conversations -----


def questions(spark: SparkSession, d: str) -> DataFrame:
    conv = table(spark, d, "conversations").filter(F.col("role") == "user")
    q = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("What is "), "text", F.lit("?"))).otherwise(
        F.col("text")
    )
    return conv.select("conv_id", "turn", q.alias("question"))


SQL_QUESTIONS = """questions AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'What is ' || text || '?' ELSE text END
      AS question
  FROM conversations WHERE role = 'user')"""

# ---- Stack Exchange style threads -------------------------------------------


def threads(spark: SparkSession, d: str) -> DataFrame:
    """One record per conversation: first user turn as the question, assistant
    turns (in turn order) as answers scored ``length % 7`` (so ties occur),
    html-wrapped; metadata marks every fifth thread as a meta site."""
    conv = table(spark, d, "conversations")
    user = F.col("role") == "user"
    asst = F.col("role") == "assistant"
    g = conv.groupBy("conv_id").agg(
        F.get(F.sort_array(F.collect_list(F.when(user, F.struct("turn", "text")))), 0)["text"].alias("q"),
        F.sort_array(
            F.collect_list(F.when(asst, F.struct(
                "turn",
                F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("text"),
                (F.length("text") % 7).cast("int").alias("pm_score"),
            )))
        ).alias("a"),
    )
    site = F.concat(F.lit("https://site"), (F.col("conv_id") % 4).cast("string"),
                    F.lit(".stackexchange.com/questions/"), F.col("conv_id").cast("string"))
    meta = F.when(F.col("conv_id") % 5 == 0, F.lit("meta.stackexchange.com")).otherwise(
        F.lit("stackexchange.com"))
    return g.select(
        F.col("conv_id").alias("qid"),
        F.col("conv_id").cast("string").alias("date"),
        F.concat(F.lit("<p>"), "q", F.lit("</p>")).alias("question"),
        F.array(meta, site).alias("metadata"),
        F.transform("a", lambda x: F.struct(x["text"].alias("text"), x["pm_score"].alias("pm_score")))
        .alias("answers"),
    )


SQL_THREADS = """threads AS (
  SELECT conv_id AS qid, CAST(conv_id AS VARCHAR) AS date,
    '<p>' || (list_sort(list({'turn': turn, 'text': text}) FILTER (WHERE role = 'user'))[1]).text
        || '</p>' AS question,
    [CASE WHEN conv_id % 5 = 0 THEN 'meta.stackexchange.com' ELSE 'stackexchange.com' END,
     'https://site' || CAST(conv_id % 4 AS VARCHAR) || '.stackexchange.com/questions/'
        || CAST(conv_id AS VARCHAR)] AS metadata,
    coalesce(list_transform(list_sort(list({'turn': turn, 'text': '<p>' || text || '</p>',
                                             'pm_score': CAST(length(text) % 7 AS INTEGER)})
                            FILTER (WHERE role = 'assistant')),
                   lambda x: {'text': x.text, 'pm_score': x.pm_score}), []) AS answers
  FROM conversations GROUP BY conv_id)"""

# ---- generated-answer archive, row form -------------------------------------

# The synthetic run keys ({dataset}[_formatted]_qs_ans_{rank}_
# {decoding}_{checkpoint}); the last one is written one conversation short.
RUN_KEYS = [
    "pubmed_qs_ans_8_greedy_561",
    "pubmed_qs_ans_8_nucleus_561",
    "pubmed_formatted_qs_ans_32_greedy_1122",
    "wikipedia_qs_ans_128_greedy_831",
    "wikipedia_formatted_qs_ans_128_nucleus_2493",
]
SHORT_RUN = RUN_KEYS[-1]


def answers(spark: SparkSession, d: str) -> DataFrame:
    """``(run, conv_id, turn, answer)``: every assistant turn that follows a
    user turn is the generated answer of every run (the short run lacks
    conversation 0).  Rows, never one joined string per run."""
    from quarry.plans.retrieval import qa_turns

    qa = qa_turns(table(spark, d, "conversations"))
    runs = F.array(*[F.lit(k) for k in RUN_KEYS])
    rows = qa.select(F.explode(runs).alias("run"), "conv_id", "turn", "answer")
    return rows.filter(~((F.col("run") == SHORT_RUN) & (F.col("conv_id") == 0)))


SQL_ANSWERS = (
    "answers AS (\n  SELECT r.run, qa.conv_id, qa.turn, qa.answer FROM qa, (VALUES "
    + ", ".join(f"('{k}')" for k in RUN_KEYS)
    + f") r(run)\n  WHERE NOT (r.run = '{SHORT_RUN}' AND qa.conv_id = 0))"
)
