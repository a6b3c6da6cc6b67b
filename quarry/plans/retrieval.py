"""Retrieval queries: hypothetical-answer BM25 over the document corpus.

Queries are the assistant turns (the "hypothetical answers"), each paired
with the user turn just before it (the question, used only for the prompt).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import PY_WS_CLASS
from quarry.operators import bm25
from quarry.operators.joins import bounded_broadcast
from quarry.plans.registry import query
from quarry.session import materialize, scratch_folder
from quarry.sources.tables import table

QKEYS = ["conv_id", "turn"]
TOP_K = 2


def qa_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): an assistant turn and the user turn
    right before it.  An equi-join on (conv_id, turn) rather than a window
    over a conversation, so one huge conversation is not one task."""
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    q = conversations.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    return a.join(q, QKEYS).select(*QKEYS, "question", "answer")


def _hits(spark: SparkSession, d: str, per_source: bool) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    index = bm25.build_index(docs, source_col="source" if per_source else None)
    qa = qa_turns(table(spark, d, "conversations"))
    hits = bm25.top_k(index, qa, key_cols=QKEYS, text_col="answer", k=TOP_K)
    return hits, qa


# ---- oracle building blocks (DuckDB) ------------------------------------
_WS = PY_WS_CLASS.replace("'", "''")


def sql_tokens(col: str) -> str:
    """DuckDB twin of ``whitespace_tokens``."""
    return f"list_filter(regexp_split_to_array(coalesce({col}, ''), '{_WS}+'), lambda x: x <> '')"

SQL_QA = """
qa AS (
  SELECT a.conv_id, a.turn, u.text AS question, a.text AS answer
  FROM conversations a JOIN conversations u
    ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE a.role = 'assistant' AND u.role = 'user'
)"""


def sql_bm25_hits(source_expr: str) -> str:
    """CTEs ending in ``hits(conv_id, turn, source, rank, doc_id, score)``."""
    toks = sql_tokens("text")
    qtoks = sql_tokens("answer")
    return f"""
{SQL_QA},
docs AS (SELECT doc_id, {source_expr} AS source, {toks} AS tokens FROM documents),
dl AS (SELECT doc_id, source, CAST(len(tokens) AS DOUBLE) AS dl FROM docs),
cs AS (SELECT source, CAST(count(*) AS DOUBLE) AS n_docs,
              sum(dl) / CAST(count(*) AS DOUBLE) AS avgdl FROM dl GROUP BY source),
tf AS (SELECT source, doc_id, term, CAST(count(*) AS DOUBLE) AS tf
       FROM (SELECT source, doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT source, term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY ALL),
raw AS (SELECT dfs.source, term, df, ln(n_docs - df + 0.5e0) - ln(df + 0.5e0) AS raw_idf
        FROM dfs JOIN cs USING (source)),
mi AS (SELECT source, avg(raw_idf) AS mean_idf FROM raw GROUP BY source),
idf AS (SELECT raw.source, term, df,
               CASE WHEN raw_idf < 0 THEN 0.25e0 * mean_idf ELSE raw_idf END AS idf
        FROM raw JOIN mi USING (source)),
qt AS (SELECT conv_id, turn, term, CAST(count(*) AS DOUBLE) AS qtf
       FROM (SELECT conv_id, turn, unnest({qtoks}) AS term FROM qa) GROUP BY ALL),
sc AS (
  SELECT qt.conv_id, qt.turn, tf.source, tf.doc_id,
         round(sum(qt.qtf * idf.idf * (tf.tf * 2.5e0 / (tf.tf + 1.5e0 *
               (1.0e0 - 0.75e0 + 0.75e0 * dl.dl / cs.avgdl)))), 6) AS score
  FROM qt JOIN idf ON idf.term = qt.term
          JOIN tf ON tf.term = qt.term AND tf.source = idf.source
          JOIN dl ON dl.doc_id = tf.doc_id
          JOIN cs ON cs.source = tf.source
  GROUP BY ALL
),
hits AS (
  SELECT * FROM (
    SELECT conv_id, turn, source, doc_id, score,
           CAST(row_number() OVER (PARTITION BY conv_id, turn, source
                                   ORDER BY score DESC, doc_id) AS BIGINT) AS rank
    FROM sc) WHERE rank <= {TOP_K}
)"""


@query(
    "bm25_topk",
    f"WITH {sql_bm25_hits(chr(39) + 'all' + chr(39))}\n"
    "SELECT conv_id, turn, rank, doc_id, score FROM hits",
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top-2 documents per hypothetical answer, one corpus."""
    hits, _ = _hits(spark, d, per_source=False)
    return hits.select(*QKEYS, "rank", "doc_id", "score")


@query(
    "bm25_stored",
    f"WITH {sql_bm25_hits(chr(39) + 'all' + chr(39))}\n"
    "SELECT conv_id, turn, rank, doc_id, score FROM hits",
)
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """K1 + K2: the same ranking from a stored index, to which a quarter of the documents
    was appended after the others."""
    path = scratch_folder(spark, "bm25")
    docs = table(spark, d, "documents")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    bm25.write_index(docs.filter(~late), path, buckets=0)
    bm25.append_index(docs.filter(late), path)
    qa = qa_turns(table(spark, d, "conversations"))
    hits = bm25.top_k(bm25.load_index(spark, path), qa, key_cols=QKEYS, text_col="answer", k=TOP_K)
    return hits.select(*QKEYS, "rank", "doc_id", "score")


COMMON = 5

SQL_COMMON = f"""
common AS (
  SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS place FROM (
    SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term
),
qa AS (SELECT 0 AS conv_id, CAST(place AS BIGINT) AS turn, term AS question, term AS answer FROM common WHERE place <= {COMMON})"""


@query(
    "bm25_terms",
    f"WITH {sql_bm25_hits(chr(39) + 'all' + chr(39)).replace(SQL_QA, SQL_COMMON)}\n"
    "SELECT turn AS place, rank, doc_id, score FROM hits",
)
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    """K1 + K2: the best documents for each of the five most common terms, from the postings
    of their buckets in a stored index."""
    path = scratch_folder(spark, "bm25")
    bm25.write_index(table(spark, d, "documents"), path, buckets=16)
    index = bm25.load_index(spark, path)
    common = index.term_stats.orderBy(F.desc("df"), "term").limit(COMMON).select("term", "df")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("df"), "term")).cast("bigint")
    queries = materialize(common.withColumn("place", place).select("place", "term"))
    return bm25.top_k(index, queries, key_cols=["place"], text_col="term", k=TOP_K).select("place", "rank", "doc_id", "score")


@query(
    "bm25_by_source",
    f"WITH {sql_bm25_hits('source')}\nSELECT conv_id, turn, source, rank, doc_id, score FROM hits",
)
def bm25_by_source(spark: SparkSession, d: str) -> DataFrame:
    """K4: the same queries against every source corpus, each with its own
    statistics, in one job."""
    hits, _ = _hits(spark, d, per_source=True)
    return hits.select(*QKEYS, "source", "rank", "doc_id", "score")


@query(
    "hyde_context",
    f"WITH {sql_bm25_hits(chr(39) + 'all' + chr(39))}\n"
    """SELECT qa.conv_id, qa.turn, qa.question,
       coalesce(string_agg(CAST(h.doc_id AS VARCHAR), ',' ORDER BY h.rank), '') AS doc_ids,
       coalesce(string_agg(d.text, ' ' ORDER BY h.rank), '') AS context
FROM qa LEFT JOIN hits h ON qa.conv_id = h.conv_id AND qa.turn = h.turn
     LEFT JOIN documents d ON d.doc_id = h.doc_id
GROUP BY qa.conv_id, qa.turn, qa.question""",
)
def hyde_context(spark: SparkSession, d: str) -> DataFrame:
    """Flagship (K3 + H13): per question, the ids and joined text of the top-2
    documents retrieved by its hypothetical answer (both empty without a hit)."""
    hits, qa = _hits(spark, d, per_source=False)
    ctx = bm25.attach_context(hits, table(spark, d, "documents"), key_cols=QKEYS)
    empty = F.lit("")
    return qa.select(*QKEYS, "question").join(ctx.drop("source"), QKEYS, "left").select(
        *QKEYS, "question",
        F.coalesce("doc_ids", empty).alias("doc_ids"), F.coalesce("context", empty).alias("context"),
    )


@query(
    "bm25_stats",
    f"WITH {sql_bm25_hits('source')}\n"
    """SELECT idf.source, idf.term, CAST(idf.df AS BIGINT) AS df, round(idf.idf, 6) AS idf,
       CAST(cs.n_docs AS BIGINT) AS n_docs, round(cs.avgdl, 6) AS avgdl
FROM idf JOIN cs USING (source)""",
)
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """K1: per-source term statistics with the corpus statistics they use."""
    index = bm25.build_index(table(spark, d, "documents"), source_col="source")
    return index.term_stats.join(bounded_broadcast(index.corpus_stats, bm25.BROADCAST_SOURCES), "sid").select(
        "source",
        "term",
        F.col("df").cast("bigint").alias("df"),
        F.round("idf", 6).alias("idf"),
        F.col("n_docs").cast("bigint").alias("n_docs"),
        F.round("avgdl", 6).alias("avgdl"),
    )
