"""Question, thread, generated-answer and batch-request queries
(conversations; requests also read documents for retrieval)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.html import sql_paragraph_text
from quarry.operators import bm25, evalset, ordinal
from quarry.operators.agg import best_answer, incomplete_runs, prepare_threads
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.plans.retrieval import PY_WS_CLASS, SQL_QA, qa_turns, sql_bm25_hits
from quarry.sources.tables import table

_WORDS = ", ".join(f"'{w}'" for w in T.QUESTION_WORDS + T.AUXILIARY_VERBS)


def sql_format_question(c: str) -> str:
    return (f"array_to_string(list_filter(string_split(replace({c}, '?', ''), ' '), "
            f"lambda w: NOT list_contains([{_WORDS}], w)), ' ')")


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{PY_WS_CLASS}+|{PY_WS_CLASS}+$', '', 'g')"


@query(
    "question_format",
    f"WITH {fx.SQL_QUESTIONS}\nSELECT conv_id, turn, {sql_format_question('question')} AS formatted "
    "FROM questions",
)
def question_format(spark: SparkSession, d: str) -> DataFrame:
    """H8: question words and auxiliaries dropped, ``?`` deleted."""
    q = fx.questions(spark, d)
    return q.select("conv_id", "turn", T.format_question("question").alias("formatted"))


_PT = sql_paragraph_text


@query(
    "thread_prepare",
    f"""WITH {fx.SQL_THREADS},
scored AS (SELECT *, list_max(list_transform(list_filter(answers, lambda a: a.pm_score > 0),
                                             lambda a: a.pm_score)) AS best FROM threads)
SELECT date, qid, {_PT('question')} AS question,
  array_to_string(list_transform(answers, lambda a: {_PT('a.text')} || chr(10) || chr(10)), '')
     AS answer_text,
  coalesce({_PT("(list_filter(answers, lambda a: a.pm_score > 0 AND a.pm_score = best)[1]).text")}, '')
     AS selected_answer_text,
  regexp_extract(metadata[2], '//([^.]*)\\.', 1) AS stack_exchange
FROM scored
WHERE len(list_distinct(list_transform(answers, lambda a: a.pm_score))) = len(answers)
  AND NOT contains(metadata[1], 'meta')""",
)
def thread_prepare(spark: SparkSession, d: str) -> DataFrame:
    """B6 + B7 + H1 + D1 + D2 + H2 + B14: threads to the six-column record."""
    return prepare_threads(fx.threads(spark, d))


@query(
    "best_answer",
    f"""WITH {fx.SQL_THREADS},
scored AS (SELECT *, list_max(list_transform(list_filter(answers, lambda a: a.pm_score > 0),
                                             lambda a: a.pm_score)) AS best FROM threads)
SELECT qid, coalesce({_PT("(list_filter(answers, lambda a: a.pm_score > 0 AND a.pm_score = best)[1]).text")}, '')
  AS selected_answer_text FROM scored""",
)
def best_answer_query(spark: SparkSession, d: str) -> DataFrame:
    """Arg-max answer per thread (``''`` when no score is positive)."""
    return fx.threads(spark, d).select("qid", best_answer().alias("selected_answer_text"))


@query(
    "answer_clean",
    f"""WITH {SQL_QA}
SELECT conv_id, turn, {sql_strip("CASE WHEN question = '' THEN question || ' ' || answer ELSE replace(question || ' ' || answer, question, '') END")}
  AS answer FROM qa""",
)
def answer_clean(spark: SparkSession, d: str) -> DataFrame:
    """H10 + H9: generated output (prompt echoed, then answer) minus the echo,
    stripped."""
    qa = qa_turns(table(spark, d, "conversations"))
    out = F.concat("question", F.lit(" "), "answer")
    return qa.select("conv_id", "turn", T.remove_echo(out, F.col("question")).alias("answer"))


def _qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    ans = fx.answers(spark, d)
    q = fx.questions(spark, d).select("conv_id", (F.col("turn") + 1).alias("turn"), "question")
    runs = F.array(*[F.lit(k) for k in fx.RUN_KEYS])
    expected = q.select(F.explode(runs).alias("run"), "conv_id", "turn", "question")
    paired = evalset.pair(ans, expected, ["run", "conv_id", "turn"])
    fmt = F.regexp_extract("run", evalset.RUN_PATTERN, 2) != F.lit("")
    return paired.select(
        "run", "conv_id", "turn",
        F.when(fmt, T.format_question("question")).otherwise(F.col("question")).alias("question"),
        F.col("question").alias("prompt_question"),
        "answer", "paired",
    )


SQL_PAIRS = f"""{SQL_QA},
{fx.SQL_QUESTIONS},
{fx.SQL_ANSWERS},
expected AS (SELECT r.run, q.conv_id, q.turn + 1 AS turn, q.question FROM questions q,
             (VALUES {", ".join(f"('{k}')" for k in fx.RUN_KEYS)}) r(run)),
pairs AS (
  SELECT run, conv_id, turn,
    CASE WHEN regexp_extract(run, '{evalset.RUN_PATTERN}', 2) <> ''
         THEN {sql_format_question('e.question')} ELSE e.question END AS question,
    e.question AS prompt_question, a.answer,
    a.answer IS NOT NULL AND e.question IS NOT NULL AS paired
  FROM answers a FULL OUTER JOIN expected e USING (run, conv_id, turn))"""


@query("qa_pair", f"WITH {SQL_PAIRS}\nSELECT * FROM pairs")
def qa_pair(spark: SparkSession, d: str) -> DataFrame:
    """C6 + C7: every run's answers paired with its questions by key (formatted
    runs pair the formatted question and keep the original for the prompt);
    unmatched rows stay visible with ``paired = false``."""
    return _qa_pairs(spark, d)


SELECTED = dict(dataset="pubmed", decoding="greedy", formatted=False, checkpoint="561", rank="8")


@query(
    "run_select",
    f"""WITH {SQL_QA}, {fx.SQL_ANSWERS}
SELECT run, regexp_extract(run, '{evalset.RUN_PATTERN}', 1) AS dataset,
  regexp_extract(run, '{evalset.RUN_PATTERN}', 2) <> '' AS formatted,
  regexp_extract(run, '{evalset.RUN_PATTERN}', 3) AS rank,
  regexp_extract(run, '{evalset.RUN_PATTERN}', 4) AS decoding,
  regexp_extract(run, '{evalset.RUN_PATTERN}', 5) AS checkpoint, conv_id, turn, answer
FROM answers WHERE run = 'pubmed_qs_ans_8_greedy_561'""",
)
def run_select(spark: SparkSession, d: str) -> DataFrame:
    """H15 + B11: one run chosen by its parsed parameters."""
    sel = evalset.select_run(fx.answers(spark, d), **SELECTED)
    return sel.select("run", "dataset", "formatted", "rank", "decoding", "checkpoint",
                      "conv_id", "turn", "answer")


@query(
    "run_completeness",
    f"""WITH {SQL_QA}, {fx.SQL_ANSWERS}
SELECT run, CAST(count(*) AS BIGINT) AS n_pieces, (SELECT CAST(count(*) AS BIGINT) FROM qa) AS expected
FROM answers GROUP BY run HAVING count(*) <> (SELECT count(*) FROM qa)""",
)
def run_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose answer count differs from the question count (the
    expected count is computed from the data, one number)."""
    expected = qa_turns(table(spark, d, "conversations")).count()
    return incomplete_runs(fx.answers(spark, d), "run", expected).select(
        "run", F.col("n_pieces").cast("bigint").alias("n_pieces"),
        F.lit(expected).cast("bigint").alias("expected"))


@query(
    "run_commands",
    """SELECT source AS dataset, 'python3 generate.py -r ' || [8, 32, 128][CAST(count(*) % 3 AS INT) + 1]
  || ' -d ' || source || ' -c ' || CAST(max(doc_id) AS VARCHAR) AS command
FROM documents WHERE source IS NOT NULL GROUP BY source""",
)
def run_commands(spark: SparkSession, d: str) -> DataFrame:
    """One generation command per corpus source; rank and checkpoint come
    from the source's rows (the grid is read from the data, not a cartesian
    product)."""
    runs = table(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("dataset")).agg(
        F.element_at(F.array(*map(F.lit, evalset.RANKS)), (F.count(F.lit(1)) % 3 + 1).cast("int")).alias("rank"),
        F.max("doc_id").alias("checkpoint"),
    )
    return runs.select("dataset", evalset.run_command(F.col("dataset"), F.col("rank"),
                                                      F.col("checkpoint").cast("string")).alias("command"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """I3 for the selected run: BM25 top-2 on each generated answer, context
    joined in rank order, original question in the prompt, JSON line out."""
    sel = evalset.select_run(fx.answers(spark, d), **SELECTED)
    q = fx.questions(spark, d).select("conv_id", (F.col("turn") + 1).alias("turn"), "question")
    pairs = sel.join(q, ["conv_id", "turn"])
    index = bm25.build_index(table(spark, d, "documents"))
    hits = bm25.top_k(index, pairs, key_cols=["conv_id", "turn"], text_col="answer", k=2)
    ctx = bm25.attach_context(hits, table(spark, d, "documents"), key_cols=["conv_id", "turn"])
    numbered = ordinal.with_ordinal(pairs, ["conv_id", "turn"], name="idx")
    j = numbered.join(ctx.select("conv_id", "turn", "context"), ["conv_id", "turn"], "left")
    name = evalset.task_name(F.col("dataset"), F.col("checkpoint"), F.col("rank"),
                             F.col("formatted"), F.col("decoding"))
    cid = F.concat(F.lit("task-"), name, F.lit("-"), F.col("idx").cast("string"))
    prompt = F.when(F.col("dataset") == "pubmed", F.lit(evalset.PUBMED_PROMPT)).otherwise(
        F.lit(evalset.WIKIPEDIA_PROMPT))
    return j.select(
        cid.alias("custom_id"),
        evalset.request_json(cid, prompt, F.col("question"), F.coalesce("context", F.lit(""))).alias(
            "request"),
    )


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_REQUESTS = f"""WITH {sql_bm25_hits(chr(39) + 'all' + chr(39))},
{fx.SQL_QUESTIONS},
{fx.SQL_ANSWERS},
sel AS (SELECT a.conv_id, a.turn, q.question FROM answers a
        JOIN questions q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
        WHERE a.run = 'pubmed_qs_ans_8_greedy_561'),
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM sel),
ctx AS (SELECT h.conv_id, h.turn, string_agg(d.text, ' ' ORDER BY h.rank) AS context
        FROM hits h JOIN documents d ON d.doc_id = h.doc_id GROUP BY h.conv_id, h.turn),
req AS (
  SELECT 'task-pubmed-561-8-false-greedy-' || CAST(idx AS VARCHAR) AS custom_id,
    json_object('body', json_object('max_tokens', 1000, 'messages', json_array(
        json_object('content', {_sql_lit(evalset.PUBMED_PROMPT)}, 'role', 'system'),
        json_object('content', json_array(json_object('text', n.question, 'type', 'text'),
                                          json_object('text', coalesce(c.context, ''), 'type', 'text')),
                    'role', 'user')),
      'model', 'gpt-3.5-turbo', 'temperature', 0.0),
      'custom_id', 'task-pubmed-561-8-false-greedy-' || CAST(idx AS VARCHAR),
      'method', 'POST', 'url', '/v1/chat/completions')::VARCHAR AS request
  FROM numbered n LEFT JOIN ctx c ON c.conv_id = n.conv_id AND c.turn = n.turn)"""


@query("request_json", SQL_REQUESTS + "\nSELECT custom_id, request FROM req")
def request_json_query(spark: SparkSession, d: str) -> DataFrame:
    """I3 + H13 + H14 + C7: batch-request JSON lines for one run."""
    return _requests(spark, d)


@query(
    "request_messages",
    SQL_REQUESTS + """
SELECT json_extract_string(request, '$.custom_id') AS custom_id,
  json_extract_string(request, '$.body.messages[0].content') AS system_prompt,
  json_extract_string(request, '$.body.messages[1].content[0].text') AS question,
  json_extract_string(request, '$.body.messages[1].content[1].text') AS context FROM req""",
)
def request_messages(spark: SparkSession, d: str) -> DataFrame:
    """I4: messages read back out of logged JSON requests."""
    return _requests(spark, d).select(*evalset.request_messages("request"))


DRAW_N = 50


@query(
    "thread_draw",
    f"""WITH {fx.SQL_THREADS}
SELECT qid, md5(CAST(qid AS VARCHAR) || ':42') AS draw_key FROM threads
WHERE len(list_distinct(list_transform(answers, lambda a: a.pm_score))) = len(answers)
  AND NOT contains(metadata[1], 'meta')
ORDER BY draw_key, qid LIMIT {DRAW_N}""",
)
def thread_draw(spark: SparkSession, d: str) -> DataFrame:
    """F3 (+B6, B7): draw accepted threads in seeded random order without
    repeats; the draw size is the feature (the reference drew 50,000)."""
    from quarry.operators.agg import distinct_scores, not_meta
    from quarry.operators.sample import draw_n

    th = fx.threads(spark, d).select("qid", "answers", "metadata")
    return draw_n(th, DRAW_N, "qid", accept=distinct_scores() & not_meta()).select("qid", "draw_key")


_FOUR_NL = "chr(10) || chr(10) || chr(10) || chr(10)"


@query(
    "answer_pieces",
    f"""WITH {fx.SQL_THREADS}
SELECT qid, CAST(len(answers) AS BIGINT) AS n_answers,
  CAST(len(string_split(t, {_FOUR_NL})) AS BIGINT) AS n_pieces,
  CAST(length(string_split(t, {_FOUR_NL})[-1]) AS BIGINT) AS last_piece_len
FROM (SELECT qid, answers, array_to_string(list_transform(answers,
        lambda a: {_PT('a.text')} || chr(10) || chr(10)), '') AS t FROM threads)""",
)
def answer_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the joined answer text split on four newlines (what the
    reference counted) beside the true answer count."""
    from quarry.operators.agg import joined_answers, piece_count

    th = fx.threads(spark, d).select("qid", "answers", joined_answers().alias("t"))
    n, last = piece_count("t", "\n\n\n\n")
    return th.select("qid", F.size("answers").cast("bigint").alias("n_answers"),
                     n.alias("n_pieces"), F.length(last).cast("bigint").alias("last_piece_len"))
