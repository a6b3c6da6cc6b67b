"""User hooks (L1-L3) over the supplied conversations, with toy models whose
answers plain SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import hooks
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.plans.retrieval import qa_turns
from quarry.session import scratch_folder
from quarry.sources.tables import table


def toy_model(name: str):
    """A factory of a generator that echoes the prompt, names itself and its parameters."""

    def build():
        def generate(prompts: list[str], decoding: str, **given) -> list[str]:
            return [f"{p} {name} {decoding} {given['max_new_tokens']}" for p in prompts]

        return generate

    return build


SQL_CLEAN = r"replace(question, chr(10), '')"


@query(
    "generated_answers",
    f"""WITH {fx.SQL_QUESTIONS}
SELECT m.model, conv_id, turn, x.decoding, m.model || ' ' || x.decoding || ' 96' AS answer
FROM questions, (VALUES ('first'), ('second')) m(model), (VALUES ('greedy'), ('nucleus')) x(decoding)""",
)
def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    """L1 + H10: two models in one session answer every question, each decoding
    with its parameters; the echoed prompt is removed."""
    q = fx.questions(spark, d)
    runs = [
        hooks.generate_answers(q, toy_model(name), key_cols=["conv_id", "turn"]).withColumn("model", F.lit(name))
        for name in ("first", "second")
    ]
    return runs[0].unionByName(runs[1]).select("model", "conv_id", "turn", "decoding", "answer")


@query(
    "resumed_answers",
    f"""WITH {fx.SQL_QUESTIONS}
SELECT conv_id, turn, x.decoding, 'first ' || x.decoding || ' 96' AS answer
FROM questions, (VALUES ('greedy'), ('nucleus')) x(decoding)""",
)
def resumed_answers(spark: SparkSession, d: str) -> DataFrame:
    """L1 in kept parts: the questions of every third conversation are answered first, and
    the run over all of them leaves these alone."""
    q = fx.questions(spark, d)
    path = f"{scratch_folder(spark, 'answers')}/table"
    keys = ["conv_id", "turn"]
    hooks.generate_resumable(q.filter("conv_id % 3 = 0"), toy_model("first"), path, key_cols=keys, parts=2)
    return hooks.generate_resumable(q, toy_model("first"), path, key_cols=keys, parts=2)


def toy_answerer():
    def answer(questions: list[str], contexts: list[str]) -> list[dict]:
        return [
            {"answer": c.split(" ")[0], "result": "yes" if len(q) % 2 == 0 else None}
            for q, c in zip(questions, contexts, strict=True)
        ]

    return answer


@query(
    "context_answers",
    """SELECT u.conv_id, a.turn, string_split(a.text, ' ')[1] AS answer,
  CASE WHEN length(u.text) % 2 = 0 THEN 'yes' END AS result
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def context_answers(spark: SparkSession, d: str) -> DataFrame:
    """L2: an answerer over question and context, with a result that may be null."""
    rows = qa_turns(table(spark, d, "conversations")).withColumnRenamed("answer", "context")
    return hooks.answer_with_context(rows, toy_answerer, key_cols=["conv_id", "turn"], with_result=True)


@query(
    "mapped_batches",
    "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars, upper(role) AS role FROM conversations",
)
def mapped_batches(spark: SparkSession, d: str) -> DataFrame:
    """L3: a batched column function that replaces the text by its length."""
    return hooks.map_batches(
        table(spark, d, "conversations"),
        lambda pdf: pdf.assign(n_chars=pdf["text"].str.len(), role=pdf["role"].str.upper()),
        "conv_id long, turn long, n_chars long, role string",
        drop=["text"],
    ).select("conv_id", "turn", "n_chars", "role")
