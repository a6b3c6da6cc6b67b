"""User hooks (L1-L3): batch generation and answering run user code inside
``mapInPandas``, Arrow-batched, with the model built once per Python worker.

No model ships with the engine; a hook is any picklable factory returning a
callable over a list of strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import remove_echo
from quarry.operators.joins import skip_done
from quarry.session import path_exists

Generator = Callable[..., list[str]]  # (prompts, decoding, **parameters) -> outputs

# The reference's generation parameters, handed to the hook by decoding.
DECODING = {
    "greedy": {"max_new_tokens": 96, "do_sample": False},
    "nucleus": {"max_new_tokens": 96, "do_sample": True, "top_p": 0.95},
}
_WORKER_CACHE: dict[str, object] = {}


def model_digest(factory: Callable[[], object]) -> str:
    """Names a model by the pickled factory (code and captured parameters),
    taken once on the driver: equal factories share a worker's model, others
    never do."""
    return hashlib.sha256(CloudPickleSerializer().dumps(factory)).hexdigest()


def cached_model(key: str, factory: Callable[[], object]) -> object:
    """Build the user's model once per Python worker; a worker keeps the last one."""
    if key not in _WORKER_CACHE:
        _WORKER_CACHE.clear()
        _WORKER_CACHE[key] = factory()
    return _WORKER_CACHE[key]


def generate_answers(
    questions: DataFrame,
    factory: Callable[[], Generator],
    *,
    key_cols: list[str],
    text_col: str = "question",
    decodings: tuple[str, ...] = ("greedy", "nucleus"),
    batch_size: int = 400,
    parameters: dict[str, dict] | None = None,
    model_key: str | None = None,
) -> DataFrame:
    """L1 + H10: one output per question and decoding, keyed by the question
    (never by position), the echoed prompt removed and the text stripped.
    ``batch_size`` rows go to the generator at once, with the parameters of
    their decoding (``DECODING`` unless given).  ``model_key`` names the model
    within a worker; by default the pickled factory does."""
    keys = list(key_cols)
    model = model_key or model_digest(factory)
    given = DECODING if parameters is None else parameters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = cached_model(model, factory)
        for whole in batches:
            for lo in range(0, len(whole), batch_size):
                pdf = whole.iloc[lo : lo + batch_size]
                prompts = pdf[text_col].fillna("").str.replace("\n", "", regex=False).tolist()
                for dec in decodings:
                    outs = gen(prompts, dec, **given.get(dec, {}))
                    if len(outs) != len(prompts):
                        raise ValueError("generator returned a different number of outputs")
                    out = pdf[keys].copy()
                    out["decoding"] = dec
                    out["prompt"] = prompts
                    out["output"] = outs
                    yield out

    schema = questions.select(*keys).schema.simpleString()[len("struct<"):-1]
    src = questions.select(*keys, F.col(text_col))
    raw = src.mapInPandas(run, f"{schema},decoding:string,prompt:string,output:string")
    return raw.select(*keys, "decoding", remove_echo("output", "prompt").alias("answer"))


def generate_resumable(
    questions: DataFrame,
    factory: Callable[[], Generator],
    path: str,
    *,
    key_cols: list[str],
    parts: int = 16,
    **given,
) -> DataFrame:
    """L1, in parts that are kept: the answers of ``generate_answers``, appended to the table
    at ``path`` part by part (by a hash of the keys).

    A run that ends midway leaves its finished parts; run again, it generates
    for questions that have no answer there yet.  So the model is called once
    for a question, but for those of the part that was not finished.
    Questions added later are answered alone.  ``given`` goes to
    ``generate_answers``; a decoding added later needs a table of its own."""
    spark = questions.sparkSession
    part = F.pmod(F.xxhash64(*key_cols), F.lit(parts)).cast("int")
    known = questions.select(*key_cols).schema
    for k in range(parts):
        mine, target = questions.filter(part == k), f"{path}/part={k}"
        if path_exists(spark, target):
            done = spark.read.schema(known).parquet(target).distinct()
            mine = skip_done(mine, done, key_cols)
        if not mine.isEmpty():
            # A commit is whole: files of a failed run are never seen.
            generate_answers(mine, factory, key_cols=key_cols, **given).write.mode("append").parquet(target)
    shape = generate_answers(questions, factory, key_cols=key_cols, **given).schema
    if not path_exists(spark, path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("basePath", path).parquet(path).select(*shape.names)


def answer_with_context(
    rows: DataFrame,
    factory: Callable[[], Callable[[list[str], list[str]], list[dict]]],
    *,
    key_cols: list[str],
    with_result: bool = False,
    model_key: str | None = None,
) -> DataFrame:
    """L2: a user answerer over ``(question, context)``; returns ``answer``
    and, for yes/no/maybe datasets, a nullable ``result``."""
    keys = list(key_cols)
    model = model_key or model_digest(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = cached_model(model, factory)
        for pdf in batches:
            replies = fn(pdf["question"].tolist(), pdf["context"].tolist())
            out = pdf[keys].copy()
            out["answer"] = [r.get("answer") for r in replies]
            if with_result:
                out["result"] = [r.get("result") for r in replies]
            yield out

    schema = rows.select(*keys).schema.simpleString()[len("struct<"):-1] + ",answer:string"
    if with_result:
        schema += ",result:string"
    return rows.select(*keys, "question", "context").mapInPandas(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                drop: list[str] | None = None) -> DataFrame:
    """L3: a batched column function (``Dataset.map(batched=True,
    remove_columns=...)``): input columns listed in ``drop`` do not reach the
    output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf)
            yield out.drop(columns=[c for c in (drop or []) if c in out.columns])

    return df.mapInPandas(run, schema)
