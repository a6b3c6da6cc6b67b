"""Operator 3: quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text.  From
labelled rows come preference pairs (a good document before a bad one), and
the weights minimise the logistic loss on the feature differences of the
pairs.  The decision threshold is a quantile of the strengths of the labelled
rows: the share of them that is labelled bad.  Strengths become scores by the
logistic function, moved so that the threshold has the score ``CUT``.

Only the fit sees a sample: at most ``SAMPLE`` labelled rows, those of the
smallest id hash.  Every document is scored where it lies, without a shuffle.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import scan, text_of
from quarry.llm.registry import llm_query
from quarry.sources.tables import table

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
#: Pairs that the fit uses at most.
PAIRS = 200_000
CUT = 0.7
RIDGE = 1e-3
STEPS = 30

SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: str) -> list[float]:
    """Shares of kinds of bytes and words; every value is 0 for the empty text."""
    raw = text.encode()
    n = max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = by_byte[_UPPER].sum(), by_byte[_LOWER].sum()
    words = raw.split()
    m = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / m
    ends = sum(w[-1] in SYMBOLS for w in words) / m
    return [
        upper / max(1, upper + lower),
        by_byte[list(SYMBOLS)].sum() / n,
        by_byte[124] / n,
        by_byte[33] / n,
        (by_byte[46] + by_byte[44]) / n,
        by_byte[_DIGIT].sum() / n,
        by_byte[128:].sum() / n,
        again,
        1 - len(set(words)) / m,
        ends,
        math.log1p(len(words)),
        len(raw) / m / 16,
        by_byte[10] / m,
        float(not words),
    ]


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> dict:
    """Weights, centre and threshold from features ``x`` and labels ``y`` (0 or 1).

    Each row is paired with rows of the other label that a fixed shuffle
    picks.  Without both labels there is no preference to learn: weights are
    0 and every score is ``CUT``."""
    none = {"w": np.zeros(x.shape[1] if x.ndim == 2 else 0), "at": 0.0}
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return none
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    z = x / scale
    draw = np.random.default_rng(0)
    each = max(1, pairs // max(len(good), len(bad)))
    each = min(each, min(len(good), len(bad)))
    few, many = (bad, good) if len(bad) < len(good) else (good, bad)
    chosen = np.concatenate([few[draw.permutation(len(many)) % len(few)] for _ in range(each)])
    others = np.tile(many, each)
    diff = (z[others] - z[chosen]) * (1 if many is good else -1)
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):  # Newton steps on the mean logistic loss with a ridge
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        slope = ridge * w - diff.T @ p / len(diff)
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = np.sort(z @ w)
    cut = min(max(1, len(bad)), len(strength) - 1)
    return {"w": w / scale, "at": float(strength[cut - 1] + strength[cut]) / 2}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    if not np.any(model["w"]):
        return np.full(len(x), CUT)
    moved = np.clip(x @ model["w"] - model["at"] + math.log(CUT / (1 - CUT)), -500, 500)
    return 1 / (1 + np.exp(-moved))


def held_out(id_: Column) -> Column:
    """Rows kept from the fit: CRC-32 of the id as text, remainder 2 by 4 (null id: not)."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _feature_rows(texts: pd.Series) -> list[list[float]]:
    return [features(t) for t in texts]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: pd.Series) -> pd.Series:
    return pd.Series(_feature_rows(texts))


def score_column(model: dict):
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        x = np.array(_feature_rows(texts)).reshape(len(texts), -1)
        return pd.Series(scores(x, model) if len(texts) else [], dtype="float64")

    return score


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> dict:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    )
    # At most ``sample`` rows on either side of the broadcast and at the driver.
    picked = marked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text"))
    rows = (
        texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
        .select("_id", "_y", feature_column("_text").alias("x"))
        .orderBy(F.xxhash64("_id"), "_id", "_y", "x")
        .limit(sample)
        .collect()
    )
    return fit_pairs(np.array([r["x"] for r in rows], float), np.array([r["_y"] for r in rows], int))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``.

    Null counts as the empty text, which is scored by the same weights.  A
    null id is never held out and has no label.  Labels other than 0 and 1
    are not used; without labels of both kinds every score is 0.7 and every
    row is predicted 1.  Repeated rows get the same score; an empty table
    gives an empty result; other columns of ``docs`` are not read."""
    score = score_column(learn(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias(id_col), score(text_of(text_col)).alias("score"))
    return rows.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good; all columns stay."""
    score = score_column(learn(docs, labels, id_col, text_col))
    return docs.filter(score(text_of(text_col)) >= CUT)


@llm_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    return classify(scan(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
