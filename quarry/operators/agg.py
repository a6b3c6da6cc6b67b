"""Aggregations (D1-D10) and thread-record operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.html import paragraph_text
from quarry.functions.text import site_name


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, n)`` most frequent first; nulls dropped as pandas does."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
    )


def stage_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One pass, one row: ``count_if`` per named predicate plus the total."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(pred).cast("bigint").alias(name) for name, pred in stages.items()],
    )


def incomplete_runs(pieces: DataFrame, run_col: str = "run", expected: int = 1001) -> DataFrame:
    """Runs whose piece count differs from ``expected``.  Pieces are rows,
    so the count is a partial aggregate (no run is ever one big string)."""
    return (
        pieces.groupBy(run_col)
        .agg(F.count(F.lit(1)).alias("n_pieces"))
        .filter(F.col("n_pieces") != expected)
    )


def length_summary(df: DataFrame, words: Column, group_cols: list[str] | None = None) -> DataFrame:
    """Words per chunk summarised (min, max, avg, median)."""
    w = words.cast("bigint")
    g = df.groupBy(*(group_cols or []))
    return g.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(w).alias("min_words"),
        F.max(w).alias("max_words"),
        F.round(F.avg(w), 6).alias("avg_words"),
        F.percentile(w, 0.5).alias("median_words"),
    )


def epoch_loss(log: DataFrame, epoch_col: str = "epoch", loss_col: str = "loss") -> DataFrame:
    """Mean loss and perplexity ``exp(mean)`` per epoch."""
    return log.groupBy(epoch_col).agg(
        F.count(F.lit(1)).alias("steps"),
        F.avg(loss_col).alias("mean_loss"),
        F.exp(F.avg(loss_col)).alias("perplexity"),
    )


# ---- thread records: answers ARRAY<STRUCT<text, pm_score>> -----------------

def distinct_scores(answers: str = "answers") -> Column:
    """Keep a thread only if no two answers share a score."""
    scores = F.transform(F.col(answers), lambda a: a["pm_score"])
    return F.size(F.array_distinct(scores)) == F.size(scores)


def not_meta(metadata: str = "metadata") -> Column:
    """Reject meta-site threads (``"meta"`` in the first metadata item)."""
    return ~F.coalesce(F.get(F.col(metadata), 0).contains("meta"), F.lit(False))


def joined_answers(answers: str = "answers") -> Column:
    """Every answer's paragraph text followed by two newlines."""
    return F.array_join(
        F.transform(F.col(answers), lambda a: F.concat(paragraph_text(a["text"]), F.lit("\n\n"))),
        "",
    )


def best_answer(answers: str = "answers") -> Column:
    """Paragraph text of the highest-scored answer with score > 0 (first on
    ties), ``''`` when none scores above 0.  A true arg-max."""
    pos = F.filter(F.col(answers), lambda a: a["pm_score"] > 0)
    best = F.aggregate(
        pos,
        F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("string").alias("t")),
        lambda acc, a: F.when(
            acc["s"].isNull() | (a["pm_score"] > acc["s"]),
            F.struct(a["pm_score"].cast("int").alias("s"), a["text"].alias("t")),
        ).otherwise(acc),
    )
    return F.coalesce(paragraph_text(best["t"]), F.lit(""))


def prepare_threads(threads: DataFrame) -> DataFrame:
    """M1 body / B14: filter (B6, B7) first, then parse.  All array
    expressions, so the same function serves a batch or a stream."""
    return threads.filter(distinct_scores() & not_meta()).select(
        "date",
        "qid",
        paragraph_text("question").alias("question"),
        joined_answers().alias("answer_text"),
        best_answer().alias("selected_answer_text"),
        site_name(F.get(F.col("metadata"), 1)).alias("stack_exchange"),
    )


def piece_count(text: str | Column, sep: str) -> tuple[Column, Column]:
    """Number of pieces and the last piece of ``text.split(sep)``."""
    col = F.col(text) if isinstance(text, str) else text
    parts = F.split(col, _literal_regex(sep), -1)
    return F.size(parts).cast("bigint"), F.element_at(parts, -1)


def _literal_regex(s: str) -> str:
    import re

    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)


# Section titles dropped from Wikipedia pages (case-insensitive).
DROPPED_SECTIONS = ["references", "external links"]


def _kept_section(title_col: str) -> Column:
    return ~F.coalesce(F.lower(F.col(title_col)).isin(DROPPED_SECTIONS), F.lit(False))


def drop_sections(sections: DataFrame, title_col: str = "sec_title") -> DataFrame:
    """Drop reference / external-link sections."""
    return sections.filter(_kept_section(title_col))


def page_text(sections: DataFrame, key: str = "title", order_col: str = "sec_no",
              text_col: str = "text", title_col: str = "sec_title") -> DataFrame:
    """D3: a page's kept sections in order, each followed by a newline; a page
    of which no section is kept has the text ``''``."""
    kept = F.when(_kept_section(title_col), F.struct(order_col, F.col(text_col).alias("t")))
    parts = F.sort_array(F.collect_list(kept))
    return sections.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda x: F.concat(x["t"], F.lit("\n"))), "").alias("text"))
