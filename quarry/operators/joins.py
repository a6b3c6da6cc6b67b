"""Joins (C1-C5, C7, C8) with size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.dictionary import encode
from quarry.session import materialize

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it is proven to have at most ``max_rows`` rows of
    at most ``BROADCAST_BYTES`` bytes together (lengths of its strings plus 16
    bytes a column); otherwise return it unchanged, so the planner shuffles
    both sides (with AQE skew splitting).  The proof is a job: pass small,
    cheap frames."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")),
               F.lit(16 * max(1, len(df.columns))))
    n, held = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (held or 0) <= BROADCAST_BYTES else df


def skip_done(todo: DataFrame, done: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose key is not in the ledger (``left_anti``)."""
    ledger = done.select(*keys).distinct()
    return todo.join(bounded_broadcast(ledger, max_rows), keys, "left_anti")


def covered(
    items: DataFrame,
    item_key: str,
    titles_col: str,
    corpus_titles: DataFrame,
    title_col: str = "title",
) -> tuple[DataFrame, DataFrame]:
    """C2/C3 relational division: an item is covered when *every* title in its
    list is in the corpus (an empty list counts as covered).

    Returns ``(covered_items, missing_pairs)``; ``missing_pairs`` holds one row
    per (item, title occurrence) that is absent, so duplicates count."""
    pairs = items.select(item_key, F.explode(F.col(titles_col)).alias(title_col))
    corpus = corpus_titles.select(title_col).distinct()
    missing = pairs.join(corpus, title_col, "left_anti")
    bad = missing.select(item_key).distinct()
    return items.join(bad, item_key, "left_anti"), missing


def first_by_key(df: DataFrame, key: str | list[str], order_col: str) -> DataFrame:
    """Keep the first row per key by ``order_col``.

    ``min(struct(order, ...))`` aggregates partially on the map side, so a
    key held by a third of the rows still costs one row per task before the
    shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys and c != order_col]
    return df.groupBy(*keys).agg(F.min(F.struct(order_col, *rest)).alias("_r")).select(
        *keys, "_r.*"
    )


def dictionary_filter(
    docs: DataFrame,
    doc_key: str,
    tokens: Column,
    vocab: DataFrame,
    word_col: str = "word",
) -> DataFrame:
    """Keep tokens whose lower case is in ``vocab``, in order, joined by a
    space; a document whose tokens all fail gives ``''``.

    Texts are encoded against the vocabulary where they lie
    (``dictionary.encode``); no row per token is made."""
    words = vocab.select(F.col(word_col).alias("word")).distinct().select("word", F.lit(1).cast("bigint").alias("id"))
    words = materialize(words.filter("word IS NOT NULL"))
    held = docs.select(doc_key, F.coalesce(tokens, F.array().cast("array<string>")).alias("_held"))
    marked = encode(held, F.transform("_held", F.lower), words, "_mark")
    kept = F.filter("_held", lambda w, i: F.get(F.col("_mark"), i).isNotNull())
    return marked.select(doc_key, F.array_join(kept, " ").alias("text"))


def lookup_first(keys: DataFrame, table: DataFrame, key: str, order_col: str) -> DataFrame:
    """C4: for each key, the first matching row of ``table`` (deduped first)."""
    return keys.join(first_by_key(table, key, order_col), key, "inner")
