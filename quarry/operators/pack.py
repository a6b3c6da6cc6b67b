"""Token ids and fixed-length training blocks.

``tokenize`` (J4): words -> ids through a vocabulary table ranked by corpus
frequency (id 1 = most frequent, ties by the word's bytes, 0 reserved for
padding), or through a user's tokenizer.  The ranking uses the distributed
ordinal, never a global window; texts are encoded by ``dictionary.encode``,
without a row per token.

``pack`` (J5/J6): rows are laid out in order over the partitions once and stay
there.  Each partition cuts its own batches into blocks while it reads; only
the ends of a block that lies across two partitions (one or two pieces a
partition, each shorter than a block) are sent on and put together.  A
partition learns from one row per partition and batch at its edges how many
tokens of its first batch lie before it.  The remainder of each batch that
does not fill a block is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.dictionary import encode, pieces, word_counts
from quarry.operators.hooks import cached_model, model_digest
from quarry.operators.ordinal import with_ordinal

PAD_ID = 0
IGNORE_INDEX = -100


def build_vocab(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, id)`` ranked by frequency desc, then word."""
    freq = word_counts(texts, text_col)
    ranked = with_ordinal(freq, [F.desc("freq"), F.asc("word")], name="rank")
    return ranked.select("word", (F.col("rank") + 1).alias("id"))


def tokenize(
    docs: DataFrame,
    vocab: DataFrame | None = None,
    *,
    key_cols: list[str],
    text: Column,
    out: str = "ids",
    tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None,
    mask: str | None = None,
) -> DataFrame:
    """``(keys, ids array<bigint>)``; every input row is kept (no tokens -> []).

    ``key_cols`` name a row.  ``tokenizer`` is a factory of a user's batch
    function, used instead of the vocabulary.  ``mask`` names an attention
    mask column (1 for each token)."""
    if tokenizer is not None:
        ided = _user_ids(docs.select(*key_cols, text.alias("_text")), key_cols, tokenizer, out)
    else:
        ided = encode(docs.select(*key_cols, text.alias("_text")), F.col("_text"), vocab, out).select(*key_cols, out)
    return ided.withColumn(mask, F.transform(out, lambda x: F.lit(1))) if mask else ided


def _user_ids(docs: DataFrame, key_cols: list[str], factory, out: str) -> DataFrame:
    model = model_digest(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = cached_model(model, factory)
        for pdf in batches:
            ids = encode(pdf["_text"].fillna("").tolist())
            yield pdf[key_cols].assign(**{out: ids})

    keys = docs.select(*key_cols).schema.simpleString()[len("struct<"):-1]
    return docs.mapInPandas(run, f"{keys},{out}:array<bigint>")


def pack(
    rows: DataFrame,
    *,
    order_col: str,
    ids_col: str = "ids",
    block: int = 1024,
    batch_rows: int = 1000,
    num_shards: int = 1,
    more_cols: tuple[str, ...] = (),
    keys: DataFrame | None = None,
) -> DataFrame:
    """``(shard, batch, block, input_ids, labels, ...)``: concatenation of each
    batch's token lists cut into ``block``-sized pieces; labels copy the ids.

    Rows are cut into ``num_shards`` contiguous shards (as parallel workers of
    the reference are), batches are counted within a shard.  ``more_cols`` are
    arrays of the ids' length that are cut alike.  Null keys come first; rows
    of one key go by length, then by a hash of their ids; null lists are empty.
    ``keys``, the values of ``order_col`` in a frame that is cheaper to compute than
    ``rows``, saves computing ``rows`` twice."""
    arrays = [ids_col, *more_cols]
    given = [F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c) for c in arrays]
    lists = rows.select(F.col(order_col).alias("_order"), *given)
    numbered = with_ordinal(lists, [F.col("_order"), F.size(ids_col), F.xxhash64(ids_col)], name="pos", keys=keys).drop("_order")
    total_rows = numbered.count() if num_shards > 1 else 0
    # Contiguous shards: the first ``total % num_shards`` hold one row more.
    small, extra = divmod(total_rows, num_shards)
    cut = extra * (small + 1)
    shard = F.lit(0).cast("bigint") if num_shards == 1 else F.when(
        F.col("pos") < cut, F.expr(f"pos div {small + 1}")).otherwise(
        F.lit(extra) + F.expr(f"(pos - {cut}) div {max(small, 1)}"))
    first = F.lit(0) if num_shards == 1 else F.when(
        F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(
        F.lit(cut) + (F.col("shard") - extra) * small)
    laid = numbered.withColumn("shard", shard.cast("bigint")).withColumn(
        "batch", F.floor((F.col("pos") - first) / batch_rows).cast("bigint")).withColumn("_pid", F.spark_partition_id())
    # Tokens of the first and the last batch of every partition: one or two rows each.
    sizes = laid.groupBy("_pid", "shard", "batch").agg(F.sum(F.size(ids_col)).cast("bigint").alias("n"))
    edges = sizes.groupBy("_pid").agg(
        F.min(F.struct("shard", "batch", "n")).alias("low"), F.max(F.struct("shard", "batch", "n")).alias("high"))
    edges = edges.select("_pid", F.explode(F.array_distinct(F.array("low", "high"))).alias("e")).select("_pid", "e.*")
    before = Window.partitionBy("shard", "batch").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("_pid", "shard", "batch", F.sum("n").over(before).alias("_carry")).filter("_carry > 0")
    starts = laid.select("shard", "batch", "_pid", *arrays).join(F.broadcast(carried), ["_pid", "shard", "batch"], "left")
    held = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in arrays]
    shape = f"shard bigint, batch bigint, block bigint, start bigint, {', '.join(held)}"
    cuts = starts.select("shard", "batch", F.coalesce("_carry", F.lit(0)).cast("bigint").alias("_carry"), *arrays)
    cuts = cuts.mapInArrow(_cut(block, arrays), shape)

    def joined(col: str) -> Column:
        parts = F.sort_array(F.collect_list(F.struct("start", F.col(col).alias("frag"))))
        return F.flatten(F.transform(parts, lambda x: x["frag"])).alias(col)

    # Whole blocks have no start; the others are pieces of blocks across partitions.
    keys = ["shard", "batch", "block"]
    whole = cuts.filter("start IS NULL").select(*keys, *arrays)
    mended = cuts.filter("start IS NOT NULL").groupBy(*keys).agg(*[joined(c) for c in arrays])
    blocks = whole.unionByName(mended.filter(F.size(ids_col) == block))
    return blocks.select(
        *keys, F.col(ids_col).alias("input_ids"), *[F.col(c) for c in more_cols], F.col(ids_col).alias("labels"))


def _cut(block: int, names: list[str]):
    """Rows ``(shard, batch, carry, lists...)`` of a partition, in order, to blocks and edge pieces."""

    def lists(flat: pa.Array, rows: int) -> pa.Array:
        offsets = np.arange(rows + 1, dtype=np.int32) * (len(flat) // max(rows, 1))
        return pa.ListArray.from_arrays(pa.array(offsets), flat)

    def made(shard: int, batch: int, numbers, start, flats: list[pa.Array]) -> pa.RecordBatch:
        rows = len(numbers)
        ends = [pa.array([x] * rows, pa.int64()) for x in (shard, batch)]
        columns = [*ends, pa.array(numbers, pa.int64()), pa.array([start] * rows, pa.int64()), *(lists(f, rows) for f in flats)]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "batch", "block", "start", *names])

    def run(batches):
        key, at, rest = None, 0, None
        for batch in batches:
            for part in pieces(batch):
                keys = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
                cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
                edges = [0, *cuts.tolist(), part.num_rows]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    some = part.slice(a, z - a)
                    flats = [c.flatten() for c in some.columns[3:]]
                    if (int(keys[0, a]), int(keys[1, a])) != key:
                        # What is left of the batch before does not fill a block.
                        key = (int(keys[0, a]), int(keys[1, a]))
                        at, rest = some.column(2)[0].as_py(), None
                    if rest is not None:
                        flats = [pa.concat_arrays([r, f]) for r, f in zip(rest, flats, strict=True)]
                        at -= len(rest[0])
                    if at % block:
                        # The open block of an earlier partition goes on here.
                        n = min(block - at % block, len(flats[0]))
                        if n:
                            yield made(*key, [at // block], at, [f.slice(0, n) for f in flats])
                        flats, at = [f.slice(n) for f in flats], at + n
                        if at % block:
                            rest = None
                            continue
                    full = len(flats[0]) // block
                    if full:
                        taken = [f.slice(0, full * block) for f in flats]
                        yield made(*key, list(range(at // block, at // block + full)), None, taken)
                    rest = [f.slice(full * block) for f in flats]
                    at += full * block + len(rest[0])
        if rest is not None and len(rest[0]):
            begin = at - len(rest[0])
            yield made(*key, [begin // block], begin, rest)

    return run


def pad_right(ids: Column, length: int, pad: int = PAD_ID) -> Column:
    """Truncate / right-pad to ``length``."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("bigint"), F.lit(length) - F.size(cut)))


def prefix_features(prompt_ids: Column, target_ids: Column, max_length: int = 1024) -> list[Column]:
    """Input ids and target labels each cut/padded to ``max_length``
    (right padding); padding in the labels becomes ``-100``."""
    inp = pad_right(prompt_ids, max_length)
    mask = F.transform(inp, lambda x: F.when(x == PAD_ID, 0).otherwise(1))
    lab = F.transform(pad_right(target_ids, max_length),
                      lambda x: F.when(x == PAD_ID, F.lit(IGNORE_INDEX).cast("bigint")).otherwise(x))
    return [inp.alias("input_ids"), mask.alias("attention_mask"), lab.alias("labels")]


def pad_left(ids: Column, length: Column | int, pad: int = PAD_ID, max_length: int | None = None) -> list[Column]:
    """Left-pad to ``length``, cut to ``max_length`` at most, with an attention mask."""
    length = F.lit(length) if isinstance(length, int) else length
    length = F.least(length, F.lit(max_length)) if max_length is not None else length
    k = F.greatest(length - F.size(ids), F.lit(0))
    cut = F.slice(ids, 1, length)
    padded = F.concat(F.array_repeat(F.lit(pad).cast("bigint"), k), cut)
    mask = F.concat(F.array_repeat(F.lit(0), k), F.array_repeat(F.lit(1), F.size(cut)))
    return [padded.alias("input_ids"), mask.alias("attention_mask")]
